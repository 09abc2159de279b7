"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps, for a run of characters, an agenda of adjacent symbol pairs ordered by piece score (ties: leftmost
first), takes the best pair, merges it, and puts the two pairs that the merge makes on the agenda. ``MergeModel.merge``
does so for one run with a heap; ``merge_many`` holds the agendas of many runs as rows of a matrix and takes the best
pair of every row at once.

The text is first cut where no merge can happen: in front of a run of the space mark, and between any two characters
that stand side by side in no piece. The cuts are sound because merges only ever build pieces of the vocabulary; the
model is examined for this when it is loaded. What a word gives, and what the runs between cuts give, is remembered in
bounded tables; a full one keeps what was met most often. In each Arrow batch, the runs met for the first time are also
encoded by the sentencepiece library, and so is one whole text of each group; a difference raises. ``check="texts"``
compares every whole text instead. Decoding is the library's ``decode(ids)``.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections import defaultdict
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import chain, count, islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from paperloom.llm.common import append_columns

SPACE = "▁"
#: So many words, and so many runs, are remembered at most; then a table keeps half of them, those met most often.
#: One group's new ones may come on top.
REMEMBER_RUNS = 120_000
#: Runs up to this length (63 at most) share matrices of so many rows; longer ones are merged with a heap.
MATRIX_CHARS, MATRIX_ROWS = 48, 4_096
NO_PAIR = np.iinfo(np.int32).max
#: Texts are processed in groups of about so many characters.
GROUP_CHARS = 200_000


def proto_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) pairs of one protocol-buffer message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < end:
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(wire) or varint()
        yield key >> 3, data[at : at + size]
        at += size


class PairTable:
    """A hash table of pairs of symbols, in which many are looked up at once."""

    def __init__(self, pairs: np.ndarray):
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.index = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int32)
        left = np.arange(len(pairs), dtype=np.int32)
        at = self._slot(pairs)
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = pairs[left[free]]
            mine = self.keys[at] == pairs[left]
            self.index[at[mine]] = left[mine]
            left, at = left[~mine], at[~mine] + 1 & self.mask

    @staticmethod
    def key(a, b):
        return a << 21 | b

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Each pair's place among those that the table was made of, or -1."""
        keys = self.key(a.astype(np.int64), b)
        at = self._slot(keys)
        met = self.keys[at]
        other = np.flatnonzero((met != keys) & (met >= 0))
        while len(other):
            at[other] = at[other] + 1 & self.mask
            now = met[other] = self.keys[at[other]]
            other = other[(now != keys[other]) & (now >= 0)]
        found = self.index[at]
        found[met != keys] = -1
        return found


class MergeModel:
    """The pieces, scores and text rules of a merge-type model file."""

    NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.rank: dict[str, tuple[float, int]] = {}
        self.bytes_id: dict[int, int] = {}
        self.unk = 0
        trainer, rules, n = {}, {}, 0
        for field, value in proto_fields(data):
            if field == 1:
                piece = dict(proto_fields(value))
                text, kind = piece[1].decode(), piece.get(3, self.NORMAL)
                if kind == self.NORMAL:
                    self.rank[text] = (-struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], n)
                elif kind == self.BYTE:
                    self.bytes_id[int(text[3:5], 16)] = n
                elif kind == self.UNKNOWN:
                    self.unk = n
                elif kind in (self.USER_DEFINED, self.UNUSED):
                    raise ValueError(f"pieces of kind {kind} are not supported")
                n += 1
            elif field == 2:
                trainer = dict(proto_fields(value))
            elif field == 3:
                rules = dict(proto_fields(value))
        if trainer.get(3) != 2:
            raise ValueError("not a merge-type model")
        if rules.get(2) or rules.get(4, 1) or not rules.get(3, 1) or not rules.get(5, 1):
            raise ValueError("only identity normalization with a dummy prefix and kept white space is supported")
        if len(self.bytes_id) != 256:
            raise ValueError("only models with byte fallback are supported")
        self.size = n
        scores = sorted({x for x, _ in self.rank.values()})
        step = {x: k for k, x in enumerate(scores)}
        if len(scores) >= 1 << 25:
            raise ValueError("too many scores")
        pairs = sorted(
            (PairTable.key(self.rank[p[:k]][1], self.rank[p[k:]][1]), step[x], i)
            for p, (x, i) in self.rank.items()
            for k in range(1, len(p))
            if p[:k] in self.rank and p[k:] in self.rank
        )
        #: For two adjacent pieces: the place of their union's score among all scores, and its id.
        self.pairs = PairTable(np.array([x[0] for x in pairs], dtype=np.int64))
        self.pair_place = np.array([x[1] for x in pairs] + [NO_PAIR], dtype=np.int32)
        self.pair_id = np.array([x[2] for x in pairs] + [-1], dtype=np.int32)
        #: By code point: the id of the character's piece, or n + code point where it has none.
        self.symbol = np.arange(0x110000, dtype=np.int32) + n
        for p, (_, i) in self.rank.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[ord(" ")] = self.symbol[ord(SPACE)]  # runs are kept with blanks, which take less room
        beside = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}
        if any(x[0] != SPACE and x[1] == SPACE for x in beside):
            raise ValueError("a piece crosses a word boundary")
        #: The characters that stand side by side in a piece; between others no merge can happen.
        self.beside = PairTable(np.array([PairTable.key(*self.symbol[[ord(x[0]), ord(x[1])]].tolist()) for x in beside], dtype=np.int64))
        self.newline_alone = not any("\n" in x for x in beside)
        self.cut = re.compile(" +[^ \n]*|\n[^ \n]*" if self.newline_alone else " +[^ ]*").findall

    def runs(self, text: str) -> list[str]:
        """The text with a blank for each space mark, cut into words where no merge crosses."""
        return self.cut(" " + text.replace(SPACE, " ")) if text else []

    def cut_many(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The runs of many words, none empty, one after the other, and at which run each word starts."""
        whole = "".join(words)
        symbols = self.symbol[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        cuts = np.ones(len(symbols) + 1, dtype=bool)
        cuts[1:-1] = self.beside.find(symbols[:-1], symbols[1:]) < 0
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        cuts[ends] = True
        at = np.flatnonzero(cuts)
        starts = np.searchsorted(at, np.concatenate([[0], ends[:-1]]))
        at = at.tolist()
        return [whole[a:b] for a, b in zip(at, at[1:])], starts

    def merge(self, run: str) -> list[int]:
        """Piece ids of one run, by an agenda of adjacent pairs."""
        rank, symbols = self.rank, list(run.replace(" ", SPACE))
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            if found := rank.get(symbols[i] + symbols[i + 1]):
                agenda.append((found[0], i, i + 1, len(symbols[i]) + len(symbols[i + 1])))
        heapq.heapify(agenda)
        while agenda:
            _, a, b, size = heapq.heappop(agenda)
            if not symbols[a] or not symbols[b] or right[a] != b or len(symbols[a]) + len(symbols[b]) != size:
                continue
            symbols[a] += symbols[b]
            symbols[b] = ""
            after = right[a] = right[b]
            if after < n:
                left[after] = a
                if found := rank.get(symbols[a] + symbols[after]):
                    heapq.heappush(agenda, (found[0], a, after, len(symbols[a]) + len(symbols[after])))
            before = left[a]
            if before >= 0 and (found := rank.get(symbols[before] + symbols[a])):
                heapq.heappush(agenda, (found[0], before, a, len(symbols[before]) + len(symbols[a])))
        ids: list[int] = []
        for s in filter(None, symbols):
            found = rank.get(s)
            ids.extend([found[1]] if found else [self.bytes_id[b] for b in s.encode()])
        return ids

    def _merge_rows(self, symbols: np.ndarray) -> None:
        """Merge every row in place; -1 marks no symbol (padding at the end, later what a merge has emptied)."""
        rows, n = symbols.shape
        # All arrays are flat and transposed, n + 1 places by rows; the last places take what points past the end.
        wide = np.full((n + 1) * rows, -1, dtype=np.int32)
        wide[:-rows] = symbols.T.ravel()
        places = np.arange((n + 1) * rows)
        right, left = places + rows, places - rows
        # An entry of the agenda is the place of a score and, below it, the column: the least of a row comes first.
        agenda = np.full((n + 1) * rows, NO_PAIR, dtype=np.int32)
        union = np.full((n + 1) * rows, -1, dtype=np.int32)

        def note(at: np.ndarray, after: np.ndarray) -> None:
            found = self.pairs.find(wide[at], wide[after])
            held = found >= 0
            agenda[at] = np.where(held, self.pair_place[found] << 6 | at // rows, NO_PAIR)
            union[at] = self.pair_id[found]

        first = np.flatnonzero(wide[rows:] >= 0)
        note(first, first + rows)
        table = agenda.reshape(n + 1, rows)
        while True:
            best = table.min(axis=0)
            live = np.flatnonzero(best < NO_PAIR)
            if not len(live):
                break
            a = (best[live] & 63) * rows + live
            b = right[a]
            c = right[b]
            wide[a] = union[a]
            wide[b] = -1
            agenda[a] = agenda[b] = NO_PAIR
            right[a] = c
            left[c] = a
            z = left[a]
            after, before = wide[c] >= 0, z >= 0
            note(np.concatenate([a[after], z[before]]), np.concatenate([c[after], a[before]]))
        symbols[:] = wide[:-rows].reshape(n, rows).T

    def merge_many(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of many runs, one after the other, and how many each has."""
        counts = np.zeros(len(runs), dtype=np.int64)
        lengths = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))
        order = np.argsort(lengths, kind="stable")
        flat_parts, flat_rows = [], []
        small = order[lengths[order] <= MATRIX_CHARS]
        for at in range(0, len(small), MATRIX_ROWS):
            rows = small[at : at + MATRIX_ROWS]
            size = lengths[rows]
            points = np.frombuffer("".join([runs[r] for r in rows]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            symbols = np.full((len(rows), max(int(size[-1]), 1)), -1, dtype=np.int32)
            inside = np.arange(symbols.shape[1])[None, :] < size[:, None]
            symbols[inside] = self.symbol[points]
            self._merge_rows(symbols)
            left_over = symbols >= 0
            flat_parts.append(symbols[left_over])
            flat_rows.append(np.repeat(rows, left_over.sum(axis=1)))
        for r in order[len(small) :]:
            ids = self.merge(runs[r])
            flat_parts.append(np.array(ids, dtype=np.int32))
            flat_rows.append(np.full(len(ids), r))
        if not flat_parts:
            return np.zeros(0, dtype=np.int32), counts
        ids, owner = np.concatenate(flat_parts), np.concatenate(flat_rows)
        if (strange := ids >= self.size).any():  # characters without a piece become bytes
            spelled = [[self.bytes_id[b] for b in chr(x - self.size).encode()] for x in ids[strange]]
            times = np.ones(len(ids), dtype=np.int64)
            times[strange] = [len(x) for x in spelled]
            starts = np.cumsum(times) - times
            ids, owner = np.repeat(ids, times), np.repeat(owner, times)
            for at, x in zip(starts[strange], spelled):
                ids[at : at + len(x)] = x
        ids = ids[np.argsort(owner, kind="stable")]
        return ids, np.bincount(owner, minlength=len(runs))


class Remembered:
    """Piece ids of the keys met so far; ``learn`` gives those of new ones, one after the other, and how many each has."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.learn = learn
        self.forget_all()

    def forget_all(self) -> None:
        #: Numbers of the keys; one that is looked up and new gets the next.
        self.place: defaultdict[str, int] = defaultdict(count().__next__)
        self.start, self.count, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        #: In how many lookups a key was met, halved whenever the table was full.
        self.met = np.zeros(0, np.int32)

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.count[at]
        before = np.cumsum(counts) - counts
        return self.pool[np.repeat(self.start[at] - before, counts) + np.arange(int(counts.sum()))], counts

    def forget(self) -> None:
        """Keep what was met most often, and more than once, up to half a table."""
        often = np.argsort(-self.met, kind="stable")[: REMEMBER_RUNS // 2]
        often = np.sort(often[self.met[often] > 1])
        keys = list(self.place)
        self.place = defaultdict(count(len(often)).__next__, zip([keys[k] for k in often.tolist()], range(len(often))))
        self.pool, self.count = self._gather(often)
        self.start, self.met = np.cumsum(self.count) - self.count, self.met[often] // 2

    def ids(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known = len(self.place)
        try:
            at = np.fromiter(map(self.place.__getitem__, keys), dtype=np.int64, count=len(keys))
            if len(self.place) > known:
                fresh = list(islice(reversed(self.place), len(self.place) - known))[::-1]
                ids, counts = self.learn(fresh)
                self.start = np.concatenate([self.start, np.cumsum(counts) - counts + len(self.pool)])
                self.count = np.concatenate([self.count, counts])
                self.pool = np.concatenate([self.pool, ids])
                self.met = np.concatenate([self.met, np.zeros(len(fresh), np.int32)])
        except BaseException:
            self.forget_all()  # no key may stay without its ids
            raise
        self.met[at] += 1
        found = self._gather(at)
        if len(self.place) > REMEMBER_RUNS:
            self.forget()
        return found


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, path: str, check: str):
        import sentencepiece

        if check not in ("runs", "texts", "none"):
            raise ValueError("check is one of runs, texts, none")
        self.model, self.check = MergeModel(path), check
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        #: Words lack the blank in front, unless a line feed or another blank follows.
        self.words, self.runs = Remembered(self._learn_words), Remembered(self._learn_runs)

    def _learn_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        runs, starts = self.model.cut_many([w if w[:1] in ("\n", " ") else " " + w for w in words])
        ids, counts = self.runs.ids(runs)
        return ids, np.add.reduceat(counts, starts)

    def _learn_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = self.model.merge_many(runs)
        if self.check == "runs":
            # The library puts a space mark in front; what has none is shown to it behind a line feed.
            marked = np.fromiter((r[0] == " " for r in runs), dtype=bool, count=len(runs))
            look = np.fromiter((r != " " for r in runs), dtype=bool, count=len(runs))
            if not self.model.newline_alone:
                look &= marked
            said = self.library.encode([r[1:] if r[0] == " " else "\n" + r for r, shown in zip(runs, look.tolist()) if shown], num_threads=1)
            theirs = np.fromiter(chain.from_iterable(said), dtype=np.int32)
            sizes = np.fromiter(map(len, said), dtype=np.int64, count=len(said))
            skip = np.where(marked[look], 0, 2)
            inside = np.arange(len(theirs)) >= np.repeat(np.cumsum(sizes) - sizes + skip, sizes)
            if not np.array_equal(sizes - skip, counts[look]) or not np.array_equal(theirs[inside], ids[np.repeat(look, counts)]):
                starts = np.cumsum(counts) - counts
                wrong = next(i for i, x, k in zip(np.flatnonzero(look), said, skip) if x[k:] != ids[starts[i] : starts[i] + counts[i]].tolist())
                raise ValueError(f"the agenda and the library differ on {runs[wrong]!r}")
        return ids, counts

    def _key(self, word: str) -> str:
        return word[1:] if word[0] == " " and word[1:2] not in ("", "\n", " ") else word

    def encode(self, texts: list[str]) -> list[list[int]]:
        words, sizes = [], []
        for t in texts:
            spread = t.replace("\n", " \n")
            plain = t and t[0] != " " and t[-1] != " " and "  " not in spread and SPACE not in t and self.model.newline_alone
            found = spread.split(" ") if plain else list(map(self._key, self.model.runs(t)))
            words += found
            sizes.append(len(found))
        if words:
            ids, counts = self.words.ids(words)
            ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *sizes])].tolist()
            ids = ids.tolist()
            out = [ids[a:b] for a, b in zip(ends, ends[1:])]
        else:
            out = [[] for _ in texts]
        whole = self._compared(texts)
        for i, said in zip(whole, self.library.encode([texts[i] for i in whole], num_threads=1) if whole else ()):
            if out[i] != said:
                raise ValueError(f"the agenda and the library differ on {texts[i][:80]!r}")
        return out

    def _compared(self, texts: list[str]) -> list[int]:
        """The texts that are compared whole: all, or the shortest, which shows that the runs were cut rightly."""
        if self.check == "texts":
            return list(range(len(texts)))
        filled = [i for i, t in enumerate(texts) if t]
        return [min(filled, key=lambda i: len(texts[i]))] if self.check == "runs" and filled else []

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1) if ids else []


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, check: str = "runs") -> Codec:
    """The worker's codec for a model file; it outlives a task."""
    if (path, check) not in _CODECS:
        _CODECS[path, check] = Codec(path, check)
    return _CODECS[path, check]


def _groups(texts: list[str | None]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        group.append(t or "")
        size += len(t or "")
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


OUTPUTS = {
    "ids": T.ArrayType(T.IntegerType()),
    "decoded": T.StringType(),
    "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def encode_decode(
    df: DataFrame,
    model_path: str,
    text_col: str = "text",
    outputs: tuple[str, ...] = ("ids", "decoded"),
    check: str = "runs",
    keep: list[str] | None = None,
) -> DataFrame:
    """Add what SentencePiece makes of a text column: ``ids``, ``decoded`` and digests of them, as named in ``outputs``.

    Map-only: one Arrow pass, no shuffle. ``model_path`` is read on the executors. A null text counts as empty and gives
    no ids. Rows, repeated ones too, each give one row; an empty table gives an empty one. Other columns are carried
    (``keep``: only these); one named like an output is replaced. Memory follows one Arrow batch.
    """
    fields = [T.StructField(o, OUTPUTS[o]) for o in outputs]

    def make():
        own = codec(model_path, check)
        shown = [str(i) for i in range(own.model.size)]

        def compute(texts: list[str | None]) -> tuple:
            cols: dict[str, list] = {o: [] for o in outputs}
            for group in _groups(texts):
                ids = own.encode(group)
                decoded = own.decode(ids) if {"decoded", "decoded_sha256"} & cols.keys() else []
                if "ids" in cols:
                    cols["ids"] += [np.array(x, dtype=np.int32) for x in ids]
                if "n_tokens" in cols:
                    cols["n_tokens"] += map(len, ids)
                if "ids_sha256" in cols:
                    cols["ids_sha256"] += [sha256(",".join([shown[i] for i in x]).encode()).hexdigest() for x in ids]
                if "decoded" in cols:
                    cols["decoded"] += decoded
                if "decoded_sha256" in cols:
                    cols["decoded_sha256"] += [sha256(x.encode()).hexdigest() for x in decoded]
            return tuple(cols[o] for o in outputs)

        return compute

    return append_columns(df, [text_col], make, fields, keep)
