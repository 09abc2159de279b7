"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order::

    data block*  index block  Bloom filter  footer

Data block: entries, then the offsets of its restart entries (u32 each), their number (u32) and the CRC-32 of all that
(u32). Entry: varint shared (bytes taken from the previous key), varint rest (key bytes that follow), varint size, the
key's rest, the value. Every RESTART-th entry shares nothing, so a block is searched by bisection over its restarts.
Index block: for each data block u32 length of its last key, the key, u64 offset, u32 length, u32 entries.
Bloom filter: u32 hash functions, then the bits. Footer (72 bytes, little-endian): u64 index offset, u64 index length, u64
filter offset, u64 filter length, u64 documents, u64 tokens, u32 blocks, u32 end id, u32 CRC-32 of index and filter, u32
bytes of an id, 8 bytes of magic.

Key: one byte (0 null id, 1 otherwise), the id as 8 big-endian bytes with its sign bit flipped, and a 4-byte ordinal that
tells rows of one id apart; byte order is id order, nulls first. Value: ids as little-endian
integers, the end id last; an id takes 2 bytes if the vocabulary allows it, else 4.

Shards are written from range-partitioned, sorted rows, under names of the attempt; the manifest, which Spark commits for
one attempt of a task, says which of them count. So a task may run again, or twice at a time, and no file that is read is
ever replaced.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import chain, filterfalse
from string import punctuation
from unicodedata import normalize
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from paperloom.llm.common import materialize, scratch_path, slices

MAGIC = b"PLSSTAB1"
FOOTER = struct.Struct("<QQQQQQIIII8s")
BLOCK_BYTES, RESTART = 64 * 1024, 16
SHARD_BYTES = 8 * 1024 * 1024
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Bytes of ids after which a reader hands on its rows, and bytes of shards that a task reads.
READ_BYTES, TASK_BYTES = 1 << 20, 32 << 20
#: Distinct pieces of text that a worker remembers.
REMEMBER = 1_000_000


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def key_of(doc_id: int | None, ordinal: int = 0) -> bytes:
    if doc_id is None:
        return b"\0" + bytes(8) + struct.pack(">I", ordinal)
    return b"\1" + struct.pack(">QI", (doc_id + (1 << 63)) & ((1 << 64) - 1), ordinal)


def wide(value: bytes, width: int) -> bytes:
    """A value as little-endian u32."""
    return value if width == 4 else np.frombuffer(value, dtype="<u2").astype("<u4").tobytes()


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


def _bloom_places(key: bytes, bits: int) -> Iterator[int]:
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(key[:9], 0)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return ((a + i * b) % bits for i in range(BLOOM_HASHES))


class ShardWriter:
    """Builds one shard in memory; keys come in ascending order."""

    def __init__(self, end_id: int, width: int = 4):
        self.end_id, self.width = end_id, width
        self.data, self.index, self.keys = bytearray(), bytearray(), []
        self.tokens = self.blocks = 0
        self._start()

    def _start(self) -> None:
        self.block, self.restarts, self.entries, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.entries % RESTART:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.entries += 1
        self.keys.append(key)
        self.tokens += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            body = bytes(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            body += struct.pack("<I", zlib.crc32(body))
            self.index += struct.pack("<I", len(self.last)) + self.last + struct.pack("<QII", len(self.data), len(body), self.entries)
            self.data += body
            self.blocks += 1
            self._start()

    def size(self) -> int:
        return len(self.data) + len(self.block)

    def finish(self) -> bytes:
        self._flush()
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = bytearray(-(-bits // 8))
        for key in self.keys:
            for p in _bloom_places(key, len(bloom) * 8):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom = struct.pack("<I", BLOOM_HASHES) + bytes(bloom)
        index = bytes(self.index)
        at = len(self.data)
        footer = FOOTER.pack(
            at, len(index), at + len(index), len(bloom), len(self.keys), self.tokens, self.blocks, self.end_id, zlib.crc32(index + bloom),
            self.width, MAGIC
        )
        return bytes(self.data) + index + bloom + footer


class Shard:
    """A shard that is read by ``read(offset, length)``; a negative offset counts from the end."""

    def __init__(self, read):
        self.read = read
        at, n, bloom_at, bloom_n, self.documents, self.tokens, self.blocks, self.end_id, crc, self.width, magic = FOOTER.unpack(
            read(-FOOTER.size, FOOTER.size)
        )
        if magic != MAGIC:
            raise ValueError("not a shard")
        index, bloom = read(at, n), read(bloom_at, bloom_n)
        if zlib.crc32(index + bloom) != crc:
            raise ValueError("a shard's index or filter is damaged")
        self.bloom = bloom[4:]
        self.index, k = [], 0
        while k < len(index):
            (size,) = struct.unpack_from("<I", index, k)
            self.index.append((index[k + 4 : k + 4 + size], *struct.unpack_from("<QII", index, k + 4 + size)))
            k += 20 + size

    @classmethod
    def of(cls, data: bytes) -> Shard:
        return cls(lambda at, n: data[at : at + n] if at >= 0 else data[len(data) + at :][:n])

    def _block(self, k: int) -> tuple[bytes, list[int]]:
        _, at, size, _ = self.index[k]
        body = self.read(at, size)
        if zlib.crc32(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError("a shard's block is damaged")
        (n,) = struct.unpack("<I", body[-8:-4])
        return body[: -8 - 4 * n], list(struct.unpack(f"<{n}I", body[-8 - 4 * n : -8]))

    def _entries(self, body: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(body):
            shared, at = _read_varint(body, at)
            rest, at = _read_varint(body, at)
            size, at = _read_varint(body, at)
            key = key[:shared] + body[at : at + rest]
            yield key, body[at + rest : at + rest + size]
            at += rest + size

    def entries(self) -> Iterator[tuple[bytes, bytes]]:
        """All (key, value) pairs, in order."""
        for k in range(len(self.index)):
            body, _ = self._block(k)
            yield from self._entries(body, 0)

    def get(self, doc_id: int | None) -> list[bytes]:
        """The values of an id: filter, bisection over blocks, bisection over a block's restarts."""
        low, high = key_of(doc_id), key_of(doc_id, 0xFFFFFFFF)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(low, len(self.bloom) * 8)):
            return []
        found = []
        for k in range(bisect_left(self.index, low, key=lambda x: x[0]), len(self.index)):
            body, restarts = self._block(k)
            at = bisect_left(restarts, low, key=lambda r: next(self._entries(body, r))[0])
            for key, value in self._entries(body, restarts[max(0, at - 1)]):
                if key > high:
                    return found
                if key >= low:
                    found.append(value)
        return found


class WordIds:
    """Token ids of whole texts by the tokenizers library, remembered by what stands between white space.

    Text between blanks or line feeds is encoded alone if the tokenizer's own file says that this changes nothing: its
    normalizer composes (NFC), makes white space one blank and lower-cases, and its pre-tokenizer drops what is between words. With
    any other rules every text is encoded whole. Words are bytes of UTF-8. ASCII capitals become small letters first, but for words
    that may hold a special token, or a mark that a small letter may be composed with and its capital not. ASCII marks behind
    letters stand for themselves, where the word is all letters once normalized. Words that this doesn't lead back to known ones
    are encoded together; a token that ends a word ends its ids. Of the words that a batch brings, some (and those with marks behind
    them that have a letter not met so) are encoded a second time, as one of the batch's texts is as it stands, and the task fails
    if that differs.
    """

    #: Of so many new words, one is encoded again as it stands.
    CHECK_EVERY = 256
    #: A text that is encoded again has so many bytes at most.
    CHECK_BYTES = 20_000
    #: First bytes of U+0300 to U+037F in UTF-8, which has all marks that are composed with ASCII letters.
    COMPOSED = (b"\xcc", b"\xcd")

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        rules = json.loads(self.library.to_str())
        self.by_word = self._splits(rules)
        marks = {t["content"][:1] for t in rules["added_tokens"]}  # a piece that may hold a special token has one of these
        self.as_it_stands = (*(m.encode() for m in marks), *self.COMPOSED)
        self.behind = "".join(sorted(set(punctuation).difference(marks))).encode()
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        tokens = self.library.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(tokens.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in tokens.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.tried: set[str] = set()

    @staticmethod
    def _splits(rules: dict) -> bool:
        """Whether the rules are those under which text between blanks is encoded alone."""
        steps = (rules["normalizer"] or {}).get("normalizers", [])
        blank = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
        cut = ((rules["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        return (
            [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"]
            and steps[1] == blank
            and cut.get("type") == "Split"
            and (cut.get("behavior"), cut.get("invert")) == ("Removed", True)
            and {r"[\p{L}]+", r"[^\s\p{L}\p{N}]+"} <= set(cut["pattern"].get("Regex", "").split("|"))
            and rules["model"]["type"] == "BPE"
            and rules["model"]["end_of_word_suffix"] == "</w>"
            and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["content"][:1] not in punctuation for t in rules["added_tokens"])
        )

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def _said(self, pieces: list[bytes]) -> list[bytes]:
        """What the library says of pieces."""
        given = [p.decode() for p in pieces]
        return [self.pack(e.ids) for e in self.library.encode_batch_fast(given, add_special_tokens=False)] if given else []

    @staticmethod
    def _letters(word: bytes) -> bool:
        """Whether a word is all letters, also as the tokenizer sees it: composed and in lower case."""
        if word.isascii():
            return word.isalpha()
        text = word.decode()
        return text.isalpha() and normalize("NFC", text).lower().isalpha()

    def _unknown(self, words: Iterable[bytes]) -> list[bytes]:
        """Words that aren't known; those that were, before, are known again."""
        known, before = self.known, self.before
        fresh = list(filterfalse(known.__contains__, words))  # not by sets' methods, which would go through all that is known
        known.update((w, before[w]) for w in filter(before.__contains__, fresh))
        return list(filterfalse(before.__contains__, fresh))

    def _learn(self, fresh: list[bytes]) -> None:
        known, behind, letters = self.known, self.behind, self._letters
        # Words with marks behind them: (word, letters, marks).
        ends: list[tuple[bytes, bytes, bytes]] = []
        words, rest = set(), set()
        for w in fresh:
            head = w.rstrip(behind)
            if not letters(head):
                rest.add(w)
                continue
            words.add(head)
            if len(head) < len(w):
                ends.append((w, head, w[len(head) :]))
        rest.update(tail for _, _, tail in ends)
        words, rest = self._unknown(words), self._unknown(rest)
        known.update(zip(rest, self._said(rest)))
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            whole = b" ".join(part).decode()
            ids = np.array(self.library.encode_batch_fast([whole], add_special_tokens=False)[0].ids, dtype=np.int64)
            ends_here = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends_here) != len(part):  # a word that isn't cut off by its last token
                known.update(zip(part, self._said(part)))
                continue
            packed, cut = ids.astype(f"<u{self.width}").tobytes(), [0, *(self.width * ends_here).tolist()]
            known.update(zip(part, (packed[a:b] for a, b in zip(cut, cut[1:]))))
        known.update((w, known[head] + known[tail]) for w, head, tail in ends)
        again = fresh[:: self.CHECK_EVERY]
        for w, _, _ in ends:
            if not w.isascii() and not self.tried.issuperset(text := w.decode()):
                self.tried.update(text)
                again.append(w)
        self._compare(again, [known[w] for w in again])

    def _compare(self, pieces: list[bytes], own: list[bytes]) -> None:
        for p, value, said in zip(pieces, own, self._said(pieces)):
            if value != said:
                raise ValueError(f"the library has other ids for {p[:200].decode('utf-8', 'replace')!r}")

    def words(self, text: bytes) -> list[bytes]:
        """What stands between blanks and line feeds, in small letters where that changes no ids."""
        if not any(mark in text for mark in self.as_it_stands):
            return text.lower().replace(b"\n", b" ").split(b" ")
        return [w if any(mark in w for mark in self.as_it_stands) else w.lower() for w in text.replace(b"\n", b" ").split(b" ")]

    def values(self, texts: list[str | bytes]) -> list[bytes]:
        texts = [t.encode() if isinstance(t, str) else t for t in texts]
        if not self.by_word:
            return self._said(texts)
        if len(self.known) > REMEMBER // 2:  # what isn't met again before this half is full is forgotten
            self.known, self.before = {}, self.known
        known, cut, missed = self.known, [], []
        for t in texts:  # a text's words go once they are looked up, but for those that aren't known
            words = self.words(t)
            ids = list(map(known.get, words))
            gaps = [k for k, value in enumerate(ids) if value is None]
            cut.append(ids)
            missed.append((gaps, [words[k] for k in gaps]))
        self._learn(self._unknown(set(chain.from_iterable(words for _, words in missed))))
        out = []
        for ids, (gaps, words) in zip(cut, missed):
            for k, w in zip(gaps, words):
                ids[k] = known[w]
            out.append(b"".join(ids))
        k = next((k for k, t in enumerate(texts) if len(t) <= self.CHECK_BYTES), None)
        if k is not None:
            self._compare([texts[k]], [out[k]])
        return out


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def _grouped(rows: Iterator[tuple[int | None, bytes]], most: int = 2_000_000) -> Iterator[list[tuple[int | None, bytes]]]:
    group, size = [], 0
    for r in rows:
        group.append(r)
        size += len(r[1])
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def write_shards(
    docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1
) -> DataFrame:
    """Encode whole texts, append the end id and write shards under ``folder``; returns the manifest, which is run once.

    Manifest: file, part, piece, documents, tokens, bytes; in the order of (part, piece) ids ascend over all shards. Null
    texts count as empty (the end id alone), null ids come first, repeated rows stay. ``folder`` is a URI that pyarrow's
    file systems open on every executor; files there that the manifest doesn't name don't count. An empty table writes no
    shard. Very long texts are encoded whole; columns but the two named play no part.
    """
    import pyarrow as pa

    schema = "file string, part int, piece int, documents long, tokens long, bytes long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part, own = TaskContext.get().partitionId(), word_ids(tokenizer_path)
        done: list[tuple] = []

        def close(shard: ShardWriter) -> None:
            name, data = f"part-{part:06d}-{len(done):05d}-{uuid.uuid4().hex}.sst", shard.finish()
            with store.open_output_stream(f"{base}/{name}") as f:
                f.write(data)
            done.append((name, part, len(done), len(shard.keys), shard.tokens, len(data)))

        def rows() -> Iterator[tuple[int | None, bytes]]:
            for batch in (part for whole in batches for part in slices(whole)):
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                    yield i, t or b""

        end, shard, last, ordinal = own.pack([end_id]), ShardWriter(end_id, own.width), object(), 0
        for group in _grouped(rows()):
            for (i, _), value in zip(group, own.values([t for _, t in group])):
                ordinal = ordinal + 1 if i == last else 0
                last = i
                shard.add(key_of(i, ordinal), value + end)
                if shard.size() >= SHARD_BYTES:
                    close(shard)
                    shard = ShardWriter(end_id, own.width)
        if shard.keys:
            close(shard)
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(zip(*done), [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])],
                names=["file", "part", "piece", "documents", "tokens", "bytes"],
            )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Rows of one id are spread by their text, should one id hold very many.
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(n, F.col("id").asc_nulls_first(), tie).sortWithinPartitions(F.col("id").asc_nulls_first(), tie)
    # One file of a row a shard, which its readers sort in one task anyway, and not one file for each task.
    return materialize(ordered.mapInArrow(run, schema).repartition(1), "manifest")


def _reader(f):
    """``read`` of a ``Shard`` for an open file."""
    size = f.size()
    return lambda at, n: f.read_at(n, at if at >= 0 else size + at)


def rows_of(shard: Shard, start: int) -> Iterator[list[tuple[int | None, int, bytes]]]:
    """A shard's documents (id, start, ids as u32) in groups of about READ_BYTES, read a block at a time."""
    rows, size = [], 0
    for key, value in shard.entries():
        rows.append((id_of(key), start, wide(value, shard.width)))
        start += len(value) // shard.width
        size += len(rows[-1][2])
        if size >= READ_BYTES:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """What the shards hold, in one row per document: doc_id, start (ids before it), ids (little-endian u32).

    Tasks get names and read a block at a time, by pyarrow's file systems as the writers do: no shard is whole in memory.
    """
    import pyarrow as pa

    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))
    files, size = manifest.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(files, max(spark.sparkContext.defaultParallelism, size // TASK_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        kinds = [pa.int64(), pa.int64(), pa.binary()]
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{base}/{name}") as f:
                    for rows in rows_of(Shard(_reader(f)), start):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "start", "ids"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])
    return starts.repartition(tasks).mapInArrow(run, schema)


def lookup(folder: str, files: list[str], doc_id: int | None) -> list[bytes]:
    """The ids of one document from the named shards, by random access: no shard is read whole."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    found = []
    for name in files:
        with store.open_input_file(f"{base}/{name}") as f:
            shard = Shard(_reader(f))
            found += [wide(v, shard.width) for v in shard.get(doc_id)]
    return found


def query(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 as the files have them."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "shards")
    manifest = write_shards(docs, tokenizer_path, folder)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = read_shards(spark, folder, manifest)
    return rows.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
