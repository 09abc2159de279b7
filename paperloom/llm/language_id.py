"""Language identification by hyperdimensional profiles.

Every letter (and the gap between words) has a random vector of +1 and -1. A trigram's vector binds its letters' vectors,
permuted by their place (rolled by 2, 1 and 0), by elementwise product. A document's vector bundles, that is sums, the
vectors of its trigrams; a language's prototype is the sum over its training documents. The prediction is the language
whose prototype has the largest cosine with the document's vector, ties going to the lesser name.

Texts are lower-cased, and runs of other characters count as one gap. All of every text is used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import append_columns

DIMENSIONS = 1024
#: Letter vectors: a to z have their own, other letters share the rest by code point.
SYMBOLS = 4096
#: Trigram vectors that a worker remembers.
REMEMBER = 60_000
#: Languages whose prototypes are compared together; more are compared block by block, in the same pass.
BLOCK_LANGUAGES = 2_000
UNDETERMINED = "und"


class Space:
    """The vectors of one worker."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 17):
        rng = np.random.default_rng(seed)
        vectors = (rng.integers(0, 2, (SYMBOLS, dimensions), dtype=np.int8) * 2 - 1).astype(np.int8)
        self.placed = [np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1), vectors]
        points = np.arange(0x110000)
        letter = np.fromiter((chr(p).isalpha() for p in range(0x110000)), dtype=bool, count=0x110000)
        self.symbol = np.where(letter, 27 + points % (SYMBOLS - 27), 0).astype(np.int64)
        self.symbol[97:123] = np.arange(1, 27)
        self.dimensions = dimensions
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.rows = np.zeros((REMEMBER, self.dimensions), dtype=np.int8)

    def trigrams(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """(trigram codes, counts), or None for a text without letters."""
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        s = self.symbol[points]
        if not s.any():
            return None
        s = np.concatenate([[0], s, [0]])
        s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
        return np.unique(s[:-2] << 24 | s[1:-1] << 12 | s[2:], return_counts=True)

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """The bound vectors of trigrams, a row each."""
        a, b, c = self.placed
        return a[codes >> 24] * b[codes >> 12 & 4095] * c[codes & 4095]

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of trigram vectors, in blocks."""
        total = np.zeros(self.dimensions, dtype=np.float64)
        for at in range(0, len(codes), 8192):
            part = codes[at : at + 8192]
            known = list(map(self.place.get, part.tolist()))
            if None in known:
                new = [x for x, k in zip(part.tolist(), known) if k is None]
                if len(self.place) + len(new) > REMEMBER:
                    self.forget()
                    new = part.tolist()
                base = len(self.place)
                self.rows[base : base + len(new)] = self.vectors(np.array(new, dtype=np.int64))
                self.place.update(zip(new, range(base, base + len(new))))
                known = list(map(self.place.__getitem__, part.tolist()))
            total += counts[at : at + 8192].astype(np.float32) @ self.rows[known].astype(np.float32)
        return total


_SPACES: dict[int, Space] = {}


def space(dimensions: int = DIMENSIONS) -> Space:
    if dimensions not in _SPACES:
        _SPACES[dimensions] = Space(dimensions)
    return _SPACES[dimensions]


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", dimensions: int = DIMENSIONS) -> dict[str, list[float]]:
    """Unit prototypes by language, from all rows with a language and a text that has letters.

    Each task bundles its rows by language into exact integer sums; these are added by dimension in a partially
    aggregated shuffle, so what reaches the driver is one vector a language, one at a time.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = space(dimensions)
        held: dict[str, tuple[list, list]] = {}
        sums: dict[str, np.ndarray] = {}

        def settle(lang: str) -> None:
            codes, counts = map(np.concatenate, held.pop(lang))
            codes, where = np.unique(codes, return_inverse=True)
            counts = np.bincount(where, weights=counts)
            total = sums.setdefault(lang, np.zeros(dimensions))
            for at in range(0, len(codes), 8192):
                total += counts[at : at + 8192] @ own.vectors(codes[at : at + 8192]).astype(np.float64)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = own.trigrams(text)
                if got:
                    codes, counts = held.setdefault(lang, ([], []))
                    codes.append(got[0])
                    counts.append(got[1])
                    if len(codes) >= 2000:
                        settle(lang)
        for lang in list(held):
            settle(lang)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(total.astype(np.int64))],
                names=["lang", "k", "v"],
            )

    rows = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang is not null and text is not null")
    sums = rows.mapInArrow(run, "lang string, k int, v long").groupBy("lang", "k").agg(F.sum("v").alias("v"))
    vectors = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("x"))
    found = vectors.select("lang", F.col("x.v").alias("v")).toLocalIterator()
    out = {}
    for r in found:
        v = np.array(r["v"], dtype=np.float64)
        out[r["lang"]] = (v / (np.linalg.norm(v) or 1.0)).tolist()
    return out


def predict(
    docs: DataFrame, prototypes: dict[str, list[float]], text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (the cosine, at least 0), from the text alone; map-only.

    A null text, one without letters, or no prototypes give ``und`` and 0. Rows stay as they are, very long texts are read
    whole, an empty table gives an empty one; columns of these names are replaced.
    """
    names = sorted(prototypes)
    blocks = []
    for at in range(0, len(names), BLOCK_LANGUAGES):
        part = names[at : at + BLOCK_LANGUAGES]
        blocks.append((part, np.array([prototypes[n] for n in part], dtype=np.float64)))

    def make():
        own = space(blocks[0][1].shape[1]) if blocks else None

        def compute(texts: list[str | None]) -> tuple:
            lang, score = [], []
            for t in texts:
                got = own.trigrams(t) if blocks else None
                if not got:
                    lang.append(UNDETERMINED)
                    score.append(0.0)
                    continue
                v = own.bundle(*got)
                size = np.linalg.norm(v) or 1.0
                best, most = UNDETERMINED, -np.inf
                for part, matrix in blocks:  # names ascend, so an earlier one wins a tie
                    cosine = matrix @ v / size
                    k = int(cosine.argmax())
                    if cosine[k] > most:
                        best, most = part[k], float(cosine[k])
                lang.append(best)
                score.append(min(1.0, max(0.0, most)))
            return lang, score

        return compute

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return append_columns(docs, [text_col], make, fields, keep)


def held_out(id_col: str = "doc_id"):
    """Rows that training never sees: crc32 of the id's text leaves 2 when divided by 4 (a null id: false)."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def query(docs: DataFrame) -> DataFrame:
    prototypes = train(docs.where(~held_out()).select("lang", "text"))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), prototypes, keep=["doc_id", "held_out"])
