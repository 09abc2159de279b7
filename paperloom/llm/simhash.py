"""SimHash near-duplicates, compared bit-sliced.

A text's fingerprint has bit i set where over half of its shingle hashes have it. Two fingerprints link if they differ in
``radius`` bits or fewer. Candidates come from blocks of bits: of m blocks, two linked fingerprints agree on m - radius
at least, so each choice of m - radius blocks is a table, keyed by the bits of these blocks, and no link is lost. m
follows the number of different fingerprints; any m gives the same links.

Rows of a key are compared bit-sliced: 64 fingerprints are stored as 64 words, word k holding bit k of all of them. A
query's bit k turns word k into the lanes that differ, and carry-save counters add them up, 8 bits at a time, for 64
fingerprints at once. After every 8 bits, words whose lanes have all passed the radius are abandoned. Keys with very many
rows are cut into tiles of a bounded size, each pair of tiles being a group of its own, so nothing is dropped. A group
returns only the edges of a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import append_columns, materialize, scratch
from paperloom.llm.components import connected_components

#: Rows of one key up to which they form one group; larger keys are cut into tiles of about this size.
TILE = 4096
#: Rows that a key is meant to have on average.
PER_KEY = 256
#: Rows of one fingerprint from which it is joined by broadcast.
HOT = 1_000_000
#: Pairs of a query and a word of lanes that are compared together.
STRIP = 16_384


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text (unsigned); 0 for a null text or one without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxh64_intdigest(joined, seed)
    ends = [e + k for k, e in enumerate(accumulate(map(len, words)))]
    starts = [0] + [e + 1 for e in ends]
    hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :])], dtype="<u8")
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(
    df: DataFrame, text_col: str = "text", width: int = 4, seed: int = 42, name: str = "fingerprint", keep=None
) -> DataFrame:
    """Add the fingerprint as a long (two's complement), in one Arrow pass over whole texts."""

    def make():
        def compute(texts: list[str | None]) -> tuple:
            prints = np.array([fingerprint(t, width, seed) for t in texts], dtype=np.uint64)
            return (prints.view(np.int64),)

        return compute

    return append_columns(df, [text_col], make, [T.StructField(name, T.LongType())], keep)


def blocks_for(n: int, radius: int) -> int:
    """How many blocks of bits to cut, so that a key of n random fingerprints has about PER_KEY rows."""
    m = radius + 1
    while m < radius + 5 and n / 2 ** (64 * (m - radius) / m) > PER_KEY:
        m += 1
    return m


def block_masks(m: int, radius: int) -> list[int]:
    """One mask for each choice of m - radius of m blocks."""
    edge = [64 * k // m for k in range(m + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:])]
    return [sum(c) for c in combinations(masks, m - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """(bits, words): word w of plane k has bit k of the fingerprints 64w to 64w + 63. A fingerprint is one or more u64."""
    prints = prints.reshape(len(prints), -1)
    words, limbs = -(-len(prints) // 64), prints.shape[1]
    padded = np.zeros((words * 64, limbs), dtype="<u8")
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(words, 64, 8 * limbs), axis=2, bitorder="little")
    packed = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(packed.reshape(64 * limbs, words * 8)).view("<u8")


def _carry_save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lane by lane, a + b + c as (ones, twos)."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def close_lanes(
    planes: np.ndarray, queries: np.ndarray, words: np.ndarray, lanes: np.ndarray, radius: int
) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (query fingerprint, word, lanes that count): the pairs that have lanes within the radius, and these lanes.

    A lane's counter starts so that it overflows with the first differing bit beyond the radius.
    """
    if not 0 <= radius < 64:
        raise ValueError("radius is 0 to 63")
    queries = queries.reshape(len(queries), -1)
    at = np.arange(len(queries))
    levels = max(3, (radius).bit_length())
    start = (1 << levels) - radius - 1
    count = [np.full(len(queries), ~np.uint64(0) if start >> v & 1 else np.uint64(0)) for v in range(levels)]
    alive = lanes
    for k in range(0, len(planes), 8):
        limb = queries[:, k // 64] >> np.uint64(k % 64)
        d = [planes[k + i][words] ^ (np.uint64(0) - ((limb >> np.uint64(i)) & np.uint64(1))) for i in range(8)]
        ones, two1 = _carry_save(count[0], d[0], d[1])
        ones, two2 = _carry_save(ones, d[2], d[3])
        twos, four1 = _carry_save(count[1], two1, two2)
        ones, two1 = _carry_save(ones, d[4], d[5])
        ones, two2 = _carry_save(ones, d[6], d[7])
        twos, four2 = _carry_save(twos, two1, two2)
        fours, carry = _carry_save(count[2], four1, four2)
        count[:3] = ones, twos, fours
        for v in range(3, levels):
            count[v], carry = count[v] ^ carry, count[v] & carry
        alive = alive & ~carry
        keep = alive != 0
        if not keep.all():
            at, queries, words, alive = at[keep], queries[keep], words[keep], alive[keep]
            count = [c[keep] for c in count]
            if not len(at):
                break
    return at, alive


def _join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union: label[x] leads to the least row of x's component, in place."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def forest(prints: np.ndarray, first: np.ndarray, end: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (row, root row) of the links between each row r and the rows first[r] to end[r] - 1."""
    planes = bit_planes(prints)
    label = np.arange(len(prints))
    some = np.flatnonzero(first < end)
    w0, w1 = first[some] >> 6, (end[some] - 1) >> 6
    cum = np.concatenate([[0], np.cumsum(w1 - w0 + 1)])
    full = ~np.uint64(0)
    at = 0
    while at < len(some):
        to = max(at + 1, int(np.searchsorted(cum, cum[at] + STRIP, side="right")) - 1)
        rows = np.repeat(some[at:to], (w1 - w0 + 1)[at:to])
        words = np.arange(cum[to] - cum[at]) - np.repeat(cum[at:to] - cum[at] - w0[at:to], (w1 - w0 + 1)[at:to])
        low = np.clip(first[rows] - 64 * words, 0, 63).astype(np.uint64)
        high = np.clip(64 * (words + 1) - end[rows], 0, 63).astype(np.uint64)
        hit, alive = close_lanes(planes, prints[rows], words, (full << low) & (full >> high), radius)
        if len(hit):
            lane = np.unpackbits(alive.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            p, bit = np.nonzero(lane)
            _join_labels(label, rows[hit[p]], words[hit[p]] * 64 + bit)
        at = to
    linked = np.flatnonzero(label != np.arange(len(label)))
    return linked, label[linked]


def _link_groups(radius: int, names: tuple[str, ...] = ("fp",), label: str = "fp"):
    """Arrow batches sorted by group -> spanning edges; groups are whole within a partition.

    ``names`` are the columns of a fingerprint's u64s; an edge is a pair of values of ``label``.
    """
    import pyarrow as pa

    def edges(t: pa.Table) -> pa.RecordBatch:
        cols = [t.column(c).to_numpy() for c in ("t", "key", "lo", "hi", "chunk", *names)]
        prints = np.stack([c.view(np.uint64) for c in cols[5:]], axis=1)
        new = np.ones(len(prints), dtype=bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(prints))
        group = np.cumsum(new) - 1
        end = ends[group]
        first = np.arange(1, len(prints) + 1)
        cross = cols[2] != cols[3]
        if cross.any():  # a pair of tiles: each row of the one against all of the other
            inner = cross & (cols[4] == cols[2])
            second = np.full(len(starts), len(prints))
            np.minimum.at(second, group[cross & ~inner], np.flatnonzero(cross & ~inner))
            first = np.where(inner, np.minimum(second[group], end), np.where(cross, end, first))
        a, b = forest(prints, first, end, radius)
        name = t.column(label).to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(name[a]), pa.array(name[b])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 65_536:
                t = pa.Table.from_batches(held).combine_chunks()
                same = np.all([t.column(c).to_numpy() == t.column(c)[-1].as_py() for c in ("t", "key", "lo", "hi")], axis=0)
                cut = int(np.argmax(same))  # sorted: the last group's rows are the last rows
                if cut:
                    yield edges(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                rows = t.num_rows - cut
        if rows:
            yield edges(pa.Table.from_batches(held).combine_chunks())

    return run


def grouped_edges(keyed: DataFrame, radius: int, names: tuple[str, ...] = ("fp",), label: str = "fp") -> DataFrame:
    """(t, key, names..., label) -> edges (u, v) that connect what links among the rows of each key; large keys go by pairs of tiles."""
    large = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(f"n > {TILE}")
    large = materialize(large.select("t", "key", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "large-keys")
    columns = list(dict.fromkeys([*names, label]))
    chunk = F.pmod(F.xxhash64(label), F.col("tiles")).cast("int")
    if large.isEmpty():
        tiled = keyed.withColumns({"lo": F.lit(0), "hi": F.lit(0), "chunk": F.lit(0)})
    else:
        tiled = (
            keyed.join(large, ["t", "key"], "left")
            .withColumn("tiles", F.coalesce("tiles", F.lit(1)))
            .withColumn("chunk", chunk)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            .withColumns({"lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other")})
            .select("t", "key", *columns, "lo", "hi", "chunk")
        )
    group = ["t", "key", "lo", "hi"]
    return (
        tiled.select(*group, "chunk", *columns)
        .repartition(*group)
        .sortWithinPartitions(*group, "chunk", label)
        .mapInArrow(_link_groups(radius, names, label), "u long, v long")
    )


def link_edges(prints: DataFrame, n: int, radius: int = 4) -> DataFrame:
    """Edges (u, v) that connect what links among the different fingerprints in column ``fp``; n: how many they are."""
    masks = [_signed(m) for m in block_masks(blocks_for(n, radius), radius)]
    keyed = prints.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
        ).alias("x"),
    ).select("x.t", "x.key", "fp")
    return grouped_edges(keyed, radius)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of ``docs``: its id, ``fp`` (long), ``root_fp`` (its component) and ``component_id``.

    component_id is the smallest id of the component (null if it has none but null ids). Texts that are null or have no
    word have the fingerprint zero and link like any other; repeated rows and equal ids stay; an empty table gives none.
    Texts are read once, whole; what is shuffled is ids and fingerprints.
    """
    with scratch(docs.sparkSession) as keep:
        prints = with_fingerprint(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), keep=["id"], name="fp", width=width)
        prints = materialize(prints, "fingerprints")
        nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
        roots = connected_components(link_edges(nodes.select("fp"), nodes.count(), radius), "linked")
        members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        joined = members.join(nodes, members["node"] == nodes["fp"]).select("node", "root", "least")
        named = materialize(members.join(joined.groupBy("root").agg(F.min("least").alias("component_least")), "root"), "named")
        placed = nodes.join(named, nodes["fp"] == named["node"], "left").select(
            F.col("fp"),
            F.coalesce("root", "fp").alias("root_fp"),
            F.when(F.col("root").isNotNull(), F.col("component_least")).otherwise(F.col("least")).alias("component_id"),
            (F.col("n") >= HOT).alias("hot"),
        )
        placed = materialize(placed, "placed")
        hot = placed.where("hot").select(F.col("fp").alias("hot_fp"), F.col("root_fp").alias("hot_root"), F.col("component_id").alias("hot_id"))
        if hot.isEmpty():
            return keep(prints.join(placed.drop("hot"), "fp").select(F.col("id").alias(id_col), "fp", "root_fp", "component_id"))
        # There is one hot fingerprint for HOT rows at most, so these few are sent to every task; the rest are joined.
        seen = prints.join(F.broadcast(hot), F.col("fp") == F.col("hot_fp"), "left")
        rest = seen.where("hot_fp is null").select("id", "fp").join(placed.where("not hot").drop("hot"), "fp")
        found = seen.where("hot_fp is not null").select("id", "fp", F.col("hot_root").alias("root_fp"), F.col("hot_id").alias("component_id"))
        return keep(found.unionByName(rest).select(F.col("id").alias(id_col), "fp", "root_fp", "component_id"))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
