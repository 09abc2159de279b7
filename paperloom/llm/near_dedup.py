"""Near-duplicates of whole texts: SimHash candidates, confirmed by the exact Jaccard similarity of word shingles.

A text is the set of its shingles of WIDTH words (ASCII letters in lower case); two texts link if their sets share at least
four fifths of their union. Texts of equal sets are one node. A node's fingerprint is a SimHash of 128 bits over its set: at
a similarity of 0.8 a bit differs with probability BIT (the angle of the sets over pi), so 19.4 bits differ, with a deviation
of 4.1; RADIUS is 2.4 deviations above. Fingerprints within the radius are found bit-sliced (``simhash.close_lanes``) among
nodes that agree in one of several samples of k bits. k makes a key hold about PER_KEY nodes, and there are as many samples
as leave a pair at 0.8 without a common key in MISS of all cases, so recall is the same at every size: two bounds, 0.99 each,
at 0.8 itself, and nearer to 1 above. Up to PER_KEY nodes there is one key, and all are compared.

Candidates are connected to clusters, and each cluster is searched on its exact sets, so nothing below 0.8 links. The search
is breadth-first: a node is compared with all that aren't reached yet, so a cluster of near copies takes a few passes. Large
clusters are cut into tiles: twice within tiles, dealt out anew each time, and then, where a cluster's nodes still aren't
connected, between tiles; nodes of the cluster's largest component aren't compared with each other again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm import simhash
from paperloom.llm.common import FILE, PLACE, append_columns, materialize, numbered, picked, scratch
from paperloom.llm.components import connected_components

WIDTH, BITS, RADIUS = 5, 128, 29
#: The share of bits that differ at a similarity of 0.8: the sets' cosine is 2 * 0.8 / 1.8.
BIT = math.acos(1.6 / 1.8) / math.pi
#: The share of pairs at 0.8 that may have no key in common, and the nodes that a key is meant to have.
MISS, PER_KEY = 0.01, 4096
#: Nodes of a cluster, and bytes of their sets, up to which it is one tile.
TILE, TILE_BYTES = 2048, 8 << 20
#: Bytes of sets that a task holds before it compares the groups that are whole.
HELD = 8 << 20


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The 128-bit hashes (pairs of u64) of a text's different shingles, in order; fewer words make one, none make none.

    Shingles are told apart by the first half of the hash.
    """
    from xxhash import xxh128_digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.zeros((0, 2), dtype="<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    ends = ends[width - 1 :] if len(words) >= width else ends[-1:]
    parts = []
    for at in range(0, len(ends), 65_536):  # a part of a very long text at a time
        cut = zip(starts[at : at + 65_536].tolist(), ends[at : at + 65_536].tolist())
        parts.append(np.frombuffer(b"".join([xxh128_digest(joined[a:b]) for a, b in cut]), dtype="<u8").reshape(-1, 2))
    found = np.concatenate(parts)
    return found[np.unique(found[:, 0], return_index=True)[1]]


def fingerprint(found: np.ndarray) -> np.ndarray:
    """Two u64: bit i is set where over half of the hashes have it."""
    count = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(found), 65_536):
        bits = np.unpackbits(found[at : at + 65_536].view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(2 * count > len(found), bitorder="little").view("<u8")


def with_prints(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with node (long: equal for equal sets, 0 for an empty one), fp and fp2 (the fingerprint)."""

    def make():
        from xxhash import xxh64_intdigest

        def compute(texts: list[str | None]) -> tuple:
            node, prints = np.zeros(len(texts), dtype=np.uint64), np.zeros((len(texts), 2), dtype=np.uint64)
            for k, t in enumerate(texts):
                found = shingles(t)
                if len(found):
                    node[k], prints[k] = xxh64_intdigest(found.tobytes()), fingerprint(found)
            return node.view(np.int64), prints[:, 0].copy().view(np.int64), prints[:, 1].copy().view(np.int64)

        return compute

    return append_columns(df, [text_col], make, [T.StructField(c, T.LongType()) for c in ("node", "fp", "fp2")], keep)


def samples_for(n: int) -> list[tuple[int, int]]:
    """Masks (of fp and of fp2), one a sample of bits, for n nodes."""
    k = max(0, math.ceil(math.log2(max(1, n) / PER_KEY)))
    times = 1 if not k else math.ceil(math.log(MISS) / math.log(1 - (1 - BIT) ** k))
    rng = np.random.default_rng(42)
    chosen = [sum(1 << int(b) for b in rng.choice(BITS, k, replace=False)) for _ in range(times)]
    full = (1 << 64) - 1
    return [(simhash._signed(m & full), simhash._signed(m >> 64)) for m in chosen]


def candidates(nodes: DataFrame, n: int) -> DataFrame:
    """(node, fp, fp2) -> edges (u, v) between nodes that connect all whose fingerprints were found within the radius."""
    keys = [
        F.struct(F.lit(t).alias("t"), F.xxhash64(F.col("fp").bitwiseAND(F.lit(a)), F.col("fp2").bitwiseAND(F.lit(b))).alias("key"))
        for t, (a, b) in enumerate(samples_for(n))
    ]
    keyed = nodes.select("node", "fp", "fp2", F.explode(F.array(*keys)).alias("x")).select("x.t", "x.key", "node", "fp", "fp2")
    return simhash.grouped_edges(keyed, RADIUS, ("fp", "fp2"), label="node")


def links(sets: list[np.ndarray], known: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) that, with the classes ``known`` of what is connected already, connect what links among the sets."""
    edges: list[tuple[int, int]] = []
    if len(sets) < 2 or (known == known[0]).all():
        return edges
    size = np.array([len(s) for s in sets])
    place = np.unique(np.concatenate(sets), return_inverse=True)[1]
    first = np.concatenate([[0], np.cumsum(size)])
    kind = np.unique(known, return_inverse=True)[1]
    own = np.split(np.argsort(kind, kind="stable"), np.cumsum(np.bincount(kind))[:-1])
    mark = np.zeros(int(place.max()) + 1, dtype=bool)
    waiting = np.ones(len(sets), dtype=bool)
    left = np.arange(len(sets))  # a superset of the waiting, with their elements
    left_place, left_first = place, first[:-1]
    for start in range(len(sets)):
        if not waiting[start]:
            continue
        queue = list(own[kind[start]])
        waiting[own[kind[start]]] = False
        while queue:
            q = queue.pop()
            n = int(waiting.sum())
            if not n:
                return edges
            if 2 * n < len(left):
                left = np.flatnonzero(waiting)
                left_first = np.concatenate([[0], np.cumsum(size[left])[:-1]])
                left_place = np.concatenate([place[first[k] : first[k + 1]] for k in left])
            mark[place[first[q] : first[q + 1]]] = True
            common = np.add.reduceat(mark[left_place], left_first, dtype=np.int64)
            mark[place[first[q] : first[q + 1]]] = False
            hits = left[waiting[left] & (9 * common >= 4 * (size[left] + size[q]))]  # common / union >= 4 / 5
            for j in hits:
                if waiting[j]:
                    edges.append((int(q), int(j)))
                    waiting[own[kind[j]]] = False
                    queue += list(own[kind[j]])
    return edges


def _compare_groups(batches: Iterator) -> Iterator:
    """Arrow batches (cluster, lo, hi, node, known, shingles) sorted by group -> edges; groups are whole in a partition."""
    import pyarrow as pa

    names = ("cluster", "lo", "hi")

    def edges(t: pa.Table) -> pa.RecordBatch:
        cols = [t.column(c).to_numpy() for c in names]
        node, known, sets = t.column("node").to_numpy(), t.column("known").to_numpy(), t.column("shingles")
        new = np.ones(len(node), dtype=bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        starts = np.flatnonzero(new)
        u, v = [], []
        for a, b in zip(starts, np.append(starts[1:], len(node))):
            held = [np.frombuffer(sets[k].as_buffer(), dtype="<u8") for k in range(a, b)]
            for i, j in links(held, known[a:b]):
                u.append(node[a + i])
                v.append(node[a + j])
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= HELD:
            t = pa.Table.from_batches(held).combine_chunks()
            same = np.all([t.column(c).to_numpy() == t.column(c)[-1].as_py() for c in names], axis=0)
            cut = int(np.argmax(same))  # sorted: the last group's rows are the last rows
            if cut:
                yield edges(t.slice(0, cut))
            held = t.slice(cut).to_batches()
            size = sum(b.nbytes for b in held)
    if held:
        yield edges(pa.Table.from_batches(held).combine_chunks())


def _search(rows: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """(cluster, lo, hi, node, known) -> edges (u, v), written."""
    group = ["cluster", "lo", "hi"]
    rows = rows.join(sets, "node").select(*group, "node", "known", "shingles")
    rows = rows.repartition(*group).sortWithinPartitions(*group, "node")
    return materialize(rows.mapInArrow(_compare_groups, "u long, v long"), name)


def _extent() -> list:
    return [F.count(F.lit(1)).alias("m"), F.sum("bytes").alias("b")]


def _tiles(count, size):
    """How many tiles so many nodes with sets of so many bytes are cut into."""
    return F.greatest(F.ceil(count / TILE), F.ceil(size / TILE_BYTES), F.lit(1)).cast("int")


def _within(members: DataFrame, sets: DataFrame, turn: int) -> DataFrame:
    """Edges within tiles of (cluster, tiles, node, known)."""
    chunk = F.pmod(F.xxhash64("node", F.lit(turn)), F.col("tiles")).cast("int")
    return _search(members.withColumns({"lo": chunk, "hi": chunk}), sets, f"links-{turn}")


def _unfinished(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Members of clusters of several tiles with what is ``known`` now, where that is more than one component."""
    roots = connected_components(edges, "known")
    now = members.where("tiles > 1").join(roots, "node", "left").select("cluster", "tiles", "node", "bytes", F.coalesce("root", "node").alias("known"))
    now = materialize(now, "unfinished")
    open_ = now.groupBy("cluster").agg(F.min("known").alias("a"), F.max("known").alias("b")).where("a <> b").select("cluster")
    return now.join(open_, "cluster")


def _across(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges between all tiles of a cluster but for pairs within its largest component, whose tiles come first."""
    parts = materialize(members.groupBy("cluster", "known").agg(*_extent()), "parts")
    whole = parts.groupBy("cluster").agg(
        F.max(F.struct("m", "known", "b")).alias("x"), F.sum("m").alias("all_m"), F.sum("b").alias("all_b")
    )
    first, rest = _tiles(F.col("x.m"), F.col("x.b")), _tiles(F.col("all_m") - F.col("x.m"), F.col("all_b") - F.col("x.b"))
    rows = members.drop("tiles").join(whole.select("cluster", F.col("x.known").alias("main"), first.alias("first"), rest.alias("rest")), "cluster")
    main, first, rest = F.col("known") == F.col("main"), F.col("first"), F.col("rest")
    spread = lambda tiles: F.pmod(F.xxhash64("node"), tiles).cast("int")
    rows = rows.withColumns({"chunk": F.when(main, spread(first)).otherwise(first + spread(rest)), "tiles": first + rest})
    others = F.when(main, F.sequence(first, F.col("tiles") - 1)).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))
    rows = rows.withColumn("other", F.explode(others))
    rows = rows.withColumns({"lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other")})
    return _search(rows.select("cluster", "lo", "hi", "node", "known"), sets, "links-across")


def similar(frame: DataFrame, nodes: DataFrame, text_col: str, keep) -> DataFrame:
    """(node, root) of the nodes that are linked to a smaller one. ``nodes``: (node, fp, fp2, FILE, PLACE) with a row of ``frame`` each."""
    clusters = connected_components(candidates(nodes, nodes.count()), "clusters")
    members = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "cluster")
    members = materialize(members, "members")
    wanted = nodes.join(members.select("node"), "node").select(FILE, PLACE, F.lit(1).alias("times"))

    def make():
        from xxhash import xxh64_intdigest

        def compute(texts: list[str | None]) -> tuple:
            sets = [shingles(t) for t in texts]
            names = np.array([xxh64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], dtype=np.uint64)
            return names.view(np.int64), [s[:, 0].tobytes() for s in sets]

        return compute

    fields = [T.StructField("node", T.LongType()), T.StructField("shingles", T.BinaryType())]
    sets = materialize(picked(frame, wanted, [text_col], keep, make, fields), "sets")
    members = members.join(sets.select("node", F.octet_length("shingles").alias("bytes")), "node")
    sizes = members.groupBy("cluster").agg(*_extent()).select("cluster", _tiles(F.col("m"), F.col("b")).alias("tiles"))
    members = materialize(members.join(sizes, "cluster").select("cluster", "tiles", "node", "bytes"), "members")
    edges = _within(members.withColumn("known", F.col("node")), sets, 0)
    open_ = _unfinished(members, edges)
    if not open_.isEmpty():
        edges = materialize(edges.unionByName(_within(open_, sets, 1)), "links")
        open_ = _unfinished(members, edges)
        if not open_.isEmpty():
            edges = edges.unionByName(_across(open_, sets))
    return connected_components(edges, "linked")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (nulls last); one of them if rows repeat.

    Columns stay as they are, whatever their names. Null texts and texts without words are copies of each other; very long
    texts are taken whole; an empty table gives an empty one. Texts aren't shuffled: what is kept goes to the rows' places.
    """
    names = docs.columns
    with scratch(docs.sparkSession) as keep:
        frame = keep(numbered(docs))
        ident = "__pl_id"
        rows = frame.select(F.col(f"`{id_col}`").alias(ident), F.col(f"`{text_col}`").alias("__pl_text"), FILE, PLACE)
        prints = materialize(with_prints(rows, "__pl_text", [ident, FILE, PLACE]), "fingerprints")
        first = F.min(F.struct(F.col(ident).isNull().alias("none"), F.col(ident).alias("id"), FILE, PLACE)).alias("x")
        nodes = prints.groupBy("node").agg(first, F.min("fp").alias("fp"), F.min("fp2").alias("fp2"))
        nodes = materialize(nodes.select("node", "fp", "fp2", "x", f"x.{FILE}", f"x.{PLACE}"), "nodes")
        roots = similar(frame, nodes, text_col, keep)
        placed = nodes.join(roots, "node", "left")
        kept = placed.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("x").alias("x"))
        return picked(frame, kept.select(f"x.{FILE}", f"x.{PLACE}", F.lit(1).alias("times")), names, keep)
