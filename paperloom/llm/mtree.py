"""Exact top-k inner products by best-first search in M-trees.

Vectors become whole numbers, floor(scale * x). Largest inner product is nearest neighbour in one more dimension: each
vector gets the coordinate sqrt(R^2 - |x|^2), R being the largest norm of the block, and a query gets 0 there; then
d(q, x)^2 = |q|^2 + R^2 - 2 q.x. In that metric space an M-tree holds the rows of a block: pages of routing entries, each
with its object, covering radius and distance to the parent's object, over leaf pages of objects with their distances to
the parent. A search takes the page with the smallest possible distance first. On a page, entries whose stored parent
distance and radius exclude them by the triangle inequality are passed over without computing a distance; the search ends
when no page can hold a better score. Bounds carry a slack for rounding; scores are exact, in doubles where these hold every
sum, else in whole numbers.

Rows are dealt to blocks of a bounded size by a hash; a block's tree is one serialized row. Queries are a stated set, also
in blocks, and each pair of a tree and a query block is one equi-joined row, so no task holds more than one of each. The
best k of every block meet in a window that keeps k rows per query before its shuffle.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm.common import materialize

#: Rows of a tree, queries of a block, objects of a leaf page, entries of a routing page.
BLOCK_ROWS, QUERY_ROWS, LEAF, FANOUT = 16_384, 512, 2048, 8
#: Integers up to this size in each partial sum are exact in doubles.
EXACT = float(1 << 53)


def quantized(vector, scale: int = 256):
    """The whole-number vector as doubles, or null if it is null, empty or holds a null or non-finite component."""
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & fine, v)


class MTree:
    """One block's tree: objects, and pages as arrays of entries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pages: list[dict], reach: float):
        self.ids, self.vectors, self.pages, self.reach = ids, vectors, pages, reach
        self.most = float(np.abs(vectors).max(initial=0.0))
        self.large = self.most**2 * vectors.shape[1] >= EXACT

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, seed: int = 5) -> MTree:
        norms = np.einsum("ij,ij->i", vectors, vectors)  # for bounds alone, so as doubles
        reach = float(norms.max())
        lift = np.sqrt(np.maximum(reach - norms, 0.0))
        rng = np.random.default_rng(seed)
        pages: list[dict] = []

        def distances(rows: np.ndarray, o: int) -> np.ndarray:
            d2 = norms[rows] + norms[o] - 2 * (vectors[rows] @ vectors[o]) + (lift[rows] - lift[o]) ** 2
            return np.sqrt(np.maximum(d2, 0.0))

        def page(rows: np.ndarray, parent: int) -> int:
            """Make the page below the routing object ``parent`` (-1: the root); returns its number."""
            far = (lambda x: distances(x, parent)) if parent >= 0 else (lambda x: np.zeros(len(x)))
            number = len(pages)
            pages.append({})
            if len(rows) > LEAF:
                pivots = rng.choice(rows, size=min(FANOUT, len(rows)), replace=False)
                near = np.stack([distances(rows, o) for o in pivots]).argmin(axis=0)
                groups = [(o, rows[near == k]) for k, o in enumerate(pivots)]
                groups = [(o, g) for o, g in groups if len(g)]
                if len(groups) > 1:
                    below = [page(g, int(o)) for o, g in groups]
                    objects = np.array([o for o, _ in groups])
                    radius = np.array([distances(g, int(o)).max() for o, g in groups])
                    pages[number] = {"objects": objects, "far": far(objects), "radius": radius, "below": np.array(below)}
                    return number
            # A leaf: also where all objects coincide, however many.
            pages[number] = {"objects": rows, "far": far(rows), "radius": np.zeros(0), "below": np.zeros(0, dtype=np.int64)}
            return number

        page(np.arange(len(ids)), -1)
        # The objects of a leaf stand together, in the order of pages.
        order = np.concatenate([p["objects"] for p in pages if not len(p["below"])])
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        for p in pages:
            p["objects"] = place[p["objects"]]
        return cls(ids[order], vectors[order], pages, reach)

    def search(self, q: np.ndarray, own: int | None, k: int) -> list[tuple[int, int]]:
        """The k best (score, id), ties to the smaller id; candidates with the id ``own`` take no part."""
        base = float(q @ q) + self.reach
        slack = 1e-7 * (base + 1.0)
        near = 1e-6 + 1e-7 * np.sqrt(base)  # what rounding may add to a distance
        best: list[tuple[float, int]] = []  # (score, -id), the worst first

        def within() -> float:
            """Objects farther than this can't enter."""
            return np.inf if len(best) < k else np.sqrt(max(base - 2 * best[0][0], 0.0) + slack)

        agenda: list[tuple[float, int, float]] = [(0.0, 0, -1.0)]
        while agenda:
            least, number, to_parent = heapq.heappop(agenda)
            limit = within()
            if least > limit:
                break
            p = self.pages[number]
            objects, radius = p["objects"], p["radius"]
            leaf = not len(p["below"])
            if to_parent >= 0 and limit < np.inf:
                gap = np.abs(to_parent - p["far"])
                keep = np.flatnonzero(gap - (0.0 if leaf else radius) <= limit + near)
                if not len(keep):
                    continue
            else:
                keep = np.arange(len(objects))
            if leaf:
                rows, scores = self._scores(objects, keep, q)
                enough = best[0][0] if len(best) == k else -np.inf
                if len(scores) > 4 * k and scores.dtype != object:  # the page's best, with their ties; one may be the query's own
                    enough = max(enough, np.partition(scores, -4 * k)[-4 * k])
                high = np.flatnonzero(scores >= enough)
                for s, i in zip(scores[high].tolist(), self.ids[rows[high]].tolist()):
                    if i == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
            else:
                d = np.sqrt(np.maximum(base - 2 * (self.vectors[objects[keep]] @ q), 0.0))
                least_here = np.maximum(d - radius[keep] - near, 0.0)
                for x, n, to in zip(least_here.tolist(), p["below"][keep].tolist(), d.tolist()):
                    if x <= limit:
                        heapq.heappush(agenda, (x, n, to))
        return sorted(((int(s), -i) for s, i in best), key=lambda x: (-x[0], x[1]))

    def _scores(self, objects: np.ndarray, keep: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of a leaf's objects: sums that doubles hold exactly, else whole numbers of any size."""
        if len(keep) == len(objects):
            rows, page = objects, self.vectors[objects[0] : objects[0] + len(objects)]
        else:
            rows = objects[keep]
            page = self.vectors[rows]
        if self.large or float(np.abs(q).max()) * self.most * len(q) >= EXACT:
            page, q = ([[int(x) for x in row] for row in m] for m in (page, q[None, :]))
            return rows, np.array([sum(map(int.__mul__, row, q[0])) for row in page], dtype=object)
        return rows, page @ q

    def to_bytes(self) -> bytes:
        """Objects and pages, one after the other."""
        out = io.BytesIO()
        sizes = np.array([[len(p["objects"]), len(p["below"])] for p in self.pages], dtype=np.int64)
        cat = lambda name, kind: np.concatenate([p[name] for p in self.pages]).astype(kind)
        np.savez(
            out, ids=self.ids, vectors=self.vectors, sizes=sizes, reach=np.array([self.reach]),
            objects=cat("objects", np.int64), far=cat("far", np.float64), radius=cat("radius", np.float64), below=cat("below", np.int64),
        )
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> MTree:
        x = np.load(io.BytesIO(data))
        objects, far, radius, below = (x[n] for n in ("objects", "far", "radius", "below"))
        pages, a, b = [], 0, 0
        for n, m in x["sizes"].tolist():
            pages.append({"objects": objects[a : a + n], "far": far[a : a + n], "radius": radius[b : b + m], "below": below[b : b + m]})
            a, b = a + n, b + m
        return cls(x["ids"], x["vectors"], pages, float(x["reach"][0]))


def _rows(pdf) -> tuple[np.ndarray, np.ndarray]:
    ids = pdf["id"].to_numpy(np.int64)
    vectors = np.stack(pdf["v"].to_numpy()).astype(np.float64)
    order = np.argsort(ids, kind="stable")
    return ids[order], vectors[order]


def _plant(pdf):
    import pandas as pd

    ids, vectors = _rows(pdf)
    return pd.DataFrame({"dim": [vectors.shape[1]], "block": [pdf["block"].iloc[0]], "tree": [MTree.build(ids, vectors).to_bytes()]})


def _pack(pdf):
    import pandas as pd

    out = io.BytesIO()
    ids, vectors = _rows(pdf)
    np.savez(out, ids=ids, vectors=vectors)
    return pd.DataFrame({"dim": [vectors.shape[1]], "query_block": [pdf["query_block"].iloc[0]], "queries": [out.getvalue()]})


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query over all rows but its own.

    Ties go to the smaller id. Rows and queries whose id or vector is null, or whose vector is empty or holds null or
    non-finite components, take no part; components of any finite size count, if the scores that are returned fit a long; vectors of different lengths never meet. A query excludes the rows that have its
    id. Repeated candidate rows each count; a repeated query row counts once. No queries, or no rows, give no result.
    """

    def clean(df: DataFrame) -> DataFrame:
        v = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), quantized(F.col(f"`{vector_col}`"), scale).alias("v"))
        return v.where("id is not null and v is not null").withColumn("dim", F.size("v"))

    spark = rows.sparkSession
    rows, asked = materialize(clean(rows), "vectors"), materialize(clean(queries).distinct(), "queries")
    n, m = rows.count(), asked.count()
    blocks, query_blocks = -(-n // BLOCK_ROWS), -(-m // QUERY_ROWS)
    if not n or not m:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    spread = lambda df, name, count: df.withColumn(name, F.pmod(F.xxhash64("id", "v"), F.lit(count)).cast("int"))
    # Copies of a vector share a hash: ids are part of it, so only rows repeated whole meet in one block.
    trees = spread(rows, "block", blocks).groupBy("dim", "block").applyInPandas(_plant, "dim int, block int, tree binary")
    trees = materialize(trees, "trees").withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    packed = spread(asked, "query_block", query_blocks).groupBy("dim", "query_block").applyInPandas(_pack, "dim int, query_block int, queries binary")
    pairs = trees.join(materialize(packed, "query-blocks"), ["dim", "query_block"]).select("tree", "queries", "query_block", "block")
    pairs = pairs.repartition(blocks * query_blocks, "block", "query_block").select("tree", "queries")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for tree, block in zip(pdf["tree"], pdf["queries"]):
                own, x = MTree.from_bytes(tree), np.load(io.BytesIO(block))
                found = []
                for i, q in zip(x["ids"].tolist(), x["vectors"]):
                    found += [(i, q.tobytes(), r, s) for s, r in own.search(q, i, k)]
                yield pd.DataFrame(found, columns=["query_id", "q", "vec_id", "score"])

    found = pairs.mapInPandas(run, "query_id long, q binary, vec_id long, score long")
    order = Window.partitionBy("query_id", "q").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, embeddings.where("vec_id % 50 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
