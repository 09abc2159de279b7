"""Connected components of a graph given as an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum (partially aggregated before its shuffle) and an equi-join, so a node with very many
neighbours is never gathered into one task; each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import materialize


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges`` (u, v) of any order -> (node, root) for each node of an edge that is not its component's least node.

    Null ends and loops are ignored, repeated edges count once; no edges give no rows.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialize(e, name)
    before = _stamp(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = F.struct(F.col("u"), F.col("m").alias("v"))
        other = F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(pair, other)).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        e = materialize(small, name)
        after = _stamp(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
