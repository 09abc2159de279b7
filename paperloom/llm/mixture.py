"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws u from a hash of its id and has the exponential key -ln(u) / w, w being its quality weight; a source's
documents in key order are a weighted sample without replacement of any length. A source's target is a share of all
words, by weights that repeat along the sources' order; a target stops at ``most`` times the source's size and what it
leaves is shared again by weight. The target is filled by complete passes over the source first, then by the documents
whose prefix sum, in key order, comes nearest to what remains.

A source's cut is found by narrowing: sizes are summed over ranges of ln(key), and the range in which the target ends is
summed by key, the key by parts of the table, and the part by rows. Each step groups what the one before has left, so no
step orders a whole source, however many rows or copies it has. What is decided is one cut a source; documents are held
against it where they stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm.common import FILE, PLACE, WORD, materialize, numbered, picked, scratch

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: A target is at most so many times the size of its source.
MOST_PASSES = 3
#: Rows of a source per range of ln(key), roughly.
PER_RANGE = 512
#: Quality weights of documents: labelled good, labelled bad, not labelled.
QUALITY = (2.0, 0.5, 1.0)


def key_column(id_text, text, weight):
    """-ln(u) / weight with u from the first 52 bits of the MD5 of the id and the text, so that only copies share a key."""
    bits = F.conv(F.substring(F.md5(F.concat(id_text, F.lit(":"), F.md5(text))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / weight


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """(source, source_size, ...) -> these and ``target``: the water level of weighted shares under caps, in exact integers."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("place", F.row_number().over(order))
    ranked = ranked.withColumn(
        "w", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long")
    ).withColumn("cap", F.col("source_size") * most)
    everything = Window.partitionBy(F.lit(1))
    up = Window.orderBy((F.col("cap") / F.col("w")), "place")
    filled = (
        ranked.withColumn("all", F.sum("source_size").over(everything))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("full", (F.col("all") - F.col("caps_before")) * F.col("w") > F.col("cap") * F.col("w_left"))
        .withColumn("caps", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0)))
        .withColumn("ws", F.sum(F.when(~F.col("full"), F.col("w"))).over(everything))
    )
    share = ((F.col("all") - F.col("caps")) * F.col("w")).cast("double") / F.col("ws").cast("double")
    return filled.select(*sizes.columns, F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def sized(docs: DataFrame, labels: DataFrame | None, id_col: str, text_col: str, source_col: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """(id, source, size, key, carried...), written once: the only pass over texts."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    good, bad, none = QUALITY
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").alias("source"),
        F.regexp_count(text, F.lit(f"({WORD})")).cast("long").alias("size"),
        key_column(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), text, F.lit(1.0)).alias("draw"),
        *[F.col(c) for c in carried],
    )
    weight = F.lit(none)
    if labels is not None:
        marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("marked")).agg(F.max("quality").alias("quality"))
        rows = rows.join(marks, rows["id"] == marks["marked"], "left")
        weight = F.when(F.col("quality") > 0, F.lit(good)).when(F.col("quality") <= 0, F.lit(bad)).otherwise(F.lit(none))
    return materialize(rows.select("id", "source", "size", (F.col("draw") / weight).alias("key"), *carried), "sizes")


def _narrowed(rows: DataFrame, cuts: DataFrame, cell, name: str) -> DataFrame:
    """rows (source, size, ...) within each source's cut so far -> the cell of each source that its target ends in.

    ``cuts`` has (s, start, rest); the answer has them too, ``start`` being the sum before the cell, and the cell as ``name``.
    """
    inside = rows.join(cuts, F.col("source").eqNullSafe(F.col("s"))).withColumn(name, cell)
    sums = inside.groupBy("s", name).agg(F.sum("size").alias("cell_size"), F.first("start").alias("start"), F.first("rest").alias("rest"))
    before = Window.partitionBy("s").orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.col("start") + F.coalesce(F.sum("cell_size").over(before), F.lit(0)))
    last = starts.where(F.col("start") <= F.col("rest")).groupBy("s").agg(F.max(F.struct(name, "start", "rest")).alias("x"))
    return materialize(last.select("s", f"x.{name}", "x.start", "x.rest"), f"cut-{name}")


def _cuts(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(id, source, size, key, PLACE) -> one row a source: s, source_size, target, whole, and the cut (key, place, start, rest).

    Of the rows with words, those before the cut's key, and those of this key up to its place, are taken once more than
    ``whole``; the row at the cut itself if half of it fits. A source without a cut takes none more.
    """
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    aims = targets(per_source, weights, most).withColumnRenamed("source", "s")
    some = F.col("source_size") > 0
    whole = F.when(some, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    aims = aims.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    aims = materialize(aims, "targets")
    with_words = rows.where("size > 0")
    spread = F.greatest(F.lit(1.0), F.col("n") / PER_RANGE)
    by_range = F.floor(F.log(F.greatest(F.col("key"), F.lit(1e-300))) * spread)
    cut = _narrowed(with_words, aims.select("s", "n", F.lit(0).cast("long").alias("start"), "rest"), by_range, "range")
    # The rows of the range, by key and part of the table (rows are numbered part by part), then by row.
    near = with_words.join(cut.join(aims.select(F.col("s").alias("s1"), "n"), F.col("s").eqNullSafe(F.col("s1"))).select("s", "range", "n"), F.col("source").eqNullSafe(F.col("s")))
    near = materialize(near.where(by_range == F.col("range")).select("source", "size", "key", PLACE), "near-the-cut")
    cell = F.struct("key", F.shiftright(PLACE, 33).alias("part"))
    cut = _narrowed(near, cut.drop("range"), cell, "cell")
    near = near.join(cut.select("s", "cell"), F.col("source").eqNullSafe(F.col("s")) & (cell == F.col("cell"))).drop("s", "cell")
    row = _narrowed(near, cut.drop("cell"), F.col(PLACE), "at_place")
    places = row.select(F.col("s").alias("s2"), "at_place", "start")
    keys = cut.select(F.col("s").alias("s1"), F.col("cell.key").alias("at_key"))
    found = aims.join(keys, F.col("s").eqNullSafe(F.col("s1")), "left").join(places, F.col("s").eqNullSafe(F.col("s2")), "left")
    return found.select("s", "source_size", "target", "whole", "rest", "at_key", "at_place", "start")


def _taken(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(id, source, size, key, PLACE, ...) -> with source_size, target and ``passes``: how often each document is taken."""
    placed = rows.join(_cuts(rows, weights, most), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    at_cut = (F.col(PLACE) == F.col("at_place")) & (2 * F.col("start") + F.col("size") <= 2 * F.col("rest"))
    before = (F.col("key") < F.col("at_key")) | ((F.col("key") == F.col("at_key")) & ((F.col(PLACE) < F.col("at_place")) | at_cut))
    more = F.when(F.coalesce(before, F.lit(False)) & (F.col("size") > 0), 1).otherwise(0)
    return placed.withColumn("passes", (F.col("whole") + more).cast("int")).drop("whole", "rest", "at_key", "at_place", "start", "key")


def mix(
    docs: DataFrame,
    labels: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_PASSES,
) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target and taken (words the mix takes).

    A size is the number of words of the whole text (null: 0). Sources go by code point, null last and a source of its
    own; a source without words has the target 0. ``labels`` (doc_id, quality) gives quality weights. The draw depends on
    id and text alone, so reruns agree; copies (equal id and text) share a key and go in the table's order. An empty table
    gives no rows. Whole documents are taken: a source's taken words differ from its target by half its longest document
    at most. Very long texts are counted whole; other columns of ``docs`` play no part.
    """
    with scratch(docs.sparkSession) as keep:
        rows = sized(docs.withColumn(PLACE, F.monotonically_increasing_id()), labels, id_col, text_col, source_col, (PLACE,))
        found = keep(_taken(rows, weights, most))
    return found.select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("passes")).alias("taken"),
        "passes",
    )


def apply_mix(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as the mix has them: each row as often as it is taken, rows taken never left out; columns as they are.

    Decisions go to the rows' places; texts are neither joined nor shuffled. Odd rows are treated as in ``mix``.
    """
    names = docs.columns
    with scratch(docs.sparkSession) as keep:
        frame = numbered(docs)
        inner = "__pl_row_file"
        at = frame.withColumns({inner: F.col(FILE), "__pl_row_place": F.col(PLACE), PLACE: F.monotonically_increasing_id()})
        rows = sized(at, labels, id_col, text_col, source_col, (PLACE, inner, "__pl_row_place"))
        taken = _taken(rows, WEIGHTS, MOST_PASSES).where("passes > 0")
        marks = taken.select(F.col(inner).alias(FILE), F.col("__pl_row_place").alias(PLACE), F.col("passes").alias("times"))
        return picked(keep(frame), marks, names, keep)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return mix(docs, labels).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH docs AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS draw, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), marks AS (
  SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), keyed AS (
  SELECT d.doc_id, d.source, d.size,
    -ln((CAST(CAST('0x' || substr(d.draw, 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)
      / 1.0::DOUBLE / CASE WHEN m.quality > 0 THEN 2.0::DOUBLE WHEN m.quality <= 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS key
  FROM docs d LEFT JOIN marks m ON d.doc_id = m.doc_id
), per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM docs GROUP BY source
), ranked AS (
  SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS w, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM per_source
), filled AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w
    > cap * sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_full FROM ranked
), levels AS (
  SELECT *, coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0) AS caps, sum(CASE WHEN NOT is_full THEN w END) OVER () AS ws FROM filled
), aims AS (
  SELECT source, source_size,
    CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE CAST((total - caps) * w AS DOUBLE) / CAST(ws AS DOUBLE) END AS target FROM levels
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM aims
), ordered AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM keyed k JOIN parts p ON k.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN size > 0 AND 2 * ahead + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ordered
"""
