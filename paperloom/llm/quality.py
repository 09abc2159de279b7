"""Quality rules: fixed counts over words and lines, and robust multivariate outliers per language and source.

The outlier rule is a minimum-covariance-determinant estimate. A document's transformed statistics are (log of the mean
word length, square root of symbols per word, share of repeated lines, share of words in repeated three-word windows). For
each language and source, the estimate has several starts: the half of the documents nearest to the coordinates' medians,
measured in three ways. Concentration steps refit mean and covariance to the COVERED share of documents with the smallest
Mahalanobis distance; after FIRST steps the start with the least determinant goes on, until a step changes nothing. A
document is rejected if its squared distance passes CUTOFF. Every coordinate has a least spread (FLOOR), added to the
covariance, so that a group in which a statistic is almost constant keeps a usable scale.

All of it is DataFrame expressions: counts by higher-order functions, moments by grouped sums, the Cholesky factor and
distances by column arithmetic, and quantiles by grouped counts of values on a grid (a bounded number of them), added up
before the shuffle; so no group is gathered or sorted, and results don't depend on how rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm.common import materialize, scratch, without

GAP = r"[\x20\x09-\x0D]+"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The transformed statistics, in order, and the least spread (standard deviation) of each.
FLOOR = (0.08, 0.1, 0.15, 0.1)
#: The share of a group's documents that the estimate is fitted to; steps of every start; steps in all, at most.
COVERED, FIRST, MOST_STEPS = 0.75, 2, 30
#: By how much a step must lower the logarithm of the determinant's root, to count.
LEAST_GAIN = 1e-6
#: Squared distances beyond this are outliers: the 0.999 quantile of chi-square with four degrees of freedom (18.47) times
#: what a covariance of the nearest 0.75 lacks there (0.75 / P(chi-square of six < 5.39) = 1.48).
CUTOFF = 18.47 * 1.48
#: Groups with fewer documents are judged by the estimate of their whole language; those of a language with fewer by the table's.
LEAST_ROWS = 30
#: Bins for a doubling of the squared distance.
BINS = 16


def count_words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def with_counts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs) of whole texts; a null text has no words.

    Windows of three words are hashed, and the hash's low bits give way to the window's place; sorted, equal hashes are
    neighbours. What they name is sorted by its words, so equal windows are neighbours and others are not taken for equal,
    whatever their hashes. Columns of the new names are replaced. A very long text is counted whole, in memory.
    """
    docs = without(docs, STATS)
    carried = [f"`{c}`" for c in (keep if keep is not None else docs.columns) if c.lower() not in STATS]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    one = docs.select(
        *carried,
        count_words(text).alias("__w"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(F.translate(x, "\t\x0b\x0c\r", "    "))) > 0).alias("__l"),
    )
    two = one.selectExpr(
        *carried,
        "__w",
        "n_symbols",
        "cast(size(__w) as bigint) as n_words",
        "cast(length(array_join(__w, '')) as bigint) as word_chars",
        "cast(size(__l) - size(array_distinct(__l)) as bigint) as n_dup_lines",
        "size(__w) - 2 as __n",
        "cast(ceil(log2(greatest(size(__w), 2))) as int) as __b",
    )
    three = two.selectExpr(
        "*",
        """case when __n < 2 then cast(array() as array<bigint>) else
             sort_array(transform(sequence(0, __n - 1),
               i -> shiftleft(xxhash64(__w[i], __w[i + 1], __w[i + 2]), __b) | cast(i as bigint))) end as __s""",
    )
    # Places whose hash is found twice, then of these, sorted by their words, the neighbours that agree.
    four = three.selectExpr(
        "*",
        """transform(filter(__s, (x, j) ->
               (j > 0 and shiftright(__s[j - 1], __b) = shiftright(x, __b)) or
               (j + 1 < __n and shiftright(get(__s, j + 1), __b) = shiftright(x, __b))),
             x -> cast(x & (shiftleft(1L, __b) - 1L) as int)) as __p""",
    )
    five = four.selectExpr("*", "sort_array(transform(__p, p -> struct(__w[p] as a, __w[p + 1] as b, __w[p + 2] as c, p as p))) as __r")
    same = "get(__r, {0}).a = x.a and get(__r, {0}).b = x.b and get(__r, {0}).c = x.c"
    six = five.selectExpr(
        "*",
        f"""transform(filter(__r, (x, j) -> (j > 0 and {same.format("j - 1")}) or (j + 1 < size(__r) and {same.format("j + 1")})),
             x -> x.p) as __q""",
    )
    return six.selectExpr(
        *carried,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        """cast(case when size(__q) = 0 then 0 else
             size(array_distinct(flatten(transform(__q, p -> array(p, p + 1, p + 2))))) end as bigint) as n_repeat_words""",
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.sqrt(F.col("n_symbols") / words),
        F.least(F.lit(1.0), 10.0 * F.col("n_dup_lines") / words),
        F.col("n_repeat_words") / words,
    ]


D = len(FLOOR)
X = [f"x{i}" for i in range(D)]
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]


def _exact(c: Column) -> Column:
    """A value in units of 2^-20, whole, so that sums don't depend on the order of rows: the nearest rows' values are small."""
    return F.round(c * float(1 << 20)).cast("long")


def _moments(rows: DataFrame, by: tuple[str, ...] = ("g",)) -> DataFrame:
    """(by..., x...) -> by, means m_i and covariances c_ij with the floors added."""
    sums = [F.count(F.lit(1)).alias("n")]
    sums += [F.sum(_exact(F.col(x))).cast("double").alias(f"s{i}") for i, x in enumerate(X)]
    sums += [F.sum(_exact(F.col(X[i]) * F.col(X[j]))).cast("double").alias(f"s{i}_{j}") for i, j in PAIRS]
    unit = float(1 << 20)
    grouped = rows.groupBy(*by).agg(*sums)
    means = [(F.col(f"s{i}") / unit / F.col("n")).alias(f"m{i}") for i in range(D)]
    grouped = grouped.select("*", *means)
    cov = [
        (F.col(f"s{i}_{j}") / unit / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") + F.lit(FLOOR[i] ** 2 if i == j else 0.0)).alias(f"c{i}_{j}")
        for i, j in PAIRS
    ]
    return grouped.select(*by, *[f"m{i}" for i in range(D)], *cov)


def _cholesky(moments: DataFrame, by: tuple[str, ...] = ("g",)) -> DataFrame:
    """The means, the lower factor l_ij of the covariance, and ``volume``, the logarithm of its determinant's root."""
    df = moments
    for i in range(D):
        for j in range(i + 1):
            v = F.col(f"c{i}_{j}")
            for k in range(j):
                v = v - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            df = df.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(v, F.lit(1e-9))) if i == j else v / F.col(f"l{j}_{j}"))
    volume = sum((F.log(f"l{i}_{i}") for i in range(1, D)), F.log("l0_0"))
    return df.select(*by, *[f"m{i}" for i in range(D)], *[f"l{i}_{j}" for i, j in PAIRS], volume.alias("volume"))


def _distance(rows: DataFrame, factors: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """rows (g, x...) with ``d2``, the squared Mahalanobis distance to their group's estimate (to each of several)."""
    df = rows.join(factors, "g")
    for i in range(D):
        v = F.col(X[i]) - F.col(f"m{i}")
        for k in range(i):
            v = v - F.col(f"l{i}_{k}") * F.col(f"y{k}")
        df = df.withColumn(f"y{i}", v / F.col(f"l{i}_{i}"))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, D)), F.col("y0") * F.col("y0"))
    return df.withColumn("d2", d2).select(*rows.columns, *carried, "d2")


def _bin(value: Column) -> Column:
    """A place on a grid of BINS steps a doubling, from 1e-6 to 1e6."""
    return F.floor(F.log2(F.least(F.greatest(value, F.lit(1e-6)), F.lit(1e6))) * BINS).cast("int")


def _quantile(grid: str, share: float) -> Column:
    """The exact quantile of whole numbers; their counts are added up before the shuffle."""
    return F.expr(f"percentile_disc({share}) within group (order by {grid})")


def _nearest(rows: DataFrame, share: float, by: tuple[str, ...] = ("g",)) -> DataFrame:
    """The rows of each group in the bins of ``d2`` up to the one that holds the share's last row."""
    binned = rows.withColumn("bin", _bin(F.col("d2")))
    limits = binned.groupBy(*by).agg(_quantile("bin", share).alias("limit"))
    limits = materialize(limits, "limits")  # a row per group: its size decides how it is joined
    return binned.join(limits, list(by)).where(F.col("bin") <= F.col("limit"))


def _middles(rows: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """(g, names...): the medians of columns on a grid of 2^-10; a row per group, written for its size."""
    step = 1024.0
    grids = rows.select("g", *[F.least(F.floor(F.col(c) * step), F.lit(1 << 14)).alias(n) for c, n in zip(columns, names)])
    return materialize(grids.groupBy("g").agg(*[((_quantile(n, 0.5) + 0.5) / step).alias(n) for n in names]), "medians")


def _step(rows: DataFrame, factors: DataFrame, by: tuple[str, ...] = ("g",)) -> DataFrame:
    """A concentration step: the estimates of the documents nearest to the estimates so far."""
    near = _nearest(_distance(rows, factors, by[1:]), COVERED, by)
    return materialize(_cholesky(_moments(near, by), by), "estimate")


def estimates(rows: DataFrame) -> DataFrame:
    """(g, x...) of documents that no fixed rule rejects -> g, means and Cholesky factors of the least determinant found."""
    centred = rows.join(_middles(rows, X, [f"med{i}" for i in range(D)]), "g")
    centred = centred.select("g", *X, *[F.abs(F.col(x) - F.col(f"med{i}")).alias(f"a{i}") for i, x in enumerate(X)])
    scaled = centred.join(_middles(centred, [f"a{i}" for i in range(D)], [f"mad{i}" for i in range(D)]), "g")
    by_spread = [F.pow(F.col(f"a{i}") / F.greatest(1.4826 * F.col(f"mad{i}"), F.lit(FLOOR[i])), 2) for i in range(D)]
    by_floor = [F.pow(F.col(f"a{i}") / FLOOR[i], 2) for i in range(D)]
    starts = F.array(sum(by_spread[1:], by_spread[0]), sum(by_floor[1:], by_floor[0]), F.greatest(*by_spread))
    each = scaled.select("g", *X, F.posexplode(starts).alias("start", "d2"))
    both = ("g", "start")
    factors = materialize(_cholesky(_moments(_nearest(each, 0.5, both), both), both), "estimate")
    for _ in range(FIRST):
        factors = _step(rows, factors, both)
    values = [c for c in factors.columns if c not in both]
    best = factors.groupBy("g").agg(F.min(F.struct("volume", "start", *[c for c in values if c != "volume"])).alias("x"))
    active = materialize(best.select("g", *[f"x.{c}" for c in values]), "estimate")
    found = active.limit(0)
    for _ in range(MOST_STEPS):
        # Only groups whose determinant still falls go on; a step that doesn't lower it is not taken.
        old = active.select("g", F.col("volume").alias("old"))
        better = materialize(_step(rows, active).join(old, "g").where(F.col("volume") < F.col("old") - LEAST_GAIN).drop("old"), "better")
        found = found.unionByName(active.join(better.select("g"), "g", "left_anti"))
        active = better
        if active.isEmpty():
            break
    return materialize(found.unionByName(active), "estimates").drop("volume")


def judged(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", ids: list[str] | None = None) -> DataFrame:
    """Columns ``ids`` (default: all but the text; one named like a new column is replaced) with the five counts, ``base_failed`` and ``kept``.

    Groups are (language, source), null being a value of its own; a group with fewer than LEAST_ROWS documents is judged by
    an estimate of all documents of its language, and, where these are fewer too, by one of all documents of the table.
    Documents that the fixed rules reject take no part in the estimates. A null text has no words and fails; repeated rows
    stay and count each time; ties in distance fall on one side together; an empty table gives no rows.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(_judged(docs, text_col, lang_col, source_col, ids))


def _judged(docs: DataFrame, text_col: str, lang_col: str, source_col: str, ids: list[str] | None) -> DataFrame:
    ids = ids if ids is not None else [c for c in docs.columns if c != text_col]
    frame = docs.select(
        *[F.col(f"`{c}`").alias(f"__id{k}") for k, c in enumerate(ids)],
        F.col(f"`{lang_col}`").alias("__lang"),
        F.col(f"`{source_col}`").alias("__source"),
        F.col(f"`{text_col}`").alias("__text"),
    )
    carried = [f"__id{k}" for k in range(len(ids))]
    counted = with_counts(frame, "__text", keep=[*carried, "__lang", "__source"]).withColumn("base_failed", base_failed())
    counted = materialize(counted, "counts")
    names = [F.struct(F.lit(2).alias("k"), F.col("__lang").alias("lang"), F.col("__source").alias("source")),
             F.struct(F.lit(1).alias("k"), F.col("__lang").alias("lang"), F.lit(None).cast("string").alias("source")),
             F.struct(F.lit(0).alias("k"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"))]
    pairs = counted.where(~F.col("base_failed")).groupBy("__lang", "__source").agg(F.count(F.lit(1)).alias("n"))
    in_lang = Window.partitionBy("__lang")
    pairs = pairs.withColumns({"in_lang": F.sum("n").over(in_lang), "least": F.min("n").over(in_lang)})
    pairs = pairs.select(
        F.col("__lang").alias("l"),
        F.col("__source").alias("s"),
        *[F.to_json(name).alias(f"g{2 - k}") for k, name in enumerate(names)],
        (F.col("n") >= LEAST_ROWS).alias("own"),
        (F.col("in_lang") >= LEAST_ROWS).alias("large_lang"),
        (F.col("least") < LEAST_ROWS).alias("small_parts"),
    )
    pairs = materialize(pairs, "groups")
    # What judges a pair's documents, and the estimates that they are part of: no language or table is fitted for nothing.
    whole = not pairs.where("not large_lang").isEmpty()
    parts = [F.when(F.col("own"), F.col("g2")), F.when(F.col("large_lang") & F.col("small_parts"), F.col("g1"))]
    parts += [F.col("g0")] if whole else []
    judge = F.when(F.col("own"), F.col("g2")).when(F.col("large_lang"), F.col("g1")).otherwise(F.col("g0"))
    pairs = pairs.select("l", "s", judge.alias("g"), F.array_compact(F.array(*parts)).alias("parts"))
    placed = counted.join(
        pairs, F.col("__lang").eqNullSafe(F.col("l")) & F.col("__source").eqNullSafe(F.col("s")), "left"
    ).drop("l", "s")
    placed = placed.select("*", *[v.alias(x) for v, x in zip(_vector(), X)])
    fitted = materialize(placed.where(~F.col("base_failed")).select(F.explode("parts").alias("g"), *X), "vectors")
    factors = estimates(fitted)
    passed = _distance(placed.where(~F.col("base_failed")), factors).withColumn("kept", F.col("d2") <= CUTOFF)
    failed = placed.where("base_failed").withColumn("kept", F.lit(False))
    out = [*carried, *STATS, "base_failed", "kept"]
    both = passed.select(*out).unionByName(failed.select(*out))
    taken = {*STATS, "base_failed", "kept"}
    shown = [F.col(f"__id{k}").alias(c) for k, c in enumerate(ids) if c.lower() not in taken]
    return both.select(*shown, *STATS, "base_failed", "kept")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns as they are."""
    inner = [f"__col{k}" for k in range(len(docs.columns))]
    at = dict(zip(docs.columns, inner))
    found = judged(docs.toDF(*inner), at[text_col], at[lang_col], at[source_col], ids=inner)
    return found.where("kept").select(*[F.col(i).alias(c) for c, i in at.items()])


def query(docs: DataFrame) -> DataFrame:
    return judged(docs, ids=["doc_id"])
