"""URL filters: explicit rules first, then gradient-boosted trees on lexical features.

Rules name a host, which fits itself and its subdomains, and the start of a path; the longest fitting rule decides. The
trees judge the other URLs. They are trained on URLs that the rules label (allow 0, block 1), from features of the URL
alone: lengths, depth, digit ratio, character entropy, number of parameters, and smoothed block rates of its suffixes (the
host's last one and two labels, its first path segment), which are counted over all labelled URLs. A training URL's rates
are out of fold: counted over the labelled URLs of the other folds, so that its own label is no part of them.

Everything is DataFrame expressions and the DataFrame API of Spark's tree ensembles; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import materialize, without

#: (verdict, host, start of the path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Labelled URLs that the trees are fitted to, at most: those with the least hash.
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 20, 4, 11
#: A suffix's block rate counts this many labelled URLs of the average rate besides its own.
SMOOTHING = 20.0
#: Labelled URLs are dealt to so many folds by a hash.
FOLDS = 5
#: Suffixes with fewer labelled URLs than this keep the average rate.
LEAST_SUFFIX = 5
FEATURES = (
    "f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digits", "f_host_digits", "f_hyphens",
    "f_params", "f_fragment", "f_entropy", "f_rate1", "f_rate2", "f_rate_segment",
)


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then up to ``?``, ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict), null where no rule fits: the longest first, the earlier first among equals."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.split(text, "")
    n = F.greatest(F.size(chars), F.lit(1)).cast("double")
    parts_ = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.aggregate(parts_, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def lexical(df: DataFrame) -> DataFrame:
    """Adds the features that need no labels, and the suffixes, to (url, host, path)."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    count = lambda c, p: F.regexp_count(c, F.lit(p)).cast("double")
    length = lambda c: F.length(c).cast("double")
    return df.withColumns(
        {
            "f_length": length(url),
            "f_host_length": length(F.col("host")),
            "f_path_length": length(F.col("path")),
            "f_depth": count(F.col("path"), "/[^/]"),
            "f_labels": count(F.col("host"), r"[^.]+"),
            "f_digits": count(url, "[0-9]") / F.greatest(length(url), F.lit(1.0)),
            "f_host_digits": count(F.col("host"), "[0-9]"),
            "f_hyphens": count(url, "[-_]"),
            "f_params": count(query, "[^&]+"),
            "f_fragment": F.instr(url, "#").cast("boolean").cast("double"),
            "f_entropy": entropy(url),
            "suffix1": F.substring_index("host", ".", -1),
            "suffix2": F.substring_index("host", ".", -2),
            "segment": F.regexp_extract("path", r"^/([^/]*)", 1),
        }
    )


def _rates(labelled: DataFrame, column: str, mean: float) -> DataFrame:
    """(suffix, rate, rates by fold left out) for suffixes with enough labelled URLs; Spark may broadcast it if it is small."""
    sums = [F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad")]
    for k in range(FOLDS):
        inside = F.col("fold") == k
        sums += [F.count(F.when(inside, 1)).alias(f"n{k}"), F.coalesce(F.sum(F.when(inside, F.col("label"))), F.lit(0.0)).alias(f"bad{k}")]
    counted = labelled.groupBy(column).agg(*sums).where(f"n >= {LEAST_SUFFIX}")
    smooth = lambda bad, n: (bad + SMOOTHING * mean) / (n + SMOOTHING)
    without_fold = F.array(*[smooth(F.col("bad") - F.col(f"bad{k}"), F.col("n") - F.col(f"n{k}")) for k in range(FOLDS)])
    rates = counted.select(F.col(column).alias(f"key_{column}"), smooth(F.col("bad"), F.col("n")).alias("rate"), without_fold.alias("out_of_fold"))
    return materialize(rates, f"rates-{column}")


def judge(pages: DataFrame, url_col: str = "url", rules=RULES, keep: list[str] | None = None) -> DataFrame:
    """Add host, path, rule, verdict and ``block_probability`` (null where a rule decides) to each row.

    A null URL, or one without ``://``, has an empty host and path and is judged by the trees, whose features then describe
    an empty URL; a very long one is judged whole. Without labelled URLs of both verdicts the trees can't be trained, and what no rule fits is allowed.
    Rows stay as they are; columns of the new names are replaced; an empty table gives an empty one.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    added = ["host", "path", "rule", "verdict", "block_probability"]
    carried = keep if keep is not None else without(pages, added).columns
    host, path = parts(F.coalesce(F.col("url"), F.lit("")))
    frame = pages.select(*[F.col(f"`{c}`").alias(f"__c{k}") for k, c in enumerate(carried)], F.col(f"`{url_col}`").alias("url"))
    frame = frame.withColumns({"host": host, "path": path})
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    frame = materialize(frame.withColumns({"rule": rule, "by_rule": verdict}), "urls")
    here = [f"__c{k}" for k in range(len(carried))]

    def named(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(h).alias(c) for h, c in zip(here, carried)], *added)

    labelled = lexical(frame.where("by_rule is not null").withColumn("label", (F.col("by_rule") == "block").cast("double")))
    labelled = labelled.withColumn("fold", F.pmod(F.xxhash64("url", F.lit(1)), F.lit(FOLDS)).cast("int"))
    total = labelled.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("bad")).first()
    if not 0 < total["bad"] < total["n"]:
        return named(
            frame.withColumns({"verdict": F.coalesce("by_rule", F.lit("allow")), "block_probability": F.lit(None).cast("double")})
        )
    mean = total["bad"] / total["n"]
    rates = {c: _rates(labelled, c, mean) for c in ("suffix1", "suffix2", "segment")}

    def with_rates(df: DataFrame, training: bool = False) -> DataFrame:
        for (column, table), name in zip(rates.items(), ("f_rate1", "f_rate2", "f_rate_segment")):
            df = df.join(table, F.col(column) == F.col(f"key_{column}"), "left")
            rate = F.get("out_of_fold", F.col("fold")) if training else F.col("rate")
            df = df.withColumn(name, F.coalesce(rate, F.lit(mean))).drop(f"key_{column}", "rate", "out_of_fold")
        return df

    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    # A threshold on the hash lets about twice as many rows pass as are wanted, of any number.
    span = 1 << 30
    share = min(span, 2 * TRAIN_ROWS * span // total["n"] + 1)
    few = labelled.where(F.pmod(F.xxhash64("url"), F.lit(span)) < share).dropDuplicates(["url"])  # copies of a URL count once
    few = few.orderBy(F.xxhash64("url"), "url").limit(TRAIN_ROWS)
    sample = materialize(assembler.transform(with_rates(few, True)).select("features", "label"), "labelled-urls")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=32).fit(sample)
    open_ = with_rates(lexical(frame.where("by_rule is null")))
    scored = trees.transform(assembler.transform(open_)).withColumn("block_probability", vector_to_array("probability")[1])
    scored = scored.withColumn("verdict", F.when(F.col("block_probability") > 0.5, "block").otherwise("allow"))
    fixed = frame.where("by_rule is not null").withColumns({"verdict": F.col("by_rule"), "block_probability": F.lit(None).cast("double")})
    return named(fixed.select(*here, *added).unionByName(scored.select(*here, *added)))


def query(pages: DataFrame) -> DataFrame:
    return judge(pages, keep=["page_id"]).select("page_id", "host", "path", "rule", "verdict", "block_probability")
