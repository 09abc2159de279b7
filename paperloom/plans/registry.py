"""Queries of the document engine over the test tables, by name, and DuckDB SQL with the same rows where SQL can say it.

Every query reads whole tables and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import cleaners, lexicon, tables, text_rules
from paperloom.plans import formats
from paperloom.operators import chunking, relational, staging
from paperloom.operators import partition as parts

FLAGSHIP = "partition_text"

Query = Callable[[SparkSession, str], DataFrame]

# --- SQL fragments ----------------------------------------------------------------------------------------------------

WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WS = WS.replace("[", "[^", 1)
GLYPHS = "".join(rf"\x{{{ord(c):X}}}" for c in lexicon.BULLETS)


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{WS}+|{WS}+\z', '', 'g')"


LINES = r"SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL"


def spread(df: DataFrame) -> DataFrame:
    """A table that comes in fewer splits than there are cores is dealt out; a larger one stays as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.split("text", "\n", -1)
    return documents(spark, sf_dir).select("doc_id", F.posexplode(split).alias("k", "line")).select("doc_id", (F.col("k") + 1).cast("long").alias("n"), "line")


# --- cleaners: one column each over all texts -------------------------------------------------------------------------

_NO_STOP = rf"regexp_replace({sql_strip('lower(text)')}, '[.,:;]+\z', '')"
_NO_DASH = sql_strip(rf"regexp_replace({_NO_STOP}, '[\-\x{{2010}}-\x{{2015}}]', ' ', 'g')")
CLEAN_SQL = sql_strip(f"trim(regexp_replace({_NO_DASH}, '{WS}+', ' ', 'g'))")
CLEANERS: dict[str, tuple[Callable, str | None]] = {
    "clean_non_ascii_chars": (cleaners.clean_non_ascii_chars, r"regexp_replace(text, '[^\x00-\x7F]', '', 'g')"),
    "clean_ligatures": (
        cleaners.clean_ligatures,
        "".join("replace(" for _ in lexicon.LIGATURES) + "text" + "".join(f", '{a}', '{b}')" for a, b in lexicon.LIGATURES),
    ),
    "replace_unicode_quotes": (
        cleaners.replace_unicode_quotes,
        "".join("replace(" for _ in lexicon.QUOTES)
        + "text"
        + "".join(", " + " || ".join(f"chr({ord(c)})" for c in a) + f", chr({ord(b)}))" for a, b in lexicon.QUOTES),
    ),
    "remove_punctuation": (cleaners.remove_punctuation, r"regexp_replace(text, '\pP', '', 'g')"),
    "clean_extra_whitespace": (cleaners.clean_extra_whitespace, f"trim(regexp_replace(text, '{WS}+', ' ', 'g'))"),
    "clean_dashes": (
        cleaners.clean_dashes,
        sql_strip(r"regexp_replace(text, '[\-\x{2010}-\x{2015}]', ' ', 'g')"),
    ),
    "clean_trailing_punctuation": (cleaners.clean_trailing_punctuation, rf"regexp_replace({sql_strip('text')}, '[.,:;]+\z', '')"),
    "clean_prefix": (
        lambda c: cleaners.clean_prefix(c, "(?:the|all|die|les|los) ?", ignore_case=True),
        rf"regexp_replace(regexp_replace(text, '(?i)\A(?:(?:the|all|die|les|los) ?)', ''), '\A{WS}+', '')",
    ),
    "clean_postfix": (
        lambda c: cleaners.clean_postfix(c, r"[a-z]\.", ignore_case=True),
        rf"regexp_replace(regexp_replace(text, '(?i)[a-z]\.\z', ''), '{WS}+\z', '')",
    ),
    "clean": (
        lambda c: cleaners.clean(c, extra_whitespace=True, dashes=True, trailing_punctuation=True, lowercase=True),
        CLEAN_SQL,
    ),
}


def cleaner_query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return documents(spark, sf_dir).select("doc_id", CLEANERS[name][0](F.col("text")).alias("cleaned"))

    return run


def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bullets and outline numbers of every line."""
    line = F.col("line")
    return lines(spark, sf_dir).select(
        "doc_id", "n", cleaners.clean_bullets(line).alias("no_bullet"), cleaners.clean_ordered_bullets(line).alias("no_number")
    )


CLEAN_LINES_SQL = rf"""
WITH lines AS ({LINES}), heads AS (
  SELECT *, regexp_extract(line, '\A{WS}*({NOT_WS}+){WS}+{NOT_WS}', 1) AS head FROM lines
)
SELECT doc_id, n,
  CASE WHEN regexp_matches(line, '^{WS}*(?:[{GLYPHS}]|[-*+\x{{2013}}\x{{2014}}]{WS})')
    THEN {sql_strip(rf"regexp_replace(line, '^{WS}*(?:[{GLYPHS}]+|[-*+\x{{2013}}\x{{2014}}]{WS}){WS}*', '')")} ELSE line END AS no_bullet,
  CASE WHEN regexp_matches(head, '\A[A-Za-z0-9]{{1,2}}(?:\.[A-Za-z0-9]{{1,2}}){{0,2}}\.?\z') AND contains(head, '.') AND NOT contains(head, '..')
    THEN regexp_replace(line, '\A{WS}*{NOT_WS}+{WS}+', '') ELSE line END AS no_number
FROM heads
"""

# --- predicates on lines ----------------------------------------------------------------------------------------------


def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("line")
    return lines(spark, sf_dir).select(
        "doc_id",
        "n",
        text_rules.is_bulleted_text(c).alias("bulleted"),
        text_rules.is_email_address(c).alias("email"),
        text_rules.is_us_city_state_zip(c).alias("city_zip"),
        text_rules.contains_us_phone_number(c).alias("phone"),
        text_rules.is_possible_numbered_list(c).alias("numbered"),
        text_rules.under_non_alpha_ratio(c).alias("few_letters"),
    )


LINE_KINDS_SQL = rf"""
WITH lines AS ({LINES}), counted AS (
  SELECT *, {sql_strip("line")} AS bare, length(regexp_replace(line, '{WS}', '', 'g')) AS seen,
    length(line) - length(regexp_replace(line, '\pL', '', 'g')) AS letters FROM lines
)
SELECT doc_id, n,
  regexp_matches(line, '^{WS}*(?:[{GLYPHS}]|[-*+\x{{2013}}\x{{2014}}]{WS})') AS bulleted,
  regexp_matches(bare, '\A[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}}\z') AS email,
  regexp_matches(bare, '(?i)\A[A-Za-z][A-Za-z .''\-]*,\s*(?:{lexicon.US_STATES}|{lexicon.US_STATE_CODES}),?\s+\d{{5}}(?:-\d{{4}})?\z') AS city_zip,
  regexp_matches(line, '(?:\+?1[\s.-]?)?(?:\(\d{{3}}\)\s?|\b\d{{3}}[\s.-])?\b\d{{3}}[\s.-]\d{{4}}\b') AS phone,
  regexp_matches(line, '\A{WS}*\d{{1,3}}(?:\.\d{{1,3}})*[.)]{WS}+{NOT_WS}') AS numbered,
  coalesce(seen > 0 AND letters / seen < 0.5, false) AS few_letters
FROM counted
"""


def text_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter share, capitalized share and number of word tokens of every text."""
    c = F.col("text")
    return documents(spark, sf_dir).select(
        "doc_id",
        text_rules.alpha_ratio(c).alias("alpha_ratio"),
        text_rules.capital_share(c).alias("capital_share"),
        F.size(text_rules.word_tokenize(c)).cast("long").alias("n_tokens"),
    )


TEXT_RATIOS_SQL = rf"""
WITH t AS (
  SELECT doc_id, length(regexp_replace(text, '{WS}', '', 'g')) AS seen, length(text) - length(regexp_replace(text, '\pL', '', 'g')) AS letters,
    regexp_extract_all(text, '[\pL\pN_]+(?:[''\x{{2019}}-][\pL\pN_]+)*|[^\pL\pN_\x09-\x0D\x1C-\x20\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]') AS tokens
  FROM documents
), w AS (SELECT *, list_filter(tokens, lambda x: regexp_matches(x, '\A\pL+\z')) AS words FROM t)
SELECT doc_id, CASE WHEN seen > 0 THEN letters / seen END AS alpha_ratio,
  CASE WHEN len(words) > 0 THEN
    len(list_filter(words, lambda x: regexp_matches(x, '\A(?:[\p{{Lu}}\p{{Lt}}][^\p{{Lu}}\p{{Lt}}]*|[^\p{{Ll}}\p{{Lt}}]*\p{{Lu}}[^\p{{Ll}}\p{{Lt}}]*)\z'))) / len(words) END AS capital_share,
  CAST(len(tokens) AS BIGINT) AS n_tokens
FROM w
"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return documents(spark, sf_dir).select(
        "doc_id",
        text_rules.sentence_count(c).alias("n_sentences"),
        text_rules.sentence_count(c, 3).alias("n_of_three_words"),
        text_rules.contains_verb(c).alias("has_verb"),
        text_rules.is_possible_narrative_text(c).alias("narrative"),
        text_rules.is_possible_title(c).alias("title"),
    )


# --- partitioning and enrichment --------------------------------------------------------------------------------------


def partition_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed elements of every document, with ids, parents and languages."""
    return parts.explode_elements(parts.partition_text(documents(spark, sf_dir).select("doc_id", "text")).drop("text"))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of every document, with their hash ids."""
    docs = documents(spark, sf_dir).select("doc_id", F.posexplode_outer(parts.paragraphs(F.col("text"))).alias("pos", "text"))
    docs = docs.where("pos is not null")
    return relational.assign_ids(docs).select("doc_id", F.col("pos").cast("long").alias("pos"), "text", "element_id")


# Paragraph rule of the texts that have few blank lines; others are left to the golden tests.
PARAGRAPHS_SQL = rf"""
WITH parts AS (
  SELECT doc_id, list_filter([{sql_strip('x')} for x in string_split(text, chr(10))], lambda x: x <> ''
    AND NOT (regexp_matches(x, '^(?:[{GLYPHS}]|[-*+\x{{2013}}\x{{2014}}]{WS})') AND
      {sql_strip(rf"regexp_replace(x, '^(?:[{GLYPHS}]+|[-*+\x{{2013}}\x{{2014}}]{WS}){WS}*', '')")} = '')) AS p
  FROM documents
), e AS (SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS pos FROM parts)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, text, substr(sha256('None' || text || 'None' || CAST(pos AS VARCHAR)), 1, 32) AS element_id FROM e
"""


def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text_rules.detect_language(F.col("text")).alias("language"))


_HITS = ", ".join(
    f"{{'n': len(list_filter(words, lambda w: w IN ({', '.join(repr(w) for w in dict.fromkeys(p.split()))}))), 'k': {-k}, 'c': '{code}'}}"
    for k, (code, p) in enumerate(lexicon.PROFILES.items())
)
DETECT_LANGUAGE_SQL = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(substr(text, 1, 20000)), '\pL+') AS words FROM documents),
best AS (SELECT doc_id, list_max([{_HITS}]) AS b FROM t)
SELECT doc_id, CASE WHEN b.n > 0 THEN b.c END AS language FROM best
"""


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of conversation turns read as elements: system is a header, users' turns are titles, the rest is prose."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    kind = F.when(F.col("role") == "system", "Header").when(F.col("role") == "user", "Title").otherwise("NarrativeText")
    ident = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", kind.alias("type"), ident.alias("element_id")))).alias("e"))
    e = F.transform("e", lambda x: F.struct(x["type"].alias("type"), F.lit(0).alias("depth"), x["element_id"].alias("element_id")))
    found = grouped.select("conv_id", F.arrays_zip(F.col("e").alias("e"), relational.parents(e).alias("p")).alias("z"))
    return found.select("conv_id", F.explode("z").alias("z")).select("conv_id", F.col("z.e.turn").alias("turn"), F.col("z.p").alias("parent_id"))


# With depths all zero, a turn's parent is the last header or title that no other kind has closed: found from the last
# header, and the last user turn, before it.
HIERARCHY_SQL = """
WITH t AS (
  SELECT conv_id, turn, CASE role WHEN 'system' THEN 'H' WHEN 'user' THEN 'T' ELSE 'N' END AS kind,
    CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id FROM conversations
), w AS (
  SELECT *, last_value(CASE WHEN kind = 'H' THEN turn END IGNORE NULLS) OVER b AS h, last_value(CASE WHEN kind = 'T' THEN turn END IGNORE NULLS) OVER b AS u
  FROM t WINDOW b AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT conv_id, turn, CASE
    WHEN kind = 'H' THEN NULL
    WHEN kind = 'T' AND h IS NOT NULL THEN CAST(conv_id AS VARCHAR) || '-' || CAST(h AS VARCHAR)
    WHEN kind = 'N' AND u IS NOT NULL AND (h IS NULL OR u > h) THEN CAST(conv_id AS VARCHAR) || '-' || CAST(u AS VARCHAR)
    WHEN kind = 'N' AND h IS NOT NULL THEN CAST(conv_id AS VARCHAR) || '-' || CAST(h AS VARCHAR)
  END AS parent_id
FROM w
"""


def partition_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))
    found = parts.partition_column(pages, "html", "text/html").drop("html", "error")
    return parts.explode_elements(found).select("page_id", "pos", "type", "text", "element_id", "metadata", F.to_json("metadata").alias("facts")).drop("metadata")


def chunk_query(strategy: str, **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = documents(spark, sf_dir).select("doc_id", F.encode("text", "UTF-8").alias("content"))
        found = parts.partition(docs, content_type="text/plain", encoding="utf-8").drop("content", "error")
        out = chunking.chunk_documents(found, strategy, **options).drop("elements")
        return parts.explode_elements(out, "chunks").select("doc_id", "pos", "type", "text", "element_id", F.size("orig_elements").alias("n_elements"))

    return run


def partition_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of each nation as a CSV document, read back as one table."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    line = F.concat_ws(",", F.col("s_suppkey").cast("string"), F.col("s_name"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", line.alias("l")))), lambda x: x["l"]), "\n")
    docs = s.groupBy("s_nationkey").agg(body.alias("csv"))
    out = parts.partition_column(docs, "csv", "text/csv", delimiter=",").drop("csv", "error")
    return parts.explode_elements(out).select("s_nationkey", "type", "text", F.col("metadata.text_as_html").alias("html"))


PARTITION_CSV_SQL = """
SELECT s_nationkey, 'Table' AS type, string_agg(CAST(s_suppkey AS VARCHAR) || ' ' || s_name, ' ' ORDER BY s_suppkey) AS text,
  '<table>' || string_agg('<tr><td>' || CAST(s_suppkey AS VARCHAR) || '</td><td>' || s_name || '</td></tr>', '' ORDER BY s_suppkey) || '</table>' AS html
FROM supplier GROUP BY s_nationkey
"""


def table_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native rendering of each nation's suppliers as HTML and text."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    row = F.struct("s_suppkey", F.array(F.col("s_suppkey").cast("string"), F.col("s_name")).alias("r"))
    docs = s.groupBy("s_nationkey").agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["r"]).alias("rows"))
    return docs.select("s_nationkey", tables.table_text_column(F.col("rows")).alias("text"), tables.table_html_column(F.col("rows")).alias("html"))


def elements_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parts.partition_text(documents(spark, sf_dir).select("doc_id", "text"))
    return docs.select("doc_id", staging.text_of(F.col("elements")).alias("rendered"))


def elements_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.encode("text", "UTF-8").alias("content"))
    found = parts.partition(docs, content_type="text/plain", encoding="utf-8").drop("content", "error")
    return staging.with_ndjson(staging.with_packed_json(found)).drop("elements")


def filter_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.filter_element_types(partition_text(spark, sf_dir), include=["Title", "ListItem"]).select("doc_id", "pos", "type", "text")


def queries() -> dict[str, Query]:
    return {
        **{name: cleaner_query(name) for name in CLEANERS},
        "clean_lines": clean_lines,
        "line_kinds": line_kinds,
        "text_ratios": text_ratios,
        "sentences": sentences,
        "partition_text": partition_text,
        "paragraphs": paragraphs,
        "detect_language": detect_language,
        "hierarchy": hierarchy,
        "partition_html": partition_html,
        "partition_csv": partition_csv,
        "table_rendering": table_rendering,
        "chunk_basic": chunk_query("basic", max_characters=500, overlap=20),
        "chunk_by_title": chunk_query("by_title", max_characters=1000, new_after_n_chars=800),
        "elements_to_text": elements_to_text,
        "elements_to_json": elements_to_json,
        "filter_types": filter_types,
        **formats.queries(),
    }


def oracle_sql() -> dict[str, str]:
    return {
        **{name: f"SELECT doc_id, {sql} AS cleaned FROM documents" for name, (_, sql) in CLEANERS.items() if sql},
        "clean_lines": CLEAN_LINES_SQL,
        "line_kinds": LINE_KINDS_SQL,
        "text_ratios": TEXT_RATIOS_SQL,
        "paragraphs": PARAGRAPHS_SQL,
        "detect_language": DETECT_LANGUAGE_SQL,
        "hierarchy": HIERARCHY_SQL,
        "partition_csv": PARTITION_CSV_SQL,
        "table_rendering": PARTITION_CSV_SQL.replace("'Table' AS type, ", ""),
        **formats.oracle_sql(),
    }
