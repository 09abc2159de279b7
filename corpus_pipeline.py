"""A training corpus from raw documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run`` writes as Parquet in the shared folder
and reads again as the next stage's ``docs``. All but the last return the columns of documents.

1. quality: documents that the quality rules reject go; so do all without text, or with a null one.
2. near_dedup: of each group of near-duplicates, the document with the smallest id stays (null ids last; of repeated rows,
   one). Groups are what links connect: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
3. secrets: found secrets are masked in the text and n_chars follows; no document goes.
4. mixture: each document is repeated as often as the mix of sources takes it, or goes if the mix takes it never. A null
   source is a source of its own.
5. tokens: SentencePiece ids of every text, with their number and digests of the ids and of the decoded text.

Texts are whole in every stage, however long. Extra columns are carried through stages 1 to 4, whatever their names; the
last stage returns doc_id, lang and source with its own. An empty table gives an empty one in every stage.

What a stage's result still reads of its scratch tables goes when the next stage begins, whose input is written by then.

SQL can't express the trained and hashed stages, so there is none; the tests hold run() against a plain version.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import mixture, near_dedup, quality, secret_scan, sentencepiece_codec
from paperloom.llm.common import delete, held, materialize, table
from paperloom.llm.registry import tokenizer_path

#: Rows of an Arrow batch, at most: what a worker holds at a time follows it.
BATCH_ROWS = 1000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Scratch tables that the last stage's result reads.
_READ: list[str] = []


def _stage(made):
    """``made``, after what earlier stages left is deleted, unless ``docs`` still reads it.

    The session's Arrow batches become smaller where they are larger than BATCH_ROWS; they stay so, as a stage's work is
    done when its result is written.
    """

    @wraps(made)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rows = int(spark.conf.get(ARROW_ROWS))
        if not 0 < rows <= BATCH_ROWS:
            spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))
        used = docs.inputFiles()
        needed = [p for p in _READ if any(f"/{p.rpartition('/')[2]}/" in u for u in used)]
        delete(spark, [p for p in _READ if p not in needed])
        _READ[:] = needed
        with held(_READ):
            return made(spark, docs, sf_dir)

    return run_stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secret_scan.redact(docs)
    n_chars = F.when(F.col("text").isNotNull(), F.length("text").cast("long"))
    return masked.withColumn("n_chars", n_chars).select(*docs.columns)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.apply_mix(docs, table(spark, sf_dir, "labels"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_decode(
        docs,
        tokenizer_path("piece_bpe_32k.model"),
        outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"),
        keep=["doc_id", "lang", "source"],
    )


STAGES = [
    ("quality", _stage(quality_stage)),
    ("near_dedup", _stage(near_dedup_stage)),
    ("secrets", _stage(secrets_stage)),
    ("mixture", _stage(mixture_stage)),
    ("tokens", _stage(tokens_stage)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        out, now = stage(spark, docs, sf_dir), []
        with held(now):
            docs = materialize(out, f"stage-{name}")
        delete(spark, before)
        before = now
    return STAGES[-1][1](spark, docs, sf_dir)
