"""Queries of this subpackage, by name, and their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm.common import table


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file: in the folder named by PAPERLOOM_TOKENIZERS, else that of the package."""
    folder = os.environ.get("PAPERLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.sentencepiece_codec import encode_decode

    return encode_decode(
        table(spark, sf_dir, "documents"),
        tokenizer_path("piece_bpe_32k.model"),
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"),
        keep=["doc_id"],
    )


def op2_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm import mtree

    return mtree.query(table(spark, sf_dir, "embeddings"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm import url_filter

    return url_filter.query(table(spark, sf_dir, "pages"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm import secret_scan

    return secret_scan.query(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm import quality

    return quality.query(table(spark, sf_dir, "documents"))


def op6_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm import sstable

    return sstable.query(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm import simhash

    return simhash.query(table(spark, sf_dir, "documents"))


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm import mixture

    return mixture.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm import language_id

    return language_id.query(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm import warc

    return warc.query(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_mtree": op2_mtree,
        "op3_urls": op3_urls,
        "op4_secrets": op4_secrets,
        "op5_quality": op5_quality,
        "op6_sstable": op6_sstable,
        "op7_simhash": op7_simhash,
        "op8_mixture": op8_mixture,
        "op9_language": op9_language,
        "op10_warc": op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    from paperloom.llm import mixture, mtree

    return {
        "op2_mtree": mtree.SQL,
        "op8_mixture": mixture.SQL,
    }
