"""The document pipeline on streams: map-only from files to elements, so no state and no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from paperloom.operators.partition import explode_elements, partition
from paperloom.sources.documents import stream_documents


def stream_elements(spark: SparkSession, folder: str, glob: str | None = None, **options) -> DataFrame:
    """Elements of documents as they arrive in a folder; documents with errors give no rows here (see ``stream_parsed``)."""
    return explode_elements(partition(stream_documents(spark, folder, glob), **options).drop("content"))


def stream_parsed(spark: SparkSession, folder: str, glob: str | None = None, **options) -> DataFrame:
    """One row for each document as it arrives, with its elements or its error, and ``failed``: nothing is left out.

    Written with ``write_elements``, the table holds the elements (``explode_elements`` of it) and the failures (where
    failed), from one pass over the documents.
    """
    parsed = partition(stream_documents(spark, folder, glob), **options).drop("content")
    return parsed.withColumn("failed", F.col("error").isNotNull())


def write_elements(elements: DataFrame, target: str, checkpoint: str, format: str = "parquet") -> StreamingQuery:
    """Append what has arrived to files, then stop; run again for more."""
    return (
        elements.writeStream.format(format)
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
