"""Readers of documents: files, URLs, table columns."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "path string, modificationTime timestamp, length long, content binary"


def read_documents(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """path, modificationTime, length and content of files; ``path`` may be a folder or a pattern.

    Spark's reader leaves files of no bytes out.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def stream_documents(spark: SparkSession, path: str, glob: str | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """The same for files as they arrive."""
    reader = spark.readStream.format("binaryFile").schema(DOCUMENT).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def fetch(url: str, headers: dict | None = None, ssl_verify: bool = True, timeout: float = 30.0) -> tuple[bytes, str | None]:
    """(content, content type) of an http or https URL."""
    import ssl
    from urllib.request import Request, urlopen

    if not url.lower().startswith(("http://", "https://")):
        raise ValueError(f"only http and https URLs are read, not {url}")
    context = None if ssl_verify else ssl._create_unverified_context()
    with urlopen(Request(url, headers=headers or {}), timeout=timeout, context=context) as r:
        return r.read(), r.headers.get("Content-Type")


def read_urls(
    urls: DataFrame, url_col: str = "url", headers: dict | None = None, ssl_verify: bool = True, timeout: float = 30.0, mode: str = "PERMISSIVE"
) -> DataFrame:
    """Fetch each row's URL once: url, content, content_type, metadata_filename, fetch_error. Other schemes are errors."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            rows = []
            for url in frame["url"]:
                name = (url or "").partition("?")[0].partition("#")[0].rstrip("/").rpartition("/")[2] or None
                try:
                    data, kind = fetch(url or "", headers, ssl_verify, timeout)
                    rows.append((url, data, kind, name, None))
                except (OSError, ValueError) as e:
                    if mode == "FAILFAST":
                        raise
                    rows.append((url, None, None, name, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["url", "content", "content_type", "metadata_filename", "fetch_error"])

    schema = "url string, content binary, content_type string, metadata_filename string, fetch_error string"
    return urls.select(F.col(url_col).alias("url")).mapInPandas(run, schema)
