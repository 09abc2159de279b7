"""paperloom: documents in, typed elements, chunks and serialized text out, on Spark DataFrames."""

__version__ = "0.1.0"
