"""Elements out: JSON, NDJSON, packed JSON, Markdown, CSV and text of documents; filters and flattening of element tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.operators import serialize
from paperloom.operators.arrow import map_column
from paperloom.operators.chunking import from_row
from paperloom.operators.schema import CHUNK_TYPE, READ_AS, row


def _rendered(render):
    def make(elements):
        return None if elements is None else render([_element(e) for e in elements])

    return make


def _element(r: dict) -> dict:
    e = from_row(r)
    if e.get("orig_elements"):
        e["orig_elements"] = [_element(x) for x in e["orig_elements"]]
    return e


def with_json(docs: DataFrame, column: str = "elements", output: str = "json", indent: int | None = 4) -> DataFrame:
    """A document's elements as a JSON array: sorted keys, ASCII, indented."""
    return map_column(docs, column, _rendered(lambda e: serialize.to_json(e, indent)), output, "string")


def with_ndjson(docs: DataFrame, column: str = "elements", output: str = "ndjson") -> DataFrame:
    return map_column(docs, column, _rendered(serialize.to_ndjson), output, "string")


def with_packed_json(docs: DataFrame, column: str = "elements", output: str = "packed") -> DataFrame:
    """Deflated JSON in Base64."""
    return map_column(docs, column, _rendered(serialize.pack), output, "string")


def with_csv(docs: DataFrame, column: str = "elements", output: str = "csv") -> DataFrame:
    return map_column(docs, column, _rendered(serialize.to_csv), output, "string")


def from_json(docs: DataFrame, column: str = "json", output: str = "elements") -> DataFrame:
    """Elements of serialized arrays; types that aren't known are left out, malformed text fails."""
    return map_column(docs, column, lambda t: None if t is None else [row(e) for e in serialize.from_json(t)], output, f"array<{CHUNK_TYPE}>")


def from_ndjson(docs: DataFrame, column: str = "ndjson", output: str = "elements") -> DataFrame:
    return map_column(docs, column, lambda t: None if t is None else [row(e) for e in serialize.from_ndjson(t)], output, f"array<{CHUNK_TYPE}>")


def from_packed_json(docs: DataFrame, column: str = "packed", output: str = "elements", limit: int = 200 << 20) -> DataFrame:
    """Elements of packed JSON; what inflates past the limit, or is cut short, fails."""
    return map_column(docs, column, lambda t: None if t is None else [row(e) for e in serialize.unpack(t, limit)], output, f"array<{CHUNK_TYPE}>")


def text_of(elements: Column) -> Column:
    """Non-empty texts, a line each."""
    return F.array_join(F.filter(F.transform(elements, lambda e: e["text"]), lambda t: t != ""), "\n")


def markdown_of(elements: Column, exclude_binary_image_data: bool = False) -> Column:
    """Titles as headings, tables as HTML, images as links, other texts as they are."""

    def one(e: Column) -> Column:
        m, text = e["metadata"], F.coalesce(e["text"], F.lit(""))
        alt = F.concat(F.lit("!["), text, F.lit("]("))
        out = F.when(e["type"] == "Title", F.concat(F.lit("# "), text))
        out = out.when(e["type"].isin("Table", "TableChunk") & m["text_as_html"].isNotNull(), m["text_as_html"])
        if not exclude_binary_image_data:
            data = F.concat(alt, F.lit("data:"), F.coalesce(m["image_mime_type"], F.lit("image/*")), F.lit(";base64,"), m["image_base64"], F.lit(")"))
            out = out.when((e["type"] == "Image") & m["image_base64"].isNotNull(), data)
        return out.when((e["type"] == "Image") & m["image_url"].isNotNull(), F.concat(alt, m["image_url"], F.lit(")"))).otherwise(text)

    return F.array_join(F.transform(elements, one), "\n")


def csv_rows(elements: DataFrame) -> DataFrame:
    """The CSV columns of exploded elements, to be written with ``df.write.csv(header=True)``."""
    m = lambda name: F.col("metadata")[name]
    return elements.select(
        "type", "text", "element_id", m("filename").alias("filename"), m("page_number").alias("page_number"), m("url").alias("url"),
        F.get(m("sent_from"), F.lit(0)).alias("sender"), m("subject").alias("subject"),
    )


def filter_element_types(elements: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None) -> DataFrame:
    """Rows of exactly these types, or of all others; a table is not a table chunk."""
    if bool(include) == bool(exclude):
        raise ValueError("exactly one of include and exclude must be given")
    return elements.where(F.col("type").isin(list(include)) if include else ~F.col("type").isin(list(exclude)))


def read_types(elements: DataFrame) -> DataFrame:
    """Serialized type strings as the types that they are read back as; others go."""
    known = F.create_map(*[F.lit(x) for kv in READ_AS.items() for x in kv])
    return elements.withColumn("type", F.element_at(known, F.col("type"))).where("type is not null")


def flatten_struct(df: DataFrame, separator: str = "_", keys_to_omit: Sequence[str] = ()) -> DataFrame:
    """Nested struct fields as columns whose names are joined by a separator; a struct to omit stays whole."""

    def leaves(kind: T.StructType, at: list[str]):
        for f in kind:
            name = separator.join([*at, f.name])
            if isinstance(f.dataType, T.StructType) and name not in keys_to_omit:
                yield from leaves(f.dataType, [*at, f.name])
            else:
                yield F.col(".".join(f"`{x}`" for x in [*at, f.name])).alias(name)

    return df.select(*leaves(df.schema, []))
