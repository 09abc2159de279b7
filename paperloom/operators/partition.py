"""Documents to elements: detect the type, parse, enrich, chunk.

``parse_document`` does so for one document's bytes. ``partition`` applies it to rows of documents in one map-only Arrow
pass, so a document is one row with an array of elements until ``explode_elements``; the plan has no shuffle, in batch and
on streams alike. ``partition_text`` is the same for a table's text column with column expressions alone.
"""

from __future__ import annotations

import json
from dataclasses import replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import cleaners, text_rules
from paperloom.functions import row_rules as rules
from paperloom.operators import enrich, relational, serialize
from paperloom.operators.arrow import map_columns
from paperloom.operators.chunking import chunk, chunk_options
from paperloom.operators.delimited import parse_delimited
from paperloom.operators.docx import parse_docx
from paperloom.operators.email import parse_email
from paperloom.operators.html import parse_html
from paperloom.operators.markdown import markdown_to_html
from paperloom.operators.options import Options, make_options
from paperloom.operators.pdf import parse_pdf
from paperloom.operators.pptx import parse_pptx
from paperloom.operators.schema import CHUNK_TYPE, element, row
from paperloom.operators.xlsx import parse_xlsx
from paperloom.sources.decode import FILETYPE, charset_of, decode_bytes, decode_html, detect_filetype


def exactly_one(**given) -> None:
    """Exactly one of the values is given; None and the empty string don't count."""
    names = [k for k, v in given.items() if v is not None and not (isinstance(v, str) and v == "")]
    if len(names) != 1:
        raise ValueError(f"exactly one of {', '.join(given)} must be given" + (f", not {', '.join(names)}" if names else ""))


def text_elements(text: str, o: Options) -> list[dict]:
    return [element(*rules.classify(p)) for p in rules.text_paragraphs(text, o.paragraph_grouper)]


def html_elements(text: str, o: Options) -> list[dict]:
    if o.html_parser_version != "v1":
        raise ValueError(f"html_parser_version is v1, not {o.html_parser_version}")
    return parse_html(text, o.skip_headers_and_footers, o.limits.html_depth) if text.strip() else []


def json_elements(text: str, o: Options) -> list[dict]:
    items = json.loads(text)
    if not isinstance(items, list) or not all(isinstance(x, dict) and "type" in x for x in items):
        raise ValueError("not an array of serialized elements")
    return serialize.from_dicts(items, o.limits.inflated_bytes)


def raw_elements(data: bytes, kind: str, o: Options, name: str | None, depth: int) -> list[dict]:
    """What the parser of a type gives, before enrichment."""
    if kind in ("csv", "tsv"):
        delimiter = "\t" if kind == "tsv" else o.delimiter
        return parse_delimited(data, o.encoding, delimiter, o.infer_table_structure, o.limits.csv_field)
    if kind == "html":
        return html_elements(decode_html(data, o.encoding, charset_of(o.content_type)), o)
    if kind == "md":
        return html_elements(markdown_to_html(decode_bytes(data, o.encoding, sent=charset_of(o.content_type))[1]), o)
    if kind == "txt":
        return text_elements(decode_bytes(data, o.encoding, sent=charset_of(o.content_type))[1], o)
    if kind == "json":
        return json_elements(decode_bytes(data, o.encoding)[1], o)
    if kind == "eml":
        return parse_email(data, o, name, depth)
    return {"docx": parse_docx, "pptx": parse_pptx, "xlsx": parse_xlsx, "pdf": parse_pdf}[kind](data, o)


def parse_document(
    data: bytes, name: str | None = None, o: Options | None = None, url: str | None = None, modified: str | None = None, depth: int = 0
) -> list[dict]:
    """Elements (chunks, if a strategy is set) of one document, enriched."""
    o = o or Options()
    kind = detect_filetype(data, name or o.metadata_filename, o.content_type)
    elements = raw_elements(bytes(data), kind, o, name, depth)
    if kind in o.skip_infer_table_types:
        for e in elements:
            e["metadata"].pop("text_as_html", None)
    enrich.set_languages(elements, o)
    enrich.set_file_facts(elements, FILETYPE[kind], o, name, url, modified)
    enrich.set_ids(elements, o.unique_element_ids)
    enrich.set_hierarchy(elements)
    if o.chunking_strategy:
        return chunk(elements, chunk_options(o.chunking_strategy, **o.chunking))
    return elements


def partition(docs: DataFrame, **options) -> DataFrame:
    """Add ``elements`` (an array in order) and ``error`` to rows of documents.

    ``docs`` has ``content`` (binary) and any of ``path``, ``content_type``, ``url``, ``metadata_filename`` and
    ``modificationTime``, as ``sources.documents`` reads them. A document that can't be parsed has null elements and its
    error's class and message in ``error``; with mode="FAILFAST" it fails the query. A null content gives neither. The
    columns ``elements`` and ``error`` of the input are replaced. Options: ``operators.options``.
    """
    o = make_options(**options)
    optional = {c: F.col(c) if c in docs.columns else F.lit(None).cast("string") for c in ("path", "content_type", "url", "metadata_filename")}
    modified = F.lit(None).cast("string")
    if "modificationTime" in docs.columns:
        modified = F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss")
    inner = [f"__{c}" for c in optional]
    frame = docs.withColumns({f"__{c}": v for c, v in optional.items()} | {"__modified": modified})

    def parse(content, path, content_type, url, called, changed):
        if content is None:
            return None, None
        given = replace(
            o,
            content_type=content_type or o.content_type,
            metadata_filename=called or o.metadata_filename,
        )
        name = path.removeprefix("file:").replace("///", "/", 1) if path else None
        try:
            return [row(e) for e in parse_document(content, name, given, url, changed)], None
        except Exception as e:  # any document may be broken in any way
            if o.mode == "FAILFAST":
                raise
            return None, f"{type(e).__name__}: {e}"

    out = map_columns(frame, ["content", *inner, "__modified"], parse, {"elements": f"array<{CHUNK_TYPE}>", "error": "string"}, 16)
    return out.drop(*inner, "__modified")


def explode_elements(docs: DataFrame, column: str = "elements") -> DataFrame:
    """One row per element: the other columns, ``pos`` and the element's fields. A null or empty array gives no row."""
    names = [c for c in docs.columns if c != column]
    # Not a plain posexplode: the planner would filter by the array's size first, and so compute the array twice and more.
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.posexplode_outer(column).alias("pos", "e")).where("pos is not null")
    return rows.select(
        *[F.col(f"`{c}`") for c in names], "pos", "e.*"
    )


def partition_path(spark: SparkSession, path: str, **options) -> DataFrame:
    from paperloom.sources.documents import read_documents

    return partition(read_documents(spark, path), **options)


def _of_type(content_type: str):
    def run(docs: DataFrame, **options) -> DataFrame:
        return partition(docs, **({"content_type": content_type} | options))

    return run


partition_html = _of_type("text/html")
partition_md = _of_type("text/markdown")
partition_csv = _of_type("text/csv")
partition_tsv = _of_type("text/tsv")
partition_json = _of_type("application/json")
partition_email = _of_type("message/rfc822")
partition_docx = _of_type(FILETYPE["docx"])
partition_pptx = _of_type(FILETYPE["pptx"])
partition_xlsx = _of_type(FILETYPE["xlsx"])
partition_pdf = _of_type("application/pdf")


def partition_column(docs: DataFrame, text_col: str, content_type: str, **options) -> DataFrame:
    """``partition`` of a text column, such as HTML in a table."""
    frame = docs.withColumn("content", F.encode(F.col(text_col), "UTF-8"))
    return partition(frame, **({"content_type": content_type, "encoding": "utf-8"} | options)).drop("content")


def paragraphs(text: Column, grouper: str = "auto") -> Column:
    """array<string> of a text's paragraphs; grouper: auto, new_line, blank_line or none."""
    parts = {
        "auto": cleaners.auto_paragraphs,
        "new_line": cleaners.new_line_paragraphs,
        "blank_line": cleaners.broken_paragraphs,
        "none": lambda c: F.transform(F.split(c, rf"\n{cleaners.WS}*\n"), cleaners.strip),
    }[grouper](text)
    empty = lambda p: (p == "") | (text_rules.is_bulleted_text(p) & (cleaners.clean_bullets(p) == ""))
    return F.filter(parts, lambda p: ~empty(p))


def partition_text(docs: DataFrame, text_col: str = "text", grouper: str = "auto", filename: Column | None = None) -> DataFrame:
    """Add ``elements``: array<struct<type, text, element_id, parent_id, languages>> of a text column, all in the JVM.

    A null or blank text gives an empty array.
    """
    parts = paragraphs(F.coalesce(F.col(text_col), F.lit("")), grouper)
    kinds = docs.withColumn("elements", F.transform(parts, text_rules.classify))
    return relational.enrich_column(kinds, "elements", filename)
