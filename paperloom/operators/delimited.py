"""CSV and TSV: one table a file, values as they are written."""

from __future__ import annotations

import csv
import io

from paperloom.functions.tables import table_html, table_text
from paperloom.operators.schema import element
from paperloom.sources.decode import decode_bytes


def delimiter_of(text: str) -> str:
    """Comma, semicolon, tab or pipe, from the first 64 Ki characters; a comma if none stands out."""
    try:
        return csv.Sniffer().sniff(text[:65_536], delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def rows_of(text: str, delimiter: str | None, most: int) -> list[list[str]]:
    csv.field_size_limit(most)
    found = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter or delimiter_of(text)) if any(map(str.strip, r))]
    width = max(map(len, found), default=0)
    return [r + [""] * (width - len(r)) for r in found]


def parse_delimited(data: bytes, encoding: str | None, delimiter: str | None, with_html: bool, most: int) -> list[dict]:
    rows = rows_of(decode_bytes(data, encoding)[1], delimiter, most)
    return [element("Table", table_text(rows), text_as_html=table_html(rows) if with_html else None)]
