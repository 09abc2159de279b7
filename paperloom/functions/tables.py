"""Tables as compact HTML and as flat text, on lists and as column expressions over array<array<string>>."""

from __future__ import annotations

from collections.abc import Sequence
from html import escape

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.cleaners import WS


def cell_html(text: str, across: int = 1, down: int = 1) -> str:
    inner = " ".join(escape(text).replace("\n", "<br/>").split())
    spans = "".join(f' {name}="{n}"' for name, n in (("colspan", across), ("rowspan", down)) if n > 1)
    return f"<td{spans}>{inner}</td>" if inner else f"<td{spans}/>"


def table_html(rows: Sequence[Sequence]) -> str:
    """Cells are texts or (text, columns spanned, rows spanned)."""
    if not rows:
        return ""
    cells = lambda row: "".join(cell_html(c) if isinstance(c, str) else cell_html(*c) for c in row)
    return "<table>" + "".join(f"<tr>{cells(row)}</tr>" for row in rows) + "</table>"


def table_text(rows: Sequence[Sequence[str]]) -> str:
    return " ".join(word for row in rows for cell in row for word in cell.split())


def _cell(c: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br/>")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    inner = F.trim(F.regexp_replace(c, f"{WS}+", " "))
    return F.when(inner == "", "<td/>").otherwise(F.concat(F.lit("<td>"), inner, F.lit("</td>")))


def table_html_column(rows: Column) -> Column:
    body = F.transform(rows, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, _cell), ""), F.lit("</tr>")))
    return F.when(F.size(rows) == 0, "").otherwise(F.concat(F.lit("<table>"), F.array_join(body, ""), F.lit("</table>")))


def table_text_column(rows: Column) -> Column:
    cells = F.transform(F.flatten(rows), lambda c: F.trim(F.regexp_replace(c, f"{WS}+", " ")))
    return F.array_join(F.filter(cells, lambda c: c != ""), " ")
