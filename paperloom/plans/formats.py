"""Queries that make a small document of every row of a table, in each format, read it back, and say in SQL what it holds."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import partition as parts
from paperloom.operators import relational, staging
from paperloom.sources.decode import FILETYPE, decode_bytes, filetype_column

Query = Callable[[SparkSession, str], DataFrame]
RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment")


def dealt(rows: DataFrame) -> DataFrame:
    """Customers dealt out to tasks: the table is one small file, which few tasks read, but each row is a document to parse."""
    n = max(2 * rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
    return rows.repartition(n, "c_custkey")


def elements_of(docs: DataFrame) -> DataFrame:
    """c_custkey, pos, type and text of the elements of (c_custkey, content, content_type)."""
    found = parts.partition(docs, mode="FAILFAST").drop("content", "content_type", "error")
    return parts.explode_elements(found).select("c_custkey", F.col("pos").cast("long").alias("pos"), "type", "text", "metadata")


def written(kind: str, body: Callable[[], Column], more: tuple[str, ...] = ()) -> Query:
    """A query over documents whose text is a column expression; ``more`` names metadata to return too."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = dealt(customers(spark, sf_dir)).select("c_custkey", F.encode(body(), "UTF-8").alias("content"), F.lit(kind).alias("content_type"))
        return elements_of(docs).select("c_custkey", "pos", "type", "text", *[F.col(f"metadata.{m}").alias(m) for m in more])

    return run


def text(*pieces: str) -> Callable[[], Column]:
    """Column names in braces, other pieces as they stand."""
    return lambda: F.concat(*[F.col(p[1:-1]) if p.startswith("{") and p.endswith("}") else F.lit(p) for p in pieces])


def rows_sql(*rows: tuple[str, str], columns: str = "") -> str:
    """SQL of elements: (type, expression of the text) in order."""
    each = [f"SELECT c_custkey, CAST({k} AS BIGINT) AS pos, '{kind}' AS type, {sql} AS text{columns} FROM customer" for k, (kind, sql) in enumerate(rows)]
    return " UNION ALL ".join(each)


def office(parts_of: Callable[[str, str], dict[str, str]], kind: str) -> Query:
    """A query over office packages that ``parts_of`` (name, segment) writes."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def pack(batches: Iterator) -> Iterator:
            import pandas as pd

            for pdf in batches:
                made = []
                for name, segment in zip(pdf["c_name"], pdf["c_mktsegment"]):
                    out = io.BytesIO()
                    with zipfile.ZipFile(out, "w") as z:
                        for path, content in parts_of(name, segment).items():
                            z.writestr(path, content)
                    made.append(out.getvalue())
                yield pd.DataFrame({"c_custkey": pdf["c_custkey"], "content": made, "content_type": FILETYPE[kind]})

        docs = dealt(customers(spark, sf_dir)).mapInPandas(pack, "c_custkey long, content binary, content_type string")
        return elements_of(docs).drop("metadata")

    return run


def relations(*items: tuple[str, str, str]) -> str:
    inner = "".join(f'<Relationship Id="{i}" Type="{RELATION}/{kind}" Target="{target}"/>' for i, kind, target in items)
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{inner}</Relationships>'


def workbook(name: str, segment: str) -> dict[str, str]:
    cell = lambda at, x: f'<c r="{at}" t="inlineStr"><is><t>{x}</t></is></c>'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    return {
        "_rels/.rels": relations(("a", "officeDocument", "xl/workbook.xml")),
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{RELATION}"><sheets><sheet name="S" sheetId="1" r:id="s"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": relations(("s", "worksheet", "sheet.xml")),
        "xl/sheet.xml": f'<worksheet xmlns="{main}"><sheetData><row r="1">{cell("A1", "name")}{cell("B1", "segment")}</row>'
        f'<row r="2">{cell("A2", name)}{cell("B2", segment)}</row></sheetData></worksheet>',
    }


def letter(name: str, segment: str) -> dict[str, str]:
    main = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    item = lambda x: f"<w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>{x}</w:t></w:r></w:p>"
    cell = lambda x: f"<w:tc><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:tc>"
    table = f"<w:tbl><w:tr>{cell('name')}{cell(name)}</w:tr></w:tbl>"
    return {
        "_rels/.rels": relations(("a", "officeDocument", "word/document.xml")),
        "word/document.xml": f'<w:document xmlns:w="{main}"><w:body>{item(name)}{item(segment)}{table}</w:body></w:document>',
    }


def slides(name: str, segment: str) -> dict[str, str]:
    p, a = "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/main"
    item = lambda x: f'<a:p><a:pPr><a:buChar char="-"/></a:pPr><a:r><a:t>{x}</a:t></a:r></a:p>'
    slide = lambda x: f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:cSld><p:spTree><p:sp><p:txBody>{item(x)}</p:txBody></p:sp></p:spTree></p:cSld></p:sld>'
    ids = '<p:sldIdLst><p:sldId id="1" r:id="s1"/><p:sldId id="2" r:id="s2"/></p:sldIdLst>'
    return {
        "_rels/.rels": relations(("a", "officeDocument", "ppt/presentation.xml")),
        "ppt/presentation.xml": f'<p:presentation xmlns:p="{p}" xmlns:r="{RELATION}">{ids}</p:presentation>',
        "ppt/_rels/presentation.xml.rels": relations(("s1", "slide", "slide1.xml"), ("s2", "slide", "slide2.xml")),
        "ppt/slide1.xml": slide(name),
        "ppt/slide2.xml": slide(segment),
    }


def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A PDF of one line in the middle of the page for each customer."""
    line = F.concat(F.lit("BT /F 12 Tf 72 400 Td (* "), F.col("c_name"), F.lit(") Tj ET"))
    body = F.concat(
        F.lit(
            "%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Kids[3 0 R]/Count 1>>endobj\n"
            "3 0 obj<</Type/Page/Parent 2 0 R/MediaBox[0 0 612 792]/Resources<</Font<</F 5 0 R>>>>/Contents 4 0 R>>endobj\n"
            "5 0 obj<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>endobj\n4 0 obj<</Length "
        ),
        F.length(line).cast("string"), F.lit(">>stream\n"), line, F.lit("\nendstream endobj\ntrailer<</Root 1 0 R>>\n%%EOF\n"),
    )
    docs = dealt(customers(spark, sf_dir)).select("c_custkey", F.encode(body, "UTF-8").alias("content"), F.lit("application/pdf").alias("content_type"))
    return elements_of(docs).drop("metadata")


#: First bytes and extensions, with the type that they stand for.
SAMPLES = (
    ("x.csv", "a,b", "csv"), ("x", "%PDF-1.7", "pdf"), ("x.MD", "text", "md"), ("x", " <!DOCTYPE html><p>", "html"), ("x", "[1]", "json"),
    ("x", "From: a\nMessage-ID: b\n\nc", "eml"), ("x", "plain words", "txt"), ("x.doc", "plain", None), ("x.eml", "{", "eml"),
)


def filetypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The native type detection over samples, one a customer."""
    k = F.col("c_custkey") % len(SAMPLES) + 1
    pick = lambda i: F.element_at(F.array(*[F.lit(s[i]) for s in SAMPLES]), k.cast("int"))
    found = filetype_column(pick(0), F.encode(pick(1), "UTF-8"))
    return customers(spark, sf_dir).select("c_custkey", found.alias("filetype"))


def _decoded(encoding: str) -> Query:
    """Whole texts in an encoding, told from their bytes and read back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def read(batches: Iterator) -> Iterator:
            import pandas as pd

            for pdf in batches:
                texts = [decode_bytes(bytes(b))[1] for b in pdf["content"]]
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": texts})

        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
        found = docs.select("doc_id", F.encode("text", encoding).alias("content")).mapInPandas(read, "doc_id long, text string")
        return found.select("doc_id", F.md5("text").alias("text_md5"))

    return run


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as points of a page of pixels, in relative coordinates."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    point = F.struct((F.col("l_orderkey") % 512).cast("double").alias("x"), (F.col("l_linenumber") * 64).cast("double").alias("y"))
    p = relational.convert_coordinates(F.array(point), ("PixelSpace", 512.0, 1024.0), ("RelativeCoordinates", 1.0, 1.0))[0]
    return t.select("l_orderkey", "l_linenumber", p["x"].alias("x"), p["y"].alias("y"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as elements."""
    kind = F.when(F.col("role") == "user", "Title").when(F.col("role") == "system", "Header").otherwise("NarrativeText")
    facts = {"filename": F.concat(F.lit("c"), "conv_id"), "page_number": F.col("turn").cast("int"), "url": F.lit(None).cast("string"), "subject": F.col("role")}
    m = F.struct(*[c.alias(n) for n, c in facts.items()], F.array(F.col("role")).alias("sent_from"))
    ident = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", kind.alias("type"), "text", ident.alias("element_id"), m.alias("metadata"))


def csv_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.csv_rows(_turns(spark, sf_dir))


def flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = staging.flatten_struct(_turns(spark, sf_dir), keys_to_omit=())
    return found.select("conv_id", "turn", "metadata_filename", "metadata_page_number", "metadata_subject")


def titles_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.filter_element_types(_turns(spark, sf_dir), include=["Title"]).select("conv_id", "turn", "type", "element_id")


def turn_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn alone, as Markdown."""
    none = {n: F.lit(None).cast("string") for n in ("text_as_html", "image_base64", "image_mime_type", "image_url")}
    e = F.struct("type", "text", F.struct(*[c.alias(n) for n, c in none.items()]).alias("metadata"))
    return _turns(spark, sf_dir).select("conv_id", "turn", F.md5(staging.markdown_of(F.array(e))).alias("markdown_md5"))


KIND_SQL = "CASE role WHEN 'user' THEN 'Title' WHEN 'system' THEN 'Header' ELSE 'NarrativeText' END"
ITEM = ("ListItem", "c_name"), ("ListItem", "c_mktsegment")
MAIL = ", ['Desk <desk@x.test>'] AS sent_from, c_mktsegment AS subject"


def queries() -> dict[str, Query]:
    return {
        "partition_tsv": written("text/tsv", text("name\tsegment\n", "{c_name}", "\t", "{c_mktsegment}", "\n"), ("text_as_html",)),
        "partition_json": written(
            "application/json",
            text('[{"type": "Title", "text": "', "{c_name}", '"}, {"type": "ListItem", "text": "', "{c_mktsegment}", '", "metadata": {"page_number": 2}}]'),
            ("page_number",),
        ),
        "partition_md": written("text/markdown", text("# ", "{c_name}", "\n\n- *", "{c_mktsegment}", "*\n- see [", "{c_name}", "](http://x.test)\n")),
        "partition_email": written(
            "message/rfc822",
            text(
                "From: Desk <desk@x.test>\nSubject: ", "{c_mktsegment}", '\nContent-Type: text/html; charset="utf-8"\n\n<h1>', "{c_name}", "</h1>\n"
            ),
            ("sent_from", "subject"),
        ),
        "partition_docx": office(letter, "docx"),
        "partition_pptx": office(slides, "pptx"),
        "partition_xlsx": office(workbook, "xlsx"),
        "partition_pdf": pdf_pages,
        "detect_filetype": filetypes,
        "decode_utf8": _decoded("UTF-8"),
        "decode_utf16": _decoded("UTF-16"),
        "coordinates": coordinates,
        "csv_staging": csv_staging,
        "flatten": flatten,
        "filter_element_types": titles_only,
        "elements_to_md": turn_markdown,
    }


def oracle_sql() -> dict[str, str]:
    decoded = "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL"
    names = ", ".join(f"'{kind}'" if kind else "NULL" for _, _, kind in SAMPLES)
    return {
        "partition_tsv": rows_sql(
            ("Table", "'name segment ' || c_name || ' ' || c_mktsegment"),
            columns=", '<table><tr><td>name</td><td>segment</td></tr><tr><td>' || c_name || '</td><td>' || c_mktsegment || '</td></tr></table>' AS text_as_html",
        ),
        "partition_json": rows_sql(("Title", "c_name"), columns=", CAST(NULL AS INTEGER) AS page_number")
        + " UNION ALL SELECT c_custkey, CAST(1 AS BIGINT), 'ListItem', c_mktsegment, 2 FROM customer",
        "partition_md": rows_sql(("Title", "c_name"), ("ListItem", "c_mktsegment"), ("ListItem", "'see ' || c_name")),
        "partition_email": rows_sql(("Title", "c_name"), columns=MAIL),
        "partition_docx": rows_sql(*ITEM, ("Table", "'name ' || c_name")),
        "partition_pptx": rows_sql(ITEM[0], ("PageBreak", "''"), ITEM[1]),
        "partition_xlsx": rows_sql(("Table", "'name segment ' || c_name || ' ' || c_mktsegment")),
        "partition_pdf": rows_sql(("ListItem", "c_name")),
        "detect_filetype": f"SELECT c_custkey, [{names}][c_custkey % {len(SAMPLES)} + 1] AS filetype FROM customer",
        "decode_utf8": decoded,
        "decode_utf16": decoded,
        "coordinates": "SELECT l_orderkey, l_linenumber, (l_orderkey % 512) / 512.0::DOUBLE AS x, 1.0::DOUBLE - l_linenumber * 64 / 1024.0::DOUBLE AS y FROM lineitem",
        "csv_staging": f"SELECT {KIND_SQL} AS type, text, conv_id || '-' || turn AS element_id, 'c' || conv_id AS filename, "
        "CAST(turn AS INTEGER) AS page_number, CAST(NULL AS VARCHAR) AS url, role AS sender, role AS subject FROM conversations",
        "flatten": "SELECT conv_id, turn, 'c' || conv_id AS metadata_filename, CAST(turn AS INTEGER) AS metadata_page_number, role AS metadata_subject FROM conversations",
        "filter_element_types": "SELECT conv_id, turn, 'Title' AS type, conv_id || '-' || turn AS element_id FROM conversations WHERE role = 'user'",
        "elements_to_md": "SELECT conv_id, turn, md5(CASE WHEN role = 'user' THEN '# ' ELSE '' END || coalesce(text, '')) AS markdown_md5 FROM conversations",
    }
