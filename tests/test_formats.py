"""The format queries against their SQL; attachments at any depth; character sets sent with pages; streams that keep failures."""

from __future__ import annotations

from email.message import EmailMessage

import pytest

from paperloom.operators.options import make_options
from paperloom.operators.partition import parse_document
from paperloom.plans import formats
from paperloom.sources.decode import charset_of, decode_bytes

TABLES = "/root/testdata/sf0.001"


def plain(value):
    return list(value) if hasattr(value, "__len__") and not isinstance(value, str) else value


@pytest.mark.parametrize("name", sorted(formats.queries()))
def test_queries_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "documents", "conversations", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    df = formats.queries()[name](spark, TABLES)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({formats.oracle_sql()[name]})").fetchall()
    got = [tuple(map(plain, r)) for r in df.select(*columns).collect()]
    assert sorted(got, key=str) == sorted([tuple(map(plain, r)) for r in want], key=str) and got


def test_attachments_of_any_depth():
    inner = b"It was at the bottom."
    for k in range(9):
        m = EmailMessage()
        m["Subject"] = f"level {k}"
        m.set_content(f"It was level {k}.")
        m.add_attachment(inner, maintype="application", subtype="octet-stream", filename="in.eml" if k else "in.txt")
        inner = m.as_bytes()
    texts = [e["text"] for e in parse_document(inner, "m.eml", make_options())]
    assert texts == [*(f"It was level {k}." for k in range(8, -1, -1)), "It was at the bottom."]
    assert len(parse_document(inner, "m.eml", make_options(attachment_depth=2))) == 3


def test_sent_character_sets():
    page = "<p>Das war für Käufer.</p>".encode("cp1252")
    for sent in ("text/html; charset=windows-1252", 'text/html;charset="Windows-1252"'):
        assert parse_document(page, None, make_options(content_type=sent))[0]["text"] == "Das war für Käufer."
    assert charset_of("text/html") is None and charset_of(None) is None
    greek = "Αυτό".encode("iso8859-7")
    assert decode_bytes(greek, sent="iso-8859-7") == ("iso-8859-7", "Αυτό")
    assert decode_bytes("ä".encode(), sent="no-such-set") == ("utf-8", "ä") and decode_bytes("ä".encode(), sent="ascii") == ("utf-8", "ä")


def test_streams_keep_failures(spark, tmp_path):
    from paperloom.streaming.pipeline import stream_parsed, write_elements

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("It was read.")
    (tmp_path / "in" / "b.docx").write_bytes(b"no package")
    write_elements(stream_parsed(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    rows = {r["path"][-5:]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert not rows["a.txt"]["failed"] and len(rows["a.txt"]["elements"]) == 1
    assert rows[".docx"]["failed"] and rows[".docx"]["error"]


@pytest.mark.parametrize("name", ["partition_email", "partition_pdf", "partition_docx"])
def test_rows_of_one_file_are_dealt_out(spark, name):
    assert formats.customers(spark, TABLES).rdd.getNumPartitions() == 1
    rows = formats.queries()[name](spark, TABLES).select("c_custkey").rdd.glom().map(len).collect()
    assert sum(map(bool, rows)) >= spark.sparkContext.defaultParallelism


def test_headers_are_parsed_once(monkeypatch):
    from email import policy
    from email.headerregistry import HeaderRegistry
    from email.parser import BytesParser

    from paperloom.operators import email

    seen = []
    plain_call = HeaderRegistry.__call__
    monkeypatch.setattr(HeaderRegistry, "__call__", lambda self, name, value: seen.append((name, value)) or plain_call(self, name, value))
    email.Remembering._parsed.cache_clear()
    mail = b'From: "A, B" <a@x.test>\r\nfrom: c@x.test\r\nSubject: =?utf-8?q?K=C3=A4ufer?=\r\n =?utf-8?q?_am_Kai?=\r\nTo: \xe4 <d@x.test>,\r\n e@x.test\r\n'
    mail += b"X-Long: " + b"w " * 2000 + b"\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nIt was here.\r\n"
    for k in range(3):
        found = parse_document(mail, f"{k}.eml", make_options())
        assert [e["text"] for e in found] == ["It was here."]
        assert len(seen) == len(set(seen)) and len(seen) < 20
    assert found[0]["metadata"]["subject"] == "Käufer am Kai"
    one, other = email.PARSER.parsebytes(mail), BytesParser(policy=policy.default).parsebytes(mail)
    assert [(k, str(v), type(v).__mro__[1:3]) for k, v in one.items()] == [(k, str(v), type(v).__mro__[1:3]) for k, v in other.items()]
    assert email.addresses(one, "From") == email.addresses(other, "From") and len(email.addresses(one, "From")) == 2


def test_pdf_objects_are_read_once(monkeypatch):
    from collections import Counter

    from paperloom.operators import pdf

    def packed(number, inner, length):
        head = b"6 0 7 %d " % (len(inner) - 3)
        return b"%d 0 obj<</Type/ObjStm/N 2/First %d/Length %s>>stream\n" % (number, len(head), length) + head + inner + b"\nendstream endobj\n"

    line = b"BT /F 12 Tf 72 400 Td (* It was here) Tj /G 12 Tf 0 -40 Td (* It was there) Tj ET"
    page = b"%d 0 obj<</Type/Page/Parent 2 0 R/MediaBox[0 0 612 792]/Resources<</Font<</F 5 0 R/G 6 0 R>>>>/Contents 4 0 R>>endobj\n"
    font = b"<</Type/Font/Subtype/Type1/BaseFont/A/FirstChar 42/Widths[7 0 R]>> %d"
    data = b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Kids[10 0 R 11 0 R 12 0 R]/Count 3>>endobj\n"
    data += b"5 0 obj<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>endobj\n4 0 obj<</Length %d>>stream\n" % len(line) + line + b"\nendstream endobj\n"
    # The second stream of objects has a length that the first one holds, and another value for it, which counts from then on.
    data += packed(30, font % 333, b"500") + packed(31, font % 999, b"7 0 R") + b"".join(page % n for n in (10, 11, 12)) + b"trailer<</Root 1 0 R>>\n%%EOF\n"
    seen, fonts = Counter(), []
    read, made = pdf.read_object, pdf.Font.__init__
    monkeypatch.setattr(pdf, "read_object", lambda data, at: seen.update([(data, at)]) or read(data, at))
    monkeypatch.setattr(pdf.Font, "__init__", lambda self, reader, facts: fonts.append(self) or made(self, reader, facts))
    pages = pdf.own_pages(data, 1 << 20)
    texts = [[b.text for b in load()[2]] for load in pages]
    assert texts == [["* It was here", "* It was there"]] * 3
    assert max(seen.values()) == 1 and len(fonts) == 2 and fonts[1].widths == {42: 999}
    monkeypatch.setattr(pdf.Reader, "REMEMBER", 1)
    monkeypatch.setattr(pdf.Reader, "FONTS", 1)
    assert [[b.text for b in load()[2]] for load in pdf.own_pages(data, 1 << 20)] == texts
