"""Golden outputs of every document type, hostile inputs, detection and decoding."""

from __future__ import annotations

import json
import zipfile
from email.message import EmailMessage

import pytest

from paperloom.operators import serialize
from paperloom.operators.markdown import markdown_to_html
from paperloom.operators.options import Limits, Options, UnsafeDocumentError, UnsupportedFileFormatError, make_options
from paperloom.operators.partition import exactly_one, parse_document
from paperloom.sources.decode import decode_bytes, detect_filetype
from tests import ooxml_fixtures as fx


def shown(elements):
    return [(e["type"], e["text"]) for e in elements]


def parse(data, name, **options):
    return parse_document(data if isinstance(data, bytes) else data.encode(), name, make_options(**options))


def test_html():
    page = """<html><head><title>t</title><script>var a = "</p>";</script></head><body><nav>Home</nav><h1>Harbor notes</h1>
    <p>The <b>north</b> quay was <i>closed</i> on Monday.</p><h2>Ships</h2><ul><li>Anna<ul><li>Small boat</li></ul></li><li>Berta</li></ul>
    <table><thead><tr><th>Ship</th><th>Tons</th></tr></thead><tbody><tr><td>Anna</td><td>12</td></tr></tbody></table>
    <pre>
a = 1
</pre><p>See <a href="http://x.test/a">the list</a> for what has arrived.</p><img src="q.png" alt="Quay"></body></html>"""
    found = parse(page, "a.html")
    assert shown(found) == [
        ("Title", "Harbor notes"), ("NarrativeText", "The north quay was closed on Monday."), ("Title", "Ships"), ("ListItem", "Anna"),
        ("ListItem", "Small boat"), ("ListItem", "Berta"), ("Table", "Ship Tons Anna 12"), ("CodeSnippet", "a = 1"),
        ("NarrativeText", "See the list for what has arrived."), ("Image", "Quay"),
    ]
    m = [e["metadata"] for e in found]
    assert m[1]["emphasized_text_contents"] == ["north", "closed"] and m[1]["emphasized_text_tags"] == ["b", "i"]
    assert [x.get("category_depth") for x in m[:6]] == [0, None, 1, 1, 2, 1]
    assert m[6]["text_as_html"] == "<table><tr><td>Ship</td><td>Tons</td></tr><tr><td>Anna</td><td>12</td></tr></table>"
    assert m[8]["link_texts"] == ["the list"] and m[8]["link_urls"] == ["http://x.test/a"]
    assert m[9]["image_url"] == "q.png" and m[0]["filetype"] == "text/html" and m[0]["filename"] == "a.html"
    ids = [e["element_id"] for e in found]
    assert m[1]["parent_id"] == ids[0] and m[2]["parent_id"] == ids[0] and m[3]["parent_id"] == ids[2]
    assert "parent_id" not in m[9]


def test_html_sloppy_and_deep():
    assert shown(parse("<p>One was here<p><b>Two was here<li>item", "a.html")) == [
        ("NarrativeText", "One was here"), ("NarrativeText", "Two was here"), ("ListItem", "item"),
    ]
    deep = "<div>" * 5000 + "The end was reached." + "</div>" * 5000
    assert shown(parse(deep, "a.html")) == [("NarrativeText", "The end was reached.")]
    assert parse("", "a.html") == []
    assert [t for _, t in shown(parse("<header>Top was here</header><p>It was fine.</p>", "a.html", skip_headers_and_footers=True))] == ["It was fine."]
    cp1252 = '<meta charset="windows-1252"><p>Das war für Käufer.</p>'.encode("cp1252")
    assert parse(cp1252, "a.html")[0]["text"] == "Das war für Käufer."
    assert parse('<div data-page-number="3"><p>It was late.</p></div>', "a.html")[0]["metadata"]["page_number"] == 3


def test_markdown():
    text = "# First steps\n\nYou *must* read **this** page.\n\n1. one\n2. two\n\n- three\n  more\n\n| A | B |\n|---|---|\n| 1 | 2 |\n\n```py\nx\n```\n"
    found = parse(text, "a.md")
    assert shown(found) == [
        ("Title", "First steps"), ("NarrativeText", "You must read this page."), ("ListItem", "one"), ("ListItem", "two"),
        ("ListItem", "three more"), ("Table", "A B 1 2"), ("CodeSnippet", "x"),
    ]
    assert found[0]["metadata"]["filetype"] == "text/markdown"
    assert markdown_to_html("a `<b>` \\* <http://x.y>") == '<p>a <code>&lt;b&gt;</code> * <a href="http://x.y">http://x.y</a></p>'
    assert markdown_to_html("Head\n===\ntext") == "<h1>Head</h1>\n<p>text</p>"
    assert markdown_to_html("x\na  \nb") == "<p>x\na<br />\nb</p>"
    assert "<blockquote>" in markdown_to_html("> said\nmore")


def test_text():
    text = "HARBOR POLICY\n\nShips are moored at night. Lights are kept on.\n\n• First item\n• Second item\n\noffice@harbor.test\n\nSpringfield, IL 62701\n"
    assert shown(parse(text, "a.txt")) == [
        ("Title", "HARBOR POLICY"), ("NarrativeText", "Ships are moored at night. Lights are kept on."), ("ListItem", "First item"),
        ("ListItem", "Second item"), ("EmailAddress", "office@harbor.test"), ("Address", "Springfield, IL 62701"),
    ]
    assert parse("   ", "a.txt") == []
    assert parse("Der Hafen ist nicht weit von der Stadt.", "a.txt")[0]["metadata"]["languages"] == ["deu"]
    assert decode_bytes("Käse".encode("cp1252")) == ("cp1252", "Käse") and decode_bytes("ä".encode("utf-16"))[1] == "ä"


def test_csv_tsv():
    found = parse('id,name\n1,"Smith, Jo"\n\n2,\n', "a.csv")
    assert shown(found) == [("Table", "id name 1 Smith, Jo 2")]
    assert found[0]["metadata"]["text_as_html"].endswith("<tr><td>2</td><td/></tr></table>")
    assert parse("a;b\n1;2\n", "a.csv")[0]["text"] == "a b 1 2"
    assert shown(parse("code\tn\n0042\t1\n", "a.tsv")) == [("Table", "code n 0042 1")]
    assert shown(parse("", "a.csv")) == [("Table", "")]


def mail(attach=True):
    m = EmailMessage()
    m["From"], m["To"], m["Cc"] = "Ann Lee <ann@x.test>", "b@x.test, C <c@x.test>", "d@x.test"
    m["Subject"], m["Date"], m["Message-ID"] = "Berths", "Mon, 03 Mar 2025 10:00:00 +0200", "<77@x.test>"
    m.set_content("plain")
    m.add_alternative("<p>The berth was changed today.</p>", subtype="html")
    if attach:
        m.add_attachment(b"ATTACHED LIST\n\nIt was added on Monday.", maintype="text", subtype="plain", filename="list.txt")
        m.add_attachment(b"\x00\x01", maintype="application", subtype="octet-stream", filename="x.doc")
    return m.as_bytes()


def test_email():
    found = parse(mail(), "m.eml")
    assert shown(found) == [
        ("NarrativeText", "The berth was changed today."), ("Title", "ATTACHED LIST"), ("NarrativeText", "It was added on Monday."),
    ]
    m = found[0]["metadata"]
    assert m["sent_from"] == ["Ann Lee <ann@x.test>"] and m["sent_to"] == ["b@x.test", "C <c@x.test>"] and m["subject"] == "Berths"
    assert m["email_message_id"] == "77@x.test" and m["last_modified"] == "2025-03-03T08:00:00+00:00" and m["filetype"] == "message/rfc822"
    a = found[1]["metadata"]
    assert a["attached_to_filename"] == "m.eml" and a["filename"] == "list.txt" and a["filetype"] == "text/plain"
    assert len(parse(mail(), "m.eml", process_attachments=False)) == 1
    assert parse(mail(False), "m.eml", content_source="text/plain")[0]["text"] == "plain"


def test_json_round_trip():
    found = parse("# A title\n\nIt was written down.", "a.md")
    text = serialize.to_json(found)
    back = parse(text, "b.json")
    assert shown(back) == shown(found) and back[0]["metadata"]["filename"] == "b.json"
    with pytest.raises(ValueError):
        parse('{"a": 1}', "b.json")
    extra = serialize.from_dict({"type": "Title", "text": "x", "metadata": {"mine": [1]}})
    assert serialize.to_dict(extra)["metadata"] == {"mine": [1]}


def test_docx():
    link = '<w:hyperlink r:id="l"><w:r><w:t>a page</w:t></w:r></w:hyperlink>'
    runs = f'<w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">Bold </w:t></w:r><w:r><w:t xml:space="preserve">words were on </w:t></w:r>{link}'
    cell = lambda t, more="": f"<w:tc><w:tcPr>{more}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    merge = '<w:gridSpan w:val="2"/>'
    table = f"<w:tbl><w:tr>{cell('A')}{cell('B')}</w:tr><w:tr>{cell('wide', merge)}</w:tr></w:tbl>"
    body = (
        fx.paragraph("Harbor report", "Title") + fx.paragraph("Part one", "Heading1") + fx.paragraph("", runs=runs)
        + fx.paragraph("item", "ListBullet") + fx.paragraph("numbered", extra='<w:numPr><w:ilvl w:val="1"/></w:numPr>') + table
        + fx.paragraph("", runs="<w:r><w:t>Before</w:t><w:lastRenderedPageBreak/><w:t>It was after.</w:t></w:r>")
        + '<w:sectPr><w:headerReference w:type="default" r:id="h"/></w:sectPr>'
    )
    data = fx.docx(
        body,
        {"word/header1.xml": f"<w:hdr {fx.W}><w:p><w:r><w:t>Top line</w:t></w:r></w:p></w:hdr>"},
        (("h", "header", "header1.xml", False), ("l", "hyperlink", "http://x.test", True)),
    )
    found = parse(data, "r.docx")
    assert shown(found) == [
        ("Header", "Top line"), ("Title", "Harbor report"), ("Title", "Part one"), ("NarrativeText", "Bold words were on a page"),
        ("ListItem", "item"), ("ListItem", "numbered"), ("Table", "A B wide"), ("UncategorizedText", "Before"), ("PageBreak", ""),
        ("NarrativeText", "It was after."),
    ]
    m = [e["metadata"] for e in found]
    assert m[3]["emphasized_text_contents"] == ["Bold"] and m[3]["links"] == [{"text": "a page", "url": "http://x.test", "start_index": 19}]
    assert m[5]["category_depth"] == 1 and m[9]["page_number"] == 2 and m[0]["header_footer_type"] == "primary"
    assert '<td colspan="2">wide</td>' in m[6]["text_as_html"]


def test_pptx():
    slide1 = fx.shape("<a:p><a:r><a:t>Plans</a:t></a:r></a:p>", "title") + fx.shape(
        '<a:p><a:pPr lvl="1"><a:buChar char="x"/></a:pPr><a:r><a:t>point</a:t></a:r></a:p><a:p><a:r><a:t>We went there today.</a:t></a:r></a:p>', y=500
    )
    table = (
        '<p:graphicFrame><p:xfrm><a:off x="0" y="900"/></p:xfrm><a:graphic><a:graphicData><a:tbl><a:tr>'
        "<a:tc><a:txBody><a:p><a:r><a:t>k</a:t></a:r></a:p></a:txBody></a:tc><a:tc><a:txBody><a:p><a:r><a:t>v</a:t></a:r></a:p></a:txBody></a:tc>"
        "</a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    )
    found = parse(fx.pptx([slide1, table]), "s.pptx")
    assert shown(found) == [
        ("Title", "Plans"), ("ListItem", "point"), ("NarrativeText", "We went there today."), ("PageBreak", ""), ("Table", "k v"),
    ]
    assert found[1]["metadata"]["category_depth"] == 1 and found[4]["metadata"]["page_number"] == 2


def test_xlsx():
    t = fx.text_cell
    data = fx.xlsx(
        {
            "Stock": [("A1", t("Stock list")), ("A3", t("Part")), ("B3", t("Count")), ("A4", t("Rope")), ("B4", "<c><v>12</v></c>")],
            "Dates": [("A1", '<c s="1"><v>45000</v></c>'), ("B1", "<c><v>2.5</v></c>"), ("A2", '<c t="b"><v>1</v></c>')],
        }
    )
    found = parse(data, "b.xlsx")
    assert shown(found) == [("Title", "Stock list"), ("Table", "Part Count Rope 12"), ("Table", "2023-03-15 00:00:00 2.5"), ("UncategorizedText", "True")] or shown(found)[:3] == [
        ("Title", "Stock list"), ("Table", "Part Count Rope 12"), ("Table", "2023-03-15 00:00:00 2.5"),
    ]
    assert [e["metadata"]["page_name"] for e in found][:3] == ["Stock", "Stock", "Dates"]
    with pytest.raises(UnsafeDocumentError):
        parse(data, "b.xlsx", limits=Limits(sheet_cells=2))


def test_pdf():
    pages = [
        [(72, 770, "Harbor office"), (72, 650, "Annual Report"), (72, 600, "The harbor was enlarged this year. It now"), (72, 586, "serves more ships."), (72, 20, "Page 1")],
        [(72, 600, "Left column was written first."), (350, 600, "Right column was written second.")],
    ]
    found = parse(fx.pdf(pages), "a.pdf")
    assert shown(found) == [
        ("Header", "Harbor office"), ("Title", "Annual Report"), ("NarrativeText", "The harbor was enlarged this year. It now serves more ships."),
        ("Footer", "Page 1"), ("NarrativeText", "Left column was written first."), ("NarrativeText", "Right column was written second."),
    ]
    assert found[0]["metadata"]["coordinates"]["system"] == "PixelSpace" and found[-1]["metadata"]["page_number"] == 2
    with pytest.raises(NotImplementedError):
        parse(fx.pdf(pages), "a.pdf", strategy="hi_res")
    with pytest.raises(UnsafeDocumentError):
        parse(fx.pdf(pages), "a.pdf", limits=Limits(pdf_pages=1))
    with pytest.raises(ValueError):
        parse(b"%PDF-1.4 broken", "a.pdf")
    with pytest.warns(UserWarning):
        assert parse(fx.pdf([[]]), "a.pdf") == []


def test_hostile_packages():
    with pytest.raises(UnsafeDocumentError):
        parse(fx.docx("<w:p/>", {"word/styles.xml": '<!DOCTYPE x [<!ENTITY a "b">]><x/>'}), "a.docx")
    with pytest.raises(UnsafeDocumentError):
        parse(fx.docx("<w:p/>", {"big.bin": "\0" * (4 << 20)}), "a.docx")
    with pytest.raises(UnsafeDocumentError):
        parse(fx.docx(fx.paragraph("x" * 5000)), "a.docx", limits=Limits(part_bytes=1000))
    with pytest.raises(ValueError):
        parse(b"PK\x03\x04 no", "a.docx")
    assert zipfile.is_zipfile(__file__) is False


@pytest.mark.parametrize(
    ("data", "name", "kind"),
    [
        (b"%PDF-1.7", None, "pdf"), (b"  <!DOCTYPE html><p>", None, "html"), (b'[{"type": "Title"}]', None, "json"),
        (b"From: a@b.c\nTo: d\nMessage-ID: <1>\n\nhi", None, "eml"), (b"just words", None, "txt"), (b"", "x.MD", "md"), (b"", "a.htm", "html"),
        (b"", "a.tab", "tsv"), (b"", "a.log", "txt"),
    ],
)
def test_detection(data, name, kind):
    assert detect_filetype(data, name) == kind


def test_detection_by_package_and_errors():
    assert detect_filetype(fx.docx("")) == "docx" and detect_filetype(fx.pptx([])) == "pptx" and detect_filetype(fx.xlsx({})) == "xlsx"
    assert detect_filetype(b"x", "a.pdf", "text/html; charset=utf-8") == "html"
    for data, name in ((b"", "a.doc"), (b"\0\1\2", None), (b"", None)):
        with pytest.raises(UnsupportedFileFormatError):
            detect_filetype(data, name)
    exactly_one(a=1, b=None, c="")
    with pytest.raises(ValueError):
        exactly_one(a=1, b=2)
    with pytest.raises(TypeError):
        make_options(nonsense=1)


def test_codec_limits_and_text_outputs():
    found = parse("# T\n\nIt was here.\n\n![p](u.png)", "a.md")
    assert [e["text"] for e in serialize.unpack(serialize.pack(found))] == [e["text"] for e in found]
    with pytest.raises(ValueError):
        serialize.unpack(serialize.pack(found), limit=10)
    assert serialize.to_md(found).startswith("# T\n") and serialize.to_text(found).splitlines()[1] == "It was here."
    assert serialize.to_csv(found).splitlines()[0] == "type,text,element_id,filename,page_number,url,sender,subject"
    lines = serialize.to_ndjson(found).splitlines()
    assert json.loads(lines[0])["type"] == "Title" and serialize.from_ndjson("\n".join(lines))[0]["text"] == "T"
    assert serialize.flatten_dict({"a": {"b": 1, "c": [{"d": 2}]}, "e": None}, flatten_lists=True, remove_none=True) == {"a_b": 1, "a_c_0_d": 2}
    assert Options().mode == "PERMISSIVE"
