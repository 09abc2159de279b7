"""Minimal Office packages and PDFs, written by hand."""

from __future__ import annotations

import io
import zipfile

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def rels(*items: tuple[str, str, str, bool]) -> str:
    inner = "".join(
        f'<Relationship Id="{i}" Type="{REL}/{kind}" Target="{target}"{" TargetMode=" + chr(34) + "External" + chr(34) if ext else ""}/>'
        for i, kind, target, ext in items
    )
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{inner}</Relationships>'


def package(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def paragraph(text: str, style: str | None = None, extra: str = "", runs: str | None = None) -> str:
    look = f'<w:pStyle w:val="{style}"/>' if style else ""
    return f"<w:p><w:pPr>{look}{extra}</w:pPr>{runs or f'<w:r><w:t>{text}</w:t></w:r>'}</w:p>"


def docx(body: str, more: dict[str, str] | None = None, relations=()) -> bytes:
    styles = "".join(
        f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>'
        for i, n in (("Title", "title"), ("Heading1", "heading 1"), ("Heading2", "heading 2"), ("ListBullet", "List Bullet"))
    )
    return package(
        {
            "_rels/.rels": rels(("r1", "officeDocument", "word/document.xml", False)),
            "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>",
            "word/_rels/document.xml.rels": rels(("s", "styles", "styles.xml", False), *relations),
            "word/styles.xml": f"<w:styles {W}>{styles}</w:styles>",
            **(more or {}),
        }
    )


def xlsx(sheets: dict[str, list[tuple[str, str]]]) -> bytes:
    """Sheets of (reference, cell XML without the reference)."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    names = list(sheets)
    parts = {
        "_rels/.rels": rels(("r1", "officeDocument", "xl/workbook.xml", False)),
        "xl/workbook.xml": f'<workbook {ns} xmlns:r="{REL}"><sheets>'
        + "".join(f'<sheet name="{n}" sheetId="{k + 1}" r:id="s{k}"/>' for k, n in enumerate(names))
        + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": rels(
            *[(f"s{k}", "worksheet", f"worksheets/sheet{k}.xml", False) for k in range(len(names))], ("st", "styles", "styles.xml", False)
        ),
        "xl/styles.xml": f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    }
    for k, n in enumerate(names):
        rows: dict[str, str] = {}
        for ref, cell in sheets[n]:
            number = "".join(c for c in ref if c.isdigit())
            rows[number] = rows.get(number, "") + cell.replace("<c", f'<c r="{ref}"', 1)
        body = "".join(f'<row r="{r}">{c}</row>' for r, c in rows.items())
        parts[f"xl/worksheets/sheet{k}.xml"] = f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>"
    return package(parts)


def text_cell(s: str) -> str:
    return f'<c t="inlineStr"><is><t>{s}</t></is></c>'


def pptx(slides: list[str]) -> bytes:
    ns = f'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="{REL}"'
    parts = {
        "_rels/.rels": rels(("r1", "officeDocument", "ppt/presentation.xml", False)),
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst>'
        + "".join(f'<p:sldId id="{256 + k}" r:id="s{k}"/>' for k in range(len(slides)))
        + '</p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(*[(f"s{k}", "slide", f"slides/slide{k}.xml", False) for k in range(len(slides))]),
    }
    for k, shapes in enumerate(slides):
        parts[f"ppt/slides/slide{k}.xml"] = f"<p:sld {ns}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>"
    return package(parts)


def shape(paragraphs: str, kind: str | None = None, y: int = 0) -> str:
    mark = f'<p:ph type="{kind}"/>' if kind else ""
    return (
        f"<p:sp><p:nvSpPr><p:nvPr>{mark}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x=\"0\" y=\"{y}\"/><a:ext cx=\"100\" cy=\"100\"/></a:xfrm></p:spPr>"
        f"<p:txBody>{paragraphs}</p:txBody></p:sp>"
    )


def pdf(pages: list[list[tuple[float, float, str]]]) -> bytes:
    """Pages of (x, y, text) at 12 points."""
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    kids = []
    for lines in pages:
        content = "BT /F1 12 Tf " + " ".join(f"1 0 0 1 {x} {y} Tm ({t}) Tj" for x, y, t in lines) + " ET"
        objects.append(f"<< /Length {len(content)} >>\nstream\n{content}\nendstream".encode("latin-1"))
        objects.append(
            f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents {len(objects)} 0 R /Resources << /Font << /F1 3 0 R >> >> >>".encode()
        )
        kids.append(f"{len(objects)} 0 R")
    objects[1] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>".encode()
    out = b"%PDF-1.4\n"
    for k, o in enumerate(objects):
        out += f"{k + 1} 0 obj\n".encode() + o + b"\nendobj\n"
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"
