"""Documents to files, the inverse of the parsers. The same document gives the same bytes.

A document is a dict: title, owner, updated, and sections of a heading and blocks, a block being a paragraph or a table (rows of cells).
"""

from __future__ import annotations

import io
import json
import textwrap
import zipfile
from html import escape

TITLE_SIZE, HEADING_SIZE, TEXT_SIZE = 18, 14, 10
PAGE_LINES, LINE_CHARS = 44, 95


def _is_table(block) -> bool:
    return not isinstance(block, str)


def render_markdown(doc: dict) -> bytes:
    out = ["---", f'title: "{doc["title"]}"', f"owner: {doc.get('owner', '')}", f"updated: {doc.get('updated', '')}", "---", f"# {doc['title']}"]
    for s in doc["sections"]:
        out += ["", f"## {s['heading']}"]
        for b in s["blocks"]:
            if _is_table(b):
                rows = ["| " + " | ".join(c.replace("|", r"\|") for c in row) + " |" for row in b]
                out += ["", rows[0], "|" + "---|" * len(b[0]), *rows[1:]]
            else:
                out += ["", b]
    return ("\n".join(out) + "\n").encode()


def render_html(doc: dict) -> bytes:
    out = [f"<html><head><title>{escape(doc['title'])}</title></head><body>", '<div id="header"><p>Menu</p></div>', '<div id="main-content">', f"<h1>{escape(doc['title'])}</h1>"]
    out.append(f'<div class="page-metadata">Owner: {escape(doc.get("owner", ""))}. Updated: {doc.get("updated", "")}</div>')
    for s in doc["sections"]:
        out.append(f"<h2>{escape(s['heading'])}</h2>")
        for b in s["blocks"]:
            if _is_table(b):
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{escape(c)}</td>" for c in row) + "</tr>" for row in b) + "</table>")
            else:
                out.append(f"<p>{escape(b)}</p>")
    return "\n".join([*out, "</div>", '<div id="footer"><p>Footer</p></div></body></html>']).encode()


def render_docx(doc: dict) -> bytes:
    def par(text: str, style: str = "") -> str:
        kind = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f'<w:p>{kind}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'

    body = par(doc["title"], "Title")
    for s in doc["sections"]:
        body += par(s["heading"], "Heading1")
        for b in s["blocks"]:
            cells = ("".join(f"<w:tc>{par(c)}</w:tc>" for c in row) for row in b) if _is_table(b) else ()
            body += "<w:tbl>" + "".join(f"<w:tr>{row}</w:tr>" for row in cells) + "</w:tbl>" if _is_table(b) else par(b)
    main = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    files = {
        "[Content_Types].xml": f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/word/document.xml" ContentType="{main}"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{office}" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'{head}<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)  # a fixed time, so bytes repeat
    return out.getvalue()


def render_pdf(doc: dict) -> bytes:
    lines = [(doc["title"], TITLE_SIZE)]
    for s in doc["sections"]:
        lines.append((s["heading"], HEADING_SIZE))
        for b in s["blocks"]:
            rows = [" | ".join(row) for row in b] if _is_table(b) else textwrap.wrap(b, LINE_CHARS)
            lines += [(row, TEXT_SIZE) for row in rows]
    pages = [lines[i : i + PAGE_LINES] for i in range(0, len(lines), PAGE_LINES)]
    text = lambda t: b"(" + t.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"
    kids = " ".join(f"{5 + 2 * i} 0 R" for i in range(len(pages)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode(), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    objects.append(b"<< /Title " + text(doc["title"]) + b" >>")
    for i, page in enumerate(pages):
        shown = b"".join(b"BT /F1 %d Tf 1 0 0 1 50 %d Tm %s Tj ET\n" % (size, 800 - 17 * n, text(t)) for n, (t, size) in enumerate(page))
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {6 + 2 * i} 0 R >>".encode())
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(shown), shown))
    out, starts = bytearray(b"%PDF-1.4\n"), []
    for n, body in enumerate(objects, 1):
        starts.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % s for s in starts)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R /Info 4 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, at))


def render_conversation(payload: dict) -> bytes:
    return (json.dumps(payload, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode()


RENDERERS = {"md": render_markdown, "html": render_html, "docx": render_docx, "pdf": render_pdf, "json": render_conversation}


def render(doc: dict, extension: str) -> bytes:
    return RENDERERS[extension](doc)
