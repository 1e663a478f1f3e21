"""Document formats to titles and headed sections.

Each parser turns bytes into (title, blocks), a block being a heading or a text; ``sections`` folds these. ``parse`` picks the parser by
extension and raises ``ParseError`` for what it can't read.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

from . import pdf
from .pdf import PdfError

Blocks = list[tuple[bool, str]]


class ParseError(ValueError):
    pass


def sections(blocks: Blocks) -> list[dict]:
    """Texts below the heading before them; blank texts go; a heading without texts stays."""
    out: list[dict] = []
    for heading, text in blocks:
        text = text.strip()
        if not text:
            continue
        if heading:
            out.append({"heading": text, "text": ""})
        elif out:
            out[-1]["text"] += ("\n" if out[-1]["text"] else "") + text
        else:
            out.append({"heading": None, "text": text})
    if not out:
        raise ParseError("empty document")
    return out


def parse_markdown(data: bytes) -> tuple[str | None, Blocks]:
    text, title = data.decode("utf-8-sig"), None
    if m := re.match(r"---\n(.*?)\n---\n", text, re.S):
        found = re.search(r"(?m)^title:\s*[\"']?(.*?)[\"']?\s*$", m[1])
        title, text = found and found[1], text[m.end() :]
    out: Blocks = []
    for line in text.split("\n"):
        if m := re.match(r"(#{1,6}) +(.*)", line):
            if len(m[1]) > 1:
                out.append((True, m[2]))
            else:
                title = title or m[2].strip()
        elif line.startswith("|"):
            cells = [c.strip().replace(r"\|", "|") for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))]
            if not all(re.fullmatch(r":?-+:?", c) for c in cells):
                out.append((False, " | ".join(cells)))
        else:
            out.append((False, line))
    return title, out


class _Html(HTMLParser):
    """Headings h2-h4, paragraphs, list items and table rows of the main content; each text once, in its innermost block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title = self.h1 = None
        self.blocks: Blocks = []
        self.skip = self.main = 0
        self.has_main = False
        self.kind, self.buf, self.cells = "", [], []

    def _flush(self):
        text = " ".join("".join(self.buf).split())
        if text:
            if self.kind in ("td", "th"):
                self.cells.append(text)
            elif self.kind == "h1":
                self.h1 = self.h1 or text
            elif self.kind == "title":
                self.title = text
            elif self.kind:
                self.blocks.append((self.kind in ("h2", "h3", "h4"), text))
        self.kind, self.buf = "", []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.skip or tag in ("nav", "script", "style") or a.get("id") in ("header", "footer"):
            if tag not in ("br", "img", "hr", "meta", "link", "input"):
                self.skip += 1
            return
        if a.get("id") == "main-content":
            self.blocks, self.has_main = [], True
        if tag in ("p", "li", "h1", "h2", "h3", "h4", "td", "th", "title", "tr") or "page-metadata" in (a.get("class") or ""):
            self._flush()
            if tag == "tr":
                self.cells = []
            self.kind = tag if tag != "tr" else ""
            if "page-metadata" in (a.get("class") or ""):
                self.kind = "p"

    def handle_endtag(self, tag):
        if self.skip:
            self.skip -= 1
            return
        if tag == self.kind or tag in ("tr", "table", "ul", "ol", "div", "body"):
            self._flush()
        if tag == "tr" and self.cells:
            self.blocks.append((False, " | ".join(self.cells)))
            self.cells = []

    def handle_data(self, data):
        if not self.skip and self.kind:
            self.buf.append(data)


def parse_html(data: bytes) -> tuple[str | None, Blocks]:
    p = _Html()
    p.feed(data.decode("utf-8", "replace"))
    p.close()
    p._flush()
    return p.h1 or p.title, p.blocks


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def parse_docx(data: bytes) -> tuple[str | None, Blocks]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")  # noqa: S314
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ParseError(f"bad docx: {e}") from e
    title, out = None, []

    def text(node) -> str:
        return "".join(t.text or "" for t in node.iter(f"{_W}t"))

    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            if name == "Title":
                title = title or text(node)
            else:
                out.append((name.startswith("Heading"), text(node)))
        elif node.tag == f"{_W}tbl":
            out += [(False, " | ".join(text(c) for c in row.iter(f"{_W}tc"))) for row in node.iter(f"{_W}tr")]
    return title, out


def parse_conversation(data: bytes) -> tuple[str | None, Blocks]:
    """Tickets, chats and mail threads, told apart by their keys."""
    try:
        d = json.loads(data)
    except ValueError as e:
        raise ParseError(f"bad json: {e}") from e
    messages = d.get("messages") if isinstance(d, dict) else None
    if not isinstance(messages, list):
        raise ParseError("no messages")
    if "ticket_id" in d:
        c = d.get("customer") or {}
        details = [
            f"Ticket: {d['ticket_id']}", f"Status: {d.get('status')} | Priority: {d.get('priority')}", f"Customer: {c.get('name')} ({c.get('customer_id')}, {c.get('tier')} tier)",
            f"Shipment: {d.get('shipment_id')}", f"Requester: {_person(d.get('requester'))}", f"Assignee: {_person(d.get('assignee'))}",
        ]
        head = [(True, "Ticket details"), *((False, x) for x in details)]
    elif "channel" in d:
        head = [(True, f"Thread in {d['channel']}")]
    else:
        head = [(True, "Email thread"), (False, f"Subject: {d.get('subject')}")]
    lines = (line for m in messages for line in _message(m))
    title = d.get("subject") or d.get("channel")
    return str(title) if title else None, [*head, (True, "Messages"), *((False, x) for x in lines)]


def _person(x) -> str:
    """A name with its address, whichever there is."""
    if not isinstance(x, dict):
        return str(x)
    name, email = x.get("name"), x.get("email")
    return f"{name} <{email}>" if name and email else str(name or email or "")


def _message(m: dict) -> list[str]:
    """Lines of a chat, mail or ticket message, told apart by their keys."""
    if "text" in m:
        return [f"[{m.get('ts')}] {m.get('user')}: {m['text']}"]
    if "from" in m:
        to = ", ".join(map(_person, m.get("to") or []))
        return [f"[{m.get('sent_at')}] From {_person(m['from'])} to {to}:", str(m.get("body") or "")]
    return [f"[{m.get('sent_at')}] {m.get('author')} ({m.get('role')}): {m.get('body') or ''}"]


#: Font sizes from which a line of a PDF is the title, or a heading.
PDF_TITLE, PDF_HEADING = 17, 13


def parse_pdf(data: bytes) -> tuple[str | None, Blocks]:
    """The first line of the title's size, else the metadata's title; lines of a heading's size are headings."""
    try:
        named, lines = pdf.read(data)
    except PdfError as e:
        raise ParseError(f"bad pdf: {e}") from e
    title = next((t.strip() for t, size in lines if size >= PDF_TITLE), named)
    return title, [(size >= PDF_HEADING, t) for t, size in lines if size < PDF_TITLE]


PARSERS = {"md": parse_markdown, "html": parse_html, "docx": parse_docx, "pdf": parse_pdf, "json": parse_conversation}


def parse(key: str, data: bytes) -> tuple[str | None, list[dict]]:
    ext = key.rsplit(".", 1)[-1].lower() if "." in key else ""
    if ext not in PARSERS:
        raise ParseError(f"unsupported extension: {ext or 'none'}")
    try:
        title, blocks = PARSERS[ext](data)
    except UnicodeDecodeError as e:
        raise ParseError(f"bad {ext}: {e}") from e
    return title, sections(blocks)
