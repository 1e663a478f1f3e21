import zlib

import pytest

from loamline.sources import renderers as R
from loamline.sources.parsers import ParseError, parse

DOC = {
    "title": "Travel (and stay) policy",
    "owner": "Ops",
    "updated": "2024-05-01",
    "sections": [
        {"heading": "Scope & aims", "blocks": ["All staff \\ guests < 30 days.", [["Grade", "Limit"], ["A", "100"]]]},
        {"heading": "Limits", "blocks": ["Café costs are capped.", "Twice."]},
    ],
}
SECTIONS = [{"heading": "Scope & aims", "text": "All staff \\ guests < 30 days.\nGrade | Limit\nA | 100"}, {"heading": "Limits", "text": "Café costs are capped.\nTwice."}]


@pytest.mark.parametrize("ext", ["md", "docx", "pdf", "html"])
def test_round_trip(ext):
    data = R.render(DOC, ext)
    assert data == R.render(DOC, ext)
    title, found = parse(f"x.{ext}", data)
    assert title == DOC["title"]
    if ext == "html":
        assert found.pop(0) == {"heading": None, "text": "Owner: Ops. Updated: 2024-05-01"}
    assert found == SECTIONS


def test_conversation_bytes():
    payload = {"channel": "c", "messages": [{"user": "u", "ts": "1", "text": "hé"}]}
    assert parse("x.json", R.render_conversation(payload)) == ("c", [{"heading": "Thread in c", "text": ""}, {"heading": "Messages", "text": "[1] u: hé"}])


def test_conversations_keep_who_and_what():
    """Ids, people and recipients of tickets and mails can be found."""
    ticket = {"ticket_id": "TCK-1", "subject": "Late", "status": "open", "priority": "p1", "customer": {"name": "N", "customer_id": "CUST-001", "tier": "gold"}, "shipment_id": "SHP-000001",
              "requester": {"name": "R", "email": "r@x.example"}, "assignee": "A", "messages": [{"author": "R", "role": "customer", "sent_at": "t", "body": "where?"}]}
    want = "Ticket: TCK-1\nStatus: open | Priority: p1\nCustomer: N (CUST-001, gold tier)\nShipment: SHP-000001\nRequester: R <r@x.example>\nAssignee: A"
    assert parse("t.json", R.render_conversation(ticket)) == ("Late", [{"heading": "Ticket details", "text": want}, {"heading": "Messages", "text": "[t] R (customer): where?"}])
    mail = {"thread_id": "E", "subject": "S", "messages": [{"from": {"name": "F", "email": "f@x.example"}, "to": [{"email": "t@x.example"}, "U"], "sent_at": "t", "body": "b"}]}
    assert parse("m.json", R.render_conversation(mail)) == ("S", [{"heading": "Email thread", "text": "Subject: S"}, {"heading": "Messages", "text": "[t] From F <f@x.example> to t@x.example, U:\nb"}])
    for key in ("a.txt", "a.htm"):
        with pytest.raises(ParseError):
            parse(key, b"text")


def test_pdf_of_many_pages():
    doc = {"title": "T", "sections": [{"heading": "H", "blocks": [f"line {i}" for i in range(200)]}]}
    assert parse("x.pdf", R.render_pdf(doc)) == ("T", [{"heading": "H", "text": "\n".join(f"line {i}" for i in range(200))}])


def pdf(content: bytes, font: bytes = b"<< /Type /Font >>", extra: bytes = b"", info: bytes = b"") -> bytes:
    z = zlib.compress(content)
    return (
        b"%%PDF-1.5\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Resources << /Font << /F1 5 0 R >> >> >> endobj\n"
        b"3 0 obj << /Type /Page /Contents [4 0 R] >> endobj\n4 0 obj << /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream endobj\n5 0 obj %s endobj\n%s%s" % (len(z), z, font, extra, info)
    )


def test_pdf_operators():
    content = b"BT /F1 1 Tf 14 0 0 14 50 700 Tm (Head) Tj 10 0 0 10 50 680 Tm [(o) 20 (ne) -300 (two\\056)] TJ 0 -1.2 TD (th\\162ee) Tj T* <666f7572> Tj (same) Tj ET"
    info = b"9 0 obj << /Title <FEFF00540069> >> endobj trailer << /Info 9 0 R >>"
    assert parse("x.pdf", pdf(content, info=info)) == ("Ti", [{"heading": "Head", "text": "one two.\nthree\nfoursame"}])


def test_pdf_unicode_map():
    cmap = b"1 beginbfchar <0001> <00E9> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
    extra = b"7 0 obj << /Length %d >>\nstream\n%s\nendstream endobj\n" % (len(cmap), cmap)
    assert parse("x.pdf", pdf(b"BT /F1 10 Tf 0 0 Td <0010001100120001> Tj ET", b"<< /ToUnicode 7 0 R >>", extra)) == (None, [{"heading": None, "text": "abcé"}])


@pytest.mark.parametrize("data", [b"no", b"%PDF-1.4\n", b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", b"%PDF-1.4 trailer << /Encrypt 3 0 R >>"])
def test_bad_pdf(data):
    with pytest.raises(ParseError):
        parse("x.pdf", data)
