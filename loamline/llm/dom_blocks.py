"""HTML to leaf blocks: runs of text between block-level tags, with their open ancestors.

A tolerant one-pass scanner. Unclosed and stray tags are handled as browsers do in the common cases: a block tag
ends an open paragraph, list items, cells and options end each other, an end tag closes what is open inside it, and
an end tag without its start is ignored. Inline tags and ``br`` don't end a block.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""",
    re.S,
)
#: A start tag that ends itself; a slash at the end of an unquoted value is part of that.
_EMPTY = re.compile(r"""(?:[\s"']|<[a-zA-Z]+|\s[^\s=/"'>]+)/>\Z""")
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")

BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td template tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag; it is never part of a page's text.
RAW = frozenset("script style title textarea iframe xmp noembed noframes svg object annotation annotation-xml".split())
#: svg and math may be empty elements; what math holds is text, but for its annotations. One of the second kind without an end tag hides nothing: browsers show what follows.
_FOREIGN, _MAY_STAY_OPEN = frozenset({"svg", "math"}), frozenset({"svg", "object", "annotation", "annotation-xml"})
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}
#: A start tag ends the nearest open one of these, unless one of the second is nearer.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
}


@dataclass(slots=True)
class Block:
    text: str
    #: The innermost block tag, names of all open tags, and words of their class, id and role attributes.
    tag: str
    tags: frozenset
    names: frozenset
    linked: int = 0  # characters inside of links


@dataclass(slots=True)
class _Open:
    tag: str
    tags: frozenset
    names: frozenset
    block: str = field(default="body")


def _attribute_names(attrs: str) -> frozenset:
    out = set()
    if "=" in attrs:
        for name, a, b, c in _ATTR.findall(attrs):
            if name.lower() in ("class", "id", "role", "aria-label", "itemprop", "data-component"):
                out.update(x.lower() for x in _NAME.findall(a or b or c))
    return frozenset(out)


def blocks(html: str) -> list[Block]:
    """The page's non-empty leaf blocks in page order; white space inside one is single spaces."""
    root = _Open("", frozenset(), frozenset())
    stack, out, parts, linked = [root], [], [], 0
    none: frozenset = frozenset()
    unended: set[str] = set()

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = stack[-1]
                out.append(Block(text, top.block, top.tags, top.names, min(linked, len(text))))
            parts, linked = [], 0

    def close(k: int) -> None:
        if any(x.tag in BLOCK for x in stack[k:]):
            flush()
        del stack[k:]

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        data = html[at : m.start()] if m else html[at:]
        if data:
            data = unescape(data)
            parts.append(data)
            if "a" in stack[-1].tags:
                linked += len(data.strip())
        if not m:
            break
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in BLOCK and tag not in BLOCK:
                    break
            else:
                if tag in BLOCK:
                    flush()
            if tag == "br":
                parts.append(" ")
            continue
        tag = (m[2] or m[4] or "").lower()
        if not tag:
            continue
        if tag in RAW:
            if not (tag in _FOREIGN and _EMPTY.search(m[0])):
                e = _RAW_END[tag].search(html, at) if tag not in unended else None
                if e:
                    at = e.end()
                elif tag in _MAY_STAY_OPEN:
                    unended.add(tag)  # no later one has an end tag either
                else:
                    at = end
            parts.append(" ")
            continue
        if tag in ("br", "img", "wbr", "input"):
            if tag != "wbr":
                parts.append(" ")
            continue
        if tag == "math" and _EMPTY.search(m[0]):
            continue
        if tag in BLOCK:
            flush()
            ends, inside = _ENDS.get(tag, (none, none))
            for k in range(len(stack) - 1, 0, -1):
                t = stack[k].tag
                if t in ends or (t == "p" and tag not in ("option", "optgroup")):
                    close(k)
                    if t in ends:
                        break
                elif t in inside or (t in BLOCK and not ends):
                    break
        if tag in VOID:
            continue
        top = stack[-1]
        names = _attribute_names(m[3] or m[5] or "")
        stack.append(_Open(tag, top.tags | {tag} if tag not in top.tags else top.tags, top.names | names if names else top.names, tag if tag in BLOCK else top.block))
    flush()
    return out
