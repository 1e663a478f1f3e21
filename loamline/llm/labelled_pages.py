"""Labelled training pages: random layouts whose article text is known.

Words are invented, so a model trained on these pages learns layout and text shape, no language. In the page source every word of
the article carries ``MARK``; a block that has it is article text. The mark is removed before features are taken.
"""

from __future__ import annotations

import random

MARK = "\ue000"
_SYLLABLES = "ka lo mi ten sa ru vi dor pe ni ash gol hem ist qua ri bel tu on er".split()

_NAV = ["nav", "menu", "navbar", "main-nav", "navigation", "breadcrumbs", "breadcrumb", "topbar", "toc", "pagination", "pager", "skip-link", "mega-menu", "primary_menu"]
_HEADER = ["header", "site-header", "masthead", "page-header", "banner", "top", "branding", "logo", "siteHeader", "tagline"]
_FOOTER = ["footer", "site-footer", "bottom", "page-footer", "legal", "copyright", "siteFooter", "colophon", "site-info"]
_SIDE = ["sidebar", "side", "aside", "widget", "related", "related-posts", "recommended", "popular", "trending", "right-col", "rail", "more-stories", "tags", "archive", "author-box", "blogroll"]
_NOTICE = ["cookie", "cookie-notice", "consent", "gdpr", "notice", "alert", "banner-notice", "popup", "modal", "overlay", "paywall", "newsletter", "message", "announcement", "cookieBanner", "disclaimer", "warning-bar"]
_AD = ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad", "sponsor", "adbox", "promotion", "dfp", "google-ad", "native-ad", "affiliate", "partner"]
_COMMENT = ["comments", "comment", "comment-list", "disqus", "responses", "replies", "discussion", "reader-comments", "commentBody", "user-comments", "comment-thread", "reply", "feedback"]
_SHARE = ["share", "social", "sharing", "follow", "social-links", "share-buttons"]
_MAIN = ["content", "main", "article", "post", "entry", "entry-content", "post-body", "story", "article-body", "main-content", "articleBody", "body-text", "page-content", "text", "story-body"]
_PLAIN = ["container", "wrapper", "row", "col", "inner", "page", "box", "block", "section", "grid", ""]


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        #: How the page's texts look: sentences, or words with odd signs, bars, capitals or no signs at all.
        self.style = self.r.choice(["plain"] * 5 + ["signs", "bars", "capitals", "bare"])
        #: What holds a paragraph of the article; many pages have no ``p``. Text parted by ``br`` alone is one block.
        self.body = self.r.choice(["p"] * 6 + ["div", "div", "span", "br", "br", "section", "cell", "named"])

    def words(self, lo: int, hi: int, mark: bool = False) -> str:
        r = self.r
        out = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi))]
        return " ".join(w + MARK for w in out) if mark else " ".join(out)

    def sentences(self, lo: int, hi: int, mark: bool) -> str:
        r = self.r
        out = [self.words(r.choice([1, 2, 2]), 14, mark).capitalize() for _ in range(r.randint(lo, hi))]
        if self.style == "plain":
            return " ".join(x + r.choice(".....?!") for x in out)
        if self.style == "signs":
            return " ".join(w + r.choice(["***", "###", "%%%", "$$$", "&amp;&amp;", "."]) for x in out for w in x.split(" "))
        text = " | ".join(w for x in out for w in x.split(" ")) if self.style == "bars" else " ".join(out)
        return (text.upper() if self.style == "capitals" else text) + r.choice(["", "", ".", " |"])

    def attr(self, names: list[str], p: float = 0.8) -> str:
        r = self.r
        if r.random() > p:
            return ""
        name = r.choice(names)
        extra = f" {r.choice(_PLAIN)}" if r.random() < 0.3 else ""
        return f' {r.choice(["class", "class", "id"])}="{name}{extra}"'

    def link(self, text: str) -> str:
        return f'<a href="/{self.words(1, 1)}">{text}</a>'

    def links(self, n: int, item: str = "li") -> str:
        return "".join(f"<{item}>{self.link(self.words(1, 4))}</{item}>" for _ in range(n))

    def paragraph(self, lo: int, hi: int, mark: bool) -> str:
        r = self.r
        t = self.sentences(lo, hi, mark)
        if r.random() < 0.25:
            w = t.split(" ")
            k = r.randrange(len(w))
            w[k] = r.choice([f"<b>{w[k]}</b>", f"<em>{w[k]}</em>", self.link(w[k]), f"<b>{w[k]}"])
            t = " ".join(w)
        if mark and self.body != "p":
            cell = f"<table><tr><td>{t}</td></tr></table>"
            named = f"<div class={r.choice(['para', 'paragraph', 'text', 'line', 'paragraph-block', 'rich-text'])}>{t}</div>"
            return {"div": f"<div>{t}</div>", "span": f"<div><span>{t}</span></div>", "br": t + "<br><br>", "section": f"<section>{t}</section>", "cell": cell, "named": named}[self.body]
        return "<p>" + t + ("<br>" if r.random() < 0.1 else "") + ("" if r.random() < 0.15 else "</p>")

    def nav(self) -> str:
        r = self.r
        tag = r.choice(["nav", "nav", "div", "ul", "div"])
        inner = self.links(r.randint(2, 10)) if tag == "ul" or r.random() < 0.7 else " | ".join(self.link(self.words(1, 2)) for _ in range(r.randint(2, 8)))
        inner = inner if tag == "ul" or not inner.startswith("<li") else f"<ul>{inner}</ul>"
        return f"<{tag}{self.attr(_NAV, 0.5 if tag == 'nav' else 1)}>{inner}</{tag}>"

    def header(self) -> str:
        r = self.r
        inner = r.choice([f"<h1>{self.words(1, 4)}</h1>", f"<div>{self.link(self.words(1, 3))}</div>", f"<p>{self.words(2, 7)}</p>", f"<h2>{self.words(1, 3)}</h2><p>{self.sentences(1, 1, False)}</p>"])
        tag = r.choice(["header", "div"])
        return f"<{tag}{self.attr(_HEADER, 0.4 if tag == 'header' else 1)}>{inner}{self.nav() if r.random() < 0.5 else ''}</{tag}>"

    def footer(self) -> str:
        r = self.r
        bits = [f"&copy; {r.randint(1990, 2030)} {self.words(1, 3)}. {self.words(2, 4)}.", f"<p>{self.sentences(1, 3, False)}</p>", f"<ul>{self.links(r.randint(2, 6))}</ul>", f"&copy; {self.words(1, 1)}.example &middot; {self.sentences(1, 2, False)}"]
        tag = r.choice(["footer", "footer", "div"])
        return f"<{tag}{self.attr(_FOOTER, 0.4 if tag == 'footer' else 1)}>{''.join(r.sample(bits, r.randint(1, 3)))}</{tag}>"

    def side(self) -> str:
        r = self.r
        tag = r.choice(["aside", "div", "div", "section"])
        bits = [f"<h3>{self.words(1, 3)}</h3><ul>{self.links(r.randint(2, 7))}</ul>", self.paragraph(1, 4, False), f"<h4>{self.words(1, 4)}</h4>{self.paragraph(1, 2, False)}", f"<p>{self.link(self.words(3, 9))}</p>"]
        return f"<{tag}{self.attr(_SIDE, 0.5 if tag == 'aside' else 1)}>{''.join(r.sample(bits, r.randint(1, 3)))}</{tag}>"

    def notice(self) -> str:
        r = self.r
        tag = r.choice(["div", "div", "section", "p", "dialog"])
        inner = self.sentences(1, 3, False) + r.choice(["", "<button>Ok</button>", self.link(self.words(1, 2))])
        inner = inner if tag == "p" or r.random() < 0.5 else f"<p>{inner}</p>"
        role = r.choice(["", ' role="alert"', ' role="dialog"', ""])
        return f"<{tag}{self.attr(_NOTICE, 1)}{role}>{inner}</{tag}>"

    def ad(self) -> str:
        r = self.r
        tag = r.choice(["div", "div", "aside", "section", "p"])
        inner = r.choice([self.sentences(1, 3, False), self.link(self.sentences(1, 1, False)), f"<p>{self.sentences(1, 2, False)}</p>" if tag != "p" else self.words(2, 9), f"<span>{self.words(1, 2)}</span> {self.sentences(1, 2, False)}"])
        return f"<!-- ad --><{tag}{self.attr(_AD, 1)}>{inner}</{tag}>"

    def form(self) -> str:
        r = self.r
        bits = [f"<label>{self.words(1, 3)}</label><input type='text'>", f"<p>{self.sentences(1, 2, False)}</p><input type=email>", f"<select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select>", f"<textarea>{self.words(2, 4)}</textarea>"]
        return f"<form{self.attr(['search', 'login', 'signup', 'subscribe', 'contact-form'], 0.6)}>{''.join(r.sample(bits, r.randint(1, 3)))}<button>{self.words(1, 2)}</button></form>"

    def comments(self) -> str:
        r = self.r
        n, out = r.randint(1, 6), []
        outer, inner = r.choice([("section", "div"), ("div", "div"), ("ol", "li"), ("div", "article"), ("ul", "li"), ("aside", "p"), ("div", "p")])
        for _ in range(n):
            body = self.sentences(1, 5, False)
            body = f"<b>{self.words(1, 2)}</b> {body}" if inner == "p" else r.choice([f"<h5>{self.words(1, 2)}</h5><p>{body}</p>", f"<p>{body}</p>", body, f"<cite>{self.words(1, 2)}</cite><div>{body}</div><span>{self.link('Reply')}</span>"])
            out.append(f"<{inner}{self.attr(_COMMENT, 0.5)}>{body}</{inner}>")
        head = "" if outer in ("ol", "ul") or r.random() < 0.4 else f"<h3>{r.randint(1, 99)} {self.words(1, 2)}</h3>"
        return f"<{outer}{self.attr(_COMMENT, 1)}>{head}{''.join(out)}</{outer}>"

    def share(self) -> str:
        return f"<div{self.attr(_SHARE, 1)}>{self.r.choice([self.words(1, 3), ' '.join(self.link(self.words(1, 1)) for _ in range(4))])}</div>"

    def article(self) -> str:
        r, m = self.r, True
        bits = []
        if r.random() < 0.85:
            h = f"<h1>{self.words(2, 12, m)}</h1>"
            bits.append(h if r.random() < 0.8 else f"<header>{h}</header>")
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            bits.append(self.paragraph(1, 9, m))
            x = r.random()
            if x < 0.08:
                bits.append(f"<{(h := r.choice(['h2', 'h3', 'h4']))}>{self.words(1, 7, m)}</{h}>")
            elif x < 0.13:
                bits.append("<ul>" + "".join(f"<li>{self.words(2, 12, m)}" + r.choice(["", "</li>"]) for _ in range(r.randint(2, 6))) + "</ul>")
            elif x < 0.17:
                bits.append(f"<blockquote>{self.paragraph(1, 3, m) if r.random() < 0.5 else self.sentences(1, 3, m)}</blockquote>")
            elif x < 0.2:
                bits.append("<table>" + "".join(f"<tr><td>{self.words(1, 3, m)}</td><td>{self.words(1, 3, m)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif x < 0.23:
                bits.append(f"<pre>{self.words(3, 20, m)}</pre>")
            elif x < 0.26:
                bits.append(f"<figure><img src=x><figcaption>{self.words(2, 12, m)}</figcaption></figure>")
            elif x < 0.32:
                bits.append(r.choice([self.ad, self.share, self.side, self.form, self.notice])())
        return "".join(bits)

    def page(self) -> str:
        r = self.r
        if r.random() < 0.03:  # no markup at all
            return self.sentences(1, 6, True)
        art, kind = self.article(), r.random()
        if kind < 0.45:
            tag = r.choice(["article", "article", "main"])
            art = f"<{tag}{self.attr(_MAIN, 0.4)}>{art}</{tag}>"
        elif kind < 0.85:
            art = f"<{(t := r.choice(['div', 'div', 'section', 'td']))}{self.attr(_MAIN, 1)}>{art}</{t}>"
        elif kind < 0.93:
            art = f"<div{self.attr(_PLAIN, 0.6)}>{art}</div>"
        if r.random() < 0.3:
            art = f"<main{self.attr(_MAIN, 0.3)}>{art}</main>"
        before = [f() for f in (self.nav, self.header, self.notice, self.ad, self.form, self.side) if r.random() < 0.4]
        after = [f() for f in (self.comments, self.side, self.share, self.ad, self.footer, self.nav, self.notice, self.form) if r.random() < 0.4]
        r.shuffle(before)
        if r.random() < 0.5:
            r.shuffle(after)
        body = "".join(before) + art + "".join(after)
        if r.random() < 0.4:
            body = f"<div{self.attr(_PLAIN, 0.8)}>{body}</div>"
        sep = r.choice(["", "\n", "\n  "])
        body = body.replace("><", f">{sep}<")
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}" + r.choice(["</body></html>", ""])


def labelled_pages(n: int, seed: int) -> list[str]:
    return [_Page(seed * 1_000_003 + i).page() for i in range(n)]
