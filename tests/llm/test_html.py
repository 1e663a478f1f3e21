import html
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from loamline.llm import html_crf
from loamline.llm.dom_blocks import blocks
from loamline.llm.labelled_pages import MARK, labelled_pages


@pytest.fixture(scope="module")
def field():
    return html_crf.trained()


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks():
    assert texts("<p>a <b>b</b>\n c<br>d<p>e<div>f</div>g") == ["a b c d", "e", "f", "g"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert texts("<table><tr><td>a<td>b<tr><th>c</table>") == ["a", "b", "c"]
    assert texts("x<script>if (a<b) '</p>'</script>y<!-- <p>z --><style>q</style>") == ["x y"]
    assert texts("a &lt; b &amp c &eacute;&#233; &unknown; &nbsp; d") == ["a < b & c éé &unknown; d"]
    assert texts("<a title='1>2' href=\"x>y\">t</a>") == ["t"]
    assert texts("1 < 2 <") == ["1 < 2 <"]
    assert texts("</p></div>a</b>b<title>no") == ["ab"]
    assert texts("<!doctype html><p>a<!-- open <p>b") == ["a"]
    b = blocks("<div class='sideBar main_nav'><a href=x>link</a> text")[0]
    assert b.linked == 4 and {"side", "bar", "main", "nav"} <= b.names and b.tags == {"div"}


def test_deep_and_long(field):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert texts(deep) == ["x"]
    page = "<article>" + "<p>Some words of a long article, again and again.</p>" * 20000 + "</article>"
    assert html_crf.main_text(page, field).count("\n") == 19999


def test_held_out_pages(field):
    bad = n = 0
    for h in labelled_pages(300, 77):
        page = blocks(h)
        want = [MARK in b.text for b in page]
        for b in page:
            b.text = b.text.replace(MARK, "")
        got = field.decode(page)
        bad += sum(x != y for x, y in zip(got, want, strict=True))
        n += len(want)
    assert bad < 0.01 * n


def test_viterbi_is_best(field):
    page = [b for b in blocks(labelled_pages(40, 5)[7])][:9]
    emit = [sum(field._table.get(x, 0.0) for x in f) for f in html_crf.features(page)]

    def value(y):
        return sum(e for e, s in zip(emit, y, strict=True) if s) + sum(field.step[a, b] for a, b in zip(y, y[1:]))  # noqa: B905

    best = max(value([k >> i & 1 for i in range(len(page))]) for k in range(1 << len(page)))
    assert value([int(x) for x in field.decode(page)]) == pytest.approx(best)


def test_expected_counts_by_enumeration():
    emit, step = np.array([[0.3, -0.7, 1.1]]), np.array([[0.2, -0.4], [0.1, 0.6]])
    post, both = html_crf._expected(emit, step, np.ones((1, 3), bool))
    total, p, c = 0.0, np.zeros(3), np.zeros((2, 2))
    for k in range(8):
        y = [k >> i & 1 for i in range(3)]
        v = np.exp(sum(emit[0, i] for i in range(3) if y[i]) + sum(step[y[i], y[i + 1]] for i in range(2)))
        total += v
        p += v * np.array(y)
        for i in range(2):
            c[y[i], y[i + 1]] += v
    assert np.allclose(post[0], p / total) and np.allclose(both, c / total)


def test_corpus_pages(field):
    wrong = []
    for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        art = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", y)).split()) for y in re.split(r"</?(?:p|h1)>", art))
        if html_crf.main_text(r["html"], field) != "\n".join(x for x in parts if x):
            wrong.append(r["page_id"])
    assert len(wrong) <= 1, wrong


def test_extract(spark, field):
    art = "<nav><a href=1>Home</a></nav><article><h1>Title</h1><p>A body of text, quite long enough.</p></article>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "v", art, "x"), (3, "w", art, "x"), (3, "w", art, "x"), (4, "z", "<script>a</script>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    want = "Title\nA body of text, quite long enough."
    got = sorted(map(tuple, html_crf.extract(df, field).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (None, "v", want, len(want)), (3, "w", want, len(want)), (3, "w", want, len(want)), (4, "z", "", 0)], key=str)
    assert html_crf.extract(df.limit(0), field).collect() == []


def test_empty_and_unended_raw_elements():
    assert texts("<p>a</p><svg viewBox='0 0 1 1'/><p>b</p><svg><text>x</text></svg><p>c") == ["a", "b", "c"]
    assert texts("<p>a</p><svg/><p>b</p><MATH hidden /><p>c") == ["a", "b", "c"]
    assert texts("<p>a</p><svg class=x/><text>y</text></svg><p>b") == ["a", "b"]
    for t in ("svg", "math", "object"):
        assert texts(f"<p>a</p><{t} id=x><p>b</p><{t}><p>c") == ["a", "b", "c"]
    assert texts("<p>a</p><script src=x /><p>b") == ["a"]


def test_saved_weights_are_what_training_gives(field):
    new = html_crf.fit()
    assert new.index.keys() == field.index.keys() and abs(new.step - field.step).max() < 1e-6
    assert max(abs(new.weight[i] - field.weight[field.index[k]]) for k, i in new.index.items()) < 1e-6


def test_formulas_are_text(field):
    page = "<article>" + "".join(f"<p>A paragraph of plain prose, number {i}, that says a few things and ends. Another sentence follows it here.</p>" for i in range(4))
    page += "<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='t'>x=2</annotation></math> holds, as every reader of these lines knows well.<math/> It is so.</p></article>"
    assert "So x=2 holds, as every reader of these lines knows well. It is so." in html_crf.main_text(page, field)


PARTS = [
    "The first paragraph of the story says what happened, where it did, and to whom. It is long enough to be read as prose.",
    "A second one follows, with another thought or two; nobody was hurt, and the bridge was opened again by noon.",
    "In the end, the council said that it would look into the matter once more, and then everyone went home.",
]
LAYOUTS = {
    "p": ("<div class=content>", "<p>{}</p>", "</div>"),
    "article p": ("<article>", "<p>{}</p>", "</article>"),
    "div": ("<div class=content>", "<div>{}</div>", "</div>"),
    "div in article": ("<article>", "<div>{}</div>", "</article>"),
    "span": ("<div id=main>", "<div><span>{}</span></div>", "</div>"),
    "br": ("<div class=post>", "{}<br><br>", "</div>"),
    "bare br": ("<div>", "{}<br><br>", "</div>"),
    "section": ("<div class=story>", "<section>{}</section>", "</div>"),
    "cells": ("<table>", "<tr><td>{}</td></tr>", "</table>"),
    "bare": ("", "<p>{}</p>", ""),
}


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("title", [True, False])
def test_articles_without_paragraph_tags(field, layout, title):
    a, each, z = LAYOUTS[layout]
    nav = "<div class=menu><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li></ul></div>"
    side = "<div class=sidebar><h3>More</h3><ul><li><a href=/1>Another story</a></li><li><a href=/2>And one more</a></li></ul></div>"
    end = "<div class=footer>&copy; 2020 Some Paper. All rights reserved.</div>"
    page = f"<html><body>{nav}{'<h1>A bridge is opened</h1>' if title else ''}{a}{''.join(each.format(x) for x in PARTS)}{z}{side}{end}</body></html>"
    got = html_crf.main_text(page, field)
    kept = [x for x in PARTS if x in got]
    assert len(kept) >= 2, got
    assert not any(x in got for x in ("Home", "Another story", "All rights"))
