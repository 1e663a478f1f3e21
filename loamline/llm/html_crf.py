"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

Blocks get features of their ancestors' tags and attribute words and of their text's shape. The field has two states, article and
other. It is trained by maximum likelihood (forward-backward gradients, Adam) on ``labelled_pages``, once for all runs, and decoded by Viterbi.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches
from .dom_blocks import Block, blocks
from .labelled_pages import MARK, labelled_pages
from .textkit import released

#: Pages that the field is trained on, steps of the optimiser and the penalty on squared weights.
TRAIN_PAGES, STEPS, RIDGE = 4000, 200, 1e-5
_END = re.compile(r"[.!?…。]['\"”’)\]]*$")
_STOP = re.compile(r"[.!?,;:]")
_SIGNS = {
    "sign=copyright": re.compile(r"©|\(c\) ?\d{4}|copyright|all rights reserved", re.I),
    "sign=cookie": re.compile(r"\bcookies?\b", re.I),
    "sign=subscribe": re.compile(r"\b(subscribe|newsletter|sign ?up|log ?in|sign ?in|register)\b", re.I),
    "sign=ad": re.compile(r"\b(advertisement|sponsored|promoted)\b", re.I),
    "sign=reply": re.compile(r"^\W*(reply|share|tweet|comments?|\d+ comments?|read more|related|tags)\b", re.I),
}
_WIDTHS = (0, 1, 2, 4, 7, 12, 20, 35, 60)


def _bucket(x: float, edges: tuple) -> int:
    return sum(x > e for e in edges)


def features(page: list[Block]) -> Iterator[list[str]]:
    """Names of each block's features."""
    n, seen_title = len(page), False
    for i, b in enumerate(page):
        words = b.text.count(" ") + 1
        link = b.linked / len(b.text)
        out = [f"tag={b.tag}", *("in=" + t for t in b.tags), *("name=" + x for x in b.names)]
        out.append(f"words={_bucket(words, _WIDTHS)}")
        density = _bucket(link, (0, 0.3, 0.8))
        out.append(f"link={density}")
        out.append(f"stops={_bucket(len(_STOP.findall(b.text)), (0, 1, 3, 8))}")
        ends = bool(_END.search(b.text))
        out.append(f"ends={ends},{_bucket(words, (3, 12))}")
        out.append(f"{b.tag},link={density}")
        out.append(f"{b.tag},{'named' if b.names else 'bare'},words={_bucket(words, (4, 12))}")
        out.append(f"place={min(4, 5 * i // n)}")
        out.append("after_title" if seen_title else "before_title")
        out += [k for k, p in _SIGNS.items() if p.search(b.text)] if words < 60 else []
        seen_title = seen_title or b.tag == "h1"
        yield out


class Field:
    """Weights of the state 'article' against 'other': of features, of the first block, and of steps between states."""

    def __init__(self, index: dict[str, int], weight: np.ndarray, step: np.ndarray):
        self.index, self.weight, self.step = index, weight, step
        self._table = {k: float(weight[i]) for k, i in index.items()}

    def decode(self, page: list[Block]) -> list[bool]:
        """The likeliest states (Viterbi)."""
        get = self._table.get
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b, back = 0.0, 0.0, []
        for k, names in enumerate(features(page)):
            e = sum(get(x, 0.0) for x in names)
            if k == 0:
                a, b = 0.0, e
                back.append((0, 0))
                continue
            fa, fb = a + s00 >= b + s10, a + s01 > b + s11
            back.append((0 if fa else 1, 0 if fb else 1))
            a, b = (a + s00 if fa else b + s10), (a + s01 if fb else b + s11) + e
        out, y = [], int(b > a)
        for x in reversed(back):
            out.append(bool(y))
            y = x[y]
        return out[::-1]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def train(pages: list[str], steps: int = STEPS) -> Field:
    """Fits a field to marked pages."""
    index: dict[str, int] = {}
    rows, labels, length = [], [], []
    for html in pages:
        page = blocks(html)
        labels += [MARK in b.text for b in page]
        for b in page:
            b.text = b.text.replace(MARK, "")
        rows += [[index.setdefault(x, len(index)) for x in f] for f in features(page)]
        length.append(len(page))
    n, d = len(rows), len(index)
    flat = np.concatenate([np.array(r, np.int64) for r in rows])
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    y, length = np.array(labels, np.float64), np.array(length)
    p = len(length)
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    want, groups = np.zeros((2, 2)), []
    for own in np.array_split(np.argsort(length, kind="stable"), 8):  # pages of like length share a padded array
        own = own[length[own] > 0]
        if not len(own):
            continue
        inside = np.arange(int(length[own].max()))[None, :] < length[own][:, None]
        at = np.where(inside, first[own][:, None] + np.arange(inside.shape[1])[None, :], 0)
        state = np.where(inside, y[at], 0).astype(int)
        np.add.at(want, (state[:, :-1][inside[:, 1:]], state[:, 1:][inside[:, 1:]]), 1)
        groups.append((at, inside))
    w, step = np.zeros(d), np.zeros((2, 2))
    m1, m2 = [np.zeros(d), np.zeros((2, 2))], [np.zeros(d), np.zeros((2, 2))]
    for k in range(1, steps + 1):
        emit = np.bincount(owner, weights=w[flat], minlength=n)
        miss, got = np.zeros(n), np.zeros((2, 2))
        for at, inside in groups:
            post, both = _expected(emit[at], step, inside)
            miss[at[inside]] = y[at[inside]] - post[inside]
            got += both
        grad = [np.bincount(flat, weights=miss[owner], minlength=d) / p - RIDGE * w * n / p, (want - got) / p - RIDGE * step]
        for x, g, a, b in zip((w, step), grad, m1, m2, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x += 0.15 * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
    return Field(index, w, step)


def _expected(emit: np.ndarray, step: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: each block's probability of being article, and expected counts of steps between states."""
    score = np.stack((np.zeros_like(emit), emit), axis=2)  # page, place, state
    fwd, bwd = np.zeros_like(score), np.zeros_like(score)
    t = emit.shape[1]
    fwd[:, 0] = score[:, 0]
    for i in range(1, t):
        fwd[:, i] = np.where(inside[:, i, None], _lse(fwd[:, i - 1, :, None] + step[None], 1) + score[:, i], fwd[:, i - 1])
    for i in range(t - 2, -1, -1):
        bwd[:, i] = np.where(inside[:, i + 1, None], _lse(step[None] + (score[:, i + 1] + bwd[:, i + 1])[:, None, :], 2), 0)
    z = _lse(fwd[:, -1], 1)
    post = np.exp(fwd[..., 1] + bwd[..., 1] - z[:, None])
    both = np.exp(fwd[:, :-1, :, None] + step + (score[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])
    return post, both[inside[:, 1:]].sum(axis=0)


#: Weights of the field that ``fit`` gives; ``python -m loamline.llm.html_crf`` writes them anew.
WEIGHTS = Path(__file__).with_name("html_field.json")


def fit(pages: int = TRAIN_PAGES, seed: int = 11) -> Field:
    return train(labelled_pages(pages, seed))


@lru_cache(maxsize=1)
def trained() -> Field:
    """The field of ``WEIGHTS``, so that no driver has to fit it first."""
    saved = json.loads(WEIGHTS.read_text())
    return Field({k: i for i, k in enumerate(saved["weights"])}, np.array(list(saved["weights"].values())), np.array(saved["step"]))


def save(field: Field) -> None:
    weights = {k: float(field.weight[i]) for k, i in field.index.items()}
    WEIGHTS.write_text(json.dumps({"weights": weights, "step": field.step.tolist()}, indent=0) + "\n")


def main_text(html: str | None, field: Field) -> str:
    page = blocks(html or "")
    return "\n".join(b.text for b, keep in zip(page, field.decode(page), strict=True) if keep) if page else ""


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html; others are ignored).

    A null or empty page, or one without article text, has text '' and n_chars 0. Repeated rows and null ids and urls each give a row.
    Empty tables give none.
    """
    bound_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(field or trained())  # a few thousand weights

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            text = [main_text(h, f) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")


if __name__ == "__main__":
    save(fit())
