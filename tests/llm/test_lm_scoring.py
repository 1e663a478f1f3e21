import math
import random
from collections import Counter

import pytest

from loamline.llm import lm_scoring
from loamline.llm.lm_scoring import ADD, DISCOUNT, ce_difference
from loamline.llm.tokenization import WordIds

VOCAB, BEGIN = "word_bpe_49k.json", 49406


def brute(rows, good, leave_out=True):
    """Models are counted anew for each row, from the other rows only if ``leave_out``."""
    words = WordIds(VOCAB)
    toks = [[int.from_bytes(b[i : i + 4], "little") for i in range(0, len(b), 4)] for b in (words(r[1]) for r in rows)]
    pairs = [list(zip([BEGIN, *t], t)) for t in toks]  # noqa: B905

    def model(keep, without):
        c = Counter()
        for k, r in enumerate(rows):
            if keep(r) and k != without:
                c.update(pairs[k])
        ctx, uni, kinds = Counter(), Counter(), Counter()
        for (h, w), n in c.items():
            ctx[h] += n
            uni[w] += n
            kinds[h] += 1
        return c, ctx, uni, kinds, sum(uni.values())

    def p(model, h, w):
        c, ctx, uni, kinds, total = model
        u = (uni[w] + ADD) / (total + ADD * 65536)
        return u if not ctx[h] else max(c[h, w] - DISCOUNT, 0) / ctx[h] + DISCOUNT * kinds[h] / ctx[h] * u

    def models(without):
        return [model(keep, without) for keep in (lambda r: True, lambda r: r[0] in good and r[0] is not None)]

    out, whole = [], models(None)
    for k, (r, ps) in enumerate(zip(rows, pairs, strict=True)):
        own = models(k) if leave_out else whole
        ce = [-sum(math.log2(p(m, *x)) for x in ps) / len(ps) for m in own] if ps else [None, None]
        out.append((r[0], len(ps), *ce, ce[1] - ce[0] if ps else None))
    return out


def same(got, want):
    got, want = (sorted(x, key=lambda r: (str(r[0]), r[1], str(r[2])[:6])) for x in (map(tuple, got), want))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and all(a == b if b is None else a == pytest.approx(b, abs=1e-7) for a, b in zip(g[2:], w[2:], strict=True)), (g, w)


@pytest.mark.parametrize("chunk", [lm_scoring.CHUNK_TOKENS, 8000])
def test_against_brute_force(spark, sf, monkeypatch, chunk):
    monkeypatch.setattr(lm_scoring, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(lm_scoring, "SLICE_TOKENS", min(chunk, 3000))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    ids = {r.doc_id for r in good.collect()}
    same(ce_difference(docs, good, leave_out=False).collect(), brute(rows, ids, False))
    some = docs.filter("length(text) < 3000")
    rows = [tuple(r) for r in some.select("doc_id", "text").collect()]
    same(ce_difference(some, good).collect(), brute(rows, ids))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "a b"), (4, "x"), (5, "a b " * 3000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, chunk int")
    ids = spark.createDataFrame([(3,), (3,), (None,), (99,)], "doc_id long")
    for leave_out in (False, True):
        same(ce_difference(df, ids, leave_out=leave_out).collect(), brute(rows, {3, 99}, leave_out))
        same(ce_difference(df, ids.limit(0), leave_out=leave_out).collect(), brute(rows, set(), leave_out))
    assert ce_difference(df.limit(0), ids).collect() == []
    with pytest.raises(ValueError, match="entries"):
        ce_difference(df, ids, begin=70_000)


def test_repeated_documents_are_told_apart(spark):
    """A document that occurs twice is likely to the background of all others, one that occurs once isn't."""
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(60)) for _ in range(40)]
    rows = [(i, texts[i % 40]) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.ce_background for r in ce_difference(df, df.limit(0)).collect()}
    twice = [got[i] for i in got if i % 40 < 10]
    assert max(twice) < min(got[i] for i in got if i % 40 >= 10)


def test_score_tells_domains_apart(spark):
    a, b = "red green blue red green", "north south east west north"
    rows = [(i, a if i % 2 else b) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in ce_difference(df, df.filter("doc_id % 2 = 1 and doc_id < 30")).collect()}
    assert max(got[i] for i in range(1, 60, 2)) < min(got[i] for i in range(0, 60, 2))
