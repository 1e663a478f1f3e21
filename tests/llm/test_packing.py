import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamline.llm.packing import best_fit, local_search, pack, pack_documents, sequences
from loamline.llm.tokenization import WordIds

VOCAB = "word_bpe_49k.json"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=80))
def test_pack_is_valid(lengths):
    lengths = np.array(lengths)
    bins, offset = pack(lengths, 50)
    for b in set(bins.tolist()):
        at = np.flatnonzero(bins == b)
        at = at[np.argsort(offset[at])]
        assert offset[at].tolist() == np.concatenate(([0], np.cumsum(lengths[at])[:-1])).tolist()
        assert lengths[at].sum() <= 50
    assert sorted(set(bins.tolist())) == list(range(bins.max() + 1))


def test_local_search_beats_best_fit():
    better = 0
    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths = rng.integers(120, 520, 60)
        first = best_fit(lengths, 1000)
        second = local_search(lengths, first, 1000)
        assert second.max() <= first.max()
        better += second.max() < first.max()
    assert better >= 3


def check(rows, docs, cap):
    words = WordIds(VOCAB)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= cap
    want = []
    for d, t in docs:
        ids = words(t) + bytes(4)
        for k in range(math.ceil(len(ids) / 4 / cap)):
            part = ids[4 * k * cap : 4 * (k + 1) * cap]
            want.append((d, k, k * cap, len(part) // 4, zlib.crc32(part)))
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    return len(by), math.ceil(sum(w[3] for w in want) / cap)


def test_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    used, least = check(pack_documents(docs).collect(), [tuple(r) for r in docs.collect()], 2048)
    assert used <= least + 1


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "one two"), (3, "one two"), (4, "word " * 9000), (5, "x" * 100), (6, "<|endoftext|>")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, sequence_id int, part string")
    packed = pack_documents(df, keep_ids=True)
    used, least = check([r for r in packed.drop("ids").collect()], rows, 2048)
    assert used == least
    whole = sequences(packed).collect()
    assert sum(r.length for r in whole) == sum(len(r.ids) for r in whole) // 4 and len(whole) == used
    assert pack_documents(df.limit(0)).collect() == []


@pytest.mark.parametrize("cap", [3, 7])
def test_small_caps(spark, cap):
    rows = [(i, " ".join(["cat"] * (i % 11))) for i in range(40)]
    check(pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), cap=cap).collect(), rows, cap)


def test_local_search_looks_beyond_unusable_bins():
    """Twelve pieces of equal length in fuller bins stand before the one that lets a bin empty."""
    lengths = np.array([30, 60] + [65, 30] * 12)
    bins = np.array([0, 1] + [2 + i // 2 for i in range(24)])
    got = local_search(lengths, bins, 100)
    assert np.bincount(got, weights=lengths).max() <= 100 and got.max() + 1 == 13


def test_search_beats_best_fit_decreasing():
    """Lengths of which best fit leaves many bins half empty: the search empties some of them, and a fill never falls beyond the capacity."""
    rng = np.random.default_rng(4)
    for lengths, gain in ((rng.integers(600, 1100, 6000), 30), (rng.integers(300, 1000, 6000), 20)):
        before = best_fit(lengths, 2048)
        after = local_search(lengths, before, 2048)
        fills = [np.bincount(x, weights=lengths) for x in (before, after)]
        assert fills[1].max() <= 2048 and fills[1].sum() == lengths.sum()
        assert len(fills[0]) - len(fills[1]) >= gain, (len(fills[0]), len(fills[1]))
        assert (fills[1] ** 2).sum() > (fills[0] ** 2).sum()


def test_search_among_many_small_pieces():
    """Bins of many pieces are searched too: no single piece fills the first bin's gap of 3, so two come together, and the third bin empties."""
    lengths = np.array([5] * 40 + [1] * 2 + [2] * 60 + [2] * 2, np.int64)
    bins = np.array([0] * 40 + [1] * 62 + [2] * 2)
    out = local_search(lengths, bins, 203)
    assert sorted(np.bincount(out, weights=lengths).tolist()) == [123, 203]


def test_equal_rows_are_spread_over_groups(spark, monkeypatch):
    """Thousands of rows without an id and with one text are dealt to groups like any others."""
    from loamline.llm import packing

    monkeypatch.setattr(packing, "GROUP_PIECES", 100)
    df = spark.createDataFrame([(None, "one two three " * 100)] * 1000, "doc_id long, text string")
    out = packing.pack_documents(df)
    groups = out.selectExpr("shiftright(sequence_id, 32) as g").distinct().count()
    assert out.count() == 1000 and groups >= 6
