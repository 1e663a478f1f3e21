import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.llm import hard_negatives as hn
from loamline.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int, score string, band string"


def brute(rows, positives=5, negatives=3, low=50, high=95):
    """rows: (vec_id, vector, label); anchors: ids divisible by 50."""
    good = [r for r in rows if r[1] is not None and len(r[1]) and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    good = [(i, np.floor(256 * np.array(v, np.float64)), (c + 1) % 10 if i is not None and i % 7 == 0 else c) for i, v, c in good]
    key = lambda s: (-s[1], s[0] is None, s[0] or 0)
    out = []
    for k, (i, v, c) in enumerate(good):
        if i is None or i % 50:
            continue
        score = lambda same: sorted(((j, float(v @ w)) for m, (j, w, d) in enumerate(good) if m != k and len(w) == len(v) and (d == c) == same), key=key)  # noqa: E731, B023
        other = score(False)
        for pid, p in score(True)[:positives]:
            near = [(n, s) for n, s in other if low * p <= 100 * s <= high * p][:negatives]
            out += [(i, pid, r + 1, n, int(p), int(s)) for r, (n, s) in enumerate(near)]
    return sorted(out, key=str)


def random_rows(n, dim, seed, spread):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * np.exp(rng.normal(size=(n, 1)) * spread)
    x[::9] = x[0]  # a group of copies
    return [(i, x[i].astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(n)]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "s", "b") for r in rows], SCHEMA)
    got = hn.hard_negatives(hn.quantized(df), F.col("vec_id") % 50 == 0, **kw)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(((r[0], r[1], r[2], r[3], int(r[4]), int(r[5])) for r in got.collect()), key=str)


@pytest.mark.parametrize(("spread", "band_rows"), [(0, 16384), (1.0, 100), (0, 150)])
def test_against_brute_force(spark, spread, band_rows):
    rows = random_rows(700, 8, 5, spread)
    got = run(spark, rows, band_rows=band_rows)
    assert got == brute(rows) and len(got) > 50


def test_nulls_ties_repeats_and_other_lengths(spark):
    rows = [(0, [1.0, 0.5], 1), (50, [1.0, 0.5], 1), (50, [1.0, 0.5], 1), (None, [1.0, 0.4], 2), (None, [1.0, 0.4], 1), (1, [0.9, 0.2], 1), (2, [0.8, 0.3], 2), (3, [0.8, 0.3], 3), (4, [0.8, 0.3], 2)]
    rows += [(100, None, 1), (150, [1.0, None], 1), (200, [float("nan"), 1.0], 1), (250, [], 1), (300, [1.0, 1.0], None), (350, [0.0, 0.0], 1), (400, [1.0, 2.0, 3.0], 1), (5, [1.0, 2.0, 3.0], 1), (6, [0.5, 1.0, 1.5], 9)]
    rows += [(450, [-1.0, -1.0], 5), (10, [1.0, 1.0], 5), (11, [1.0, 1.0], 6)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(50, [1.0], 1)]) == []


def test_buckets_are_left_out():
    rng = np.random.default_rng(2)
    c = rng.normal(size=(8 * hn.BUCKET, 16))
    c *= (np.linspace(8, 0.01, len(c)) / np.linalg.norm(c, axis=1))[:, None]
    q, n = c[:3], np.arange(len(c))
    limit = np.zeros((3, 1))
    scores, _, buckets = hn.best_in(q, n[:3], np.zeros(3, int), limit - np.inf, limit + np.inf, limit - np.inf, c, n, np.zeros(len(c), int), n, 5, True)
    want = np.sort(np.where(np.eye(3, len(c), dtype=bool), -np.inf, q @ c.T), axis=1)[:, ::-1][:, :5]
    assert np.allclose(scores[:, 0], want) and buckets < 8
    low = np.full((3, 1), 100 * 40.0)  # the window's lower limit alone
    assert hn.best_in(q, n[:3], np.zeros(3, int), low, limit + np.inf, limit - np.inf, c, n, np.zeros(len(c), int), n, 5, True)[2] < 8


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op12_hard_negatives(spark, sf)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = con.sql(f"select {', '.join(got.columns)} from ({queries.oracle_sql()['op12_hard_negatives']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
