import hashlib
import random
import zlib

import pytest

from loamline.llm import periodic_runs as pr
from loamline.llm import queries

SCHEMA = "doc_id long, text string, runs string, n_words string"


def brute(x, least=12):
    """All runs by trying each period at each place."""
    out = {}
    n = len(x)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            e = i
            while e + q < n and x[e] == x[e + q]:
                e += 1
            if e + q - i >= max(least, 2 * q):
                out.setdefault((i, e + q), q)
            i = e + 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute(w)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    exponent = 1000 * best[1] // best[2] if runs else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    listed = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    return (doc_id, len(runs), *best, exponent, sha(listed), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("least", [2, 3, 5, 12])
def test_runs_against_all_periods(least):
    rng = random.Random(least)
    for _ in range(1500):
        x = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.5:
            x = x[:7] * rng.randrange(1, 9) + x
        assert pr.runs_in(x, least) == sorted(brute(x, least)), x
        assert pr.find_runs([str(i).encode() for i in x], least) == brute(x, least), x


def test_fibonacci_words_have_the_most_runs():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert pr.runs_in(b) == sorted(brute(b)) and len(pr.runs_in(b)) > 10


def test_masking_keeps_only_what_may_repeat():
    rng = random.Random(1)
    other = list(range(1000, 3000))
    run = [1, 2, 3, 4, 5] * 5
    x = other[:700] + run + other[700:]
    ids = pr.word_numbers([str(i).encode() for i in x])
    assert pr.segments(ids) == [(700, 725)]
    far = other[:50] + other[100:130] + other[200:300] + other[100:130] + other[400:420]  # repeated, but in two segments
    assert pr.segments(pr.word_numbers([str(i).encode() for i in far])) == []
    assert pr.segments(pr.word_numbers([])) == []
    rng.shuffle(other)


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "one", "a " * 11, "a " * 12, "a b " * 20, "A a " * 30, "x\x0by\x0cz\r" * 9, ("wort " * 50 + "\n" + "two words " * 40) * 3]
    texts += [" ".join(rng.choice(["ab", "AB", "ç", "d."]) for _ in range(rng.randrange(0, 90))) for _ in range(120)]
    rows = [(i, t, "x", None) for i, t in enumerate(texts)] + [(None, "b c " * 20, None, "y"), (5, "a " * 12, None, None), (5, "a " * 12, None, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((brute_row(r[0], r[1]) for r in rows), key=str)
    assert any(r.n_runs > 1 for r in got.collect())


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(map(tuple, queries.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()), key=str)
    want = sorted((brute_row(r.doc_id, r.text) for r in docs.collect() if len((r.text or "").split()) < 1500), key=str)
    assert set(want) <= set(got) and len(got) == docs.count()


def test_empty_and_very_long(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert pr.periodic_runs(df).collect() == []
    n = 400_000
    long = " ".join(str(i) for i in range(n)) + " " + "tick tock " * n
    row = pr.periodic_runs(spark.createDataFrame([(1, long, None, None)], SCHEMA)).first()
    assert [tuple(r) for r in row.runs] == [(n, 2 * n, 2)] and row.n_words == 3 * n and row.collapsed.endswith(f"{n - 1} tick tock")
    assert pr.periodic_runs(spark.createDataFrame([(1, "z" * 10_000_000, None, None)], SCHEMA)).first().runs == []
