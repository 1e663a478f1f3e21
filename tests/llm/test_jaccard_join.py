import random
import re

import pytest

from loamline.llm import jaccard_join
from loamline.llm.jaccard_join import light_boundary, min_overlap, ngram_components
from loamline.llm.textkit import shingle_sets

SCHEMA = "doc_id long, text string, node string, component_id int"


def sets_of(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows, k, percent):
    sets = [sets_of(r[1], k) for r in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        same = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(same) if same else None) if sets[i] else (r[0], 0, r[0]))
    return sorted(out, key=str)


def corpus(seed, n=160):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Ärger", "É", "x y"]
    rows, shared = [], [rnd.choice(words) for _ in range(70)]
    for i in range(n):
        kind = rnd.random()
        if rows and kind < 0.45:
            t = re.split(r"[ \n]", rnd.choice(rows)[1] or "a")
            for _ in range(rnd.randrange(3)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
        elif kind < 0.6:
            t = [rnd.choice(words) for _ in range(30)] + shared
        else:
            t = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 4, 8, 10, 11, 12, 13, 14, 15, 17, 30, 80, 300]))]
        rows.append((i, rnd.choice([" ", "\n"]).join(t).upper() if kind > 0.95 else " ".join(t), "x", 1))
    return rows


@pytest.mark.parametrize(("k", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (1, 85, 3)])
def test_against_brute_force(spark, k, percent, seed):
    rows = corpus(seed)
    got = ngram_components(spark.createDataFrame(rows, SCHEMA).repartition(5), k, percent)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, k, percent)


def test_edges(spark):
    long = " ".join(f"v{i}" for i in range(20000))
    rows = [(3, None, None, None), (4, "", None, None), (5, " \n\t", None, None), (None, "a b c d e", None, None), (2, "A B c d e", None, None),
            (9, "q r", None, None), (8, "q r", None, None), (7, "q\x0br", None, None), (6, "q r s", None, None),
            (11, long, None, None), (12, long + " tail", None, None), (12, "another text", None, None), (None, "lone null", None, None), (2, "A B c d e", None, None)]
    got = ngram_components(spark.createDataFrame(rows, SCHEMA), 4, 85)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 4, 85)


def test_empty(spark):
    assert ngram_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_parts():
    assert min_overlap(20, 20, 85) == 19 and min_overlap(6, 6, 85) == 6
    assert 6 < light_boundary(85) < 30
    a, b = shingle_sets([b"A b c d e", b"a B C d  e\n"], 4)
    assert (a == b).all() and len(a) == 2


def test_long_lists_in_blocks(spark, monkeypatch):
    """Lists above a block are compared in parts: many sets around one passage, of which some link and most don't."""
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", 7)
    rnd = random.Random(8)
    shared = [f"s{i}" for i in range(30)]
    rows = []
    for i in range(150):
        own = [f"o{i % 50 if i % 3 else i}x{j}" for j in range(3 + i % 4)]
        t = shared + own
        if i % 7 == 0:
            t[rnd.randrange(20)] = f"z{i}"
        rows.append((i, " ".join(t), "x", 1))
    for k, percent in ((1, 85), (4, 85), (2, 80)):
        got = ngram_components(spark.createDataFrame(rows, SCHEMA).repartition(5), k, percent)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, k, percent)


def test_very_long_texts(spark):
    """Texts of tens of MB and a word of a MB."""
    rnd = random.Random(3)
    text = " ".join(f"{rnd.randrange(10**9):09d}" for _ in range(1_200_000))
    cut = text[: len(text) * 9 // 10]
    rows = [(5, text), (2, cut), (3, text.replace("1", "2")), (4, "q" * 1_000_000), (1, "Q" * 1_000_000 + "\n")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    n = len(set(zip(*(text.split()[i:] for i in range(4)))))  # noqa: B905
    assert got[5] == (n, 2) and got[2][1] == 2 and got[3][1] == 3 and got[4] == got[1] == (1, 1)


def test_keep_one(spark):
    """One row of each group stays, whatever repeats: ids, texts, whole rows, null ids; extra columns stay as they are."""
    t, u = "a b c d e f g h i j k l m n o p", "q r s t u v"
    rows = [(1, t, "x", 0), (1, t, "y", 0), (2, t, "x", 0), (None, t, "x", 0), (None, u, "x", 0), (None, u, "x", 0), (None, u + " ", "z", 0), (7, "lone text of its own", "x", 0),
            (8, "", "x", 0), (8, "", "x", 0), (9, None, "x", 0), (7, "another lone text here", "x", 0), (5, t.upper(), "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, stays int").repartition(3)
    got = jaccard_join.keep_one(df)
    assert got.columns == df.columns
    got = sorted((r.doc_id, r.text and r.text.strip()) for r in got.collect() if r.doc_id is not None)
    assert got == [(1, t), (7, "another lone text here"), (7, "lone text of its own"), (8, ""), (8, ""), (9, None)]
    none = [r for r in jaccard_join.keep_one(df).collect() if r.doc_id is None]
    assert len(none) == 1 and none[0].text.strip() == u
    assert jaccard_join.keep_one(df.limit(0)).collect() == []
