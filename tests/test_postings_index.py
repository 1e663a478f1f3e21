import random

import pytest
from pyspark.sql import functions as F

from loamline.operators import fulltext
from loamline.operators.postings_index import PostingsIndex, bound
from loamline.sources.table import VersionedTable

DDL = "id string, text string, groups array<string>"
WORDS = "shipment delayed port policy travel rules Rotterdam invoice overdue late customer TCK-00013 the of at and report freight customs storm".split()
QUERIES = ["delayed shipments", '"delayed shipment"', "shipment -rotterdam", "rotterdam or rules", "the of", "", None, "TCK-00013", "policy or overdue invoices or storm", "late -late", "nothing", "travel policies report"]


def made(n, seed=2):
    r = random.Random(seed)
    groups = [["x"], ["y"], ["x", "y"], [], None]
    return [(f"d{i:04d}", None if i % 97 == 3 else " ".join(r.choice(WORDS) for _ in range(r.randrange(0, 60))), groups[i % 5]) for i in range(n)]


def brute(rows, queries, k):
    out = []
    for i, q, mine in queries:
        parsed = fulltext.parse_query(q or "")
        got = [(fulltext.score(fulltext.lexemes(t), parsed), d) for d, t, g in rows if set(g or ()) & set(mine or ())] if parsed else []
        best = sorted((-s, d) for s, d in got if s is not None)[:k]
        out += [(i, d, round(-s, 9), n) for n, (s, d) in enumerate(best, 1)]
    return sorted(out)


def found(index, spark, queries, k, **kw):
    df = index.search(spark.createDataFrame(queries, "query_id long, query string, groups array<string>"), k, **kw)
    return sorted((r.query_id, r.id, round(r.lexical_score, 9), r["rank"]) for r in df.collect())


ASKED = [(i, q, [["x"], ["y", "z"], [], None][i % 4]) for i, q in enumerate(QUERIES * 2)] + [(100 + i, q, ["x", "y"]) for i, q in enumerate(QUERIES)]


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_equal_to_scoring_everything(spark, tmp_path, k):
    rows = made(700)
    index = PostingsIndex.build(spark.createDataFrame(rows, DDL), str(tmp_path / "i"), chunk_docs=60)
    assert found(index, spark, ASKED, k) == brute(rows, ASKED, k)


def test_changes_are_followed(spark, tmp_path):
    rows = made(120)
    gold = VersionedTable(spark, str(tmp_path / "gold"), DDL)
    gold.merge(spark.createDataFrame(rows[:100], DDL), "id")
    index = PostingsIndex.build(gold.read(1), str(tmp_path / "i"), chunk_docs=40)
    gold.merge(spark.createDataFrame([(f"d{i:04d}", "storm at the port", ["y"]) for i in range(0, 30)] + rows[100:], DDL), "id", delete_if=F.col("s.id") < "d0010")
    gold.merge(spark.createDataFrame([("d0003", "storm again", ["x"]), ("d0020", "storm storm storm", ["x"])], DDL), "id")
    for v in (2, 3):
        index.follow(gold.changes(v - 1, v), v, "id", "text", "groups")
    now = [tuple(r) for r in gold.read().collect()]
    assert found(index, spark, ASKED, 9) == brute(now, ASKED, 9)


def test_chunks_below_the_bound_are_not_read(spark, tmp_path):
    rows = [(f"d{i:04d}", "storm " * (40 if i == 5 else 1) + "filler words", ["x"]) for i in range(400)]
    index = PostingsIndex.build(spark.createDataFrame(rows, DDL), str(tmp_path / "i"), chunk_docs=20)
    assert found(index, spark, [(1, "storm", ["x"])], 1, first=1) == [(1, "d0005", 4.0, 1)]
    plan = index.blocks().filter("bucket = 3 and lexeme = 'storm'").select("most")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(lexeme,storm)" in plan and "positions" not in plan


def test_bounds_hold():
    r = random.Random(4)
    for _ in range(3000):
        where = {w: sorted(r.sample(range(1, 40), r.randrange(1, 8))) for w in r.sample("abcd", r.randrange(1, 5))}
        for q in ("aa", "aa or bb", "aa bb", '"aa bb" or cc', "aa bb cc -dd", "cc dd or aa"):
            parsed = [[(n, [x[0] for x in p]) for n, p in a] for a in fulltext.parse_query(q)]
            got = fulltext.score(where, parsed)
            assert got is None or got <= bound(parsed, {w: len(p) for w, p in where.items()}) + 1e-9


def test_no_documents(spark, tmp_path):
    index = PostingsIndex.build(spark.createDataFrame([], DDL), str(tmp_path / "i"))
    assert found(index, spark, ASKED, 3) == []


def test_equal_questions_are_searched_once(spark, tmp_path, monkeypatch):
    rows = made(300)
    index = PostingsIndex.build(spark.createDataFrame(rows, DDL), str(tmp_path / "i"), chunk_docs=40)
    searched, search = [], PostingsIndex._search

    def counted(self, q, *rest):
        searched.append(q.count())
        return search(self, q, *rest)

    monkeypatch.setattr(PostingsIndex, "_search", counted)
    asked = [(i, QUERIES[i % 3], [["x", "y"], ["y", "x", "x"], ["y"], None][i % 4]) for i in range(120)]
    assert found(index, spark, asked, 4) == brute(rows, asked, 4)
    assert searched == [6]  # three wordings, two sets of groups


def test_postings_of_many_texts(spark, tmp_path):
    texts = ["well-known port-of-call, the state-of-the-art", None, "", "ports port-port x-ray the-the", "the of", "Ärger ǅ-x port_1 a-b-c", "port " * 50]
    words, docs, starts, positions, sizes = fulltext.chunk_postings(texts)
    got, ends, at = {}, [*starts[1:], len(docs)], 0
    for w, a, b in zip(words, starts, ends, strict=True):
        for i in range(a, b):
            got.setdefault(int(docs[i]), {})[w] = positions[at : at + sizes[i]].tolist()
            at += sizes[i]
    assert got == {i: x for i, t in enumerate(texts) if (x := fulltext.lexemes(t))}
    index = PostingsIndex.build(spark.createDataFrame([(str(i), t, ["x"]) for i, t in enumerate(texts)], DDL), str(tmp_path / "i"))
    assert {r.lexeme: r.most for r in index.blocks().collect()} == {w: max(len(x[w]) for x in got.values() if w in x) for w in words}
