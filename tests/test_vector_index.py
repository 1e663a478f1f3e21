import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.operators.vector_index import VectorIndex

GROUPS = [["staff"], ["hr"], ["staff", "hr"], [], None, ["rare"]]


def made(n=3000, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(30, dim))
    x = centre[rng.integers(0, 30, n)] + 0.6 * rng.normal(size=(n, dim))
    which = rng.choice(6, n, p=[0.3, 0.3, 0.2, 0.09, 0.1, 0.01])
    return x, [GROUPS[i] for i in which]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    x, groups = made()
    rows = [(i, v.tolist(), g) for i, (v, g) in enumerate(zip(x, groups, strict=True))]
    odd = [(None, [1.0] * 24, ["staff"]), (9000, None, ["staff"]), (9001, [0.0] * 24, ["staff"])]
    df = spark.createDataFrame(rows[:2500] + odd, "id long, embedding array<double>, groups array<string>")
    index = VectorIndex.build(df, str(tmp_path_factory.mktemp("index") / "v"), cells=40)
    index.append(spark.createDataFrame(rows[2500:], "id long, embedding array<double>, groups array<string>"))
    return x, groups, index


def exact(x, groups, q, mine, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ (q / np.linalg.norm(q)), 6)
    ids = [i for i in range(len(x)) if set(groups[i] or ()) & set(mine)]
    return sorted(ids, key=lambda i: (-s[i], i))[:k]


def asked(spark, x, seed=5, n=60):
    rng = np.random.default_rng(seed)
    q = x[rng.integers(0, len(x), n)] + 0.2 * rng.normal(size=(n, x.shape[1]))
    mine = [[["staff"], ["hr", "none"], ["rare"], ["rare", "staff"]][i % 4] for i in range(n)]
    rows = [(i, v.tolist(), g) for i, (v, g) in enumerate(zip(q, mine, strict=True))]
    rows += [(900, q[0].tolist(), []), (901, None, ["hr"]), (902, [0.0] * 24, ["hr"]), (903, [1.0, 2.0], ["hr"]), (904, q[0].tolist(), ["nobody"]), (905, q[0].tolist(), None)]
    return q, mine, spark.createDataFrame(rows, "query_id long, query array<double>, groups array<string>")


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.id)
    return out


def test_exact_search(spark, data):
    x, groups, index = data
    q, mine, df = asked(spark, x)
    got = by_query(index.search(df, 8, exact=True).collect())
    assert got == {i: exact(x, groups, q[i], mine[i], 8) for i in range(len(q))}


def test_recall_and_widening(spark, data):
    x, groups, index = data
    q, mine, df = asked(spark, x)
    got = by_query(index.search(df, 8, probes=4).collect())
    want = {i: exact(x, groups, q[i], mine[i], 8) for i in range(len(q))}
    assert all(len(got[i]) == len(want[i]) for i in want)  # those who may read little widen until they have enough
    recall = np.mean([len(set(got[i]) & set(want[i])) / len(want[i]) for i in want])
    assert recall >= 0.95, recall


def test_partitions_are_pruned(spark, data):
    _, _, index = data
    plan = index.rows([3, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1][:80]
    files = [r[0] for r in index.rows([3, 5]).select(F.input_file_name()).distinct().collect()]
    assert files and all("cell=3/" in f or "cell=5/" in f for f in files)
    assert index.rows([3]).select("id", "code")._jdf.queryExecution().executedPlan().toString().count("unit") == 0  # a scan reads codes, not vectors


def test_ties_repeats_and_one_cell(spark, tmp_path):
    rows = [(i, [1.0, 2.0, 3.0], ["a"]) for i in range(6)] + [(7, [1.0, 2.0, 3.0], ["b"]), (7, [1.0, 2.0, 3.0], ["a"]), (8, [-1.0, 0.0, 0.0], ["a"])]
    index = VectorIndex.build(spark.createDataFrame(rows, "id long, embedding array<double>, groups array<string>"), str(tmp_path / "v"), cells=3)
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], ["a"]), (2, [1.0, 2.0, 3.0], ["b"])], "query_id long, query array<double>, groups array<string>")
    for mode in (True, False):
        got = by_query(index.search(df, 7, exact=mode).collect())
        assert got == {1: [0, 1, 2, 3, 4, 5, 7], 2: [7]}
    with pytest.raises(ValueError):
        VectorIndex.build(spark.createDataFrame([], "id long, embedding array<double>, groups array<string>"), str(tmp_path / "e"))


def test_exact_search_keeps_few_rows(spark, tmp_path, monkeypatch):
    """Where bounds leave nothing out, as between random vectors, rows that are written don't grow with the pairs, and strips of several cells give the same rows."""
    from loamline.operators import vector_index
    from loamline.scratch import Scratch

    rng = np.random.default_rng(7)
    x, k = rng.normal(size=(4000, 24)), 5
    rows = [(i, v.tolist(), ["a"] if i % 3 else ["b"]) for i, v in enumerate(x)]
    index = vector_index.VectorIndex.build(spark.createDataFrame(rows, "id long, embedding array<double>, groups array<string>"), str(tmp_path / "v"))
    monkeypatch.setattr(vector_index, "STRIP_BYTES", 8 * 24 * 700)
    written, save = [], Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    asked = spark.createDataFrame([(i, x[i * 20].tolist(), ["a"]) for i in range(200)], "query_id long, query array<double>, groups array<string>")
    got = by_query(index.search(asked, k, exact=True).collect())
    assert got == {i: exact(x, [r[2] for r in rows], x[i * 20], ["a"], k) for i in range(200)}
    assert max(written) <= 200 * k * 10  # 800,000 pairs
