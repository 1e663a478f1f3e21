import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from loamline.llm import embedding_graph as eg

SCHEMA = "vec_id long, embedding array<float>, label int, node string, shard int"


def brute(rows, low=0.93):
    ok = []
    for i, r in enumerate(rows):
        v = r[1]
        if r[2] is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok.append(i)
    n, up = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    by = {}
    for i in ok:
        by.setdefault((rows[i][2], len(rows[i][1])), []).append(i)
    for own in by.values():
        x = np.array([rows[i][1] for i in own], np.float32).astype(np.float64)
        norm = np.linalg.norm(x, axis=1)
        for a, b in zip(*np.nonzero((x @ x.T) / (norm[:, None] * norm[None, :]) >= low), strict=True):
            if a != b:
                n[own[a]] += 1
                up[find(own[a])] = find(own[b])
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        c = min(ids) if ids and i in set(ok) else r[0]
        out.append((r[0], n[i], c, r[0] == c))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)
    return sorted((tuple(r)[:4] for r in eg.near_duplicates(df).collect()), key=str)


def made(seed, n=400, d=16, copies=150):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d))
    near = base[rng.integers(0, 40, copies)] + 0.2 * rng.normal(size=(copies, d))
    x = np.concatenate((base, near, base[:10])).astype(np.float32)
    return [(i, v.tolist(), int(i % 2 if i < n else i % 3)) for i, v in enumerate(x)]


def test_against_brute_force(spark):
    rows = made(1)
    assert run(spark, rows) == brute(rows)


def test_split_shards(spark, monkeypatch):
    monkeypatch.setattr(eg, "MAX_SHARD", 120)
    rows = made(2)
    got, want = run(spark, rows), brute(rows)
    assert sum(r[1] for r in got) >= 0.97 * sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.95 * len(want)


def test_edges(spark):
    a, b = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0]
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0, 0.0], 1), (4, [1.0, None, 0.0], 1), (5, [1.0, float("nan"), 0.0], 1), (6, [float("inf"), 0.0, 0.0], 1),
            (7, a, None), (8, a, 1), (9, [2.0, 0.0, 0.2], 1), (None, a, 1), (10, a, 2), (11, [1.0, 0.0], 1), (12, b, 3), (12, b, 3), (13, b, 3), (None, b, 9), (0, [-0.0, 1.0, 0.0], 3)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:0]) == []


def test_range_search_finds_all_in_range():
    rng = np.random.default_rng(3)
    x = eg._unit(np.concatenate((rng.normal(size=(500, 32)), rng.normal(size=(1, 32)) + 0.1 * rng.normal(size=(200, 32)))))
    s = x @ x.T
    np.fill_diagonal(s, -2)
    graph = []
    for i in range(len(x)):
        c = np.argsort(-s[i])[: eg.POOL]
        graph.append(np.array(eg._prune(c, s[i, c], x)))
    assert max(map(len, graph)) <= eg.DEGREE
    got = np.concatenate(list(eg.range_search(x, graph, np.arange(len(x)), [0], 0.93)))
    assert ((got >= 0.93) == (x @ x.T >= 0.93)).mean() > 0.999


@pytest.mark.parametrize("d", ["sf0.01"])
def test_corpus(spark, d):
    rows = [tuple(r.values())[:3] for r in pq.read_table(f"/root/testdata/{d}/embeddings.parquet", columns=["vec_id", "embedding", "label"]).to_pylist()]
    assert run(spark, rows) == brute(rows)


def test_small_groups_beside_a_large_one(spark, monkeypatch):
    """What small groups lose isn't hidden by a large group, and is found exactly if no overlap is left to try."""
    monkeypatch.setattr(eg, "MAX_SHARD", 60)
    monkeypatch.setattr(eg, "OVERLAP", (0.0,))
    monkeypatch.setattr(eg, "EXACT_BLOCK", 150)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(250, 16))
    x = np.concatenate((base, base + 0.25 * rng.normal(size=base.shape), rng.normal(size=16) + 0.01 * rng.normal(size=(250, 16)))).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(len(rows) + i, *r[1:]) for i, r in enumerate(rows[::50])]  # equal vectors
    assert run(spark, rows) == brute(rows)


def test_tight_group_of_any_size(spark, monkeypatch):
    """A tight group above the largest shard is compared in blocks; every link is counted, also those with vectors outside of it."""
    monkeypatch.setattr(eg, "MAX_SHARD", 150)
    monkeypatch.setattr(eg, "EXACT_BLOCK", 100)
    rng = np.random.default_rng(9)
    centre = rng.normal(size=16)
    tight = centre + 0.02 * rng.normal(size=(700, 16))
    rim = centre + 0.28 * rng.normal(size=(200, 16))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate((tight, rim, rng.normal(size=(300, 16)))).astype(np.float32))]
    got, want = run(spark, rows), brute(rows)
    assert [r[2:] for r in got] == [r[2:] for r in want]
    assert sum(r[1] for r in got) >= 0.999 * sum(r[1] for r in want)
    big = np.stack([centre + 0.02 * rng.normal(size=16) for _ in range(3000)])
    x = eg._unit(big)
    graph = [np.array([(i + k) % 3000 for k in (1, 7, 49, 343, 1201)]) for i in range(3000)]
    assert all((s >= 0.93).all() for s in eg.range_search(x, graph, np.arange(256), [0], 0.93))


def test_audit_of_each_label(spark, monkeypatch):
    """Links of a label with few rows are measured; labels without links have nothing to measure."""
    monkeypatch.setattr(eg, "AUDIT", 4)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1200, 16))
    rows = [(i, v.tolist(), 1 if i < 900 else 2) for i, v in enumerate(x.astype(np.float32))]
    rows += [(5000 + i, (np.array(rows[1199][1]) * 1.01 + 0.01 * i).tolist(), 2) for i in range(3)] + [(6000, [1.0] * 16, 3), (6001, None, 3)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = {r.vec_id: r.audit_recall for r in eg.near_duplicates(df).collect()}
    assert got[0] is None and got[6000] is None and got[6001] is None and got[1000] == got[5000] == 1.0
    assert run(spark, rows) == brute(rows)


def test_rings(spark, monkeypatch):
    """Links within inner rings are counted without comparisons, and no pair is counted twice or lost."""
    monkeypatch.setattr(eg, "EXACT_BLOCK", 60)
    rng = np.random.default_rng(12)
    centre = rng.normal(size=12)
    x = np.concatenate([centre + w * rng.normal(size=(150, 12)) for w in (0.01, 0.1, 0.2, 0.4, 1.0)]).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(2000 + i, *r[1:]) for i, r in enumerate(rows[::40])]
    df = spark.createDataFrame([(i, v, 1) for i, v, _ in rows], "vec_id long, embedding array<float>, label int")
    from pyspark.sql import functions as F

    from loamline.scratch import Scratch

    v = F.col("embedding").cast("array<double>")
    nodes = df.groupBy(F.xxhash64("embedding").alias("node"), v.alias("vec")).agg(F.count("*").alias("copies"), F.min("vec_id").alias("id")).withColumns({"shard": F.lit("1"), "own": F.lit(True)})
    found = eg._searched_exactly(nodes.drop("id"), 0.93, Scratch(spark, "t")).filter("links is not null").join(nodes, "node").collect()
    want = {r[0]: r[1] for r in brute(rows)}
    assert {r.id: r.links for r in found} == {r.id: want[r.id] for r in found} and len(found) == len(x)


def test_vectors_are_written_a_few_times_only(spark, monkeypatch):
    """Splitting vectors without any structure doesn't multiply what is kept on disk and shuffled, and links of any strength are found."""
    from loamline.scratch import Scratch

    written = []

    class Counted(Scratch):
        def save(self, df, name):
            out = super().save(df, name)
            written.append((name, out.count()) if "vec" in out.columns else (name, 0))
            return out

    monkeypatch.setattr(eg, "MAX_SHARD", 400)
    rng = np.random.default_rng(21)
    base = rng.normal(size=(1300, 64))
    x = np.concatenate((base, base[:100] + 0.3 * rng.normal(size=(100, 64)), base[500:600] + 0.05 * rng.normal(size=(100, 64)))).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)
    got = sorted((tuple(r)[:4] for r in eg.near_duplicates(df, scratch=Counted(spark, "t")).collect()), key=str)
    assert sum(n for _, n in written) <= 8 * len(rows), written
    want = brute(rows)
    assert sum(r[1] for r in got) >= 0.97 * sum(r[1] for r in want) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


def test_exact_links_of_a_shard_alone(spark):
    """What a vector links with in a shard that it overlaps into isn't counted again in its own."""
    from pyspark.sql import functions as F

    from loamline.scratch import Scratch

    rng = np.random.default_rng(22)
    base = rng.normal(size=(120, 12))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate((base, base + 0.05 * rng.normal(size=base.shape))))]
    one = spark.createDataFrame([r[:2] for r in rows], "node long, vec array<double>").withColumns({"copies": F.lit(1).cast("long"), "shard": F.lit("a"), "own": F.lit(True)})
    both = one.unionByName(one.withColumns({"shard": F.lit("b"), "own": F.lit(False)}))
    found = eg._searched_exactly(both, 0.93, Scratch(spark, "t")).filter("links is not null").collect()
    assert sorted((r.node, r.links) for r in found) == sorted(r[:2] for r in brute([(i, np.float64(v).tolist(), 1) for i, v, _ in rows]))


def test_copies_of_one_vector_find_each_other():
    """Near copies of one vector, each with it as its nearest, are all within reach of a walk that begins at any of them."""
    rng = np.random.default_rng(31)
    centre = rng.normal(size=64)
    x = eg._unit(np.concatenate((centre[None], centre + 0.1 * rng.normal(size=(600, 64)), rng.normal(size=(2000, 64)))))
    got = np.concatenate(list(eg.range_search(x, eg._build(x), np.arange(601), [2600], 0.93)))
    assert ((got >= 0.93) == (x[:601] @ x.T >= 0.93)).all()


def test_parts_of_a_shard_are_one_graph(monkeypatch):
    monkeypatch.setattr(eg, "CELL", 200)
    rng = np.random.default_rng(32)
    x = eg._unit(rng.normal(size=(1500, 24)))
    x = np.concatenate((x, eg._unit(x[:300] + 0.03 * rng.normal(size=(300, 24)))))
    cells = eg._cells(x)
    assert len(cells) > 10 and sum(map(len, cells)) == 2 * len(x)
    graph = eg._build(x)
    assert not eg._unreached(graph, 0)
    got = np.concatenate(list(eg.range_search(x, graph, np.arange(len(x)), [0], 0.93)))
    assert ((got >= 0.93) == (x @ x.T >= 0.93)).mean() > 0.99999
