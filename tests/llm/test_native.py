import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.llm import mixing, quality_rules
from loamline.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, host string, n_words string"
ROWS = [
    (1, None, None), (2, "", "b"), (3, " \n ", "b"), (None, "a b c d e f a b c d e g", "a"), (4, "a b c d e f a b c d e g", "a"), (4, "a b c d e f a b c d e g", "a"),
    (5, "x " * 300, "a"), (6, "l one\nl one\n\nl one\n \n \n# * <é>", None), (7, "one two three four five six seven eight nine ten", "z"),
    (8, " ".join(f"w{i % 997}" for i in range(20000)), "é"), (9, "\x0ba b\x0cc", "Z"),
]
ROWS = [(*r, "h", "w") for r in ROWS]


def native(df):
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def base(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    cover = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    out = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover))
    return (*out, out[0] < 10 or 100 * out[4] > 20 * out[0])


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_columns(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source", F.lit("h"), F.lit("w")).collect()] + ROWS
    out = quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA))
    native(out)
    assert sorted((tuple(r) for r in out.select(NAMES).collect()), key=str) == sorted(((r[0], *base(r[1])) for r in rows), key=str)


def test_host_verdicts(spark):
    good = " ".join(f"g{i}" for i in range(30))
    rows = [(i, good, "good") for i in range(60)] + [(100 + i, good if i % 10 == 0 else "bad", "bad") for i in range(60)] + [(200, good, "few"), (201, "x", "few"), (300, good, None)]
    df = spark.createDataFrame([(*r, "h", "w") for r in rows], SCHEMA)
    kept = {r.doc_id for r in quality_rules.quality_rules(df).filter("kept").collect()}
    assert kept == {*range(60), 200, 300}
    assert {r.doc_id for r in quality_rules.keep_good(df).collect()} == kept
    assert quality_rules.keep_good(df).columns == df.columns
    more = df.withColumns({c: F.lit("x") for c in ("_bad_host", "_bad_host_", "host", "kept", "n_words", "failed")})
    assert {r.doc_id for r in quality_rules.keep_good(more).collect()} == kept and quality_rules.keep_good(more).columns == more.columns
    assert quality_rules.quality_rules(df.limit(0)).collect() == [] and quality_rules.keep_good(df.limit(0)).collect() == []


def test_quality_oracle(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    out = quality_rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).select(*NAMES, "kept")
    assert sorted(tuple(r) for r in out.collect()) == sorted(con.sql(quality_rules.ORACLE_SQL).fetchall())


def targets(size_of):
    names = sorted((s for s in size_of if s is not None), key=lambda s: s.encode()) + [None] * (None in size_of)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(size_of.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size_of[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * size_of[s]
            left -= out[s]
        free -= over
    return out


def check_mix(rows, got, close):
    size_of = defaultdict(int)
    for r in rows:
        size_of[r[2]] += len(WORD.findall(r[1] or ""))
    want = targets(size_of)
    assert sorted((g.doc_id, g.size) for g in got if g.doc_id is not None) == sorted((r[0], len(WORD.findall(r[1] or ""))) for r in rows if r[0] is not None)
    assert all(g.taken <= 3 * g.size for g in got)
    source_of = {r[0]: r[2] for r in rows}
    took = defaultdict(int)
    for g in got:
        took[source_of[g.doc_id]] += g.taken
        assert g.source_size == size_of[source_of[g.doc_id]]
        assert g.target == pytest.approx(want[source_of[g.doc_id]])
    for s, t in want.items():
        assert abs(took[s] - t) <= max(close * t, 1), (s, took[s], t)
    return took


def test_mixing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.mix_sources(docs)
    native(out)
    got = out.collect()
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    took = check_mix(rows, got, 0.02)
    assert sorted(map(tuple, mixing.mix_sources(docs.repartition(3)).collect())) == sorted(map(tuple, got))
    mixed = mixing.mixture(docs)
    native(mixed)
    words, whole = Counter(), {r[0]: r[1] for r in rows}
    for r in mixed.collect():
        words[r.source] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text) and set(WORD.findall(r.text)) <= set(WORD.findall(whole[r.doc_id]))
    assert words == Counter({s: n for s, n in took.items() if n})
    assert mixed.columns == docs.columns


def test_mixing_edges(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    check_mix(ROWS, mixing.mix_sources(df).collect(), 0.02)
    assert mixing.mix_sources(df.limit(0)).collect() == [] and mixing.mixture(df.limit(0)).collect() == []
    empty = mixing.mix_sources(df.filter("doc_id < 4")).collect()
    assert [(r.size, r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 3
    total = sum(len(WORD.findall(r.text)) for r in mixing.mixture(df).collect())
    assert total == sum(r.taken for r in mixing.mix_sources(df).collect())


def test_permutation(spark):
    n = F.lit(1000).cast("long")
    df = spark.range(1000).select("id", *(mixing.permute(F.col("id"), n, F.lit(3), seed=s).alias(f"y{s}") for s in (1, 2))).orderBy("id")
    rows = df.collect()
    a = [r.y1 for r in rows]
    assert sorted(a) == list(range(1000)) and a != sorted(a)
    assert abs(sum(a[:500]) / 500 - 499.5) < 60
    assert a != [r.y2 for r in rows]


def test_slot_plan(spark):
    """Shards draw their source counts; every slot is used once and every source gets its slots in its permutations' order."""
    slots, blocks = [30_000, 0, 9_000, 900, 61], [20_000, 10, 3_000, 900, 128]
    rows = [(i + 1, n, b, sum(slots[:i]), sum(slots)) for i, (n, b) in enumerate(zip(slots, blocks, strict=True))]
    sources = spark.createDataFrame(rows, "s_no int, n_slots long, n_blocks long, first_slot long, all_slots long")
    plan = mixing.slot_plan(sources, 5, 512).toPandas()
    total = sum(slots)
    assert sorted(zip(plan.shard, plan.slot, strict=True)) == [(i // 512, i % 512) for i in range(total)]
    for i, n in enumerate(slots):
        own = plan[plan.s_no == i + 1].sort_values("k")
        assert own.k.tolist() == list(range(n)) and (own.pass_no == own.k // blocks[i]).all()
        assert not own.duplicated(["pass_no", "block"]).any() and own.block.between(0, blocks[i] - 1).all()
    draws = mixing.shard_draws(sources, 6, 512, Scratch(spark, "draws")).toPandas().pivot_table(index="shard", columns="s_no", values="n", fill_value=0)
    sizes = draws.sum(axis=1)
    assert sizes.tolist() == [512] * (total // 512) + [total % 512] and set(draws.columns) == {1, 3, 4, 5}
    share = np.array([n / total for n in slots if n])
    full = draws[:-1].to_numpy()
    z = (full.mean(axis=0) - 512 * share) / np.sqrt(512 * share * (1 - share) / len(full))
    assert (abs(z) < 5).all()
    # Multinomial counts vary from shard to shard as they should, neither fixed nor drawn from what is left.
    spread = full.var(axis=0) / (512 * share * (1 - share))
    assert ((spread > 0.5) & (spread < 1.8)).all()
    moved = plan.groupby(["shard", "s_no"]).size().unstack(fill_value=0).reindex(draws.index, fill_value=0).to_numpy() != draws.to_numpy()
    assert moved.any(axis=1).mean() < 0.25  # only what is over moves
    assert mixing.slot_plan(sources, 5, 512).groupBy().agg(F.sum("k")).first()[0] == plan.k.sum()


def test_shard_parts(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    parts = mixing.shard_parts(df).toPandas()
    taken = mixing.mix_sources(df).toPandas()
    assert parts.n.sum() == taken.taken.sum()
    by = parts.groupby("doc_id").n.sum()
    for doc, n in taken.dropna(subset="doc_id").groupby("doc_id").taken.sum().items():
        assert by.get(doc, 0) == n
