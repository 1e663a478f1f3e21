import corpus_pipeline as cp
from loamline.llm import language_filters, packing


def test_stages(spark, sf):
    docs = first = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["language_id", "quality_rules", "ngram_jaccard_join", "source_mixing", "best_fit_packing"]
    sizes = []
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        if name != "best_fit_packing":
            assert out.dtypes == first.dtypes
            out = spark.createDataFrame(out.collect(), docs.schema)
        sizes.append(out.count())
        last, docs = docs, out
    assert first.count() >= sizes[0] >= sizes[1] >= sizes[2] > 0
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {r.doc_id for r in last.select("doc_id").distinct().collect()}


def test_run_on_copies_and_junk(spark, tmp_path):
    clean = [" ".join(f"word{i * 7 + j}" for j in range(120)) for i in range(8)]
    rows = [(i, t, "en", f"s{i % 2}", len(t), "extra") for i, t in enumerate(clean)]
    rows += [(20, clean[0], "en", "s0", 1, ""), (21, clean[1] + " and more", "en", "s1", 1, ""), (22, "123 456", "en", "s0", 1, ""), (23, None, None, None, None, None), (24, "spam " * 200, "en", "s1", 1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = cp.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.collect()} <= set(range(8)) and got.count() > 0
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert cp.run(spark, f"{tmp_path}/none").count() == 0
    assert language_filters.keep_known(df.limit(0)).count() == packing.pack_documents(df.limit(0)).count() == 0


def test_stages_on_odd_rows(spark, sf):
    """Nulls, repeats, ties, a very long text and columns with the stages' own names: rows come out whole or not at all."""
    clean = [" ".join(f"word{i * 7 + j} plain" for j in range(60)) for i in range(6)]
    long = " ".join(f"lang{j} wort" for j in range(150_000))
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(clean)]
    rows += [(None, clean[0], "en", None, 1), (None, clean[5] + " tail", None, "s1", None), (3, clean[3], "en", "s1", 1), (3, clean[3], "en", "s1", 1), (90, long, "en", "s0", len(long)), (91, None, "en", "s0", None), (92, "", "en", "s1", 0), (93, " \n ", None, None, 3)]
    extra = "comp string, node int, size string, _doc string, block int, kept boolean, `Hash` string, rank int"
    df = spark.createDataFrame([(*r, "c", 1, "z", "d", 2, True, "h", 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + extra)
    docs = df
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.dtypes == df.dtypes, name
        got = out.collect()
        assert all(tuple(r)[5:] == ("c", 1, "z", "d", 2, True, "h", 3) for r in got), name
        if name != "source_mixing":
            assert all(tuple(r)[:5] in rows for r in got), name
            assert any(r.doc_id == 90 and r.text == long for r in got), name
        docs = spark.createDataFrame(got, df.schema)
        if name == "ngram_jaccard_join":
            assert sorted(r.doc_id for r in got if r.doc_id is not None) == [*range(6), 90]
    assert all(r.text and r.text.strip() for r in docs.collect())
    packed = cp.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()} and all(r.length <= 2048 for r in packed)
