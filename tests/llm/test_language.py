import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.llm import language_filters as lf

SCHEMA = "doc_id long, text string, lang string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(spark, docs):
    got = lf.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    test = [r for r in got if r.held_out]
    right = [r.lang == r.lang_pred for r in test]
    wrong = [(r.doc_id, r.lang, r.lang_pred, r.text[:60]) for r in got if r.lang != r.lang_pred]
    assert sum(right) / len(right) > 0.99, wrong
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_are_no_input(spark, docs):
    filters = lf.train(docs)
    plain = sorted(lf.identify(docs, filters).collect())
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s"))
    assert sorted(lf.identify(other, filters).collect()) == plain


def test_filters_have_no_false_negatives():
    rng = np.random.default_rng(1)
    sets = {f"l{i:02d}": rng.integers(0, 2**63, 500, dtype=np.uint64) for i in range(70)}
    f = lf.Filters(sets)
    for i, lang in enumerate(f.languages):
        m = f.masks(sets[lang])
        assert ((m[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all()
    other = f.masks(rng.integers(0, 2**63, 20000, dtype=np.uint64))
    assert abs((other[:, 0] & np.uint64(1)).mean() - f.fill[0] ** lf.HASHES) < 0.01


def test_edges(spark):
    en = "the cat and the dog went to the house of the man"
    de = "der hund und die katze gehen in das haus von dem mann"
    rows = [(i, en, "en", "z") for i in range(40)] + [(100 + i, de, "de", "z") for i in range(40)] + [
        (200, None, "en", None), (201, "", None, None), (202, " 12 .!? \n", "de", None), (None, en, "de", None), (203, de, None, None), (203, de, None, None),
        (204, (en + " ") * 4000, None, None), (205, "ΩΣ", None, None), (206, "THE DOG", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.lang_pred) for r in lf.identify(df).collect() if r.doc_id is None or r.doc_id >= 200), key=str)
    assert got == sorted([(200, "und"), (201, "und"), (202, "und"), (None, "en"), (203, "de"), (203, "de"), (204, "en"), (205, "de"), (206, "en")], key=str)
    kept = lf.keep_known(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {*range(40), *range(100, 140), None, 203, 204, 206}
    assert lf.identify(df.limit(0)).collect() == []
    none = lf.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}


def test_keep_known_keeps_the_corpus(spark, docs):
    assert lf.keep_known(docs).count() >= 0.995 * docs.count()
