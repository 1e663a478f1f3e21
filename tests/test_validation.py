from pyspark.sql import functions as F

from loamline.operators.postings_index import PostingsIndex
from loamline.operators.search import batch_vector_top_k, evaluate_retrieval
from loamline.operators.validation import validate_corpus
from loamline.operators.vector_index import VectorIndex
from loamline.streaming import contracts
from loamline.streaming import pipeline as P

EVENTS = "event_name string, bucket string, key string, version_id string, size bigint, sequencer string, event_time string, metadata map<string,string>"


def test_validate_corpus(spark):
    ddl = "doc_id string, key string, allowed_groups array<string>, updated_at string, sections array<string>, payload string, title string"
    rows = [("a", "k1", ["x"], "2024", ["s"], None, "T"), ("a", "k2", [], "2027", ["s"], "p", "Tö"), ("b", "k3", None, None, None, None, None), ("c", "k3", ["x", "q"], "2024", None, "p", "T"), (None, None, ["y"], "2024", [], "p", "T")]
    got = sorted(map(tuple, validate_corpus(spark.createDataFrame(rows, ddl), ["x", "y"], "2026").collect()))
    assert got == sorted([("duplicate_doc_id", "a"), ("duplicate_key", "k3"), ("invalid_groups", "a"), ("invalid_groups", "b"), ("invalid_groups", "c"), ("updated_after_as_of", "a"), ("sections_or_payload", "a"), ("sections_or_payload", "b"), ("title_not_ascii", "a")])
    assert validate_corpus(spark.createDataFrame([], ddl), ["x"], "2026").count() == 0


def test_registration(spark):
    at = "2024-01-02T03:04:05+00:00"
    versions = [("b", "a b.md", "2", '"e"', 3, at, "text/plain", True, False, {"Allowed-Groups": "hr"}), ("b", "a b.md", "1", '"d"', 3, at, None, False, False, {}), ("b", "gone.md", "9", None, None, at, None, True, True, {})]
    listing = spark.createDataFrame(versions, contracts.LISTING)
    put, rm = "ObjectCreated:Put", "ObjectRemoved:Delete"
    events = [(put, "b", "a+b.md", "2", 3, "0A", at, None), (put, "b", "a+b.md", "7", 3, "0B", at, None), (rm, "b", "a+b.md", "7", None, "0C", at, None), (rm, "b", "gone.md", "8", None, "0D", at, None), ("ObjectRemoved:DeleteMarkerCreated", "b", "a+b.md", "5", None, "0E", at, None)]
    got = P.registered(spark.createDataFrame(events, EVENTS), listing).collect()
    assert sorted((r.event_type, r.key, r.version_id, tuple(r.allowed_groups)) for r in got) == [("delete", "a b.md", "5", ()), ("delete", "gone.md", "8", ()), ("upsert", "a b.md", "2", ("hr",))]
    back = P.listed(listing).collect()
    assert sorted((r.event_type, r.key, r.etag) for r in back) == [("delete", "gone.md", None), ("upsert", "a b.md", "e")]
    assert {r.event_id for r in back if r.event_type == "upsert"} == {r.event_id for r in got if r.event_type == "upsert"}
    assert set(back[0].asDict()) == set(P.manifests(spark.createDataFrame(events, EVENTS)).columns)


def test_batch_search_in_passes(spark):
    rows = [(i, [float((i * 7) % 11 - 5), float((i * 3) % 13 - 6), 1.0]) for i in range(60)] + [(100, None), (101, [0.0, 0.0, 0.0]), (102, [None, 1.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = v.select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    one, many = (sorted(map(tuple, batch_vector_top_k(v, q, 5, block=b, digits=9).collect())) for b in (1000, 7))
    assert one == many and len(one) == 300 and {r[0] for r in one} == set(range(60)) == {r[1] for r in one} | set(range(60))


def test_retrieval_evaluation(spark, tmp_path):
    chunks = [(1, "d1", "the travel policy is strict", ["x"], [1.0, 0.0]), (2, "d2", "a wiki of orders", ["x"], [0.0, 1.0]), (3, "d3", "travel policy for hr", ["hr"], [1.0, 0.0])]
    df = spark.createDataFrame(chunks, "id long, doc_id string, text string, groups array<string>, embedding array<double>")
    words, vectors = PostingsIndex.build(df, str(tmp_path / "w")), VectorIndex.build(df, str(tmp_path / "v"))
    asked = [("c1", "What does the travel policy say?", ["x"]), ("c2", "How many orders?", ["x"]), ("c3", "What does the policy say?", None), ("c4", "What does the policy for hr say?", ["hr", "x"])]
    cases = spark.createDataFrame(asked, "case_id string, question string, groups array<string>")
    got = evaluate_retrieval(cases, vectors, words, df, lambda q: q.withColumn("vector", F.array(F.lit(1.0), F.lit(0.1))), k=2).collect()
    assert sorted((r.case_id, r["rank"], r.doc_id, r.route) for r in got) == [("c1", 1, "d1", "docs"), ("c1", 2, "d2", "docs"), ("c4", 1, "d1", "docs"), ("c4", 2, "d3", "docs")]  # equal similarity: the lesser id
