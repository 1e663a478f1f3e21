import base64
import json

import pytest

from loamline.functions import tables
from loamline.functions.stemming import stem
from loamline.operators import fulltext
from loamline.sources import fetch, sinks
from loamline.streaming import pipeline as P

EVENTS = "event_name string, bucket string, key string, version_id string, size bigint, sequencer string, event_time string, metadata map<string,string>"

STEMS = """consign consign consigned consign consigning consign consignment consign consist consist consistency consist consistently consist consolation consol consolatory consolatori
consolidate consolid conspicuously conspicu conspiracy conspiraci constables constabl constancy constanc knack knack knackeries knackeri knees knee kneeling kneel knew knew knightly knight
knots knot knowledge knowledg generous generous generate generat communism communism hoping hope hopping hop ties tie cries cri gas gas this this gaps gap say say cry cri by by dying die
news news proceed proceed agreed agre feed feed luxuriated luxuri shipment shipment shipments shipment policies polici delayed delay relational relat national nation happily happili
controlling control rate rate sky sky youth youth boyish boyish tck13 tck13""".split()


@pytest.mark.parametrize("word, want", list(zip(STEMS[::2], STEMS[1::2], strict=True)))
def test_stem(word, want):
    assert stem(word) == want


def test_fulltext_stems_and_stop_words():
    where = fulltext.lexemes("The policies of delayed shipments, and why TCK-00013 is consistently late")
    assert where["polici"] == [2] and where["delay"] == [4] and where["shipment"] == [5] and where["tck-00013"] and "why" not in where
    assert fulltext.score(where, fulltext.parse_query("delaying shipment")) is not None
    assert fulltext.parse_query("why is the") == []


def test_table_functions(spark):
    tables.register(spark)
    docs = spark.createDataFrame([("a.md", b"# T\n\nOne.\n\n## H\n\nTwo."), ("b.exe", b"x"), ("c.md", None)], "key string, content binary")
    docs.createOrReplaceTempView("table_function_docs")
    rows = spark.sql("select d.key, p.* from table_function_docs d, lateral parse_document(d.key, d.content) p").collect()
    assert [(r["heading"], r["text"]) for r in rows if r["key"] == "a.md" and r["heading"] == "H"] == [("H", "Two.")]
    assert [r["error"] for r in rows if r["key"] == "b.exe"] == ["unsupported extension: exe"] and not [r for r in rows if r["key"] == "c.md"]
    got = spark.sql("select * from chunk_text('H', concat(repeat('Word. ', 300), 'End.'))").collect()
    assert [r["ordinal"] for r in got] == list(range(len(got))) and len(got) > 1 and all(len(r["text"]) <= 1200 for r in got)
    assert spark.sql("select * from chunk_text('H', null)").collect()[0]["text"] == "H"


def test_fetch(spark):
    def store():
        tried = {}

        def read(bucket, key, version):
            tried[key] = tried.get(key, 0) + 1
            if key == "gone":
                raise fetch.StoreError("NoSuchVersion")
            if key == "slow" and tried[key] < 3:
                raise fetch.StoreError("SlowDown")
            if key == "dead":
                raise fetch.StoreError("InternalError")
            return f"{bucket}/{key}@{version}".encode()

        return read

    ddl = "event_type string, bucket string, key string, version_id string, size bigint, title string"
    rows = [("upsert", "b", "ok", "v1", 5, "T"), ("upsert", "b", "slow", "", None, None), ("delete", "b", "ok", "v2", None, None), ("upsert", "b", "gone", "v", 1, None), ("upsert", "b", "big", "v", fetch.MAX_OBJECT_BYTES + 1, None)]
    out = fetch.fetch_contents(spark.createDataFrame(rows, ddl).coalesce(1), store, pause=0.0).collect()
    assert [r["fetch_error"] for r in out] == [None, None, None, "missing: NoSuchVersion", f"too_large: {fetch.MAX_OBJECT_BYTES + 1} bytes"]
    assert [None if r["content"] is None else bytes(r["content"]) for r in out] == [b"b/ok@v1", b"b/slow@None", None, None, None]
    assert out[0]["title"] == "T" and len(out[0]["content_sha256"]) == 64
    assert fetch.fetch_contents(spark.createDataFrame([], ddl), store).count() == 0
    with pytest.raises(Exception, match="InternalError"):
        fetch.fetch_contents(spark.createDataFrame([("upsert", "b", "dead", "v", 1, None)], ddl), store, pause=0.0).collect()


def test_bronze_reads_objects_itself(spark, tmp_path):
    def store():
        def read(bucket, key, version):
            if key == "gone.md":
                raise fetch.StoreError("404")
            return f"# {key} {version}".encode()

        return read

    lake = P.Lake.from_env(spark, {"LOAMLINE_ROOT": f"{tmp_path}/lake", "LOAMLINE_MAX_FILES": "7"})
    assert lake.max_files == 7
    for env in ({}, {"LOAMLINE_ROOT": " "}, {"LOAMLINE_ROOT": "x", "LOAMLINE_MAX_FILES": "0"}):
        with pytest.raises(ValueError):
            P.Lake.from_env(spark, env)
    meta = {"Allowed-Groups": "staff", "Source-Type": "wiki"}
    rows = [(kind, "b", key, "v1", 1, f"{n:04x}", f"2024-01-01T00:00:{n:02d}Z", meta) for n, (kind, key) in enumerate([("ObjectCreated:Put", "a.md"), ("ObjectCreated:Put", "gone.md"), ("ObjectRemoved:Delete", "old.md")])]
    P.write_manifests(P.manifests(spark.createDataFrame(rows, EVENTS)), f"{tmp_path}/manifests")
    for _ in range(2):
        P.run_bronze(lake, f"{tmp_path}/manifests", store)
        got = {r["key"]: r for r in lake.table("bronze").read().collect()}
        assert len(got) == 3 and bytes(got["a.md"]["content"]) == b"# a.md v1" and got["a.md"]["ingested_at"] is not None
        assert got["gone.md"]["fetch_error"] == "missing: 404" and got["old.md"]["content"] is None and got["old.md"]["fetch_error"] is None


def test_queue_messages_fail_alone(spark):
    record = {"eventName": "s3:ObjectCreated:Put", "eventTime": "2026-01-01T00:00:00Z", "s3": {"bucket": {"name": "b"}, "object": {"key": "k", "size": 3, "versionId": "v"}}}
    bodies = {"good": json.dumps({"Records": [record, record]}), "test": json.dumps({"Event": "s3:TestEvent"}), "broken": "{", "list": "[]", "null": None, "no key": json.dumps({"Records": [record, {"eventName": "x"}]}), "text": json.dumps({"Records": "x"}), "numbers": json.dumps({"Records": [1]}), "none": json.dumps({"Records": []})}
    messages = spark.createDataFrame(list(bodies.items()), "message_id string, body string")
    events, failed = fetch.queue_events(messages)
    assert [(r["message_id"], r["event_name"], r["size"]) for r in events.collect()] == [("good", "ObjectCreated:Put", 3)] * 2
    ids = {x["itemIdentifier"] for x in json.loads(fetch.batch_failures(failed))["batchItemFailures"]}
    assert ids == {"broken", "list", "null", "no key", "text", "numbers"}


def test_sinks(spark, tmp_path):
    root = str(tmp_path / "ops")
    assert sinks.loaded_tables(spark, root) == {}
    assert sinks.replace_tables(spark, root, {"a": spark.range(3), "b": spark.range(0)}) == {"a": 3, "b": 0}
    assert sinks.replace_tables(spark, root, {"a": spark.range(5), "b": spark.range(1)}) == {"a": 5, "b": 1}
    with pytest.raises(Exception):
        sinks.replace_tables(spark, root, {"a": spark.range(9), "b": spark.sql("select id, raise_error('stop') as x from range(1)")})
    assert {n: df.count() for n, df in sinks.loaded_tables(spark, root).items()} == {"a": 5, "b": 1}

    listed = json.loads(sinks.write_corpus([("wiki/a.md", b"x", {"title": "A"})], tmp_path / "corpus").read_text())
    assert listed[0]["key"] == "wiki/a.md" and (tmp_path / "corpus/raw/wiki/a.md").read_bytes() == b"x"
    sinks.write_corpus([("b.md", b"y", {})], tmp_path / "corpus")
    assert not (tmp_path / "corpus/raw/wiki").exists()
    with pytest.raises(ValueError):
        sinks.write_corpus([("../c.md", b"z", {})], tmp_path / "corpus")

    sinks.write_report(str(tmp_path / "report"), spark.sql("select 2 as cases, 0.5D as mrr"), spark.range(2), mode="retrieval")
    assert json.loads((tmp_path / "report/summary.json").read_text()) == {"mode": "retrieval", "metrics": {"cases": 2, "mrr": 0.5}}
    assert spark.read.json(str(tmp_path / "report/results")).count() == 2
