import pytest
from pyspark.sql import functions as F

from loamline.operators import index as I
from loamline.operators.search import hybrid
from loamline.operators import fulltext
from loamline.sources import table
from loamline.sources.parsers import ParseError, parse
from loamline.sources.table import VersionedTable
from loamline.streaming import pipeline as P

EVENTS = "event_name string, bucket string, key string, version_id string, size bigint, sequencer string, event_time string, metadata map<string,string>"


def test_versioned_table(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t", "id INT, v INT")
    rows = lambda *r: spark.createDataFrame(r, "id int, v int")
    assert t.version() == 0 and t.read().count() == 0
    assert t.merge(rows((1, 1), (2, 2)), "id") == {"insert": 2}
    newer = F.col("s.v") > F.col("t.v")
    assert t.merge(rows((1, 0), (2, 5), (3, 3)), "id", newer) == {"keep": 1, "update": 1, "insert": 1}
    assert t.merge(rows((1, 0)), "id", newer).get("update") is None and t.version() == 2
    assert sorted(map(tuple, t.read().collect())) == [(1, 1), (2, 5), (3, 3)]
    assert sorted(map(tuple, t.read(1).collect())) == [(1, 1), (2, 2)]
    assert sorted(tuple(r)[:3] for r in t.changes(1).collect()) == [(2, 2, "update_preimage"), (2, 5, "update_postimage"), (3, 3, "insert")]
    t.merge(rows((3, 9)), "id", delete_if=F.lit(True))
    assert t.changes(2).collect()[0]["_change_type"] == "delete"
    t.merge(rows((7, 7)), "id", stream="s", batch_id=4)
    assert t.merge(rows((8, 8)), "id", stream="s", batch_id=4) == {}
    assert t.append_new(rows((7, 0), (9, 9), (9, 9)), "id")["insert"] == 1
    t.replace_where(rows((9, 1), (10, 1)), "id", "v", rows((0, 9), (0, 1)))
    assert sorted(map(tuple, t.read().collect())) == [(2, 5), (7, 7), (9, 1), (10, 1)]
    t.keep_only(rows((7, 0)), "id")
    assert [tuple(r) for r in t.read().collect()] == [(7, 7)]
    with pytest.raises(ValueError, match="several rows"):
        t.merge(rows((1, 1), (1, 2)), "id")


def test_merges_read_only_files_that_may_hold_a_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(table, "FEW_FILES", 2)
    t = VersionedTable(spark, f"{tmp_path}/t", "id STRING, unit INT, v INT")
    rows = lambda r, v=0: spark.createDataFrame([(f"k{i}", i // 10, v) for i in r], "id string, unit int, v int")
    for k in range(8):
        t.append_new(rows(range(1000 * k, 1000 * k + 1000)), "id")
    files = t._commit(t.version())["files"]
    batch = rows([5, 7, 2040], 9)
    some = t.candidates(batch, "id")
    with_rows = {t._name(r[0]) for r in t._read_files(files).withColumn("f", F.input_file_name()).join(batch, "id", "left_semi").select("f").distinct().collect()}
    assert with_rows <= set(some) and len(with_rows) == 2 and len(some) <= 3 and len(files) == 8
    assert t.candidates(rows([]), "id") == [] and set(t.candidates(batch, "v")) == set(files)  # nothing is known of v
    seen = []
    read = VersionedTable._read_files
    VersionedTable._read_files = lambda self, f: seen.append(set(f)) or read(self, f)
    try:
        assert t.merge(batch, "id") == {"update": 3}
    finally:
        VersionedTable._read_files = read
    assert all(f <= set(some) for f in seen if f & set(files))
    t.replace_where(rows([100, 101], 3), "id", "unit", rows([100]).select("unit"))
    want = sorted((f"k{i}", {5: 9, 7: 9, 2040: 9, 100: 3, 101: 3}.get(i, 0)) for i in range(8000) if i not in range(102, 110))
    assert sorted((r.id, r.v) for r in t.read().collect()) == want
    before, n = len(t._commit(t.version())["files"]), t.version()
    assert t.compact(4000) > 2 and t.version() == n + 1 and len(t._commit(t.version())["files"]) < before
    assert sorted((r.id, r.v) for r in t.read().collect()) == want and t.changes(n).count() == 0 and t.compact(4000) == 0
    assert t.merge(rows([5], 1), "id", delete_if=F.lit(True)) == {"delete": 1} and t.read().count() == len(want) - 1


def test_two_writers(spark, tmp_path, monkeypatch):
    """Of two writers of a version one fails, and the change feed is that of the one who won."""
    ddl = "id INT, v INT"
    a, b = (VersionedTable(spark, f"{tmp_path}/t", ddl) for _ in range(2))
    rows = lambda *r: spark.createDataFrame(r, "id int, v int")
    a.merge(rows((1, 1)), "id")
    publish = VersionedTable._publish

    def late(self, version, commit):
        if self is b:  # a commits between b's writing and its commit
            a.merge(rows((2, 2)), "id")
        publish(self, version, commit)

    monkeypatch.setattr(VersionedTable, "_publish", late)
    with pytest.raises(RuntimeError, match="another writer"):
        b.merge(rows((3, 3)), "id")
    monkeypatch.undo()
    assert sorted(map(tuple, a.read().collect())) == [(1, 1), (2, 2)] and a.version() == 2
    assert sorted(map(tuple, a.changes(0).select("id", "_change_type", "_version").collect())) == [(1, "insert", 1), (2, "insert", 2)]
    assert b.merge(rows((3, 3)), "id") == {"insert": 1} and [r.id for r in a.changes(2).collect()] == [3]


def test_parsers():
    md = b"---\ntitle: 'T'\n---\n# Ignored\nintro\n## A\none\n| x | y |\n|---|---|\n| 1 | a\\|b |\n## B\n"
    assert parse("d/x.md", md) == ("T", [{"heading": None, "text": "intro"}, {"heading": "A", "text": "one\nx | y\n1 | a|b"}, {"heading": "B", "text": ""}])
    html = b"<title>no</title><nav>menu</nav><div id=header>x<p>y</p></div><h1>T</h1><h2>A</h2><p>one<li>two</li><table><tr><td>1<td>2</tr></table><script>z</script>"
    assert parse("x.html", html) == ("T", [{"heading": "A", "text": "one\ntwo\n1 | 2"}])
    chat = b'{"channel":"c","messages":[{"user":"u","ts":"1","text":"hi"}]}'
    assert parse("x.json", chat) == ("c", [{"heading": "Thread in c", "text": ""}, {"heading": "Messages", "text": "[1] u: hi"}])
    for key, data in (("x.docx", b"no"), ("x.json", b"{"), ("x.json", b'{"messages": 1}'), ("x.md", b""), ("x.exe", b"a"), ("noext", b"a")):
        with pytest.raises(ParseError):
            parse(key, data)


def test_lake(spark, tmp_path):
    lake = P.Lake(spark, f"{tmp_path}/lake")
    contents = [("a.md", "1", b"# A\n## S\nsame text"), ("bb.md", "1", b"# B\n## S\nSame  text"), ("c.md", "1", b"# C\n## S\nmail x@y.org"), ("c.md", "2", b"# C\n## S\nnew text"), ("c.md", "3", b"# C\n## S\nthird text"), ("d.bin", "1", b"?")]
    objects = spark.createDataFrame(contents, "key string, version_id string, content binary")

    def push(*events):
        meta = {"Allowed-Groups": "staff, hr,staff", "Source-Type": "wiki"}
        rows = [(kind, "b", key, v, 1, f"{n:04x}", f"2024-01-01T00:00:{n:02d}Z", meta) for n, kind, key, v in events]
        P.write_manifests(P.manifests(spark.createDataFrame(rows, EVENTS)), f"{tmp_path}/manifests")
        run()

    def run():
        P.run_bronze(lake, f"{tmp_path}/manifests", objects)
        P.run_silver(lake)
        P.run_gold(lake)

    def gold():
        return sorted((r.chunk_id, r.content) for r in lake.table("gold").read().collect())

    put, gone = "ObjectCreated:Put", "ObjectRemoved:Delete"
    push((1, put, "a.md", "1"), (2, put, "bb.md", "1"), (3, put, "c.md", "1"), (4, put, "d.bin", "1"))
    silver = {r.key: r for r in lake.table("silver").read().collect()}
    assert silver["bb.md"].is_duplicate and silver["bb.md"].canonical_key == "a.md" and silver["c.md"].pii_types == ["email"]
    assert "unsupported" in silver["d.bin"].parse_error and silver["a.md"].allowed_groups == ["hr", "staff"]
    assert gold() == [("a.md:0000", "A > S\n\nsame text"), ("c.md:0000", "C > S\n\nmail x@y.org")]
    versions = [lake.table(n).version() for n in ("bronze", "silver", "gold")]
    run()
    assert versions == [lake.table(n).version() for n in ("bronze", "silver", "gold")]
    push((9, put, "c.md", "2"), (8, put, "c.md", "1"), (3, put, "c.md", "1"), (7, gone, "a.md", "1"))
    assert gold() == [("bb.md:0000", "B > S\n\nSame  text"), ("c.md:0000", "C > S\n\nnew text")]

    index, marks = VersionedTable(spark, f"{tmp_path}/index", I.INDEX), VersionedTable(spark, f"{tmp_path}/marks", "name STRING, version BIGINT")
    embed = lambda df: df.select("content_hash", F.array(F.length("content").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    first = I.update(lake.table("gold"), index, marks, embed, "m")
    assert first["mode"] == "full" and first["computed"] == 2 and index.read().count() == 2
    assert I.update(lake.table("gold"), index, marks, embed, "m") == {"mode": "noop"}
    push((12, put, "c.md", "3"))
    assert I.update(lake.table("gold"), index, marks, embed, "m")["computed"] == 1
    words = fulltext.postings(index.read(), "chunk_id", "content")
    hits = hybrid(index.read(), words, "same text", [1.0, 1.0], ["staff"]).collect()
    assert hits[0].chunk_id == "bb.md:0000" and hits[0].lexical_rank == 1 and len(hits) == 2
    assert hybrid(index.read(), words, "same text", [1.0, 1.0], []).collect() == [] == hybrid(index.read(), words, "same", [1.0, 1.0], ["x"]).collect()


def test_deleted_rows_travel_by_key(spark, tmp_path, monkeypatch):
    """What a replacement or keep_only takes away comes as keys; the change feed has the whole rows, and nothing to delete merges nothing."""
    from loamline.sources.table import VersionedTable

    t = VersionedTable(spark, str(tmp_path / "t"), "id STRING, unit STRING, text STRING")
    t.merge(spark.createDataFrame([(f"k{i}", f"u{i % 3}", "long " * i) for i in range(9)], "id string, unit string, text string"), "id")
    sources, apply = [], VersionedTable._apply

    def seen(self, source, *rest, **kw):
        sources.append(source.filter("text is not null").count())
        return apply(self, source, *rest, **kw)

    monkeypatch.setattr(VersionedTable, "_apply", seen)
    new = spark.createDataFrame([("k0", "u0", "new")], "id string, unit string, text string")
    assert t.replace_where(new, "id", "unit", new.select("unit")) == {"update": 1, "delete": 2}
    assert t.keep_only(t.read().filter("id <> 'k1'"), "id") == {"delete": 1} and t.keep_only(t.read(), "id") == {}
    assert sources == [1, 0]
    gone = {r.id: r.text for r in t.changes(1).filter("_change_type = 'delete'").collect()}
    assert gone == {k: "long " * int(k[1]) for k in ("k1", "k3", "k6")} and sorted(r.id for r in t.read().collect()) == ["k0", "k2", "k4", "k5", "k7", "k8"]
