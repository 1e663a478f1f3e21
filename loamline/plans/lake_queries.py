"""Queries over the lake's own operators: manifests, versioned tables, parsing, chunking and a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunking import chunk_sections, content
from ..scratch import Scratch
from ..sources.parsers import ParseError, parse
from ..sources.table import VersionedTable
from ..streaming import pipeline as P
from .catalog import query, table


def notifications(spark, sf_dir) -> DataFrame:
    """Events as object notifications; the object is the user's, and errors are removals."""
    e = table(spark, sf_dir, "events")
    name = F.when(F.col("event_type") == "error", "ObjectRemoved:Delete").otherwise("ObjectCreated:Put")
    meta = F.create_map(F.lit("Allowed-Groups"), F.concat(F.lit("staff, g"), F.col("user_id") % 3, F.lit(",staff")), F.lit("Source-Type"), F.col("event_type"))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return e.select(
        name.alias("event_name"), F.lit("raw").alias("bucket"), F.concat(F.lit("user+files/"), "user_id", F.lit(".md")).alias("key"), F.col("event_id").cast("string").alias("version_id"),
        F.lit(1).cast("long").alias("size"), F.when(F.col("event_id") % 2 == 0, F.hex("event_id")).alias("sequencer"), at.alias("event_time"), meta.alias("metadata"),
    )


MANIFEST_SQL = r"""m AS (SELECT event_id AS n, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS event_type, 'user files/' || user_id || '.md' AS key,
CASE WHEN event_id % 2 = 0 THEN lpad(printf('%X', event_id), 32, '0') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' END AS sort_key,
'g' || (user_id % 3) || ',staff' AS group_list, event_type AS source_type FROM events)"""


@query(f"WITH {MANIFEST_SQL} SELECT sha256(concat_ws(chr(10), 'raw', key, n::VARCHAR, event_type)) AS event_id, event_type, key, sort_key, group_list, source_type FROM m")
def manifest_rows(spark, sf_dir):
    m = P.manifests(notifications(spark, sf_dir))
    return m.select("event_id", "event_type", "key", "sort_key", F.array_join("allowed_groups", ",").alias("group_list"), "source_type")


LISTED_SQL = "l AS (SELECT user_id, max(event_id) AS version FROM events WHERE event_type <> 'error' AND event_id % 3 <> 0 GROUP BY 1)"


def listing(spark, sf_dir) -> DataFrame:
    """Versions that are still there: of a user's good events those that 3 doesn't divide, the last one being the latest."""
    e = table(spark, sf_dir, "events").filter("event_type <> 'error' and event_id % 3 <> 0")
    last = e.groupBy("user_id").agg(F.max("event_id").alias("_last"))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return e.join(last, "user_id").select(
        F.lit("raw").alias("bucket"), F.concat(F.lit("user files/"), "user_id", F.lit(".md")).alias("key"), F.col("event_id").cast("string").alias("version_id"), F.lit('"x"').alias("etag"),
        F.lit(1).cast("long").alias("size"), at.alias("last_modified"), F.lit("text/markdown").alias("content_type"), (F.col("event_id") == F.col("_last")).alias("is_latest"),
        F.lit(False).alias("is_delete_marker"), F.create_map(F.lit("allowed-groups"), F.lit("staff")).alias("metadata"),
    )


@query(f"""WITH {LISTED_SQL}, e AS (SELECT e.user_id, event_id, event_type, l.version FROM events e LEFT JOIN l ON e.user_id = l.user_id),
r AS (SELECT user_id, event_id AS version, 'upsert' AS event_type FROM e WHERE event_type <> 'error' AND event_id % 3 <> 0
UNION SELECT user_id, version, 'upsert' FROM e WHERE event_type = 'error' AND version IS NOT NULL UNION SELECT user_id, event_id, 'delete' FROM e WHERE event_type = 'error' AND version IS NULL)
SELECT event_type, 'user files/' || user_id || '.md' AS key, version::VARCHAR AS version_id, CASE WHEN event_type = 'upsert' THEN 'staff' ELSE '' END AS group_list FROM r""")
def registered_manifests(spark, sf_dir):
    m = P.registered(notifications(spark, sf_dir), listing(spark, sf_dir))
    return m.select("event_type", "key", "version_id", F.array_join("allowed_groups", ",").alias("group_list"))


@query(f"WITH {LISTED_SQL} SELECT 'user files/' || user_id || '.md' AS key, version::VARCHAR AS version_id, 'x' AS etag FROM l")
def listing_manifests(spark, sf_dir):
    return P.listed(listing(spark, sf_dir)).select("key", "version_id", "etag")


def balances(spark, sf_dir) -> DataFrame:
    """What is merged into the customers: new balances of all who order, made of their orders, and all suppliers as new customers."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey"))
    o = o.agg((F.max("o_totalprice") / 50).alias("c_acctbal"), F.max("o_orderstatus").alias("c_mktsegment"))
    return o.unionByName(table(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"), F.lit("new").alias("c_mktsegment")))


BALANCES_SQL = """s AS (SELECT o_custkey AS c_custkey, max(o_totalprice) / 50 AS c_acctbal, max(o_orderstatus) AS c_mktsegment FROM orders GROUP BY 1
UNION ALL SELECT -1 - s_suppkey, s_acctbal, 'new' FROM supplier)"""


def merged_table(spark, sf_dir, name: str) -> VersionedTable:
    """Customers as a table of two versions: all customers, then all of ``balances``; customers with every fifth key who order go."""
    t = VersionedTable(spark, f"{Scratch(spark, name).root}/table", "c_custkey BIGINT, c_acctbal DOUBLE")
    t.merge(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    t.merge(balances(spark, sf_dir), "c_custkey", delete_if=F.col("s.c_custkey") % 5 == 0)
    return t


MERGED_SQL = f"""o AS (SELECT c_custkey, c_acctbal FROM customer), {BALANCES_SQL}"""


@query(f"""WITH {MERGED_SQL}, j AS (SELECT s.c_custkey, o.c_acctbal AS old, s.c_acctbal AS new, o.c_custkey IS NOT NULL AS had FROM s LEFT JOIN o ON s.c_custkey = o.c_custkey)
SELECT c_custkey, old AS c_acctbal, 'delete' AS change FROM j WHERE had AND c_custkey % 5 = 0 UNION ALL SELECT c_custkey, old, 'update_preimage' FROM j WHERE had AND c_custkey % 5 <> 0
UNION ALL SELECT c_custkey, new, 'update_postimage' FROM j WHERE had AND c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, new, 'insert' FROM j WHERE NOT had AND c_custkey % 5 <> 0""")
def change_feed(spark, sf_dir):
    return merged_table(spark, sf_dir, "change-feed").changes(1).select("c_custkey", "c_acctbal", F.col("_change_type").alias("change"))


@query(f"WITH {MERGED_SQL} SELECT * FROM o")
def time_travel(spark, sf_dir):
    return merged_table(spark, sf_dir, "time-travel").read(1)


@query(f"""WITH {MERGED_SQL} SELECT c_custkey, c_acctbal FROM s WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, c_acctbal FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM s)""")
def merged_latest(spark, sf_dir):
    return merged_table(spark, sf_dir, "merged-latest").read()


@query(f"""WITH {MANIFEST_SQL}, e AS (SELECT sha256(concat_ws(chr(10), 'raw', key, n::VARCHAR, event_type)) AS event_id, * FROM m),
l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY sort_key DESC, event_id DESC) = 1),
d AS (SELECT key, group_list, 'note ' || (n % 50) AS body FROM l WHERE event_type = 'upsert')
SELECT key || ':0000' AS chunk_id, 'U > S' || chr(10) || chr(10) || body AS content, group_list FROM d QUALIFY row_number() OVER (PARTITION BY body, group_list ORDER BY length(key), key) = 1""")
def medallion_chunks(spark, sf_dir):
    """All events through the bronze, silver and gold streams: chunks of the newest version of each user's file, one for each group of copies."""
    scratch = Scratch(spark, "medallion")
    lake, arrived = P.Lake(spark, f"{scratch.root}/lake"), f"{scratch.root}/manifests"
    body = F.concat(F.lit("# U\n## S\nnote "), F.col("event_id") % 50).cast("binary")
    versions = table(spark, sf_dir, "events").filter("event_type <> 'error'")
    objects = versions.select(F.concat(F.lit("user files/"), "user_id", F.lit(".md")).alias("key"), F.col("event_id").cast("string").alias("version_id"), body.alias("content"))
    P.write_manifests(P.manifests(notifications(spark, sf_dir)), arrived)
    P.run_bronze(lake, arrived, objects)
    P.run_silver(lake)
    P.run_gold(lake)
    return lake.table("gold").read().select("chunk_id", "content", F.array_join("allowed_groups", ",").alias("group_list"))


def _sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"page_id": pa.int64(), "title": pa.string(), "ordinal": pa.int32(), "heading": pa.string(), "text": pa.string(), "error": pa.string()}
    for b in batches:
        rows = []
        for page, html in zip(b.column("page_id").to_pylist(), b.column("html").to_pylist(), strict=True):
            try:
                title, found = parse("page.html", (html or "").encode("utf-8", "surrogatepass"))
                rows += [(page, title, i, s["heading"], s["text"], None) for i, s in enumerate(found)]
            except ParseError as e:
                rows.append((page, None, None, None, None, str(e)))
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], names=list(kinds))


@query()
def page_sections(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "html").mapInArrow(_sections, "page_id long, title string, ordinal int, heading string, text string, error string")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc, source, text in zip(b.column("doc_id").to_pylist(), b.column("source").to_pylist(), b.column("text").to_pylist(), strict=True):
            rows += [(doc, c["ordinal"], content(source, None, c["text"])) for c in chunk_sections([{"heading": None, "text": text or ""}])]
        cols = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string()), strict=True)], names=["doc_id", "ordinal", "content"])


@query()
def document_chunks(spark, sf_dir):
    out = table(spark, sf_dir, "documents").select("doc_id", "source", "text").mapInArrow(_chunks, "doc_id long, ordinal int, content string")
    return out.withColumn("content_hash", F.sha2("content", 256))
