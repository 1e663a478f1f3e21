"""Object events to bronze, silver and gold tables, each a run-to-completion stream that may be run again at any time."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.chunking import chunk_sections, content
from ..operators.documents import canonical_keys, latest_per_key
from ..sources.fetch import MAX_OBJECT_BYTES, fetch_contents
from ..sources.parsers import ParseError, parse
from ..sources.table import VersionedTable
from . import contracts


@dataclass
class Lake:
    """Folders of a lake and the limits of its streams."""

    spark: SparkSession
    root: str
    max_files: int = 500

    @classmethod
    def from_env(cls, spark: SparkSession, env: Mapping[str, str] = os.environ) -> Lake:
        """The lake that LOAMLINE_ROOT and, if it is set, LOAMLINE_MAX_FILES name."""
        root, files = env.get("LOAMLINE_ROOT", "").strip(), env.get("LOAMLINE_MAX_FILES", "").strip() or cls.max_files
        if not root or int(files) < 1:
            raise ValueError("LOAMLINE_ROOT must be set and LOAMLINE_MAX_FILES be at least 1")
        return cls(spark, root, int(files))

    def table(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/{name}", getattr(contracts, name.upper()))


def manifests(events: DataFrame) -> DataFrame:
    """Object notifications (event_name, bucket, key, version_id, size, sequencer, event_time, metadata map) to manifests.

    Keys are URL-decoded, metadata keys lower-cased, and groups become a sorted set; without groups nobody sees the object.
    """
    meta = F.transform_keys(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    df = events.withColumn("metadata", meta).withColumn("key", F.url_decode("key"))
    kind = F.when(F.col("event_name").startswith("ObjectRemoved"), "delete").otherwise("upsert")
    version = F.coalesce(F.nullif("version_id", F.lit("")), F.nullif("sequencer", F.lit("")), F.col("event_time"))
    got = lambda k: F.try_element_at("metadata", F.lit(k))
    df = df.withColumn("event_type", kind).withColumns({
        "event_id": X.event_id(F.col("bucket"), F.col("key"), version, F.col("event_type")), "sort_key": X.sort_key(F.col("sequencer"), F.col("event_time")),
        "doc_id": got("doc-id"), "source_type": got("source-type"), "title": got("title"), "owner": got("owner"),
        "allowed_groups": X.csv_set(got("allowed-groups")), "source_updated_at": got("updated-at"),
    })
    absent = [c for c in ("etag", "content_type") if c not in events.columns]
    df = df.withColumns({c: F.lit(None).cast("string") for c in absent}).withColumns({
        "manifest_version": F.lit(contracts.MANIFEST_VERSION), "etag": F.trim(F.col("etag"), F.lit('"')), "registered_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"),
    })
    return df.select(*T.StructType.fromDDL(contracts.MANIFEST).names)


def listed(listing: DataFrame) -> DataFrame:
    """Manifests of a listing's latest versions and delete markers. They have the ids of the events they stand for, so a backfill may be run again."""
    latest = listing.filter("is_latest")
    name = F.when(F.col("is_delete_marker"), "ObjectRemoved:DeleteMarkerCreated").otherwise("ObjectCreated:Put")
    return manifests(_as_events(latest.withColumn("event_name", name)))


def _as_events(versions: DataFrame) -> DataFrame:
    encoded = F.url_encode("key")  # keys of events are encoded, those of listings aren't
    return versions.withColumns({"key": encoded, "sequencer": F.lit(None).cast("string"), "event_time": X.utc_timestamp(F.col("last_modified"))})


def registered(events: DataFrame, listing: DataFrame) -> DataFrame:
    """Manifests of ``events``, looked up in a ``listing`` of the versions that there are.

    A created object that is gone by now is left out: a later event tells of it. Where one version was purged but the object is still there, its
    current version is registered again. Other removals become deletes. Metadata of created objects come from the listing.
    """
    versions = listing.filter("not is_delete_marker").select(*(F.col(c).alias(f"_l_{c}") for c in listing.columns))
    keyed = events.withColumn("_key", F.url_decode("key"))
    same = (F.col("bucket") == F.col("_l_bucket")) & (F.col("_key") == F.col("_l_key"))
    given = F.nullif("version_id", F.lit(""))
    created = F.col("event_name").startswith("ObjectCreated")
    purged = (F.col("event_name") == "ObjectRemoved:Delete") & given.isNotNull()
    wanted = F.when(created & given.isNotNull(), F.col("_l_version_id") == given).otherwise(F.col("_l_is_latest")) & (created | purged)
    found = keyed.join(versions, same & wanted, "left")
    there = F.col("_l_key").isNotNull()
    new = found.filter(created & there).withColumns({"metadata": F.col("_l_metadata"), "content_type": F.col("_l_content_type")})
    again = found.filter(purged & there).select(*(F.col(f"_l_{c}").alias(c) for c in listing.columns), F.lit("ObjectCreated:Put").alias("event_name"))
    gone = found.filter(~created & ~(purged & there)).withColumn("metadata", F.lit(None).cast("map<string,string>"))
    names = events.columns
    out = manifests(new.select(*names, *(["content_type"] if "content_type" not in names else [])))
    return out.unionByName(manifests(gone.select(*names))).unionByName(manifests(_as_events(again))).dropDuplicates(["event_id"])


def write_manifests(df: DataFrame, path: str) -> None:
    df.withColumn("dt", F.substring("event_time", 1, 10)).write.mode("append").partitionBy("dt").json(path)


def with_content(df: DataFrame, objects: DataFrame) -> DataFrame:
    """Joins bytes of (key, version_id, content); deletes have none, missing and too large objects an error."""
    o = objects.select(F.col("key").alias("_k"), F.col("version_id").alias("_v"), F.col("content").alias("_c"))
    df = df.join(o, (F.col("key") == F.col("_k")) & F.col("version_id").eqNullSafe(F.col("_v")), "left")
    upsert, size = F.col("event_type") == "upsert", F.octet_length("_c")
    error = F.when(upsert & F.col("_c").isNull(), "missing: NoSuchVersion").when(upsert & (size > MAX_OBJECT_BYTES), F.concat(F.lit("too_large: "), size, F.lit(" bytes")))
    df = df.withColumn("fetch_error", error).withColumn("content", F.when(upsert & F.col("fetch_error").isNull(), F.col("_c")))
    return df.withColumn("content_sha256", F.when(F.col("content").isNotNull(), F.sha2("content", 256))).withColumn("ingested_at", F.current_timestamp()).drop("_k", "_v", "_c")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for key, data, error in zip(b.column("key").to_pylist(), b.column("content").to_pylist(), b.column("fetch_error").to_pylist(), strict=True):
            title, found = None, []
            if data is None or error is not None:
                error = f"fetch: {error or 'no content'}"
            else:
                try:
                    title, found = parse(key, data)
                except ParseError as e:
                    error = f"parse: {e}"
            headed = [s for s in found if s["heading"]] or found
            norm = "\n".join(" ".join(f"{s['heading'] or ''}\n{s['text']}".split()).lower() for s in headed)
            text = "\n".join(x for s in found for x in (s["heading"], s["text"]) if x)
            rows.append((title, found, text if found else None, hashlib.sha256(norm.encode()).hexdigest() if found else None, error))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        section = pa.list_(pa.struct([("heading", pa.string()), ("text", pa.string())]))
        kinds = (pa.string(), section, pa.string(), pa.string(), pa.string())
        keep = [b.column(c) for c in ("key", "event_id")]
        yield pa.RecordBatch.from_arrays([*keep, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["key", "event_id", "_title", "sections", "text", "fingerprint", "parse_error"])


def silver_rows(bronze: DataFrame) -> DataFrame:
    """The latest event of each key as a parsed document; deletes become tombstones, unreadable objects keep their error."""
    latest = latest_per_key(bronze, "key", "sort_key", "event_id")
    parsed = latest.select("key", "event_id", "content", "fetch_error").mapInArrow(
        _parse, "key string, event_id string, _title string, sections array<struct<heading:string,text:string>>, text string, fingerprint string, parse_error string"
    )
    df = latest.drop("content").join(parsed, ["key", "event_id"])
    gone = F.col("event_type") == "delete"
    own = F.nullif("title", F.lit(""))
    title = F.when(F.col("fingerprint").isNull(), own).otherwise(F.coalesce(own, F.nullif("_title", F.lit("")), X.basename(F.col("key"))))
    df = df.withColumns({"is_deleted": gone, "title": title, "parse_error": F.when(~gone, F.col("parse_error")), "pii_types": X.detect_pii(F.coalesce("text", F.lit("")))})
    df = df.withColumns({"doc_id": F.coalesce(F.nullif("doc_id", F.lit("")), F.col("key")), "parser_version": F.lit(contracts.PARSER_VERSION), "updated_at": F.current_timestamp()})
    return df.withColumns({"canonical_key": F.col("key"), "is_duplicate": F.lit(False)}).select(*T.StructType.fromDDL(contracts.SILVER).names)


def canonical_updates(silver: DataFrame, touched: DataFrame) -> DataFrame:
    """Rows of ``silver`` with a touched fingerprint and their canonical copy; tombstones and unreadable ones are no copies."""
    df = silver.join(touched.select("fingerprint").distinct(), "fingerprint", "left_semi")
    live = ~F.col("is_deleted") & F.col("parse_error").isNull()
    own = df.filter(live).select("key", "fingerprint", "allowed_groups", "source_updated_at")
    first = canonical_keys(own, "fingerprint", "allowed_groups", "source_updated_at", "key").select("key", F.col("canonical_key").alias("_first"))
    df = df.join(first, "key", "left").withColumn("canonical_key", F.coalesce("_first", "key"))
    return df.withColumns({"is_duplicate": F.col("canonical_key") != F.col("key"), "updated_at": F.current_timestamp()}).select(*T.StructType.fromDDL(contracts.SILVER).names)


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for key, title, found in zip(b.column("key").to_pylist(), b.column("title").to_pylist(), b.column("sections").to_pylist(), strict=True):
            rows += [(key, c["ordinal"], c["heading"], content(title, c["heading"], c["text"]), c["text"]) for c in chunk_sections(found or [])]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["key", "ordinal", "heading", "content", "_text"])


def gold_rows(silver: DataFrame) -> DataFrame:
    """Chunks of live canonical documents."""
    live = silver.filter("not is_deleted and parse_error is null and not is_duplicate")
    chunks = live.select("key", "title", "sections").mapInArrow(_chunk, "key string, ordinal int, heading string, content string, _text string")
    df = chunks.join(live.select("key", "bucket", "doc_id", "title", "source_type", "owner", "allowed_groups", "source_updated_at", "version_id", "content_sha256", "parser_version"), "key")
    df = df.withColumns({"chunk_id": F.format_string("%s:%04d", "doc_id", "ordinal"), "content_hash": F.sha2("content", 256), "allowed_groups": F.array_sort("allowed_groups")})
    df = df.withColumns({
        "source_uri": F.concat(F.lit("s3://"), "bucket", F.lit("/"), "key"), "doc_version": F.coalesce(F.nullif("version_id", F.lit("")), F.col("content_sha256")),
        "pii_types": X.detect_pii(F.col("_text")), "chunker_version": F.lit(contracts.CHUNKER_VERSION), "updated_at": F.current_timestamp(),
    })
    names = [c for c in T.StructType.fromDDL(contracts.GOLD).names if c not in ("row_hash", *contracts.AUDIT)]
    whole = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    return df.withColumn("row_hash", F.sha2(whole, 256)).select(*T.StructType.fromDDL(contracts.GOLD).names)


def run_bronze(lake: Lake, manifest_path: str, objects: DataFrame | Callable) -> None:
    """Streams manifest files into bronze; each event once, whatever is delivered again. ``objects`` are rows of (key, version_id, content), or what ``fetch_contents`` connects by."""

    def batch(df: DataFrame, batch_id: int) -> None:
        new = df.select(*T.StructType.fromDDL(contracts.MANIFEST).names).dropDuplicates(["event_id"])
        rows = with_content(new, objects) if isinstance(objects, DataFrame) else fetch_contents(new, objects).withColumn("ingested_at", F.current_timestamp())
        lake.table("bronze").append_new(rows, "event_id", stream="bronze", batch_id=batch_id)

    src = lake.spark.readStream.schema(contracts.MANIFEST).option("maxFilesPerTrigger", lake.max_files).json(manifest_path)
    run = src.writeStream.foreachBatch(batch).option("checkpointLocation", f"{lake.root}/_checkpoints/bronze").trigger(availableNow=True)
    run.start().awaitTermination()


def _each_commit(lake: Lake, source: str, job: str, batch) -> None:
    """Runs ``batch`` (versions, batch_id) over the commits of ``source`` that ``job`` hasn't seen, in bounded batches, and ends."""

    def run(df: DataFrame, batch_id: int) -> None:
        batch(sorted(r["version"] for r in df.collect()), batch_id)  # at most ``max_files`` numbers

    src = lake.table(source).commits_stream(lake.max_files)
    out = src.writeStream.foreachBatch(run).option("checkpointLocation", f"{lake.root}/_checkpoints/{job}").trigger(availableNow=True)
    out.start().awaitTermination()


def run_silver(lake: Lake) -> None:
    """Streams what is new in bronze into silver: parsed, newest event wins. A second stream then renews the canonical copies of all fingerprints before and after."""
    silver = lake.table("silver")

    def parsed(versions: list[int], batch_id: int) -> None:
        new = lake.table("bronze").changes_of(versions).drop("_change_type", "_version")
        silver.merge(silver_rows(new), "key", update_if=F.col("s.sort_key") > F.col("t.sort_key"), stream="silver", batch_id=batch_id)

    def canonical(versions: list[int], batch_id: int) -> None:
        touched = silver.changes_of(versions).filter("fingerprint is not null")
        silver.merge(canonical_updates(silver.read(), touched), "key", update_if=~F.col("t.canonical_key").eqNullSafe(F.col("s.canonical_key")), stream="canonical", batch_id=batch_id)

    _each_commit(lake, "bronze", "silver", parsed)
    _each_commit(lake, "silver", "canonical", canonical)


def run_gold(lake: Lake) -> None:
    """Streams what changed in silver into gold: of the documents' chunks stale ones go, changed ones are replaced."""
    gold = lake.table("gold")

    def reconciled(versions: list[int], batch_id: int) -> None:
        keys = lake.table("silver").changes_of(versions).filter("_change_type <> 'update_preimage'").select("key").distinct()
        desired = gold_rows(lake.table("silver").read().join(keys, "key", "left_semi"))
        gold.replace_where(desired, "chunk_id", "key", keys, ignore=contracts.AUDIT, stream="gold", batch_id=batch_id)

    _each_commit(lake, "silver", "gold", reconciled)
