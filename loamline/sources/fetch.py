"""Bytes of object versions, read on executors, and queue messages that fail one by one."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The largest object that is read, and error codes that say that a version is gone for good.
MAX_OBJECT_BYTES = 25 * 1024 * 1024
MISSING = ("404", "NoSuchKey", "NoSuchVersion")
#: Bytes of objects in one Arrow batch that goes back to the JVM; one object may be larger.
BATCH_BYTES = 4 * 2**20


class StoreError(OSError):
    """What a store refuses, by its code."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def fetch_one(read: Callable[[str, str, str | None], bytes], row: dict, attempts: int, pause: float) -> tuple[bytes | None, str | None]:
    """(content, error) of one object: a delete has neither, what is too large or gone an error. Any other refusal is tried again and raised after the last attempt, so that the task is done again."""
    if row["event_type"] == "delete":
        return None, None
    if row["size"] is not None and row["size"] > MAX_OBJECT_BYTES:
        return None, f"too_large: {row['size']} bytes"
    for left in reversed(range(attempts)):
        try:
            return read(row["bucket"], row["key"], row["version_id"] or None), None
        except StoreError as e:
            if e.code in MISSING:
                return None, f"missing: {e.code}"
            if not left:
                raise
        time.sleep(pause * 2 ** (attempts - 1 - left))
    raise ValueError("attempts must be at least 1")


def fetch_contents(manifests: DataFrame, connect: Callable[[], Callable[[str, str, str | None], bytes]], attempts: int = 3, pause: float = 0.5) -> DataFrame:
    """``manifests`` with content, content_sha256 and fetch_error. ``connect`` runs once a task and gives ``read(bucket, key, version_id)``, which raises ``StoreError``.

    Only what a read needs goes to Python beside the row's other columns, which pass through as they are; a batch holds no more than ``BATCH_BYTES`` of objects, or one object.
    """
    added = "content binary, content_sha256 string, fetch_error string"
    out = T.StructType([*manifests.schema.fields, *T.StructType.fromDDL(added).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = connect()
        for b in batches:
            rows = b.select(["event_type", "bucket", "key", "version_id", "size"]).to_pylist()
            start, held, got = 0, 0, []
            for i, row in enumerate(rows):
                content, error = fetch_one(read, row, attempts, pause)
                got.append((content, None if content is None else hashlib.sha256(content).hexdigest(), error))
                held += len(content or b"")
                if held >= BATCH_BYTES or i + 1 == len(rows):
                    cols = [pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.binary(), pa.string(), pa.string()), strict=True)]
                    part = b.slice(start, len(got))
                    yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*part.schema.names, "content", "content_sha256", "fetch_error"])
                    start, held, got = i + 1, 0, []

    return manifests.mapInArrow(run, out)


#: What is read of a notification's record.
RECORD = "eventName string, eventTime string, s3 struct<bucket:struct<name:string>,object:struct<key:string,versionId:string,size:bigint,sequencer:string>>"


def queue_events(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of queue ``messages`` (message_id, body), and the ids of those that failed, so that a queue sends these alone again.

    A body without records (a test notification) has no events and doesn't fail. A message fails whole: if its body is no JSON object, or a record lacks its name, bucket or key.
    """
    shape = T.ArrayType(T.StructType.fromDDL(RECORD))
    records = F.from_json(F.get_json_object("body", "$.Records"), shape)
    object_body = F.coalesce(F.col("body").rlike(r"^\s*\{") & F.try_parse_json("body").isNotNull(), F.lit(False))
    broken = lambda r: r["eventName"].isNull() | r["s3"]["bucket"]["name"].isNull() | r["s3"]["object"]["key"].isNull()
    none = F.get_json_object("body", "$.Records").isNull()
    good = object_body & (none | F.coalesce(~F.exists(records, lambda r: F.coalesce(broken(r), F.lit(True))), F.lit(False)))
    df = messages.withColumns({"_good": good, "_records": F.coalesce(records, F.from_json(F.lit("[]"), shape))})
    r = F.col("r")
    events = df.filter("_good").select("message_id", F.explode("_records").alias("r")).select(
        "message_id", F.regexp_replace(r["eventName"], "^s3:", "").alias("event_name"), r["s3"]["bucket"]["name"].alias("bucket"), r["s3"]["object"]["key"].alias("key"),
        r["s3"]["object"]["versionId"].alias("version_id"), r["s3"]["object"]["size"].alias("size"), r["s3"]["object"]["sequencer"].alias("sequencer"), r["eventTime"].alias("event_time"),
    )
    return events, df.filter(~F.col("_good")).select("message_id")


def batch_failures(failed: DataFrame) -> str:
    """The answer a queue takes; a batch of messages is small."""
    return json.dumps({"batchItemFailures": [{"itemIdentifier": r["message_id"]} for r in failed.orderBy("message_id").toLocalIterator()]})
