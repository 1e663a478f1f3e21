"""A limit of requests for each caller as a stateful stream: token buckets in event time.

A bucket holds ``burst`` tokens and gets one each ``period``. A request takes one, or is refused. All is counted in whole microseconds, so results don't depend on how a
stream is cut into batches. A bucket that would be full by now is forgotten: a timer drops its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TokenBucket(StatefulProcessor):
    """State of a caller: microseconds' worth of tokens, and when that was counted."""

    def __init__(self, burst: int, period_us: int):
        self.full, self.period = burst * period_us, period_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "level bigint, at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        had = self.bucket.get()
        level, last = had if had is not None else (self.full, None)
        asked = pd.concat(list(rows)).sort_values(["at_us", "request_id"], kind="stable")
        allowed = []
        for at in asked["at_us"].tolist():
            if last is not None:
                level = min(self.full, level + max(0, at - last))
            last = at if last is None else max(last, at)
            allowed.append(level >= self.period)
            level -= self.period * allowed[-1]
        self.bucket.update((int(level), int(last)))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer((last + self.full - level) // 1000 + 1)  # milliseconds, when the bucket is full again
        yield pd.DataFrame({"caller": [key[0]] * len(asked), "request_id": asked["request_id"].to_numpy(), "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.bucket.clear()
        yield pd.DataFrame({"caller": [], "request_id": [], "allowed": []}).astype({"caller": "int64", "request_id": "int64", "allowed": "bool"})

    def close(self) -> None:
        pass


def limited(requests: DataFrame, burst: int, period_seconds: int, delay: str = "1 hour") -> DataFrame:
    """(caller, request_id, allowed) for a stream of (caller long, request_id long, at timestamp).

    Requests of a batch are taken in order of time, then id; ones that come more than ``delay`` late are left out, as by any stream with a watermark.
    One that is late within this gives its bucket no tokens back.
    """
    timed = requests.select("caller", "request_id", "at", F.unix_micros("at").alias("at_us")).withWatermark("at", delay)
    bucket = TokenBucket(burst, period_seconds * 1_000_000)
    return timed.groupBy("caller").transformWithStateInPandas(bucket, "caller long, request_id long, allowed boolean", "append", "EventTime")


def run_limited(decisions: DataFrame, out: str, checkpoint: str) -> None:
    """Appends the decisions on what has come by now to the table ``out``, exactly once. States are kept by the state store that keyed timers need."""
    conf = decisions.sparkSession.conf
    had = conf.get(_PROVIDER)
    conf.set(_PROVIDER, _ROCKS)
    try:
        decisions.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(_PROVIDER, had)
