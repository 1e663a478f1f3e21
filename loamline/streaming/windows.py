"""Event-time streams that keep state: windows that are given out once, when they are closed, over events that may come late or twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def closed_windows(events: DataFrame, event_id: str, at: str, width: str, delay: str, by: list[str], **aggregates: Column) -> DataFrame:
    """(window_start, window_end, by, aggregates) of a stream, each window once, when no event may come any more that isn't ``delay`` late.

    An event that is delivered again counts once: its id is kept as long as its delivery wouldn't be too late anyway, so the state doesn't grow with the stream. Too late
    events are left out. For the append mode of ``writeStream``.
    """
    once = events.withWatermark(at, delay).dropDuplicatesWithinWatermark([event_id])
    out = once.groupBy(F.window(at, width).alias("_w"), *by).agg(*(c.alias(n) for n, c in aggregates.items()))
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *by, *aggregates)


def run_windows(windows: DataFrame, out: str, checkpoint: str) -> None:
    """Appends what is closed by now to the table ``out``, exactly once, also if a run ends early and is done again."""
    windows.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def with_late(windows: DataFrame, events: DataFrame, event_id: str, at: str, width: str, by: list[str], count: str) -> DataFrame:
    """``windows`` with ``late``: how many different events of each window came too late to be counted."""
    every = events.groupBy(F.window(at, width).alias("_w"), *(F.col(c).alias(f"_{c}") for c in by)).agg(F.countDistinct(event_id).alias("_all"))
    every = every.select(F.col("_w.start").alias("_start"), *(f"_{c}" for c in by), "_all")
    same = (F.col("window_start") == F.col("_start")) & F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return windows.join(every, same).withColumn("late", F.col("_all") - F.col(count)).drop("_start", "_all", *(f"_{c}" for c in by))
