"""Queries over stateful streams: deliveries of the given events arrive in parts, and each part is a run to completion that goes on from the last one's state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sketches
from ..scratch import Scratch
from ..streaming import limiter, windows
from .catalog import query, table

#: Deliveries: thirds of the events by number; every tenth comes one delivery later, and every thirteenth comes again with the next.
PARTS = 3
ARRIVED_SQL = f"""n AS (SELECT count(*) AS n FROM events), e AS (SELECT event_id, event_type, value, ts, least({PARTS - 1}, event_id * {PARTS} // n) + (event_id % 10 = 0)::INT AS part FROM events, n),
d AS (SELECT * FROM e UNION ALL SELECT * REPLACE (part + 1 AS part) FROM e WHERE event_id % 13 = 0)"""


def arrivals(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    part = F.least(F.lit(PARTS - 1), F.floor(F.col("event_id") * PARTS / F.lit(e.count()))) + (F.col("event_id") % 10 == 0).cast("int")
    e = e.select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("at"), part.cast("int").alias("part"))
    return e.unionByName(e.filter("event_id % 13 = 0").withColumn("part", F.col("part") + 1))


def delivered(scratch: Scratch, rows: DataFrame, name: str, run) -> None:
    """Writes each part of ``rows`` to a folder of arrivals and calls ``run`` with the stream over it."""
    folder = f"{scratch.root}/{name}"
    rows = scratch.save(rows, "rows")
    for part in sorted(r["part"] for r in rows.select("part").distinct().collect()):  # a few
        rows.filter(F.col("part") == part).drop("part").write.mode("append").parquet(folder)
        run(rows.sparkSession.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 500).parquet(folder))


@query(f"""WITH {ARRIVED_SQL}, w AS (SELECT part, (SELECT max(date_trunc('milliseconds', o.ts)) FROM d o WHERE o.part < p.part) - INTERVAL 1 HOUR AS mark FROM (SELECT DISTINCT part FROM d) p),
k AS (SELECT DISTINCT event_id, event_type, value, ts FROM d JOIN w USING (part) WHERE mark IS NULL OR ts > mark),
g AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM k GROUP BY 1, 2),
a AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS every FROM events GROUP BY 1, 2)
SELECT hour, event_type, n, total, every - n AS late FROM g JOIN a USING (hour, event_type) WHERE hour + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def streamed_windows(spark, sf_dir):
    """Hours of events as a stream with a watermark: each is given out once, when it is closed. Events that are delivered twice count once, and late ones are counted beside."""
    scratch = Scratch(spark, "streamed-windows")
    out, sums = f"{scratch.root}/windows", {"n": F.count("*"), "total": F.sum("value")}
    rows = arrivals(spark, sf_dir)
    delivered(scratch, rows, "arrivals", lambda src: windows.run_windows(windows.closed_windows(src, "event_id", "at", "1 hour", "1 hour", ["event_type"], **sums), out, f"{scratch.root}/checkpoint"))
    found = spark.read.schema("window_start timestamp, window_end timestamp, event_type string, n long, total double").parquet(out)
    counted = windows.with_late(found, rows, "event_id", "at", "1 hour", ["event_type"], "n")
    return counted.select(F.col("window_start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"), "late")


#: A caller has two requests at once and one more each half day, in microseconds.
BURST, PERIOD = 2, 43_200


@query(f"""WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
b AS (SELECT user_id, event_id, us, i, true AS allowed, {(BURST - 1) * PERIOD * 1_000_000}::BIGINT AS level FROM r WHERE i = 1
UNION ALL SELECT r.user_id, r.event_id, r.us, r.i, least({BURST * PERIOD * 1_000_000}, level + r.us - b.us) >= {PERIOD * 1_000_000},
least({BURST * PERIOD * 1_000_000}, level + r.us - b.us) - CASE WHEN least({BURST * PERIOD * 1_000_000}, level + r.us - b.us) >= {PERIOD * 1_000_000} THEN {PERIOD * 1_000_000} ELSE 0 END
FROM b JOIN r ON r.user_id = b.user_id AND r.i = b.i + 1)
SELECT user_id, event_id, allowed FROM b""")
def limited_requests(spark, sf_dir):
    """All events as requests of their users, allowed or refused by a keyed token bucket that keeps its state between two deliveries."""
    scratch = Scratch(spark, "limited-requests")
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("caller"), F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") >= e.count() / 2).cast("int").alias("part"))
    out = f"{scratch.root}/decisions"
    delivered(scratch, rows, "requests", lambda src: limiter.run_limited(limiter.limited(src, BURST, PERIOD), out, f"{scratch.root}/checkpoint"))
    return spark.read.schema("caller long, request_id long, allowed boolean").parquet(out).select(F.col("caller").alias("user_id"), F.col("request_id").alias("event_id"), "allowed")


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS p50_ok, true AS p95_ok, true AS users_ok FROM events GROUP BY 1, 2""")
def sketched_days(spark, sf_dir):
    """Hourly sketches of values and users rolled up to days, held against the exact answers: each estimate has to keep to the sketch's bound."""
    e = table(spark, sf_dir, "events").select("event_type", "user_id", "value", F.col("ts").cast("timestamp").alias("at"))
    hours = Scratch(spark, "sketches").save(sketches.sketched(e, "at", "1 hour", ["event_type"], "value", "user_id"), "hours")
    days = sketches.rolled_up(hours, F.date_trunc("day", "bucket"), ["event_type"])
    told = days.select("bucket", "event_type", sketches.quantile(F.col("values"), 0.5).alias("p50"), sketches.quantile(F.col("values"), 0.95).alias("p95"), sketches.distinct_count(F.col("idents")).alias("users_told"))
    rows = e.withColumn("bucket", F.date_trunc("day", "at")).join(told, ["bucket", "event_type"]).groupBy("bucket", "event_type")
    # The place that an estimate has among all values, from below it to up to it, must hold the quantile within the bound.
    place = lambda p: (F.count_if(F.col("value") < F.col(p)) / F.count("value"), F.count_if(F.col("value") <= F.col(p)) / F.count("value"))
    within = lambda p, q: (place(p)[0] - sketches.RANK_ERROR <= q) & (place(p)[1] + sketches.RANK_ERROR >= q)
    users = F.countDistinct("user_id")
    near = F.abs(F.first("users_told") - users) <= F.greatest(F.lit(1.0), users * sketches.COUNT_ERROR)
    exact = rows.agg(F.count("*").alias("n"), users.alias("users"), within("p50", 0.5).alias("p50_ok"), within("p95", 0.95).alias("p95_ok"), near.alias("users_ok"))
    return exact.withColumn("bucket", F.col("bucket").cast("timestamp_ntz")).withColumnRenamed("bucket", "day")
