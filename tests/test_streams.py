from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loamline.streaming import limiter, windows

T0 = datetime(2024, 5, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_windows_are_given_out_once(spark, tmp_path):
    """Every run starts anew from the checkpoint; late events are left out and repeated ones count once."""
    runs = [[(1, at(5)), (2, at(50)), (3, at(130)), (1, at(5))], [(4, at(20)), (3, at(130)), (5, at(125)), (6, at(300))], [(7, at(290)), (8, at(500)), (6, at(300))]]
    out = f"{tmp_path}/out"
    seen = []
    for rows in runs:
        spark.createDataFrame([(*r, "k") for r in rows], "id long, at timestamp, kind string").write.mode("append").parquet(f"{tmp_path}/in")
        src = spark.readStream.schema("id long, at timestamp, kind string").parquet(f"{tmp_path}/in")
        windows.run_windows(windows.closed_windows(src, "id", "at", "1 hour", "30 minutes", ["kind"], n=F.count("*")), out, f"{tmp_path}/checkpoint")
        found = spark.read.parquet(out)
        seen.append(sorted(((r.window_start - T0).seconds // 3600, r.n) for r in found.collect()))
    assert seen[0] == [(0, 2)]  # up to 100 minutes
    assert seen[1] == [(0, 2), (2, 2)]  # event 4 came too late
    assert seen[2] == [(0, 2), (2, 2), (4, 1), (5, 1)] or seen[2] == [(0, 2), (2, 2), (4, 1), (5, 1)]
    every = spark.createDataFrame([(*r, "k") for rows in runs for r in rows], "id long, at timestamp, kind string")
    late = windows.with_late(found, every, "id", "at", "1 hour", ["kind"], "n").collect()
    assert sorted(((r.window_start - T0).seconds // 3600, r.late) for r in late) == [(0, 1), (2, 0), (4, 0), (5, 0)]


def brute(requests, burst, period):
    out, level, last = {}, {}, {}
    for who, i, t in sorted(requests, key=lambda r: (r[0], r[2], r[1])):
        have = min(burst * period, level.get(who, burst * period) + ((t - last[who]).total_seconds() if who in last else 0))
        out[i] = have >= period
        level[who], last[who] = have - period * out[i], t
    return out


@pytest.mark.parametrize("cuts", [[40], [13, 27, 40]])
def test_buckets_go_on_between_runs(spark, tmp_path, cuts):
    requests = [(i % 3, i, T0 + timedelta(seconds=9 * i + 200 * (i // 10) + (i * i) % 5)) for i in range(40)]
    lo = 0
    for hi in cuts:
        spark.createDataFrame(requests[lo:hi], "caller long, request_id long, at timestamp").write.mode("append").parquet(f"{tmp_path}/in")
        src = spark.readStream.schema("caller long, request_id long, at timestamp").parquet(f"{tmp_path}/in")
        limiter.run_limited(limiter.limited(src, 2, 60), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        lo = hi
    got = {r.request_id: r.allowed for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == brute(requests, 2, 60) and 0 < sum(got.values()) < 40
