import pytest
from pyspark.sql import functions as F

from loamline.operators.sqlguard import Caller
from loamline.operators.views import VIEWS, analytics_views
from loamline.sources import sinks
from loamline.sources.world import AS_OF, BANDS, MODES, TIERS, build_world


@pytest.fixture(scope="module")
def world(spark):
    return {n: df.cache() for n, df in build_world(spark, 7).items()}


def test_counts_and_keys(world):
    n = {k: df.count() for k, df in world.items()}
    assert (n["employees"], n["employee_compensation"], n["customers"], n["shipments"]) == (80, 80, 60, 4000)
    assert n["invoices"] == world["shipments"].filter("status <> 'cancelled'").count()
    for child, key, parent, to in (("customers", "account_manager_id", "employees", "employee_id"), ("shipments", "customer_id", "customers", "customer_id"), ("invoices", "shipment_id", "shipments", "shipment_id")):
        assert world[child].join(world[parent], world[child][key] == world[parent][to], "left_anti").count() == 0
    roots = world["employees"].filter("manager_id is null").collect()
    assert [r["employee_id"] for r in roots] == ["EMP-0001"] and world["employees"].filter("manager_id >= employee_id").count() == 0


def test_rules(world):
    s = world["shipments"]
    shares = {r["mode"]: r["n"] / 4000 for r in s.groupBy("mode").agg(F.count("*").alias("n")).collect()}
    assert all(abs(shares[m] - MODES[m][0]) < 0.04 for m in MODES)
    assert 0.01 < s.filter("status = 'cancelled'").count() / 4000 < 0.035
    assert s.filter("delivered_at is not null and (status <> 'delivered' or delivered_at < booked_at)").count() == 0 and s.filter(f"delivered_at > timestamp'{AS_OF}'").count() == 0
    late = s.filter("delivered_at is not null").groupBy((F.col("customer_id") <= "CUST-003").alias("troubled")).agg(F.avg((F.col("delivered_at") > F.col("promised_at")).cast("int")).alias("late")).collect()
    late = {r["troubled"]: r["late"] for r in late}
    assert late[True] > 1.7 * late[False]
    tiers = {r["tier"]: r["h"] for r in world["customers"].groupBy("tier").agg(F.max("sla_hours").alias("h")).collect()}
    assert tiers == {t: TIERS[t][2] for t in tiers}
    for r in world["employee_compensation"].collect():
        assert BANDS[r["pay_band"]][0] <= r["base_salary_usd"] <= BANDS[r["pay_band"]][1]


def test_invoices(world):
    i = world["invoices"].join(world["shipments"].select("shipment_id", "mode", "weight_kg"), "shipment_id").join(world["customers"].select("customer_id", "tier"), "customer_id")
    for r in i.limit(200).collect():
        *_, base, kg = MODES[r["mode"]]
        assert float(r["amount_usd"]) == pytest.approx((base + r["weight_kg"] * kg) * TIERS[r["tier"]][1], abs=0.011)
    bad = "(status = 'paid') <> (paid_on is not null) or status = 'overdue' and due_on >= date'2026-08-31' or status = 'open' and due_on < date'2026-08-31'"
    assert i.filter(bad).count() == 0 and {r["status"] for r in i.select("status").distinct().collect()} == {"paid", "overdue", "open", "disputed"}


def test_same_for_the_same_seed(spark, world):
    again, other = build_world(spark, 7), build_world(spark, 8)
    for name, df in world.items():
        assert df.exceptAll(again[name].repartition(3)).count() == 0
    assert world["shipments"].exceptAll(other["shipments"]).count() > 0
    more = build_world(spark, 7, shipment_count=5000)["shipments"]
    assert world["shipments"].exceptAll(more).count() == 0  # more rows leave those before as they are


def test_empty_and_impossible(spark):
    assert {n: df.count() for n, df in build_world(spark, 1, 0, 0, 0).items()} == dict.fromkeys(["employees", "employee_compensation", "customers", "shipments", "invoices"], 0)
    with pytest.raises(ValueError):
        build_world(spark, 1, 0, 5)


def test_views_over_loaded_world(spark, world, tmp_path):
    counts = sinks.replace_tables(spark, str(tmp_path), world)
    views = analytics_views(sinks.loaded_tables(spark, str(tmp_path)), ["finance"])
    assert {n: v[0].columns for n, v in views.items()} == {n: c.split() for n, (c, _) in VIEWS.items()}
    got = Caller(spark, views, ["finance"]).query("select status, count(*) as n from invoices group by status")
    assert sum(r["n"] for r in got.collect()) == counts["invoices"] and views["employee_compensation"][0].count() == 0
