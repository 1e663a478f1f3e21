"""A made-up logistics company as DataFrames: employees, pay, customers, shipments and invoices of any number, the same for the same seed.

Every value follows from the seed, the table's name and the row's number by a hash, so rows don't depend on partitions and any number of them can be made in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the time that "now" means in the world.
AS_OF = "2026-08-31 17:00:00"
#: Rules of this world: share, lateness and daily speed by mode, prices by mode, price factors and hours to answer by tier, and pay by band.
MODES = {"ground": (0.55, 0.08, 3, 80, 0.9), "air": (0.25, 0.04, 1, 240, 3.2), "ocean": (0.20, 0.15, 21, 600, 0.3)}
TIERS = {"gold": (0.15, 0.85, 4), "silver": (0.35, 0.95, 8), "standard": (0.50, 1.0, 24)}
BANDS = {"B1": (45_000, 70_000), "B2": (65_000, 105_000), "B3": (95_000, 160_000), "B4": (150_000, 240_000)}
REGIONS, INDUSTRIES = "north south east west".split(), "retail pharma automotive electronics food".split()
DEPARTMENTS, PLACES = "operations finance sales hr support".split(), "Rotterdam Hamburg Antwerp Gdansk Le Havre".split()
#: Customers whose shipments are late this many times as often, and the share of shipments that are cancelled.
TROUBLED, TROUBLED_FACTOR, CANCELLED = 3, 3, 0.02
#: Employees that one manager has.
SPAN = 8


class _Dice:
    """Values in [0, 1) by the name of a throw; each row has its own."""

    def __init__(self, seed: int, table: str):
        self.seed, self.table = seed, table

    def __call__(self, name: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(f"{self.table}.{name}"), F.col("n")), F.lit(2**40)) / float(2**40)


def _pick(u: Column, values: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.floor(u * len(values)).cast("int"))


def _by_share(u: Column, shares: dict[str, float]) -> Column:
    out, below = None, 0.0
    for name, share in list(shares.items())[:-1]:
        below += share
        out = F.when(u < below, name) if out is None else out.when(u < below, name)
    return out.otherwise(list(shares)[-1])


def _of(key: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def _id(prefix: str, digits: int, n: Column) -> Column:
    return F.format_string(f"{prefix}-%0{digits}d", n)


def _tier(dice: _Dice) -> Column:
    return _by_share(dice("tier"), {k: v[0] for k, v in TIERS.items()})


def build_world(spark: SparkSession, seed: int, customer_count: int = 60, shipment_count: int = 4000, employee_count: int = 80) -> dict[str, DataFrame]:
    """Tables by name: employees, employee_compensation, customers, shipments, invoices. Managers have lower numbers than their people, so the chart is a tree whose root is the first.

    An invoice belongs to each shipment that isn't cancelled. Counts may be 0, but shipments need a customer and customers an employee.
    """
    if shipment_count and not customer_count or customer_count and not employee_count:
        raise ValueError("shipments need a customer, customers an employee")
    now = F.lit(AS_OF).cast("timestamp")
    rows = lambda count: spark.range(1, count + 1).withColumnRenamed("id", "n")

    d = _Dice(seed, "employees")
    band = F.when(F.col("n") == 1, "B4").when(F.col("n") <= 1 + SPAN, "B3").otherwise(F.when(d("band") < 0.6, "B1").otherwise("B2"))
    people = rows(employee_count).select(
        "n", _id("EMP", 4, F.col("n")).alias("employee_id"), F.format_string("Employee %d", "n").alias("full_name"), F.format_string("employee%d@example.com", "n").alias("email"),
        _pick(d("department"), DEPARTMENTS).alias("department"), F.when(F.col("n") == 1, "chief").when(F.col("n") <= 1 + SPAN, "manager").otherwise("specialist").alias("title"),
        F.when(F.col("n") > 1, _id("EMP", 4, F.floor((F.col("n") - 2) / SPAN) + 1)).alias("manager_id"), _pick(d("place"), PLACES).alias("location"),
        F.date_sub(F.to_date(now), F.floor(d("hired") * 3650).cast("int") + 1).alias("hire_date"), band.alias("pay_band"), d("pay").alias("_pay"), d("bonus").alias("_bonus"),
    )
    low, high = _of(F.col("pay_band"), {k: v[0] for k, v in BANDS.items()}), _of(F.col("pay_band"), {k: v[1] for k, v in BANDS.items()})
    pay = people.select("employee_id", (F.round((low + (high - low) * F.col("_pay")) / 500) * 500).cast("decimal(12,2)").alias("base_salary_usd"), F.floor(F.col("_bonus") * 21).cast("int").alias("bonus_pct"), "pay_band", F.col("hire_date").alias("effective_date"))

    d = _Dice(seed, "customers")
    customers = rows(customer_count).withColumn("tier", _tier(d)).select(
        _id("CUST", 3, F.col("n")).alias("customer_id"), F.format_string("Customer %d", "n").alias("name"), _pick(d("industry"), INDUSTRIES).alias("industry"), "tier",
        _of(F.col("tier"), {k: v[2] for k, v in TIERS.items()}).alias("sla_hours"), _pick(d("region"), REGIONS).alias("region"),
        _id("EMP", 4, F.floor(d("manager") * employee_count).cast("long") + 1).alias("account_manager_id"), F.date_sub(F.to_date(now), F.floor(d("since") * 2000).cast("int") + 400).alias("created_on"),
    )

    d = _Dice(seed, "shipments")
    base = rows(shipment_count).withColumns({"c": F.floor(d("customer") * customer_count).cast("long") + 1, "mode": _by_share(d("mode"), {k: v[0] for k, v in MODES.items()})})
    days = _of(F.col("mode"), {k: v[2] for k, v in MODES.items()})
    chance = _of(F.col("mode"), {k: v[1] for k, v in MODES.items()}) * F.when(F.col("c") <= TROUBLED, TROUBLED_FACTOR).otherwise(1)
    booked = F.timestamp_micros(F.unix_micros(now) - (d("booked") * 365 * 86_400).cast("long") * 1_000_000)
    later = lambda at, hours: F.timestamp_micros(F.unix_micros(at) + (hours * 3600).cast("long") * 1_000_000)
    base = base.withColumns({"booked_at": booked, "promised_at": later(booked, days * 24), "late": d("late") < chance, "cancelled": d("cancelled") < CANCELLED})
    came = F.when(F.col("late"), later(F.col("promised_at"), 2 + d("delay") * 94)).otherwise(later(F.col("booked_at"), days * 24 * (0.5 + d("early") * 0.5)))
    base = base.withColumn("delivered_at", F.when(~F.col("cancelled") & (came <= now), came))
    status = F.when(F.col("cancelled"), "cancelled").when(F.col("delivered_at").isNotNull(), "delivered").otherwise("in_transit")
    base = base.withColumns({"customer_id": _id("CUST", 3, F.col("c")), "shipment_id": _id("SHP", 6, F.col("n")), "status": status, "weight_kg": F.round(1 + d("weight") * 4999, 1)})
    shipments = base.select("shipment_id", "customer_id", _pick(d("origin"), PLACES).alias("origin"), _pick(d("destination"), PLACES).alias("destination"), "mode", "status", "weight_kg", "booked_at", "promised_at", "delivered_at")

    # the customer's tier comes from the same throw that made it, so no join is needed
    tier = _tier(_Dice(seed, "customers"))
    priced = base.filter(~F.col("cancelled")).withColumnsRenamed({"n": "s", "c": "n"}).withColumn("tier", tier).withColumnsRenamed({"n": "c", "s": "n"})
    d = _Dice(seed, "invoices")
    price = (_of(F.col("mode"), {k: v[3] for k, v in MODES.items()}) + F.col("weight_kg") * _of(F.col("mode"), {k: v[4] for k, v in MODES.items()})) * _of(F.col("tier"), {k: v[1] for k, v in TIERS.items()})
    issued = F.to_date("booked_at")
    invoices = priced.withColumns({"issued_on": issued, "due_on": F.date_add(issued, 30), "_paid": F.date_add(issued, F.floor(d("paid") * 40).cast("int")), "_disputed": d("disputed") < 0.02, "_never": d("never") < 0.08})
    paid = F.when(~F.col("_disputed") & ~F.col("_never") & (F.col("_paid") <= F.to_date(now)), F.col("_paid"))
    state = F.when(F.col("_disputed"), "disputed").when(F.col("paid_on").isNotNull(), "paid").when(F.col("due_on") < F.to_date(now), "overdue").otherwise("open")
    invoices = invoices.withColumn("paid_on", paid).select(_id("INV", 6, F.col("n")).alias("invoice_id"), "customer_id", "shipment_id", price.cast("decimal(12,2)").alias("amount_usd"), "issued_on", "due_on", "paid_on", state.alias("status"))
    return {"employees": people.drop("n", "pay_band", "_pay", "_bonus"), "employee_compensation": pay, "customers": customers, "shipments": shipments, "invoices": invoices}
