"""Aggregates that the built-in ones don't give directly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: How far beside the asked rank, as a share of all rows, the bracket of a percentile lies, and the error that the sketch behind it may have (1 / accuracy).
BESIDE, ACCURACY = 0.001, 10_000


def nearest_ranks(df: DataFrame, value: str, ranks: dict[str, float], *keys: str) -> DataFrame:
    """(keys, one column for each of ``ranks``): the value at index round(q * (n - 1)), half to even, of a group's sorted non-null values; 0 if there are none.

    A sketch brackets each rank; rows below are counted and only the bracket's values are sorted, so no task holds a group. Exact, since
    the sketch's error is less than the bracket is wide.
    """
    if not len(keys):
        df, keys = df.withColumn("_all", F.lit(0)), ("_all",)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    sides = [x for q in ranks.values() for x in (max(0.0, q - BESIDE), min(1.0, q + BESIDE))]
    found = F.percentile_approx("_v", sides, ACCURACY)
    edges = [F.when(F.lit(x in (0.0, 1.0)), F.min("_v") if x == 0.0 else F.max("_v")).otherwise(F.get(found, F.lit(i))) for i, x in enumerate(sides)]
    stats = rows.groupBy(*keys).agg(F.count("_v").alias("_n"), *(e.alias(f"_e{i}") for i, e in enumerate(edges)))
    each = F.array(*(F.struct(F.lit(name).alias("name"), F.bround(F.lit(q) * (F.col("_n") - 1)).cast("long").alias("at"), F.col(f"_e{2 * i}").alias("lo"), F.col(f"_e{2 * i + 1}").alias("hi")) for i, (name, q) in enumerate(ranks.items())))
    wanted = stats.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.explode(each).alias("w")).select("*", "w.*").drop("w")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    counts = rows.filter("_v is not null").groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    near = counts.join(wanted, same).filter("_v <= hi")
    # Values below a bracket are one row; the rest is numbered through.
    near = near.groupBy(*keys, "name", "at", F.greatest("_v", F.col("lo")).alias("_v"), (F.col("_v") < F.col("lo")).alias("_below")).agg(F.sum("_c").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "name").orderBy(F.col("_below").desc(), "_v"))
    hit = near.withColumn("_upto", upto).filter((F.col("_upto") > F.col("at")) & ~F.col("_below")).groupBy(*keys, "name").agg(F.min("_v").alias("_v"))
    wide = hit.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in ranks))
    wide = wide.select(*(F.col(k).alias(f"_w_{k}") for k in keys), *ranks)
    out = stats.select(*keys).join(wide, [F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in keys], "left")
    return out.select(*(k for k in keys if k != "_all"), *(F.coalesce(name, F.lit(0.0)).alias(name) for name in ranks))


def whole_dollars(x: Column) -> Column:
    """An amount in whole dollars, halves to even."""
    return F.bround(x.cast("decimal(38,6)"), 0).cast("long")


def known_sum(x: Column) -> Column:
    """The sum, or null if any value is unknown; 0 over no rows."""
    return F.when(F.count(F.lit(1)) == F.count(x), F.coalesce(F.sum(x), F.lit(0)))


def ratio(hit: Column, of: Column) -> Column:
    """Share of rows with ``hit`` among those with ``of``; 0 if there are none."""
    n = F.count_if(of)
    return F.coalesce(F.count_if(hit & of) / F.nullif(n, F.lit(0)), F.lit(0.0))
