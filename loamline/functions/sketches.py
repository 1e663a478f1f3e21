"""Quantiles and distinct counts that can be merged: KLL and HyperLogLog sketches as columns, by time bucket, rolled up without reading the rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes of the sketches, and the errors that these keep to in nearly all cases: of a quantile's rank, and of a distinct count as a share of it (three standard errors).
KLL_K, HLL_LOG = 200, 12
RANK_ERROR, COUNT_ERROR = 0.02, 3 * 1.04 / 2 ** (HLL_LOG / 2)


def sketched(df: DataFrame, at: str, width: str, by: list[str], value: str, ident: str) -> DataFrame:
    """(bucket, by, n, values, idents): a row of sketches for each time bucket and group. Null values and ids count for ``n`` alone."""
    rows = df.groupBy(F.window(at, width).alias("_w"), *by)
    out = rows.agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_K)).alias("values"), F.hll_sketch_agg(ident, F.lit(HLL_LOG)).alias("idents"))
    return out.select(F.col("_w.start").alias("bucket"), *by, "n", "values", "idents")


def rolled_up(sketches: DataFrame, bucket: Column, by: list[str]) -> DataFrame:
    """The sketches of larger buckets, from those of smaller ones."""
    rows = sketches.withColumn("bucket", bucket).groupBy("bucket", *by)
    return rows.agg(F.sum("n").alias("n"), F.kll_merge_agg_double("values").alias("values"), F.hll_union_agg("idents").alias("idents"))


def quantile(values: Column, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(values, F.lit(q))


def distinct_count(idents: Column) -> Column:
    return F.hll_sketch_estimate(idents)
