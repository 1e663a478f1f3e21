"""Newest-wins, canonical copies, merges and access as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: str, *newest_first: str) -> DataFrame:
    """One row a key: the greatest by the given columns. A max_by over a struct, so rows combine before the shuffle."""
    row = F.struct(*(F.col(c) for c in df.columns))
    order = F.struct(*(F.col(c) for c in newest_first))
    return df.groupBy(key).agg(F.max_by(row, order).alias("_row")).select("_row.*")


def canonical_keys(df: DataFrame, fingerprint: str, groups: str, updated: str, key: str) -> DataFrame:
    """Adds canonical_key and is_duplicate: of equal fingerprints with equal groups, the earliest (unknown dates last), then the shortest and least key.

    Only the least struct of a group travels, so a large group of copies is combined before the shuffle.
    """
    group = F.array_join(F.array_sort(F.col(groups)), ",")
    order = F.struct(F.col(updated).isNull().alias("u"), F.col(updated).alias("t"), F.length(key).alias("n"), F.col(key).alias("k"))
    df = df.withColumn("_groups", group)
    first = df.groupBy(fingerprint, "_groups").agg(F.min(order).alias("_first"))
    out = df.join(first, [fingerprint, "_groups"]).withColumn("canonical_key", F.col("_first.k"))
    return out.withColumn("is_duplicate", F.col("canonical_key") != F.col(key)).drop("_groups", "_first")


def visible(groups: Column, caller: list[str]) -> Column:
    """Whether a row shares a group with the caller; nobody without groups sees anything."""
    return F.arrays_overlap(groups, F.array(*map(F.lit, caller))) if caller else F.lit(False)


def merge_plan(target: DataFrame, source: DataFrame, key: str, update_if: Column, delete_if: Column | None = None, insert_if: Column | None = None) -> DataFrame:
    """(_action, _old, _new) for each key of either side: keep, update, delete, insert or ignore.

    Conditions see the structs t (target) and s (source). The source must have each key once.
    """
    t = target.select(F.col(key).alias("_tk"), F.struct(*(F.col(c) for c in target.columns)).alias("t"))
    s = source.select(F.col(key).alias("_sk"), F.struct(*(F.col(c) for c in source.columns)).alias("s"))
    both = t.join(s, F.col("_tk") == F.col("_sk"), "full")
    action = F.when(F.col("s").isNull(), "keep")
    if delete_if is not None:
        action = action.when(delete_if, F.when(F.col("t").isNull(), "ignore").otherwise("delete"))
    action = action.when(F.col("t").isNull(), F.when(insert_if if insert_if is not None else F.lit(True), "insert").otherwise("ignore"))
    action = action.when(update_if, "update").otherwise("keep")
    return both.select(action.alias("_action"), F.col("t").alias("_old"), F.col("s").alias("_new"))


def rrf(left: DataFrame, right: DataFrame, key: str | list[str], left_rank: str, right_rank: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two rankings."""
    part = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    return left.join(right, key, "full").withColumn("score", part(left_rank) + part(right_rank))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows, ranked: a bounded heap in each task, then a window over k rows."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
