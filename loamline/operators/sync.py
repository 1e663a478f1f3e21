"""What has to be done so that a store holds the wanted objects and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sync_plan(wanted: DataFrame, listed: DataFrame, prefixes: list[str]) -> DataFrame:
    """(key, action) for each key of ``wanted`` (key, md5, metadata map) and each of ``listed`` (key, etag, metadata map) below one of ``prefixes``.

    upload: not there, or there with another hash or other metadata; unchanged: there as wanted; delete: there but not wanted. Listed
    objects outside of the prefixes aren't managed and stay, and are overwritten if wanted. Metadata that are null count as none.
    """
    pairs = lambda c: F.array_sort(F.map_entries(F.coalesce(c, F.create_map().cast("map<string,string>"))))
    managed = F.lit(False)
    for p in prefixes:
        managed |= F.col("key").startswith(p)
    there = listed.filter(managed).select(F.col("key").alias("_k"), F.btrim("etag", F.lit('"')).alias("_etag"), pairs(F.col("metadata")).alias("_had"))
    both = wanted.select("key", "md5", pairs(F.col("metadata")).alias("_want")).join(there, F.col("key") == F.col("_k"), "full")
    same = F.col("md5").eqNullSafe(F.col("_etag")) & F.col("_want").eqNullSafe(F.col("_had"))
    action = F.when(F.col("key").isNull(), "delete").when(F.col("_k").isNotNull() & same, "unchanged").otherwise("upload")
    return both.select(F.coalesce("key", "_k").alias("key"), action.alias("action"))
