"""Who may read a document of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups of a document by the last digit of its source, in Spark and in SQL.
GROUPS_SQL = "CASE WHEN right(source, 1) IN ('0','1','2') THEN ['all-staff','sales'] WHEN right(source, 1) IN ('3','4') THEN ['hr'] WHEN right(source, 1) = '5' THEN [] ELSE ['all-staff'] END"


def with_groups(df: DataFrame) -> DataFrame:
    digit = F.right("source", F.lit(1))
    groups = F.when(digit.isin("0", "1", "2"), F.array(F.lit("all-staff"), F.lit("sales"))).when(digit.isin("3", "4"), F.array(F.lit("hr")))
    return df.withColumn("groups", groups.when(digit == "5", F.array().cast("array<string>")).otherwise(F.array(F.lit("all-staff"))))
