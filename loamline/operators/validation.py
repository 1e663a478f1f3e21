"""Data-quality rules as queries that return violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names and groups that the rules of a corpus of documents know.
CORPUS = ("duplicate_doc_id", "duplicate_key", "invalid_groups", "updated_after_as_of", "sections_or_payload", "title_not_ascii")


def violations(df: DataFrame, key: str, rules: dict[str, Column], unique: tuple[str, ...] = ()) -> DataFrame:
    """(rule, key) for each row that a rule doesn't hold for, and for each repeated value of a ``unique`` column (with that value as key).

    As in a CHECK constraint, a rule that is null holds. All rules are evaluated in one scan.
    """
    failed = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    out = df.select(F.explode(failed).alias("rule"), F.col(key).cast("string").alias("key"))
    for c in unique:
        twice = df.groupBy(c).agg(F.count("*").alias("n")).filter((F.col("n") > 1) & F.col(c).isNotNull())
        out = out.unionByName(twice.select(F.lit(f"duplicate_{c}").alias("rule"), F.col(c).cast("string").alias("key")))
    return out


def validate_corpus(docs: DataFrame, groups: list[str], as_of: str) -> DataFrame:
    """Violations of a corpus (doc_id, key, allowed_groups, updated_at, sections, payload, title): see ``CORPUS``."""
    known = F.array(*map(F.lit, groups))
    some = F.coalesce(F.size("allowed_groups"), F.lit(0)) > 0
    rules = {
        "invalid_groups": some & (F.size(F.array_except(F.coalesce("allowed_groups", F.array().cast("array<string>")), known)) == 0),
        "updated_after_as_of": F.col("updated_at") <= F.lit(as_of),
        "sections_or_payload": (F.coalesce(F.size("sections"), F.lit(0)) > 0) != F.col("payload").isNotNull(),
        "title_not_ascii": ~F.col("title").rlike(r"[^\x00-\x7F]"),
    }
    return violations(docs, "doc_id", rules, unique=("doc_id", "key"))
