"""A golden set made from the data: templates of questions, bound to rows of the record views and to documents, with the facts that a right answer has.

A template is a plan: its facts are computed together with the rows it is bound to, so they are right for whatever the tables hold. Restricted cases ask the same
for callers of all other groups, must be refused, and have as forbidden what the allowed ones expect.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cases by kind of a golden set.
SHAPE = {"docs": 62, "sql": 37, "hybrid": 10, "acl": 12}
CASE = ["case_id", "kind", "question", "groups", "expected_route", "expected_facts", "forbidden", "must_refuse"]
_NONE = "array<string>"


@dataclass(frozen=True)
class Template:
    """``question`` has the key in braces; ``fact`` is the aggregate, or the column, that answers it. ``groups`` are a caller's, or a column of the rows."""

    name: str
    kind: str
    question: str
    key: str
    fact: Column
    groups: list[str] | Column
    grouped: bool = True


def _filled(t: Template) -> Column:
    before, after = t.question.split("{" + t.key + "}")
    return F.concat(F.lit(before), F.col(t.key).cast("string"), F.lit(after))


def bind(t: Template, rows: DataFrame) -> DataFrame:
    """A case for each key of ``rows`` whose fact isn't null."""
    groups = t.groups if isinstance(t.groups, Column) else F.array(*map(F.lit, t.groups)).cast(_NONE)
    if t.grouped:
        found = rows.groupBy(t.key).agg(t.fact.cast("string").alias("_fact")).withColumn("_groups", groups)
    else:
        found = rows.select(t.key, t.fact.cast("string").alias("_fact"), groups.alias("_groups"))
    return found.filter(F.col("_fact").isNotNull() & F.col(t.key).isNotNull()).select(
        F.concat_ws("-", F.lit(t.name), F.col(t.key).cast("string")).alias("case_id"), F.lit(t.kind).alias("kind"), _filled(t).alias("question"), F.col("_groups").alias("groups"),
        F.lit(t.kind).alias("expected_route"), F.array("_fact").alias("expected_facts"), F.array().cast(_NONE).alias("forbidden"), F.lit(False).alias("must_refuse"),
    )


def restricted(cases: DataFrame, all_groups: list[str]) -> DataFrame:
    """The cases again, asked by a caller who has all groups but those of the case: nothing may be told. Cases that everybody may ask give none."""
    others = F.array_except(F.array(*map(F.lit, all_groups)), "groups")
    out = cases.withColumns({"case_id": F.concat(F.lit("acl-"), "case_id"), "kind": F.lit("acl"), "forbidden": F.col("expected_facts"), "groups": others, "must_refuse": F.lit(True)})
    return out.filter(F.size("groups") > 0).withColumn("expected_facts", F.array().cast(_NONE)).select(CASE)


def build(bound: list[DataFrame], guarded: list[DataFrame], all_groups: list[str]) -> DataFrame:
    """All cases of ``bound``, and of ``guarded`` with their restricted counterparts."""
    out = bound[0]
    for df in [*bound[1:], *guarded, *(restricted(df, all_groups) for df in guarded)]:
        out = out.unionByName(df)
    return out


def sample(cases: DataFrame, seed: int, shape: dict[str, int] = SHAPE) -> DataFrame:
    """So many cases of each kind as ``shape`` asks for (all, where there are fewer), the same ones for the same seed."""
    order = Window.partitionBy("kind").orderBy(F.xxhash64(F.lit(seed), "case_id"), "case_id")
    most = F.element_at(F.create_map(*(F.lit(x) for pair in shape.items() for x in pair)), F.col("kind"))
    return cases.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= F.coalesce(most, F.lit(0))).drop("_n")
