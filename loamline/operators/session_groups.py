"""A caller's groups as state of the session: one set of views for all callers, whose filters read a session variable.

The variable has no groups until a request sets its own, and none again after it, so a query outside of a request sees no guarded row.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VARIABLE = "caller_groups"


def install(session: SparkSession, views: dict[str, tuple[DataFrame, list[str] | None]], rows: dict[str, tuple[DataFrame, str]] | None = None) -> None:
    """Creates ``views`` (name: rows and the groups of which a caller needs one, None for any caller with groups) and those of ``rows`` (name: rows and their column of readers)."""
    session.sql(f"DECLARE OR REPLACE VARIABLE {VARIABLE} ARRAY<STRING> DEFAULT CAST(array() AS ARRAY<STRING>)")
    for name, (df, need) in views.items():
        _view(session, name, df, f"size({VARIABLE}) > 0" if need is None else f"arrays_overlap({_literal(need)}, {VARIABLE})")
    for name, (df, readers) in (rows or {}).items():
        _view(session, name, df, f"arrays_overlap(`{readers}`, {VARIABLE})")


def _literal(groups: list[str]) -> str:
    quoted = ", ".join("'" + g.replace("\\", "\\\\").replace("'", "\\'") + "'" for g in groups)
    return f"CAST(array({quoted}) AS ARRAY<STRING>)"


def _view(session: SparkSession, name: str, df: DataFrame, condition: str) -> None:
    df.createOrReplaceTempView(f"_all_{name}")
    session.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS SELECT * FROM _all_{name} WHERE {condition}")


@contextmanager
def groups_of(session: SparkSession, groups: list[str]) -> Iterator[None]:
    """Sets the caller's groups for what is read inside; the result must be taken inside, too."""
    session.sql(f"SET VARIABLE {VARIABLE} = {_literal(groups)}")
    try:
        yield
    finally:
        session.sql(f"SET VARIABLE {VARIABLE} = DEFAULT")


def current_groups(session: SparkSession) -> list[str]:
    return list(session.range(1).select(F.expr(VARIABLE)).first()[0])
