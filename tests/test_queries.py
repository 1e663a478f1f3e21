import duckdb
import pytest

import __spark_entry__ as entry
from loamline.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sf, con, name):
    df, rel = registry.queries()[name](spark, sf), con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert ordered(df.collect()) == ordered(con.sql(f"select {', '.join(df.columns)} from ({registry.oracle_sql()[name]})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
