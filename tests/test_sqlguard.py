import pytest

from loamline.operators.evaluation import check_thresholds, hit_ranks
from loamline.operators.sqlguard import Caller, Rejected, validate

GOOD = [
    "select c_name from customers where c_custkey < 5", "select count(*) filter (where c_custkey > 1) from analytics.customers",
    "with t as (select c_nationkey n, count(*) k from customers group by 1) select n, rank() over (order by k desc) from t where k > (select avg(k) from t)",
    "select c_custkey from customers union all select o_custkey from invoices limit 5", "select c.c_name from customers c join invoices i on c.c_custkey = i.o_custkey where i.o_orderdate >= date '1995-01-01' order by 1 nulls last",
    "select date_trunc('month', o_orderdate) m, sum(o_totalprice)::int from invoices group by 1", "select * from customers where exists (select 1 from invoices where o_custkey = c_custkey)", "select c_custkey from customers where c_custkey in (select o_custkey from invoices)",
]
BAD = [
    "", "delete from customers", "insert into customers select * from customers", "drop table customers", "select 1", "select * from secret", "select * from parquet.`/etc/x`", "select * from global_temp.customers",
    "select * from other.customers", "select reflect('java.lang.System', 'exit', 0) from customers", "select java_method('a', 'b') from customers", "select raise_error('x') from customers", "select * from range(10)",
    "select transform(c_name) using 'cat' from customers", "show tables", "select current_user() from customers", "select input_file_name() from customers", "select * from customers; select 1", "execute immediate 'select 1'",
    "select * from identifier('customers')", "with secret as (select * from customers) select * from analytics.secret", "select (select count(*) from secret) from customers", "select * from customers where c_custkey in (select x from secret)",
    "with a as (select * from secret) select * from customers", "set spark.x = 1", "create view v as select * from customers", "explain select * from customers", "select * from customers |> where c_custkey > 1", "select explode(array(1)) from customers",
]


@pytest.fixture(scope="module")
def caller(spark, sf):
    c, o = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("customer", "orders"))
    return Caller(spark, {"customers": (c, None), "invoices": (o, ["finance"]), "pay": (o, ["hr"])}, ["finance"], max_rows=3)


@pytest.mark.parametrize("sql", GOOD)
def test_accepted(spark, caller, sql):
    assert validate(spark, sql, ["customers", "invoices"]) and len(caller.run(sql).rows) <= 3


@pytest.mark.parametrize("sql", BAD)
def test_rejected(spark, sql):
    with pytest.raises(Rejected):
        validate(spark, sql, ["customers", "invoices"])


def test_caller(spark, sf, caller):
    assert caller.views == ["customers", "invoices"]
    got = caller.run("select c_custkey from customers order by 1")
    assert got.truncated and len(got.rows) == 3 and not caller.run("select count(*) from customers").truncated
    with pytest.raises(Rejected):
        caller.run("select * from pay")
    assert Caller(spark, {"customers": (spark.range(1), None)}, []).views == []


def test_evaluation(spark):
    got = hit_ranks(spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, "c")], "case_id int, rank int, doc_id string"), spark.createDataFrame([(1, "b"), (2, "z")], "case_id int, doc_id string"))
    assert [tuple(r) for r in got.collect()] == [(1, 2)]
    assert check_thresholds({"a": 0.5, "b": 2}, {"a": {"min": 0.6}, "b": {"max": 2}, "c": {"min": 0}}) == ["a = 0.5", "c is not reported"]


def test_date_functions(spark):
    """Spans between times and bins of a width, which Spark has no functions for."""
    df = spark.sql("select timestamp '2024-01-31 10:17:00' as a, timestamp '2024-01-29 00:00:00' as b")
    caller = Caller(spark, {"t": (df, None)}, ["staff"])
    got = caller.run("select age(a, b) as span, date_bin(interval '15' minute, a, timestamp '2024-01-01') as q, date_bin(interval '7' day, a, timestamp '2024-01-01') as w from t").rows
    assert [(str(x[0]), str(x[1]), str(x[2])) for x in got] == [("2 days, 10:17:00", "2024-01-31 10:15:00", "2024-01-29 00:00:00")]


def test_costs_are_checked_before_a_run(spark, sf):
    views = {n: (spark.read.parquet(f"{sf}/{n}.parquet"), None) for n in ("customer", "orders")}
    caller = Caller(spark, views, ["staff"], timeout_s=60)
    pairs = ["select count(*) from customer a, orders b", "select count(*) from customer a join orders b on a.c_custkey < b.o_custkey", "select count(*) from customer a cross join orders b",
             "select count(*) from customer a where not exists (select 1 from orders b where b.o_totalprice > a.c_acctbal)"]
    for sql in pairs:
        with pytest.raises(Rejected, match="pair all rows"):
            caller.run(sql)
    good = ["select count(*) from customer a join orders b on a.c_custkey = b.o_custkey and a.c_acctbal < b.o_totalprice", "select count(*) from customer where c_acctbal > (select avg(c_acctbal) from customer)",
            "select count(*) from customer, (select * from orders limit 5) o", "select c_custkey from customer except select o_custkey from orders"]
    for sql in good:
        assert caller.run(sql).columns
    small = Caller(spark, views, ["staff"], timeout_s=60, max_read=100)
    with pytest.raises(Rejected, match="would read about"):
        small.run("select count(*) from orders")
