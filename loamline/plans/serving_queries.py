"""Queries over serving: views of records, object sync, scored cases and what calls used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import whole_dollars
from ..operators import evaluation, session_groups
from ..operators.sqlguard import Caller
from ..operators.sync import sync_plan
from ..operators.views import VIEWS, analytics_views
from .catalog import query, table


def record_tables(spark, sf_dir) -> dict:
    """The records that questions are about, made of customers, suppliers, line items and orders; every seventh line item has no delivery yet."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    lines, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    none, text = F.lit(None).cast("string"), lambda x: F.col(x).cast("string")
    day = F.expr("INTERVAL 30 DAYS")
    open_yet = F.col("l_orderkey") % 7 == 0
    return {
        "customers": c.select(text("c_custkey").alias("customer_id"), F.concat(F.lit("Customer "), "c_custkey").alias("name"), F.col("c_mktsegment").alias("industry"), none.alias("tier"),
                              F.lit(24).alias("sla_hours"), text("c_nationkey").alias("region"), none.alias("account_manager_id"), F.lit(None).cast("date").alias("created_on")),
        "employees": s.select(text("s_suppkey").alias("employee_id"), F.concat(F.lit("Supplier "), "s_suppkey").alias("full_name"), none.alias("email"), text("s_nationkey").alias("department"), none.alias("title"), none.alias("manager_id"), none.alias("location"), F.lit(None).cast("date").alias("hire_date")),
        "employee_compensation": s.select(text("s_suppkey").alias("employee_id"), F.col("s_acctbal").alias("base_salary_usd"), F.lit(0).alias("bonus_pct"), none.alias("pay_band"), F.lit(None).cast("date").alias("effective_date")),
        "invoices": o.select(text("o_orderkey").alias("invoice_id"), text("o_custkey").alias("customer_id"), none.alias("shipment_id"), F.col("o_totalprice").cast("decimal(12,2)").alias("amount_usd"), F.col("o_orderdate").alias("issued_on"),
                             (F.col("o_orderdate") + day).alias("due_on"), F.lit(None).cast("date").alias("paid_on"), F.col("o_orderstatus").alias("status")),
        "shipments": lines.join(o.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("shipment_id"), text("o_custkey").alias("customer_id"), none.alias("origin"), none.alias("destination"), none.alias("mode"), F.col("l_linestatus").alias("status"),
            F.col("l_quantity").alias("weight_kg"), F.col("o_orderdate").alias("booked_at"), (F.col("o_orderdate") + day).alias("promised_at"), F.when(~open_yet, F.col("l_shipdate")).alias("delivered_at")),
    }


LATE_SQL = """SELECT customer_id, count(*) AS shipments, sum(CASE WHEN is_late THEN 1 ELSE 0 END) AS late, sum(CASE WHEN delivered_at IS NULL THEN 1 ELSE 0 END) AS open_yet FROM shipments GROUP BY customer_id"""


@query("""WITH shipments AS (SELECT o_custkey::VARCHAR AS customer_id, CASE WHEN l_orderkey % 7 <> 0 THEN l_shipdate END AS delivered_at,
l_orderkey % 7 <> 0 AND l_shipdate > o_orderdate + INTERVAL 30 DAY AS is_late FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT customer_id, count(*) AS shipments, count(*) FILTER (is_late) AS late, count(*) FILTER (delivered_at IS NULL) AS open_yet FROM shipments GROUP BY 1""")
def analytics_shipments(spark, sf_dir):
    """Late shipments through the guarded view of a caller without special groups."""
    views = analytics_views(record_tables(spark, sf_dir), ["all-staff"])
    return Caller(spark, views, ["all-staff"], max_rows=2**31 - 2).query(LATE_SQL)


@query("SELECT 'exec' AS caller, count(*) AS invoices, (SELECT count(*) FROM supplier) AS salaries FROM orders UNION ALL SELECT 'hr', 0, count(*) FROM supplier UNION ALL SELECT 'sales', count(*), 0 FROM orders UNION ALL SELECT 'staff', 0, 0")
def restricted_views(spark, sf_dir):
    """Rows that callers of different groups see of the two restricted views."""
    tables, out = record_tables(spark, sf_dir), None
    for caller in ("exec", "hr", "sales", "staff"):
        views = analytics_views(tables, [caller])
        n = views["invoices"][0].agg(F.count("*").alias("invoices")).join(views["employee_compensation"][0].agg(F.count("*").alias("salaries")))
        n = n.select(F.lit(caller).alias("caller"), "invoices", "salaries")
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT 'exec' AS caller, count(*) AS invoices, (SELECT count(*) FROM supplier) AS salaries, (SELECT count(*) FROM customer) AS customers FROM orders UNION ALL SELECT 'hr', 0, (SELECT count(*) FROM supplier), count(*) FROM customer UNION ALL SELECT 'nobody', 0, 0, 0 UNION ALL SELECT 'sales', count(*), 0, (SELECT count(*) FROM customer) FROM orders")
def session_views(spark, sf_dir):
    """Rows that callers see of one set of views, whose filters read the groups of the session."""
    session, tables, out = spark.newSession(), record_tables(spark, sf_dir), []
    moved = lambda df: DataFrame(session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, df._jdf.queryExecution().analyzed()), session)
    names = {"invoices": VIEWS["invoices"][1], "employee_compensation": VIEWS["employee_compensation"][1], "customers": VIEWS["customers"][1]}
    session_groups.install(session, {n: (moved(tables[n]), need) for n, need in names.items()})
    for caller in ("exec", "hr", "sales", "nobody"):
        with session_groups.groups_of(session, [] if caller == "nobody" else [caller]):
            n = [session.table(v).count() for v in names]
        out.append((caller, n[0], n[1], n[2]))
    return spark.createDataFrame(out, "caller string, invoices long, salaries long, customers long")  # a row a caller


@query("""SELECT o_custkey, count(*) AS n, round_even(sum(o_totalprice::DECIMAL(12,2))::DOUBLE, 0)::BIGINT AS dollars FROM orders WHERE o_orderstatus = 'O' GROUP BY 1""")
def open_dollars(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("n"), whole_dollars(F.sum(F.col("o_totalprice").cast("decimal(12,2)"))).alias("dollars"))


@query("""WITH w AS (SELECT 'raw/' || doc_id || '.md' AS key, md5(coalesce(text, '')) AS md5, lang FROM documents WHERE length(source) % 2 = 0 OR lang = 'en'),
h AS (SELECT CASE WHEN lang = 'fr' THEN 'other/' ELSE 'raw/' END || doc_id || '.md' AS key, CASE WHEN n_chars % 5 = 0 THEN 'x' ELSE md5(coalesce(text, '')) END AS etag, CASE WHEN n_chars % 3 = 0 THEN 'zz' ELSE lang END AS lang FROM documents),
m AS (SELECT * FROM h WHERE key LIKE 'raw/%')
SELECT coalesce(w.key, m.key) AS key, CASE WHEN w.key IS NULL THEN 'delete' WHEN m.key IS NOT NULL AND md5 = etag AND w.lang IS NOT DISTINCT FROM m.lang THEN 'unchanged' ELSE 'upload' END AS action FROM w FULL JOIN m ON w.key = m.key""")
def object_sync(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("md5"))
    key = lambda folder: F.concat(folder, "doc_id", F.lit(".md"))
    wanted = d.filter("length(source) % 2 = 0 or lang = 'en'").select(key(F.lit("raw/")).alias("key"), "md5", F.create_map(F.lit("lang"), "lang").alias("metadata"))
    folder = F.when(F.col("lang") == "fr", "other/").otherwise("raw/")
    had = F.when(F.col("n_chars") % 3 == 0, "zz").otherwise(F.col("lang"))
    etag = F.concat(F.lit('"'), F.when(F.col("n_chars") % 5 == 0, "x").otherwise(F.col("md5")), F.lit('"'))
    return sync_plan(wanted, d.select(key(folder).alias("key"), etag.alias("etag"), F.create_map(F.lit("lang"), had).alias("metadata")), ["raw/"])


#: Whether a normalized text has a fact: 12 alone (or twelve), 3.5 alone, or the words of a notice.
HOLDS_SQL = {"12": r"regexp_matches({t}, '(^|[^\d.])12($|[^\d.]|\.$|\.\D)|\btwelve\b')", "$3.5": r"regexp_matches({t}, '(^|[^\d.])3\.5($|[^\d.]|\.$|\.\D)')", "Licensed  under": "contains({t}, 'licensed under')", "the": "contains({t}, 'the')"}


def holds(text: str, facts: list[str]) -> str:
    return " + ".join(f"({HOLDS_SQL[f].format(t=text)})::INT" for f in facts)


NORM_SQL = r"trim(regexp_replace(lower(replace(replace(text, '$', ''), ',', '')), '\s+', ' ', 'g'))"


@query(f"""WITH n AS (SELECT conv_id, turn, {NORM_SQL} AS t FROM conversations), d AS (SELECT doc_id, {NORM_SQL} AS c FROM documents)
SELECT conv_id, turn, {holds('t', ['12', '$3.5', 'the'])} AS facts_found, ({holds('t', ['Licensed  under', '12'])}) + coalesce((contains(c, 'licensed under') AND NOT contains(t, 'licensed under'))::INT, 0)
+ coalesce(({HOLDS_SQL['12'].format(t='c')} AND NOT {HOLDS_SQL['12'].format(t='t')})::INT, 0) AS n_leaked FROM n LEFT JOIN d ON doc_id = conv_id""")
def case_scores(spark, sf_dir):
    """Turns of conversations as answers with the document of the same number as what was retrieved: expected facts found, forbidden ones leaked in either."""
    answers = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("answer"))
    df = answers.join(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("context")), F.col("conv_id") == F.col("doc_id"), "left")
    facts = lambda *x: F.array(*map(F.lit, x))
    scored = evaluation.score_cases(df.withColumns({"expected_facts": facts("12", "$3.5", "the"), "forbidden": facts("Licensed  under", "12")}))
    return scored.select("conv_id", "turn", "facts_found", "n_leaked")


@query("""WITH c AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'nova-lite' WHEN 'view' THEN 'haiku' ELSE 'unknown' END AS model, event_id % 1000 AS i, CASE WHEN event_id % 3 > 0 THEN event_id % 77 END AS o FROM events),
p AS (SELECT *, CASE model WHEN 'nova-lite' THEN (i * 0.06 + coalesce(o, 0) * 0.24) WHEN 'haiku' THEN (i * 1 + coalesce(o, 0) * 5) END / 1000000 AS cost FROM c)
SELECT user_id, count(*) AS calls, sum(i)::BIGINT AS input_tokens, coalesce(sum(o), 0)::BIGINT AS output_tokens, 0::BIGINT AS cache_read_tokens, 0::BIGINT AS cache_write_tokens,
CASE WHEN count(cost) = count(*) THEN round(sum(cost)::DOUBLE, 6) END AS cost_usd FROM p GROUP BY 1""")
def usage_sums(spark, sf_dir):
    kind = F.col("event_type")
    model = F.when(kind == "click", "us.amazon.nova-lite-v1:0").when(kind == "view", "claude-haiku-4-5-20251001").otherwise("unheard-of")
    out = F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 77)
    none = F.lit(None).cast("long")
    calls = table(spark, sf_dir, "events").select("user_id", model.alias("model"), (F.col("event_id") % 1000).alias("input_tokens"), out.alias("output_tokens"), none.alias("cache_read_tokens"), none.alias("cache_write_tokens"))
    return evaluation.usage_totals(calls, "user_id").withColumn("cost_usd", F.round(F.col("cost_usd").cast("double"), 6))
