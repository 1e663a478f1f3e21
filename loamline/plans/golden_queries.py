"""The golden set of the given tables, and how a fake answerer does on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import whole_dollars
from ..operators import evaluation, golden
from ..operators.views import VIEWS, analytics_views
from .catalog import query, table
from .groups import GROUPS_SQL, with_groups
from .serving_queries import record_tables

ALL_GROUPS = ["all-staff", "exec", "finance", "hr", "sales"]


def cases(spark, sf_dir) -> DataFrame:
    views = {k: df for k, (df, _) in analytics_views(record_tables(spark, sf_dir), ALL_GROUPS).items()}
    docs = with_groups(table(spark, sf_dir, "documents")).withColumn("ending", F.right(F.trim("text"), F.lit(40))).filter("size(groups) > 0 and ending <> ''")
    count, late = F.count("*"), F.count_if("is_late")
    staff, money = ["all-staff"], VIEWS["invoices"][1]
    bound = [
        golden.bind(golden.Template("shipments", "sql", "How many shipments does customer {customer_id} have?", "customer_id", count, staff), views["shipments"]),
        golden.bind(golden.Template("late", "sql", "How many late shipments does customer {customer_id} have?", "customer_id", late, staff), views["shipments"]),
        golden.bind(golden.Template("policy", "hybrid", "How many shipments does customer {customer_id} have, and what does the policy say?", "customer_id", count, staff), views["shipments"]),
    ]
    guarded = [
        golden.bind(golden.Template("invoiced", "sql", "What is the total invoiced to customer {customer_id}?", "customer_id", whole_dollars(F.sum("amount_usd")), sorted(money)), views["invoices"]),
        golden.bind(golden.Template("ending", "docs", "How does document {doc_id} end?", "doc_id", F.col("ending"), F.array_sort("groups"), grouped=False), docs),
    ]
    return golden.build(bound, guarded, ALL_GROUPS)


CASES_SQL = f"""s AS (SELECT o_custkey AS k, count(*) AS n, count(*) FILTER (l_orderkey % 7 <> 0 AND l_shipdate > o_orderdate + INTERVAL 30 DAY) AS late FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
i AS (SELECT o_custkey AS k, round_even(sum(o_totalprice::DECIMAL(12,2))::DOUBLE, 0)::BIGINT AS n FROM orders GROUP BY 1),
d AS (SELECT doc_id AS k, right(trim(text, ' '), 40) AS n, list_sort({GROUPS_SQL}) AS g FROM documents WHERE right(trim(text, ' '), 40) <> ''),
b AS (SELECT 'shipments-' || k AS case_id, 'sql' AS kind, 'How many shipments does customer ' || k || ' have?' AS question, ['all-staff'] AS groups, 'sql' AS expected_route, n::VARCHAR AS fact, false AS guarded FROM s
UNION ALL SELECT 'late-' || k, 'sql', 'How many late shipments does customer ' || k || ' have?', ['all-staff'], 'sql', late::VARCHAR, false FROM s
UNION ALL SELECT 'policy-' || k, 'hybrid', 'How many shipments does customer ' || k || ' have, and what does the policy say?', ['all-staff'], 'hybrid', n::VARCHAR, false FROM s
UNION ALL SELECT 'invoiced-' || k, 'sql', 'What is the total invoiced to customer ' || k || '?', ['exec', 'finance', 'sales'], 'sql', n::VARCHAR, true FROM i
UNION ALL SELECT 'ending-' || k, 'docs', 'How does document ' || k || ' end?', g, 'docs', n, true FROM d WHERE len(g) > 0),
c AS (SELECT case_id, kind, question, groups, expected_route, fact AS expected, NULL AS forbidden, false AS must_refuse FROM b
UNION ALL SELECT 'acl-' || case_id, 'acl', question, [x FOR x IN {ALL_GROUPS} IF NOT list_contains(groups, x)], expected_route, NULL, fact, true FROM b WHERE guarded AND len([x FOR x IN {ALL_GROUPS} IF NOT list_contains(groups, x)]) > 0)"""


@query(f"WITH {CASES_SQL} SELECT case_id, kind, question, array_to_string(groups, ',') AS group_list, expected_route, expected, forbidden, must_refuse FROM c")
def golden_cases(spark, sf_dir):
    first = lambda c: F.get(c, F.lit(0)).alias
    return cases(spark, sf_dir).select("case_id", "kind", "question", F.array_join("groups", ",").alias("group_list"), "expected_route", first("expected_facts")("expected"), first("forbidden")("forbidden"), "must_refuse")


@query(f"""WITH {CASES_SQL} SELECT kind, count(*) AS n, count(*) FILTER (expected IS NOT NULL) AS facts_found, count(*) FILTER (forbidden IS NOT NULL AND expected_route = 'docs') AS leaks FROM c GROUP BY 1""")
def golden_scores(spark, sf_dir):
    """Scores of an answerer that says what is expected, and tells forbidden endings of documents: every such leak must be seen."""
    told = F.when(F.col("expected_route") == "docs", F.array_join("forbidden", " "))
    said = cases(spark, sf_dir).withColumns({"answer": F.concat_ws(" ", F.array_join("expected_facts", " "), told), "context": F.lit(None).cast("string")})
    scored = evaluation.score_cases(said)
    return scored.groupBy("kind").agg(F.count("*").alias("n"), F.sum("facts_found").cast("long").alias("facts_found"), F.count_if(F.col("n_leaked") > 0).alias("leaks"))
