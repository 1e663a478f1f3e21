"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numbers import known_sum, nearest_ranks
from ..functions.vectors import cosine
from ..operators import documents as D
from ..operators import evaluation
from ..operators.search import batch_vector_top_k
from . import golden_queries, index_queries, lake_queries, record_queries, search_queries, serving_queries, stream_queries  # noqa: F401  they register queries
from .catalog import ORACLES, QUERIES, query, table
from .groups import GROUPS_SQL, with_groups


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


CALLER = ["all-staff", "sales"]
PRINT_SQL = r"sha256(lower(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))))"
CANON_SQL = f"""d AS (SELECT *, {PRINT_SQL} AS fingerprint, {GROUPS_SQL} AS groups FROM documents),
c AS (SELECT *, first_value(doc_id) OVER (PARTITION BY fingerprint, array_to_string(groups, ',') ORDER BY length(doc_id::VARCHAR), doc_id::VARCHAR) AS canonical FROM d)"""


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_groups(table(spark, sf_dir, "documents")).withColumn("key", F.col("doc_id").cast("string")).withColumn("fingerprint", X.fingerprint(F.col("text")))
    return D.canonical_keys(df.withColumn("updated", F.lit(None).cast("string")).drop("text"), "fingerprint", "groups", "updated", "key")


@query(f"""WITH {CANON_SQL} SELECT lang, source, count(*) AS n_docs FROM c
WHERE canonical = doc_id AND list_has_any(groups, ['all-staff','sales']) GROUP BY lang, source""")
def canonical_by_source(spark, sf_dir):
    seen = canonical(spark, sf_dir).filter(~F.col("is_duplicate") & D.visible(F.col("groups"), CALLER))
    return seen.groupBy("lang", "source").agg(F.count("*").alias("n_docs"))


@query(f"WITH {CANON_SQL} SELECT doc_id, canonical::VARCHAR AS canonical_key, canonical <> doc_id AS is_duplicate FROM c")
def canonical_documents(spark, sf_dir):
    return canonical(spark, sf_dir).select("doc_id", "canonical_key", "is_duplicate")


@query(f"SELECT fingerprint, count(*) AS copies, min(doc_id) AS least FROM (SELECT doc_id, {PRINT_SQL} AS fingerprint FROM documents) GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", X.fingerprint(F.col("text")).alias("fingerprint"))
    return df.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")).filter("copies > 1")


@query(f"SELECT doc_id, array_to_string(groups, ',') AS group_list FROM (SELECT doc_id, {GROUPS_SQL} AS groups FROM documents) WHERE list_has_any(groups, ['all-staff','sales'])")
def acl_visible(spark, sf_dir):
    return with_groups(table(spark, sf_dir, "documents")).filter(D.visible(F.col("groups"), CALLER)).select("doc_id", F.array_join("groups", ",").alias("group_list"))


@query("""SELECT user_id, event_id, event_type, event_type = 'error' AS is_deleted FROM
(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_per_key(spark, sf_dir):
    latest = D.latest_per_key(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    return latest.select("user_id", "event_id", "event_type", (F.col("event_type") == "error").alias("is_deleted"))


def halves(spark, sf_dir):
    """All customers as a merge target. The source has new balances of all who order, made of their orders, and all suppliers as new customers."""
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), lake_queries.balances(spark, sf_dir)


HALVES = f"t AS (SELECT c_custkey, c_acctbal, c_mktsegment FROM customer), {lake_queries.BALANCES_SQL}"


@query(f"""WITH {HALVES} SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey,
CASE WHEN s.c_custkey IS NULL THEN 'keep' WHEN s.c_mktsegment = 'P' THEN CASE WHEN t.c_custkey IS NULL THEN 'ignore' ELSE 'delete' END
WHEN t.c_custkey IS NULL THEN 'insert' WHEN s.c_acctbal > t.c_acctbal THEN 'update' ELSE 'keep' END AS action
FROM t FULL JOIN s ON t.c_custkey = s.c_custkey""")
def merge_actions(spark, sf_dir):
    target, source = halves(spark, sf_dir)
    plan = D.merge_plan(target, source, "c_custkey", F.col("s.c_acctbal") > F.col("t.c_acctbal"), F.col("s.c_mktsegment") == "P")
    return plan.select(F.coalesce("_old.c_custkey", "_new.c_custkey").alias("c_custkey"), F.col("_action").alias("action"))


@query(f"""WITH {HALVES} SELECT * FROM t UNION ALL SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.c_custkey = s.c_custkey)""")
def insert_only_merge(spark, sf_dir):
    target, source = halves(spark, sf_dir)
    plan = D.merge_plan(target, source, "c_custkey", F.lit(False))
    return plan.select(F.when(F.col("_action") == "insert", F.col("_new")).otherwise(F.col("_old")).alias("r")).select("r.*")


@query(f"""WITH {HALVES} SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey,
CASE WHEN t.c_custkey IS NULL OR s.c_acctbal > t.c_acctbal THEN s.c_acctbal ELSE t.c_acctbal END AS c_acctbal FROM t FULL JOIN s ON t.c_custkey = s.c_custkey""")
def newest_wins_merge(spark, sf_dir):
    target, source = halves(spark, sf_dir)
    plan = D.merge_plan(target, source, "c_custkey", F.col("s.c_acctbal") > F.col("t.c_acctbal"))
    row = F.when(F.col("_action").isin("insert", "update"), F.col("_new")).otherwise(F.col("_old"))
    return plan.select(row.alias("r")).select("r.c_custkey", "r.c_acctbal")


@query(f"""WITH {HALVES} SELECT c_custkey, NULL::VARCHAR AS note, 'stale' AS op FROM t WHERE c_custkey NOT IN (SELECT c_custkey FROM s)
UNION ALL SELECT c_custkey, c_mktsegment AS note, 'desired' AS op FROM s""")
def reconcile_chunks(spark, sf_dir):
    target, source = halves(spark, sf_dir)
    plan = D.merge_plan(target, source, "c_custkey", F.lit(True))
    stale = F.col("_new").isNull()
    return plan.select(F.coalesce("_new.c_custkey", "_old.c_custkey").alias("c_custkey"), F.col("_new.c_mktsegment").alias("note"), F.when(stale, "stale").otherwise("desired").alias("op"))


TOP_SQL = """q AS (SELECT embedding AS query FROM embeddings WHERE vec_id = 0),
v AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT query FROM q)::DOUBLE[]), 6) AS similarity FROM embeddings),
vr AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, vec_id) AS vector_rank FROM v QUALIFY vector_rank <= 40)"""


def vector_ranks(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    q = [float(x) for x in vectors.filter("vec_id = 0").first()["embedding"]]
    near = vectors.select("vec_id", F.round(cosine(F.col("embedding"), F.array(*map(F.lit, q))), 6).alias("similarity"))
    return D.top_k(near, 40, F.col("similarity").desc(), F.col("vec_id")).withColumnRenamed("rank", "vector_rank")


@query(f"WITH {TOP_SQL} SELECT vec_id, similarity, vector_rank FROM vr")
def vector_topk(spark, sf_dir):
    return vector_ranks(spark, sf_dir)


WORDS_SQL = r"""w AS (SELECT doc_id, count(*) AS hits FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE word IN ('the', 'thing', 'licensed') GROUP BY doc_id),
wr AS (SELECT *, row_number() OVER (ORDER BY hits DESC, doc_id) AS lexical_rank FROM w QUALIFY lexical_rank <= 40)"""


def word_ranks(spark, sf_dir):
    words = F.filter(F.split(F.lower("text"), " "), lambda x: x.isin("the", "thing", "licensed"))
    hits = table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("hits")).filter("hits > 0")
    return D.top_k(hits, 40, F.col("hits").desc(), F.col("doc_id")).withColumnRenamed("rank", "lexical_rank")


@query(f"WITH {WORDS_SQL} SELECT doc_id, hits, lexical_rank FROM wr")
def lexical_topk(spark, sf_dir):
    return word_ranks(spark, sf_dir)


@query(f"""WITH {TOP_SQL}, {WORDS_SQL} SELECT coalesce(vec_id, doc_id) AS id, vector_rank, lexical_rank,
round(coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0), 9) AS score
FROM vr FULL JOIN wr ON vec_id = doc_id ORDER BY score DESC, id LIMIT 40""")
def rrf_fusion(spark, sf_dir):
    left = vector_ranks(spark, sf_dir).select(F.col("vec_id").alias("id"), "vector_rank")
    right = word_ranks(spark, sf_dir).select(F.col("doc_id").alias("id"), "lexical_rank")
    fused = D.rrf(left, right, "id", "vector_rank", "lexical_rank").withColumn("score", F.round("score", 9))
    return fused.select("id", "vector_rank", "lexical_rank", "score").orderBy(F.col("score").desc(), "id").limit(40)


@query("""SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, v.vec_id) <= 8""")
def batch_retrieval(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return batch_vector_top_k(v.select(F.col("vec_id").alias("id"), "embedding"), q, 8, digits=6).select("query_id", "id", "similarity")


#: Personal data in DuckDB, whose patterns look neither back nor ahead: the characters around a match are part of it and put back, in two passes for matches that share one.
EMAIL_SQL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE_SQL = r"(^|[^\w-])((?:\+?1[\s.-]?)?(?:\(\d{3}\)\s?|\d{3}[\s.-])\d{3}[\s.-]\d{4}(?:\s?x\d{1,5})?)($|[^\w-])"
SSN_SQL = r"(^|\D)(\d{3}-\d{2}-\d{4})($|\D)"
CARD_SQL = r"((?:\d[ -]?){13,16})($|\D)"


def luhn_sql(m: str) -> str:
    """Whether a card number's digits are valid: every second one from the right counts twice, less 9 above 9, and the sum ends in 0."""
    digits = rf"regexp_replace({m}, '\D', '', 'g')"
    one = f"CASE WHEN i % 2 = 1 THEN {digits}[-i]::INT ELSE {digits}[-i]::INT * 2 - CASE WHEN {digits}[-i]::INT > 4 THEN 9 ELSE 0 END END"
    return f"list_sum(list_transform(range(1, len({digits}) + 1), lambda i: {one})) % 10 = 0"


def cards_sql(text: str) -> str:
    """What looks like card numbers, each with the text up to the next behind a chr(2): a list whose first entry is the text before the first."""
    mark = r"'\1' || chr(1) || '\2' || chr(2) || '\3'"
    return rf"string_split(regexp_replace(regexp_replace({text}, '(^|\D){CARD_SQL}', {mark}, 'g'), '(^|[^\d\x01]){CARD_SQL}', {mark}, 'g'), chr(1))"


@query(f"""SELECT doc_id, array_to_string(list_filter([CASE WHEN list_bool_or(list_transform({cards_sql('text')}[2:], lambda x: {luhn_sql('string_split(x, chr(2))[1]')})) THEN 'card' END, CASE WHEN regexp_matches(text, '{EMAIL_SQL}') THEN 'email' END,
CASE WHEN regexp_matches(text, '{PHONE_SQL}') THEN 'phone' END, CASE WHEN regexp_matches(text, '{SSN_SQL}') THEN 'ssn' END], lambda x: x IS NOT NULL), ',') AS kinds FROM documents""")
def pii_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.detect_pii(F.col("text")), ",").alias("kinds"))


@query(rf"""WITH a AS (SELECT doc_id, regexp_replace(text, '{EMAIL_SQL}', '[EMAIL]', 'g') AS t, text FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '{PHONE_SQL}', '\1[PHONE]\3', 'g'), '{PHONE_SQL}', '\1[PHONE]\3', 'g') AS t, text FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '{SSN_SQL}', '\1[SSN]\3', 'g'), '{SSN_SQL}', '\1[SSN]\3', 'g') AS t, text FROM b),
k AS (SELECT doc_id, text, {cards_sql('t')} AS parts FROM c)
SELECT doc_id, masked FROM (SELECT doc_id, text, parts[1] || array_to_string(list_transform(parts[2:], lambda x: CASE WHEN {luhn_sql('string_split(x, chr(2))[1]')} THEN '[CARD]' ELSE string_split(x, chr(2))[1] END || string_split(x, chr(2))[2]), '') AS masked FROM k) WHERE masked <> text""")
def pii_masked(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "text", X.mask_pii(F.col("text"), as_sql=True).alias("masked"))
    return df.filter("masked <> text").select("doc_id", "masked")


@query("SELECT conv_id, turn, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?im){p}') THEN '{k}' END" for k, p in X.INJECTION.items()) + "], lambda x: x IS NOT NULL)), ',') AS patterns FROM conversations")
def injection_flags(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(X.detect_injection(F.col("text")), ",").alias("patterns"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS thread, count(*) AS turns, sha256(string_agg(text, chr(10) ORDER BY turn)) AS content_hash FROM conversations GROUP BY conv_id")
def conversation_threads(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"), "text")))
    df = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(rows.alias("r"), F.count("*").alias("turns"))
    lines = lambda f: F.array_join(F.transform("r", lambda x: x[f]), "\n")
    return df.select("conv_id", lines("line").alias("thread"), "turns", F.sha2(lines("text"), 256).alias("content_hash"))


@query("""SELECT c_mktsegment AS segment, count(*) AS shipments, sum((l_shipdate > o_orderdate + INTERVAL 30 DAY)::INT)::BIGINT AS late,
round(avg((l_shipdate > o_orderdate + INTERVAL 30 DAY)::INT), 6) AS late_share
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def late_by_segment(spark, sf_dir):
    late = F.coalesce(F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"), F.lit(False))
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    df = df.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    df = df.join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    share = F.round(F.avg(late.cast("int")), 6)
    return df.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("shipments"), F.count_if(late).alias("late"), share.alias("late_share"))


@query("""SELECT o_custkey, count(*) AS late FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate + INTERVAL 30 DAY
GROUP BY 1 ORDER BY late DESC, o_custkey LIMIT 6""")
def top_late_customers(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    df = df.filter(F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    return df.groupBy("o_custkey").agg(F.count("*").alias("late")).orderBy(F.col("late").desc(), "o_custkey").limit(6)


@query("""SELECT o_custkey, count(*) AS n, sum(o_totalprice::DECIMAL(12,2)) AS total, min(o_orderdate) AS first_date FROM orders GROUP BY 1 HAVING count(*) >= 2 ORDER BY total DESC, o_custkey LIMIT 4""")
def overdue_totals(spark, sf_dir):
    df = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(12,2)")).alias("total"), F.min("o_orderdate").alias("first_date"))
    return df.filter("n >= 2").orderBy(F.col("total").desc(), "o_custkey").limit(4)


@query("""SELECT month, c_mktsegment, n, rank() OVER (PARTITION BY month ORDER BY n DESC) AS r FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, c_mktsegment, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)""")
def ranked_months(spark, sf_dir):
    df = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    df = df.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "c_mktsegment").agg(F.count("*").alias("n"))
    return df.withColumn("r", F.rank().over(Window.partitionBy("month").orderBy(F.col("n").desc())))


@query("""(SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT o_custkey FROM orders) EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey < 5 ORDER BY k LIMIT 200""")
def set_ops_capped(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    building = c.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"))
    return building.union(o.select("o_custkey")).distinct().exceptAll(c.filter("c_nationkey < 5").select("c_custkey")).orderBy("k").limit(200)


@query("""SELECT event_type, [x FOR x IN list_sort(list(value))][(round_even(0.5 * (count(*) - 1), 0) + 1)::INT] AS p50, [x FOR x IN list_sort(list(value))][(round_even(0.95 * (count(*) - 1), 0) + 1)::INT] AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1""")
def latency_percentiles(spark, sf_dir):
    df = table(spark, sf_dir, "events").filter("value is not null")
    return nearest_ranks(df, "value", {"p50": 0.5, "p95": 0.95}, "event_type")


@query("""SELECT user_id, CASE WHEN count(*) = count(v) THEN coalesce(sum(v), 0)::BIGINT END AS total FROM (SELECT user_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE event_id END AS v FROM events) GROUP BY 1""")
def known_sums(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 97 != 0, F.col("event_id")))
    return df.groupBy("user_id").agg(known_sum(F.col("v")).alias("total"))


RECORDS_SQL, DOCUMENTS_SQL = f"(?i){X.RECORD_ID}|{X.ROUTE_SQL}", f"(?i){X.ROUTE_DOCS}"
#: Texts that are asked: all turns of users and every document, which have ids, lists and stops of all kinds.
ASKED_SQL = "(SELECT 'c' || conv_id || ':' || turn AS id, text FROM conversations WHERE role = 'user' UNION ALL SELECT 'd' || doc_id, text FROM documents)"


def asked(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.concat(F.lit("c"), "conv_id", F.lit(":"), "turn").alias("id"), "text")
    return said.unionByName(table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text"))


@query(f"""SELECT id, CASE WHEN regexp_matches(text, '{RECORDS_SQL}') THEN CASE WHEN regexp_matches(text, '{DOCUMENTS_SQL}') THEN 'hybrid' ELSE 'sql' END ELSE 'docs' END AS route FROM {ASKED_SQL}""")
def route_questions(spark, sf_dir):
    return asked(spark, sf_dir).select("id", X.heuristic_route(F.col("text")).alias("route"))


@query(rf"""WITH c AS (SELECT id, text, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '(?i)([.!?])\s+|,\s+and\s+|;\s+and\s+|;\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ,')), lambda x: x <> '') AS clauses FROM {ASKED_SQL}),
k AS (SELECT *, list_filter(clauses, lambda x: regexp_matches(x, '{DOCUMENTS_SQL}')) AS kept FROM c)
SELECT id, CASE WHEN len(kept) > 0 AND len(kept) < len(clauses) THEN array_to_string(list_transform(kept, lambda x: CASE WHEN x LIKE '%?' THEN x ELSE x || '.' END), ' ') ELSE text END AS subquery FROM k""")
def document_subqueries(spark, sf_dir):
    return asked(spark, sf_dir).select("id", X.document_subquery(F.col("text")).alias("subquery"))


RESULTS_SQL = """r AS (SELECT CASE event_type WHEN 'click' THEN 'docs' WHEN 'view' THEN 'sql' WHEN 'purchase' THEN 'hybrid' ELSE 'acl' END AS kind,
CASE WHEN event_id % 7 = 0 THEN 'sql' ELSE 'docs' END AS route, CASE WHEN event_type = 'view' THEN 'sql' ELSE 'docs' END AS expected_route,
CASE WHEN event_id % 5 > 0 THEN event_id % 5 END AS hit_rank, event_id % 11 = 0 AS refused, event_id % 13 > 0 AS grounded, value AS latency_ms,
event_id % 3 AS facts_found, (event_id % 17 = 0)::INT AS leaked, event_id % 4 > 0 AS has_sql, event_id % 19 = 0 AS sql_failed, event_id % 23 = 0 AS failed, event_id % 9 / 8::DOUBLE AS cost_usd FROM events)"""


def results(spark, sf_dir):
    e, t, none = F.col("event_id"), F.col("event_type"), F.lit(None).cast("string")
    return table(spark, sf_dir, "events").select(
        F.when(t == "click", "docs").when(t == "view", "sql").when(t == "purchase", "hybrid").otherwise("acl").alias("kind"), F.when(e % 7 == 0, "sql").otherwise("docs").alias("route"),
        F.when(t == "view", "sql").otherwise("docs").alias("expected_route"), F.when(e % 5 > 0, e % 5).alias("hit_rank"), (e % 11 == 0).alias("refused"), (e % 13 > 0).alias("grounded"),
        (e % 3).alias("facts_found"), F.lit(2).alias("facts_expected"), (e % 17 == 0).cast("int").alias("leaked"), F.when(e % 4 > 0, "s").alias("sql"), F.when(e % 19 == 0, "e").otherwise(none).alias("sql_error"),
        F.when(e % 23 == 0, "e").otherwise(none).alias("error"), F.col("value").alias("latency_ms"), (e % 9 / 8.0).alias("cost_usd"),
    )


METRICS = "recall_at_k mrr router_accuracy answer_correctness sql_success refusal_rate_restricted grounded_rate unexpected_refusal_rate acl_leaks errors total_cost_usd p50_ms p95_ms".split()


def share_sql(hit: str, of: str) -> str:
    return f"round(count(*) FILTER ({of} AND {hit})::DOUBLE / count(*) FILTER ({of}), 9)"


@query(f"""WITH {RESULTS_SQL}, o AS (SELECT list_sort(list(latency_ms)) AS l FROM r WHERE latency_ms IS NOT NULL)
SELECT count(*) AS cases, {share_sql("hit_rank IS NOT NULL", "kind IN ('docs','hybrid')")} AS recall_at_k,
round(sum(1.0::DOUBLE / hit_rank) FILTER (kind IN ('docs','hybrid')) / count(*) FILTER (kind IN ('docs','hybrid')), 9) AS mrr,
{share_sql("route = expected_route", "kind <> 'acl'")} AS router_accuracy, {share_sql("NOT refused AND facts_found = 2", "kind <> 'acl'")} AS answer_correctness,
{share_sql("has_sql AND NOT sql_failed", "kind IN ('sql','hybrid')")} AS sql_success, {share_sql("refused", "kind = 'acl'")} AS refusal_rate_restricted,
{share_sql("grounded", "kind <> 'acl' AND NOT refused")} AS grounded_rate, {share_sql("refused", "kind <> 'acl'")} AS unexpected_refusal_rate,
sum(leaked)::BIGINT AS acl_leaks, count(*) FILTER (failed) AS errors, round(sum(cost_usd), 9) AS total_cost_usd,
(SELECT round(l[(round_even(0.5 * (len(l) - 1), 0) + 1)::INT], 9) FROM o) AS p50_ms, (SELECT round(l[(round_even(0.95 * (len(l) - 1), 0) + 1)::INT], 9) FROM o) AS p95_ms FROM r""")
def golden_metrics(spark, sf_dir):
    return evaluation.summarise(results(spark, sf_dir)).select("cases", *(n if n in ("acl_leaks", "errors") else F.round(n, 9).alias(n) for n in METRICS))


@query("""SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def event_windows(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return df.groupBy(F.window("at", "5 minutes").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("SELECT s_nationkey, n_name, count(*) AS suppliers, count(DISTINCT s_acctbal) AS balances, max(s_acctbal) AS most FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2")
def directory_by_nation(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return df.groupBy("s_nationkey", "n_name").agg(F.count("*").alias("suppliers"), F.countDistinct("s_acctbal").alias("balances"), F.max("s_acctbal").alias("most"))


@query("""SELECT c_custkey, coalesce(n, 0) AS n_orders, CASE WHEN n IS NULL THEN 'only_listed' ELSE 'both' END AS side FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def sync_listing(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    df = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return df.select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("n_orders"), F.when(F.col("n").isNull(), "only_listed").otherwise("both").alias("side"))
