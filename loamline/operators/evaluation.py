"""Evaluation of answers: metrics over case results, and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.costs import cost_usd
from ..functions.numbers import known_sum, nearest_ranks, ratio
from ..functions.text import NUMBERS, normalized


def summarise(results: DataFrame) -> DataFrame:
    """One row of metrics over results (kind, route, expected_route, hit_rank, refused, grounded, facts_found, facts_expected, leaked, sql, error, sql_error, latency_ms, cost_usd).

    Empty populations give 0; ``n_`` columns say how many cases a metric was measured on.
    """
    c = F.col
    answerable, docs, sql = c("kind") != "acl", c("kind").isin("docs", "hybrid"), c("kind").isin("sql", "hybrid")
    answered = answerable & ~c("refused")
    n_docs = F.nullif(F.count_if(docs), F.lit(0))
    latency = nearest_ranks(results, "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    metrics = results.agg(
        F.count("*").alias("cases"),
        ratio(c("hit_rank").isNotNull(), docs).alias("recall_at_k"),
        F.coalesce(F.sum(F.when(docs, 1.0 / c("hit_rank"))) / n_docs, F.lit(0.0)).alias("mrr"),
        ratio(c("route").eqNullSafe(c("expected_route")), answerable).alias("router_accuracy"),
        ratio(~c("refused") & (c("facts_found") == c("facts_expected")), answerable).alias("answer_correctness"),
        ratio(c("sql").isNotNull() & c("sql_error").isNull(), sql).alias("sql_success"),
        ratio(c("refused"), c("kind") == "acl").alias("refusal_rate_restricted"),
        ratio(c("grounded"), answered).alias("grounded_rate"),
        ratio(c("refused"), answerable).alias("unexpected_refusal_rate"),
        F.coalesce(F.sum("leaked"), F.lit(0)).alias("acl_leaks"),
        F.count("error").alias("errors"),
        F.coalesce(F.sum("cost_usd"), F.lit(0)).alias("total_cost_usd"),
        F.count_if(docs).alias("n_docs"),
        F.count_if(answerable).alias("n_answerable"),
        F.count_if(sql).alias("n_sql"),
        F.count_if(c("kind") == "acl").alias("n_acl"),
        F.count_if(answered).alias("n_answered"),
    )
    return metrics.join(latency, how="left").na.fill(0.0, ["p50_ms", "p95_ms"])  # a row each


def hit_ranks(retrieved: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, hit_rank): place of the first expected document among a case's distinct documents. ``retrieved``: case_id, rank, doc_id."""
    first = retrieved.groupBy("case_id", "doc_id").agg(F.min("rank").alias("r"))
    ordered = first.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("r", "doc_id"))).alias("d"))  # at most k documents a case
    each = ordered.select("case_id", F.posexplode("d").alias("p", "d")).select("case_id", (F.col("p") + 1).alias("hit_rank"), F.col("d.doc_id").alias("doc_id"))
    return each.join(expected, ["case_id", "doc_id"]).groupBy("case_id").agg(F.min("hit_rank").alias("hit_rank"))


#: Column that says on how many cases a metric was measured; the others are measured on all.
POPULATION = {
    "recall_at_k": "n_docs", "mrr": "n_docs", "router_accuracy": "n_answerable", "answer_correctness": "n_answerable", "sql_success": "n_sql",
    "refusal_rate_restricted": "n_acl", "grounded_rate": "n_answered", "unexpected_refusal_rate": "n_answerable",
}


def check_thresholds(metrics: dict, limits: dict[str, dict[str, float]]) -> list[str]:
    """Failures of min and max limits. A metric that was measured on no case is skipped, one that isn't reported fails."""
    out = []
    for name, limit in limits.items():
        v = metrics.get(name)
        if metrics.get(POPULATION.get(name, "cases"), 1) == 0:
            continue
        if v is None:
            out.append(f"{name} is not reported")
        elif v < limit.get("min", v) or v > limit.get("max", v):
            out.append(f"{name} = {v}")
    return out


def _holds(text: Column, needle: Column) -> Column:
    """As ``functions.text.contains_fact``, for needles of a column; ``text`` is normalized."""
    low = normalized(F.translate(needle, "$,", ""))
    number = F.concat(F.lit(r"(?<![\d.])"), F.replace(low, F.lit("."), F.lit("[.]")), F.lit(r"(?!\d|\.\d)"))
    word = F.try_element_at(F.create_map(*(x for i, w in enumerate(NUMBERS) for x in (F.lit(str(i)), F.lit(w)))), low)
    spelled = F.coalesce(F.regexp_like(text, F.concat(F.lit(r"\b"), word, F.lit(r"\b"))), F.lit(False))
    return F.when(low.rlike(r"^[\d.]+$"), F.regexp_like(text, number) | spelled).otherwise(F.contains(text, low))


def score_cases(answers: DataFrame) -> DataFrame:
    """Adds facts_found, facts_expected, leaked (facts that must not be told, in the answer or in what was retrieved for it) and n_leaked to ``answers``
    (answer, context, expected_facts array, forbidden array). A null answer or context holds nothing."""
    text, context = (normalized(F.translate(F.coalesce(F.col(c), F.lit("")), "$,", "")) for c in ("answer", "context"))
    expected, forbidden = (F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("expected_facts", "forbidden"))
    df = answers.withColumns({"_text": text, "_context": context})
    found = F.size(F.filter(expected, lambda x: _holds(F.col("_text"), x)))
    leaked = F.filter(forbidden, lambda x: _holds(F.col("_text"), x) | _holds(F.col("_context"), x))
    return df.withColumns({"facts_found": found, "facts_expected": F.size(expected), "leaked": leaked}).withColumn("n_leaked", F.size("leaked")).drop("_text", "_context")


def usage_totals(calls: DataFrame, *keys: str) -> DataFrame:
    """Tokens of all kinds by ``keys`` (input, output, cache_read and cache_write tokens; null counts as 0), the calls, and their cost, which is null if any call has no known price."""
    kinds = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
    cost = cost_usd(F.col("model"), *(F.coalesce(c, F.lit(0)) for c in ("input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens")))
    sums = [F.coalesce(F.sum(k), F.lit(0)).cast("long").alias(k) for k in kinds]
    return calls.withColumn("_cost", cost).groupBy(*keys).agg(F.count("*").alias("calls"), *sums, known_sum(F.col("_cost")).alias("cost_usd"))
