"""Document quality rules with host-level verdicts, in DataFrame expressions only.

Rules are evaluated per document. Failures are summed by host, each host's failure rate is shrunk towards the corpus by a
beta prior fitted to all hosts' rates by moments, and a host whose shrunk rate is above a bound has all its documents rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: A host is rejected when its shrunk failure rate exceeds this.
MAX_HOST_FAILURE = 0.5
#: Rejected hosts up to this number are broadcast (a name each); more are joined by a shuffle.
BROADCAST_HOSTS = 20_000
RULES = ("short", "repetitive", "symbols", "dup_lines")


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it, and wherever the optimizer moves the whole."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words in 5-word windows that occur twice or more in ``words``.

    Positions of such windows are found by sorting (hash, position), and only in documents whose windows aren't all
    different, so the cost is n log n for any text.
    """

    def grams(h: Column) -> Column:
        g = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(WINDOW))))
        return F.when(F.size(h) >= WINDOW, g).otherwise(F.array().cast("array<bigint>"))

    def covered(rank: Column) -> Column:
        def twice(x: Column, j: Column) -> Column:
            return F.when(F.get(rank, j - 1)["g"].eqNullSafe(x["g"]) | F.get(rank, j + 1)["g"].eqNullSafe(x["g"]), x["i"])

        at = F.sort_array(F.filter(F.transform(rank, twice), lambda i: i.isNotNull()))
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last"))
        return F.aggregate(at, start, step, lambda acc: acc["n"])

    def count(g: Column) -> Column:
        ranked = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")).otherwise(let(ranked, covered))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(grams(h), count))


def fails_base(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row for each row of ``docs``: doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rules that fail."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), text.alias("text"))

    def of_words(w: Column) -> Column:
        chars = F.length(F.array_join(w, "")).cast("long")
        return F.struct(F.size(w).cast("long").alias("n_words"), chars.alias("word_chars"), repeat_words(w).alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({"_w": let(word_array(F.col("text")), of_words), "_l": let(lines, of_lines), "n_symbols": F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long")})
    df = df.select("doc_id", "host", "n_symbols", "_w.*", "_l.*")
    fails = {
        "short": F.col("n_words") < 10,
        "repetitive": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
    }
    return df.withColumns({f"fails_{k}": v for k, v in fails.items()})


def host_verdicts(measured: DataFrame, max_failure: float = MAX_HOST_FAILURE) -> DataFrame:
    """(host, host_docs, host_failures, one count for each rule, failure_rate, host_kept) from rows with ``host`` and ``failed``.

    Moments: with m the share of failures over all documents and v the hosts' mean squared distance from m less the mean
    binomial variance m(1-m)/n, the prior weighs s = m(1-m)/v - 1 documents (from 1 to 1e6) and the shrunk rate is (f + s m) / (n + s).
    """
    counts = [F.sum(F.col(c).cast("long")).alias(c) for c in measured.columns if c.startswith("fails_")]
    hosts = measured.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failures"), *counts)
    total = hosts.agg(F.sum("host_failures").alias("f"), F.sum("host_docs").alias("n")).first()
    m = total["f"] / total["n"] if total["n"] else 0.0
    n = F.col("host_docs").cast("double")
    v = hosts.agg(F.avg((F.col("host_failures") / n - m) ** 2 - m * (1 - m) / n).alias("v")).first()["v"] or 0.0
    s = min(1e6, max(1.0, m * (1 - m) / v - 1)) if v > 0 else 1e6
    rate = (F.col("host_failures") + F.lit(s * m)) / (n + F.lit(s))
    return hosts.withColumn("failure_rate", rate).withColumn("host_kept", F.col("failure_rate") <= max_failure)


def quality_rules(docs: DataFrame, host: str = "source", max_failure: float = MAX_HOST_FAILURE, scratch: Scratch | None = None) -> DataFrame:
    """Measures, rule failures and verdicts, one row for each row of ``docs`` (doc_id, text and the host column; others are ignored).

    A null text has no words and fails; null hosts form a host of their own; repeated rows and null ids each count.
    An empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    measured = measure(docs, host).withColumn("base_failed", fails_base(F.col("n_words"), F.col("n_repeat_words")))
    failed = F.col("base_failed") | F.col("fails_symbols") | F.col("fails_dup_lines")
    measured = scratch.save(measured.withColumn("failed", failed), "measured")
    hosts = host_verdicts(measured, max_failure).select(F.col("host").alias("_host"), "failure_rate", "host_kept")
    out = measured.join(hosts, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))


def keep_good(docs: DataFrame, host: str = "source", max_failure: float = MAX_HOST_FAILURE, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` that pass: all its columns, documents of rejected hosts and documents that fail the base rules left out.

    A null text has no words and fails; null hosts form a host of their own; repeated rows and null ids are judged each; columns of any name stay. An empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    measured = measure(docs, host).withColumn("base_failed", fails_base(F.col("n_words"), F.col("n_repeat_words")))
    failed = F.col("base_failed") | F.col("fails_symbols") | F.col("fails_dup_lines")
    hosts = scratch.save(host_verdicts(scratch.save(measured.select("host", failed.alias("failed")), "measured"), max_failure), "hosts")
    name = "_bad_host"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    bad = hosts.filter(~F.col("host_kept")).select(F.col("host").alias(name))
    n = bad.count()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = docs.filter(~let(word_array(text), lambda w: fails_base(F.size(w), repeat_words(w))))
    if n:
        bad = F.broadcast(bad) if n <= BROADCAST_HOSTS else bad
        kept = kept.join(bad, F.col(host).cast("string").eqNullSafe(F.col(name)), "left_anti")
    return kept


#: The same rows in SQL, for the check of results.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls
  FROM d
), m AS (
  SELECT rid, doc_id, host, ws, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines
  FROM w
), g AS (
  SELECT rid, i, array_to_string(ws[i : i + 4], ' ') AS gram FROM (SELECT rid, ws, unnest(range(1, n_words - 3)) AS i FROM m WHERE n_words >= 5)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1
), cover AS (
  SELECT rid, sum(least(5, i - coalesce(prev, -5)))::BIGINT AS n_repeat_words
  FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS prev FROM twice) GROUP BY rid
), b AS (
  SELECT m.*, coalesce(c.n_repeat_words, 0) AS n_repeat_words,
         n_words < 10 OR 100 * coalesce(c.n_repeat_words, 0) > 20 * n_words AS base_failed
  FROM m LEFT JOIN cover c USING (rid)
), f AS (
  SELECT *, base_failed OR 10 * n_symbols > word_chars OR 10 * n_dup_lines > 3 * n_lines AS failed FROM b
), h AS (
  SELECT host, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS x FROM f GROUP BY host
), t AS (
  SELECT sum(x) / sum(n) AS m FROM h
), v AS (
  SELECT m, avg((x / n - m) ** 2 - m * (1 - m) / n) AS v FROM h, t GROUP BY m
), s AS (
  SELECT m, CASE WHEN v > 0 THEN least(1e6, greatest(1.0, m * (1 - m) / v - 1)) ELSE 1e6 END AS s FROM v
), k AS (
  SELECT host, (x + s * m) / (n + s) <= 0.5 AS host_kept FROM h, s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept
FROM f JOIN k ON f.host IS NOT DISTINCT FROM k.host
"""
