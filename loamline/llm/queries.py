"""The registered queries of the training-data operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_graph, hard_negatives, html_crf, jaccard_join, language_filters, license_scan, lm_scoring, mixing, packing, periodic_runs, private_spans, quality_rules, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm_scoring.ce_difference(_table(spark, sf_dir, "documents"), good)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_graph.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(_table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_filters.identify(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.ngram_components(_table(spark, sf_dir, "documents"), k=4, percent=85)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan_licenses(_table(spark, sf_dir, "documents"))
    return out.withColumns({"n_missing": F.size("missing"), "n_extra": F.size("extra")}).drop("missing", "extra")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("base_failed"), "kept")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(periodic_runs.planted(_table(spark, sf_dir, "documents")))
    best = periodic_runs.longest(F.col("runs"))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), periodic_runs.listed(F.col("runs")).alias("runs"), "collapsed")
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long")
    return found.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), F.sha2("runs", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hard_negatives.hard_negatives(hard_negatives.quantized(_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)
    return found.withColumns({c: F.col(c).cast("long") for c in ("positive_score", "negative_score")})


def op13_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_spans.private_spans(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    number = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(number, private_spans.KINDS), F.sha2(private_spans.listed(base), 256).alias("base_sha256"), private_spans.listed(F.col("spans")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op10_quality_rules": quality_rules.ORACLE_SQL, "op12_hard_negatives": hard_negatives.ORACLE_SQL}
