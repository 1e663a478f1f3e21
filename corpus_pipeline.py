"""The corpus pipeline: language ID, quality rules, near-duplicates, source mixing and packing over ``documents``.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of documents. Texts of any length are taken whole, columns of any other name stay as they are, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamline.llm import jaccard_join, language_filters, mixing, packing, quality_rules
from loamline.scratch import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts among them) and those whose n-grams no language's filter knows. Repeated rows and rows without an id are judged each."""
    return language_filters.keep_known(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules (a null text has no words and fails) and all documents of rejected hosts. Documents without a source are a host; repeated rows count each."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links of 0.8 Jaccard over 5-word shingles connect: the one with the least id, null last, of these the one with the least hash
    of its text, of equal rows any one. Texts without words link with nothing and all stay."""
    return jaccard_join.keep_one(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and thins documents so that sources come near their target weights. Texts without words are never taken; documents without a source are one source, the last; equal
    rows each have their own place. A document that is taken several times gives a row each time."""
    return mixing.mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the mix in sequences of 2048 tokens; one row a piece. A null text is an empty one; rows that repeat an id or have none are packed each."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("source_mixing", mix), ("best_fit_packing", pack)]

#: Stages that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``, with a written table between two."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        old, docs = docs, scratch.save(stage(spark, docs, sf_dir), name)
        if hasattr(old, "_loamline_path"):
            scratch.drop(old)
    return STAGES[-1][1](spark, docs, sf_dir)
