"""The incremental index over the given tables: documents first, then what conversations change and add."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import index
from ..scratch import Scratch
from ..sources.table import VersionedTable
from .catalog import query, table
from .groups import GROUPS_SQL, with_groups

GOLD = "chunk_id STRING, doc_id STRING, ordinal INT, title STRING, content STRING, content_hash STRING, allowed_groups ARRAY<STRING>, source_type STRING"


def _chunks(df: DataFrame) -> DataFrame:
    """Chunks of (doc_id, content, allowed_groups, source_type), one a document."""
    return df.filter("content is not null").select(
        F.concat("doc_id", F.lit(":0000")).alias("chunk_id"), "doc_id", F.lit(0).alias("ordinal"), F.col("doc_id").alias("title"), "content", F.sha2("content", 256).alias("content_hash"), "allowed_groups", "source_type"
    )


def _embed(needed: DataFrame) -> DataFrame:
    """Two numbers of a content in place of a model's vector."""
    return needed.select("content_hash", F.array(F.length("content").cast("float"), (F.crc32(F.col("content").cast("binary")) % 1000).cast("float")).alias("embedding"))


@query(f"""WITH d AS (SELECT 'd' || doc_id AS doc_id, text AS content, {GROUPS_SQL} AS groups FROM documents WHERE text IS NOT NULL),
c AS (SELECT conv_id, arg_min(text, turn) AS content FROM conversations GROUP BY 1),
n AS (SELECT coalesce(d.doc_id, 'c' || conv_id) AS doc_id, c.content, coalesce(groups, ['all-staff']) AS groups FROM c LEFT JOIN d ON d.doc_id = 'd' || conv_id WHERE c.content IS NOT NULL),
a AS (SELECT * FROM d WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n)
SELECT doc_id || ':0000' AS chunk_id, sha256(content) AS content_hash, array_to_string(list_sort(groups), ',') AS group_list, 'm1' AS model, length(content)::DOUBLE AS first_component,
(SELECT count(DISTINCT sha256(content)) FROM n WHERE len(groups) > 0 AND sha256(content) NOT IN (SELECT sha256(content) FROM d WHERE len(groups) > 0)) AS computed_by_second_run FROM a WHERE len(groups) > 0""")
def index_updates(spark, sf_dir):
    """The index after two runs: the second takes what changed from the change feed, computes vectors of new contents alone and replaces whole documents."""
    root = Scratch(spark, "index").root
    gold, rows = VersionedTable(spark, f"{root}/gold", GOLD), VersionedTable(spark, f"{root}/index", index.INDEX)
    marks = VersionedTable(spark, f"{root}/marks", "name STRING, version BIGINT")
    docs = with_groups(table(spark, sf_dir, "documents")).select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), F.col("text").alias("content"), F.array_sort("groups").alias("allowed_groups"), F.lit("wiki").alias("source_type"))
    gold.merge(_chunks(docs), "chunk_id")
    index.update(gold, rows, marks, _embed, "m1")
    said = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("said"))
    known = docs.filter("content is not null").select(F.col("doc_id").alias("_d"), "allowed_groups")
    said = said.join(known, F.col("_d") == F.concat(F.lit("d"), "conv_id"), "left")
    said = said.select(F.coalesce("_d", F.concat(F.lit("c"), "conv_id")).alias("doc_id"), F.col("said").alias("content"), F.coalesce("allowed_groups", F.array(F.lit("all-staff"))).alias("allowed_groups"), F.lit("wiki").alias("source_type"))
    gold.merge(_chunks(said), "chunk_id")
    done = index.update(gold, rows, marks, _embed, "m1")
    if done["mode"] != "incremental" or index.update(gold, rows, marks, _embed, "m1") != {"mode": "noop"}:
        raise RuntimeError("the index didn't follow the change feed")
    return rows.read().select("chunk_id", "content_hash", F.array_join("allowed_groups", ",").alias("group_list"), "model", F.get("embedding", F.lit(0)).cast("double").alias("first_component"), F.lit(done["computed"]).cast("long").alias("computed_by_second_run"))
