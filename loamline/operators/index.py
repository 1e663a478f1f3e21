"""The incremental retrieval index: changed documents are replaced whole, vectors of known contents are used again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from ..sources.table import VersionedTable

SOURCE_TYPES = ("wiki", "ticket", "chat", "email", "pdf", "docx")
INDEX = "chunk_id STRING, doc_id STRING, content STRING, content_hash STRING, allowed_groups ARRAY<STRING>, source_type STRING, embedding ARRAY<FLOAT>, model STRING"


def skip_reason(groups: Column, source_type: Column, n_chunks: Column | None = None) -> Column:
    """Why a document is not indexed, null if it is: nobody may read it, its type is unknown, or (if ``n_chunks`` is given) it has no chunks."""
    reason = F.when(F.coalesce(F.size(groups), F.lit(0)) == 0, "no_groups").when(~F.coalesce(source_type.isin(*SOURCE_TYPES), F.lit(False)), "unsupported_type")
    return reason if n_chunks is None else reason.when(F.coalesce(n_chunks, F.lit(0)) == 0, "no_chunks")


def documents(chunks: DataFrame) -> DataFrame:
    """Chunks grouped to documents: attributes of the first chunk and the hash of all chunk hashes in order."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "content_hash")))
    first = lambda c: F.min_by(c, "ordinal").alias(c)
    out = chunks.groupBy("doc_id").agg(ordered.alias("_o"), first("title"), first("source_type"), first("allowed_groups"))
    hashes = F.array_join(F.transform("_o", lambda x: x["content_hash"]), "\n")
    out = out.select("doc_id", F.coalesce("title", "doc_id").alias("title"), "source_type", "allowed_groups", F.size("_o").alias("n_chunks"), F.sha2(hashes, 256).alias("content_hash"))
    return out.withColumn("skip_reason", skip_reason(F.col("allowed_groups"), F.col("source_type"), F.col("n_chunks")))


def update(gold: VersionedTable, index: VersionedTable, marks: VersionedTable, embed: Callable[[DataFrame], DataFrame], model: str) -> dict:
    """Brings ``index`` to the latest version of ``gold``; ``embed`` gives (content_hash, embedding) for (content_hash, content) rows.

    Mode is noop, incremental, or full when the change history is gone. The mark moves last, so an ended run is done again.
    """
    seen = {r["name"]: r["version"] for r in marks.read().collect()}.get("index", 0)
    now = gold.version()
    if now == seen:
        return {"mode": "noop"}
    changed = gold.changes(seen, now) if seen else None
    # Contents travel twice at most, both times by chunk_id: to those that lack a vector, and to the rows. All else goes by keys and hashes.
    chunks = gold.read(now)
    units = (chunks if changed is None else changed).select("doc_id").distinct()
    scratch = Scratch(gold.spark, "index")
    if changed is not None:
        chunks = scratch.save(chunks.join(units, "doc_id", "left_semi"), "chunks")
    state = scratch.save(documents(chunks).select("doc_id", "skip_reason"), "documents")
    keys = chunks.select("chunk_id", "doc_id", "content_hash").join(state.filter("skip_reason is null"), "doc_id", "left_semi")
    keys = scratch.save(keys.select("chunk_id", "content_hash"), "keys")
    known = index.read().filter(F.col("model") == model).select("content_hash", "embedding").dropDuplicates(["content_hash"])
    needed = keys.groupBy("content_hash").agg(F.min("chunk_id").alias("chunk_id"))
    reused = scratch.save(known.join(needed, "content_hash", "left_semi"), "reused")
    lacking = scratch.save(needed.join(reused, "content_hash", "left_anti"), "lacking")
    new = scratch.save(embed(lacking.join(chunks.select("chunk_id", "content"), "chunk_id").select("content_hash", "content")), "new")
    vectors = keys.join(reused.unionByName(new), "content_hash").select("chunk_id", "embedding")
    rows = chunks.select("chunk_id", "doc_id", "content", "content_hash", "allowed_groups", "source_type").join(vectors, "chunk_id").withColumn("model", F.lit(model))
    counts = {"computed": lacking.count(), "reused": reused.count(), "skipped": state.filter("skip_reason is not null").count()}
    out = index.replace_where(rows, "chunk_id", "doc_id", units)
    if changed is None:
        index.keep_only(gold.read(now).select("chunk_id"), "chunk_id")
    marks.merge(gold.spark.createDataFrame([("index", now)], "name string, version bigint"), "name", F.col("t.version") < F.col("s.version"))
    return {"mode": "full" if changed is None else "incremental", **counts, **out}
