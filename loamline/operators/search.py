"""Hybrid retrieval as one plan: access filter, vector and word rankings, reciprocal-rank fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import document_subquery, heuristic_route
from ..functions.vectors import cosine, normalised
from ..scratch import Scratch
from . import fulltext
from .documents import rrf, top_k, visible
from .postings_index import PostingsIndex
from .vector_index import VectorIndex

#: Queries of one pass of a batch search: 4,096 vectors of 1,024 doubles are 32 MB.
QUERY_BLOCK = 4096


def hybrid(chunks: DataFrame, index: DataFrame, query: str, vector: list[float], caller: list[str], k: int = 8, candidates: int = 40, rrf_k: int = 60) -> DataFrame:
    """The best ``k`` of ``chunks`` (chunk_id, allowed_groups, embedding, ...) with score, similarity and both ranks; ties by chunk_id.

    Similarity of hits that only words found is filled in from their vectors. A caller without groups gets nothing.
    """
    seen = chunks.filter(visible(F.col("allowed_groups"), caller))
    similarity = F.coalesce(cosine(F.col("embedding"), F.array(*map(F.lit, vector))), F.lit(0.0))
    n = max(candidates, k)
    near = top_k(seen.select("chunk_id", similarity.alias("_s")), n, F.col("_s").desc(), F.col("chunk_id")).select("chunk_id", F.col("rank").alias("vector_rank"))
    ids = seen.select(F.col("chunk_id").alias("id"))
    words = fulltext.search(index, query, ids).withColumnRenamed("id", "chunk_id")
    words = top_k(words, n, F.col("lexical_score").desc(), F.col("chunk_id")).select("chunk_id", F.col("rank").alias("lexical_rank"))
    fused = rrf(near, words, "chunk_id", "vector_rank", "lexical_rank", rrf_k)
    return seen.join(F.broadcast(fused), "chunk_id").withColumn("similarity", similarity).orderBy(F.col("score").desc(), "chunk_id").limit(k)


def _nearest(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best scores, ties by id, best first."""
    if len(scores) > 4 * k:
        least = -np.partition(-scores, k - 1)[k - 1]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def _best_of_task(asked, k: int, digits: int | None):
    """(id, vector of length 1) in batches -> (query_id, id, similarity): the task's best ``k`` for each query, all that it holds at any time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = asked.value
        best = [(np.empty(0, np.int64), np.empty(0)) for _ in names]
        for b in batches:
            by_length: dict[int, list[int]] = {}
            offsets = b.column(1).offsets.to_numpy()
            for i, n in enumerate(np.diff(offsets).tolist()):
                by_length.setdefault(n, []).append(i)
            ids, flat = b.column(0).to_numpy(), b.column(1).values.to_numpy()
            for n, rows in by_length.items():
                if n not in q:
                    continue
                at, x = np.array(rows), flat[offsets[rows][:, None] + np.arange(n)]
                own, y = q[n]
                for lo in range(0, len(own), 256):
                    sim = y[lo : lo + 256] @ x.T
                    sim = sim if digits is None else np.round(sim, digits)
                    for row, who in zip(sim, own[lo : lo + 256], strict=True):
                        had, had_sim = best[who]
                        if len(had) == k:  # most rows of most batches aren't near any query
                            hit = np.flatnonzero(row >= had_sim[-1])
                            if not len(hit):
                                continue
                        else:
                            hit = np.arange(len(row))
                        new, new_sim = np.concatenate((had, ids[at[hit]])), np.concatenate((had_sim, row[hit]))
                        keep = _nearest(new, new_sim, k)
                        best[who] = new[keep], new_sim[keep]
        sizes = [len(x) for x, _ in best]
        who = pa.array(np.repeat(np.asarray(names, np.int64), sizes))
        yield pa.RecordBatch.from_arrays([who, *(pa.array(np.concatenate([x[i] for x in best]) if best else []) for i in (0, 1))], names=["query_id", "id", "similarity"])

    return run


def batch_vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK, digits: int | None = None) -> DataFrame:
    """(query_id, id, similarity, rank): the nearest ``k`` of all ``vectors`` (id, embedding) for each of ``queries`` (query_id, query), exactly; ids are long.

    A pass sends about ``block`` queries, dealt by hash, to every task of the vectors, however many queries there are; a task keeps its best ``k`` for each
    query of the pass, and only these are shuffled. Null and zero vectors aren't found and find nothing, nor do vectors of other lengths. Similarities
    are rounded to ``digits`` before they are ordered, if given; ties go to the least id.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "batch-search")
    unit = vectors.select(F.col("id").cast("long").alias("id"), normalised(F.col("embedding")).alias("_v")).filter("_v is not null and id is not null")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), normalised(F.col("query")).alias("_q")).filter("_q is not null and query_id is not null")
    asked = scratch.save(asked, "queries")
    passes = max(1, -(-asked.count() // block))
    found = []
    for n in range(passes):
        some = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == n).collect()  # about ``block`` rows
        by: dict[int, list[int]] = {}
        for i, r in enumerate(some):
            by.setdefault(len(r["_q"]), []).append(i)
        shared = spark.sparkContext.broadcast(([r["query_id"] for r in some], {n: (own, np.array([some[i]["_q"] for i in own])) for n, own in by.items()}))
        part = unit.mapInArrow(_best_of_task(shared, k, digits), "query_id long, id long, similarity double")
        found.append(part if passes == 1 else scratch.save(part, "found"))
    every = found[0] if len(found) == 1 else spark.read.schema(found[0].schema).parquet(*(d._loamline_path for d in found))
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hybrid_batch(questions: DataFrame, vectors: VectorIndex, words: PostingsIndex, k: int = 8, candidates: int = 40, rrf_k: int = 60, exact: bool = False) -> DataFrame:
    """(query_id, id, rank, score, similarity, vector_rank, lexical_rank): the best ``k`` for each of ``questions`` (query_id, query, vector, groups), all in one plan.

    Both indexes give a question's visible ``candidates``, which are fused by rank; ties go to the least id, as a string. Similarity of hits that only words
    found is filled in from their vectors. Callers without groups get nothing.
    """
    n = max(candidates, k)
    near = vectors.search(questions.select("query_id", F.col("vector").alias("query"), "groups"), n, exact=exact)
    near = near.select("query_id", F.col("id").cast("string").alias("id"), F.col("similarity").alias("_near"), F.col("rank").alias("vector_rank"))
    lexical = words.search(questions.select("query_id", "query", "groups"), n).select("query_id", "id", F.col("rank").alias("lexical_rank"))
    fused = rrf(near, lexical, ["query_id", "id"], "vector_rank", "lexical_rank", rrf_k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    fused = Scratch(questions.sparkSession, "hybrid").save(fused.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "fused")
    lone = vectors.similarities(fused.filter("_near is null").select("query_id", "id"), questions.select("query_id", F.col("vector").alias("query")))
    out = fused.join(lone, ["query_id", "id"], "left").withColumn("similarity", F.coalesce("_near", "similarity", F.lit(0.0)))
    return out.select("query_id", "id", "rank", "score", "similarity", "vector_rank", "lexical_rank")


def evaluate_retrieval(cases: DataFrame, vectors: VectorIndex, words: PostingsIndex, documents: DataFrame, embed: Callable[[DataFrame], DataFrame], k: int = 8) -> DataFrame:
    """(case_id, rank, doc_id, route) of the best chunks for each of a golden set's ``cases`` (case_id, question, groups), without a model, in one plan.

    The route is that of the wording; hybrid questions search with their document clauses alone, and questions for records don't search. ``embed`` adds ``vector`` to
    rows with ``query``; ``documents`` has (id, doc_id) of the chunks.
    """
    routed = cases.withColumns({"route": heuristic_route(F.col("question")), "query_id": F.xxhash64("case_id")})
    asked = routed.withColumn("query", F.when(F.col("route") == "hybrid", document_subquery(F.col("question"))).otherwise(F.col("question"))).filter("route <> 'sql'")
    asked = Scratch(cases.sparkSession, "evaluation").save(embed(asked.select("case_id", "query_id", "query", "groups", "route")), "asked")
    hits = hybrid_batch(asked.select("query_id", "query", "vector", "groups"), vectors, words, k)
    named = hits.join(documents.select(F.col("id").cast("string").alias("id"), "doc_id"), "id").join(asked.select("query_id", "case_id", "route"), "query_id")
    return named.select("case_id", "rank", "doc_id", "route")
