"""A stored inverted index with block maxima, for many queries at once and under access filters.

Documents are numbered inside of chunks of about ``CHUNK_DOCS``. A lexeme has one block a chunk: its documents' numbers, their positions, and the most positions that a
document has. Blocks are stored by buckets of lexemes, sorted, so a query reads the buckets of its own words; the most positions alone bound what a chunk's documents can score.
A query first scores the chunks of its highest bounds, which gives a kth score, and then only those whose bound reaches it. Each task gives the k best of a chunk, so
what is shuffled doesn't grow with the number of matches.

Who may read what is a bitmap of a chunk's documents for each group. New documents are a segment of chunks of their own, and removed ones are left out by bitmaps, too, so a
change feed is followed without writing old blocks again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import Scratch
from .fulltext import chunk_postings, parse_query, score

#: Documents of a chunk on average; buckets of lexemes; chunks that a query scores before it has a kth score.
CHUNK_DOCS, BUCKETS, FIRST = 2048, 64, 2
#: Bytes of a chunk's texts on average: what a task that makes its blocks holds at once.
CHUNK_BYTES = 16 * 2**20
BLOCKS = "lexeme string, segment int, chunk int, most int, docs array<int>, positions array<array<int>>, bucket int"
_SCORED = "query_id long, segment int, chunk int, doc int, lexical_score double"


def bound(query: list[list[tuple[bool, list[str]]]], most: dict[str, int]) -> float:
    """What no document scores more than, if it has each lexeme at most so often. Covers differ in their first word, and a cover gives 0.1 at most."""
    best = 0.0
    for alternative in query:
        terms = {w for negated, phrase in alternative if not negated for w in phrase}
        if all(w in most for w in terms):
            best = max(best, 0.1 * (sum(most[w] for w in terms) - len(terms) + 1))
    return best


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, query) -> (query_id, lexeme) of all words of a query."""
    for b in batches:
        rows = [(i, w) for i, q in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in sorted({w for a in parse_query(q or "") for _, p in a for w in p})]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([w for _, w in rows], pa.string())], names=["query_id", "lexeme"])


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, segment, chunk, query, most) -> (query_id, segment, chunk, bound)."""
    for b in batches:
        found = [bound(parse_query(q), {x["lexeme"]: x["most"] for x in m}) for q, m in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.float64())], names=["query_id", "segment", "chunk", "bound"])


def _bits(size: int, some: list[bytes]) -> np.ndarray:
    out = np.zeros(size, bool)
    for x in some:
        got = np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")[:size]
        out[: len(got)] |= got.astype(bool)
    return out


def _score_chunks(k: int):
    """(query_id, segment, chunk, query, seen, gone, blocks) -> the k best documents of the chunk for the query that it may see."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                parsed, where = parse_query(r["query"]), {}
                size = 1 + max(d for x in r["blocks"] for d in x["docs"])
                seen = _bits(size, [x for x in r["seen"] or [] if x is not None])
                if r["gone"] is not None:
                    seen &= ~_bits(size, [r["gone"]])
                for x in r["blocks"]:
                    for d, at in zip(x["docs"], x["positions"], strict=True):
                        if seen[d]:
                            where.setdefault(d, {})[x["lexeme"]] = at
                got = [(s, d) for d, w in where.items() if (s := score(w, parsed)) is not None]
                got.sort(key=lambda x: -x[0])
                least = got[k - 1][0] if len(got) > k else -1.0  # equal scores stay, ids decide later
                out += [(r["query_id"], r["segment"], r["chunk"], d, s) for s, d in got if s >= least]
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["query_id", "segment", "chunk", "doc", "lexical_score"])

    return run


def _chunk_blocks(segment: int):
    """A chunk's documents (chunk, id, text) -> its blocks, by lexeme. Documents are numbered by id."""

    def run(t: pa.Table) -> pa.Table:
        ids, chunk = t.column("id").to_pylist(), t.column("chunk")[0].as_py()
        text = t.column("text")
        words, docs, starts, positions, sizes = chunk_postings(text[i].as_py() for i in sorted(range(len(ids)), key=ids.__getitem__))
        first = np.concatenate((starts, [len(docs)]))
        places = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), pa.array(positions, pa.int32()))
        cols = {
            "lexeme": pa.array(words, pa.string()), "segment": pa.array(np.full(len(words), segment), pa.int32()), "chunk": pa.array(np.full(len(words), chunk), pa.int32()),
            "most": pa.array(np.maximum.reduceat(sizes, starts) if len(starts) else [], pa.int32()),
            "docs": pa.ListArray.from_arrays(first.astype(np.int32), pa.array(docs, pa.int32())), "positions": pa.ListArray.from_arrays(first.astype(np.int32), places),
        }
        return pa.table(cols)

    return run


@F.pandas_udf(T.BinaryType())
def _bitmap(docs):
    """A bitmap of each list of document numbers."""

    def one(x) -> bytes:
        bits = np.zeros(1 + max(x), np.uint8)
        bits[np.asarray(x, np.int64)] = 1
        return np.packbits(bits, bitorder="little").tobytes()

    return docs.map(one)


class PostingsIndex:
    """The index below ``path``: ``blocks`` by bucket, ``docs`` (chunk, number, id), ``readers`` (chunk, group, bitmap) and ``gone`` (chunk, number)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def docs(self) -> DataFrame:
        return self._read("docs", "segment int, chunk int, doc int, id string")

    def blocks(self) -> DataFrame:
        return self._read("blocks", BLOCKS)

    @classmethod
    def build(cls, docs: DataFrame, path: str, chunk_docs: int = CHUNK_DOCS) -> PostingsIndex:
        """Indexes ``docs`` (id, text, groups); ids are distinct. A null text has no words; without groups nobody finds it; null ids are left out."""
        out = cls(docs.sparkSession, path)
        out._gone(docs.sparkSession.createDataFrame([], "segment int, chunk int, doc int"))
        out.append(docs, 0, chunk_docs)
        return out

    def append(self, docs: DataFrame, segment: int, chunk_docs: int = CHUNK_DOCS) -> None:
        """Adds ``docs`` as a segment, a number that none has yet."""
        scratch = Scratch(self.spark, "postings")
        src = docs.select(F.col("id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), F.col("groups").cast("array<string>").alias("groups")).filter("id is not null")
        size = src.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
        chunks = max(1, -(-size["n"] // chunk_docs), -(-(size["bytes"] or 0) // CHUNK_BYTES))
        src = src.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))
        own = src.select("id", "groups", "chunk")
        number = F.row_number().over(Window.partitionBy("chunk").orderBy("id")) - 1  # a chunk has about ``chunk_docs`` rows
        own = scratch.save(own.select(F.lit(segment).alias("segment"), "chunk", number.cast("int").alias("doc"), "id", "groups"), "docs")
        own.select("segment", "chunk", "doc", "id").repartition("chunk").write.mode("append").parquet(f"{self.path}/docs")
        readers = own.select("segment", "chunk", "doc", F.explode("groups").alias("group")).groupBy("segment", "chunk", "group").agg(F.collect_list("doc").alias("d"))
        readers.select("segment", "chunk", "group", _bitmap("d").alias("seen")).write.mode("append").parquet(f"{self.path}/readers")
        blocks = src.select("chunk", "id", "text").groupBy("chunk").applyInArrow(_chunk_blocks(segment), "lexeme string, segment int, chunk int, most int, docs array<int>, positions array<array<int>>").withColumn("bucket", _bucket())
        blocks.repartition("bucket").sortWithinPartitions("bucket", "lexeme", "chunk").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/blocks")

    def _gone(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/gone")

    def remove(self, ids: DataFrame) -> None:
        """Leaves out the documents of ``ids`` (id) that there are now; a later segment may have them again."""
        self._gone(self.docs().join(ids.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi").select("segment", "chunk", "doc"))

    def follow(self, changes: DataFrame, segment: int, key: str, text: str, groups: str) -> None:
        """Applies change rows of a versioned table: what was updated or deleted goes, and what was inserted or updated comes as a segment of the feed's version."""
        old = changes.filter(F.col("_change_type").isin("update_preimage", "delete")).select(F.col(key).alias("id"))
        new = changes.filter(F.col("_change_type").isin("update_postimage", "insert")).select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(groups).alias("groups"))
        self.remove(old)
        self.append(new, segment)

    def search(self, queries: DataFrame, k: int, first: int = FIRST) -> DataFrame:
        """(query_id, id, lexical_score, rank): the ``k`` best visible matches for each of ``queries`` (query_id, query, groups), ties by id.

        Equal to scoring every document. Query ids are distinct; null queries, those without words and callers without groups find nothing. What several ask with the same groups is searched once.
        """
        scratch = Scratch(self.spark, "postings-search")
        q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("string").alias("query"), F.array_sort(F.array_compact(F.array_distinct("groups"))).alias("groups"))
        q = scratch.save(q.filter("query_id is not null and query is not null and size(groups) > 0"), "queries")
        first_of = scratch.save(q.groupBy("query", "groups").agg(F.min("query_id").alias("query_id")), "distinct")
        best = scratch.save(self._search(first_of, k, first, scratch), "best")
        same = q.join(first_of.select("query", "groups", F.col("query_id").alias("_first")), ["query", "groups"]).select(F.col("query_id").alias("_asked"), F.col("_first").alias("query_id"))
        return same.join(best, "query_id").select(F.col("_asked").alias("query_id"), "id", "lexical_score", "rank")

    def _search(self, q: DataFrame, k: int, first: int, scratch: Scratch) -> DataFrame:
        """``search`` of written queries that differ in words or groups."""
        terms = scratch.save(q.select("query_id", "query").mapInArrow(_terms, "query_id long, lexeme string").withColumn("bucket", _bucket()), "terms")
        buckets = [r["bucket"] for r in terms.select("bucket").distinct().collect()]  # at most BUCKETS
        blocks = self.blocks().filter(F.col("bucket").isin(buckets))
        words = [r["lexeme"] for r in terms.select("lexeme").distinct().limit(201).collect()]
        if len(words) <= 200:  # few enough for the scan to skip row groups by their lexemes
            blocks = blocks.filter(F.col("lexeme").isin(words))
        at = ["query_id", "segment", "chunk"]
        most = terms.join(blocks.select("lexeme", "segment", "chunk", "most", "bucket"), ["bucket", "lexeme"])
        most = most.groupBy(*at).agg(F.collect_list(F.struct("lexeme", "most")).alias("most")).join(q.select("query_id", "query"), "query_id")
        readers = self._read("readers", "segment int, chunk int, group string, seen binary")
        mine = q.select("query_id", F.explode(F.array_distinct("groups")).alias("group")).join(readers, "group").groupBy(*at).agg(F.collect_list("seen").alias("seen"))
        chunks = most.select(*at, "query", "most").mapInArrow(_bounds, "query_id long, segment int, chunk int, bound double").filter("bound > 0").join(mine, at)
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "chunk")
        chunks = scratch.save(chunks.withColumn("place", F.row_number().over(order)), "chunks")
        gone = self._read("gone", "segment int, chunk int, doc int").distinct().groupBy("segment", "chunk").agg(F.collect_list("doc").alias("d")).select("segment", "chunk", _bitmap("d").alias("gone"))

        def scored(some: DataFrame) -> DataFrame:
            wanted = some.select(*at).join(terms, "query_id")
            got = wanted.join(blocks, ["bucket", "lexeme", "segment", "chunk"]).groupBy(*at).agg(F.collect_list(F.struct("lexeme", "docs", "positions")).alias("blocks"))  # a query's words
            rows = some.select(*at, "seen").join(got, at).join(gone, ["segment", "chunk"], "left").join(q.select("query_id", "query"), "query_id")
            return scratch.save(rows.select(*at, "query", "seen", "gone", "blocks").mapInArrow(_score_chunks(k), _SCORED), "scored")

        found = scored(chunks.filter(F.col("place") <= first))
        kth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lexical_score")))
        floors = found.withColumn("_r", kth).filter(F.col("_r") == k).select("query_id", F.col("lexical_score").alias("floor"))
        rest = chunks.filter(F.col("place") > first).join(floors, "query_id", "left").filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 1e-9))
        found = found.unionByName(scored(rest))
        named = found.join(self.docs(), ["segment", "chunk", "doc"]).select("query_id", "id", "lexical_score")
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lexical_score"), "id"))
        return named.withColumn("rank", best).filter(F.col("rank") <= k)


def _bucket():
    return F.pmod(F.xxhash64("lexeme"), F.lit(BUCKETS)).cast("int")
