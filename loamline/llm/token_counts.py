"""Token counts without token ids.

Each text is split into pre-tokens that the tokenizer never merges across. A task packs, for every chunk of documents,
the documents' pre-token frequencies under numbers of the chunk's own, and the chunk's distinct pre-tokens once, dealt by hash to
buckets. A bucket's task counts each distinct pre-token once, whatever number of chunks has it, and gives every chunk its counts; a
chunk's counts are joined to its documents' frequencies, which are multiplied and summed. What is shuffled are compressed distinct pre-tokens
and frequencies of chunks, never texts, and no ids are made. A common pre-token has one entry a chunk.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .textkit import released
from .tokenization import PieceCounts

#: A chunk is closed at so many distinct pre-tokens or entries of document frequencies; so many of the latter are packed in one row.
CHUNK_PRE, CHUNK_ENTRIES, ROW_ENTRIES = 300_000, 4_000_000, 250_000
#: Documents for each bucket of pre-tokens.
BUCKET_DOCS = 8000
_ROWS = pa.schema(
    [("chunk", pa.int64()), ("bucket", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("sizes", pa.binary()),
     ("ids", pa.binary()), ("freq", pa.binary()), ("lengths", pa.binary()), ("words", pa.binary())]
)


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers below 2**32, their bytes of one weight side by side, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(4, -1).T.tobytes(), "<u4").astype(np.int64)


def _frequencies(model: str, buckets: int):
    """(doc_id, text, n_bytes) -> rows of documents (chunk, doc_id, n_bytes, sizes, ids, freq) and of the chunks' pre-tokens (chunk, bucket, ids, lengths, words)."""

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, _ROWS)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceCounts(model)
        chunk = TaskContext.get().partitionId() << 32
        number: dict[str, int] = defaultdict(count().__next__)
        docs: list[int | None] = []
        n_bytes: list[int] = []
        sizes, ids, freq = (array("I") for _ in range(3))
        entries = 0

        def documents() -> dict:
            row = {"chunk": chunk, "doc_id": docs, "n_bytes": n_bytes, **{k: _pack(np.frombuffer(x, np.uint32)) for k, x in (("sizes", sizes), ("ids", ids), ("freq", freq))}}
            return row

        def pre_tokens() -> Iterator[dict]:
            words = [w.encode() for w in number]
            own = np.fromiter((crc32(w) for w in words), np.int64, len(words)) % buckets
            order = np.argsort(own, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                some = [words[i] for i in part.tolist()]
                yield {
                    "chunk": chunk, "bucket": int(own[part[0]]), "ids": _pack(np.diff(part, prepend=0)),
                    "lengths": _pack(np.fromiter(map(len, some), np.int64, len(some))), "words": zstandard.compress(b"".join(some), 3),
                }

        for b in batches:
            for doc, t, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                own = Counter(pieces.pre_tokens(t))
                docs.append(doc)
                n_bytes.append(size)
                sizes.append(len(own))
                ids.extend(map(number.__getitem__, own))
                freq.extend(own.values())
                full = len(number) >= CHUNK_PRE or entries + len(ids) >= CHUNK_ENTRIES
                if full or len(ids) >= ROW_ENTRIES or len(docs) >= ROW_ENTRIES:
                    entries += len(ids)
                    yield batch([documents()])
                    docs, n_bytes = [], []
                    sizes, ids, freq = (array("I") for _ in range(3))
                if full:
                    yield batch(list(pre_tokens()))
                    number, entries, chunk = defaultdict(count().__next__), 0, chunk + 1
        if docs:
            yield batch([documents()])
        if number:
            yield batch(list(pre_tokens()))

    return run


def _counted(model: str):
    """A bucket's (chunk, ids, lengths, words) -> (chunk, ids, counts), with the number of pieces of each distinct pre-token taken once."""

    @released
    def run(t: pa.Table) -> pa.Table:
        pieces = PieceCounts(model)
        known: dict[bytes, int] = {}
        out = []
        for lengths, words in zip(t.column("lengths"), t.column("words"), strict=True):
            ends = np.cumsum(_unpack(lengths.as_py()))
            body = zstandard.decompress(words.as_py())
            some = [body[lo:hi] for lo, hi in pairwise([0, *ends.tolist()])]
            for w in some:
                if w not in known:
                    known[w] = pieces.count(w.decode())
            out.append(_pack(np.fromiter(map(known.__getitem__, some), np.int64, len(some))))
        return pa.table({"chunk": t.column("chunk"), "ids": t.column("ids"), "counts": pa.array(out, pa.binary())})

    return run


@released
def _sums(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """A chunk's packed documents and its pre-tokens' counts -> (doc_id, n_bytes, n_tokens)."""
    found = [(np.cumsum(_unpack(i.as_py())), _unpack(c.as_py())) for i, c in zip(counts.column("ids"), counts.column("counts"), strict=True)]
    n = np.zeros(1 + max((int(i[-1]) for i, _ in found), default=0), np.int64)
    for i, c in found:
        n[i] = c
    total = []
    for row in range(docs.num_rows):
        sizes, ids, freq = (_unpack(docs.column(k)[row].as_py()) for k in ("sizes", "ids", "freq"))
        run = np.concatenate(([0], np.cumsum(n[ids] * freq)))
        end = np.cumsum(sizes)
        total.append(run[end] - run[end - sizes])
    flat = {k: docs.column(k).combine_chunks().flatten() for k in ("doc_id", "n_bytes")}
    return pa.table({**flat, "n_tokens": pa.array(np.concatenate(total) if total else [], pa.int64())})


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs`` (doc_id, text; other columns are ignored).

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids each give a row. Empty tables give none. A pre-token may be as long as
    its text.
    """
    scratch = scratch or Scratch(docs.sparkSession, "tokens")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    buckets = max(1, -(-docs.count() // BUCKET_DOCS))
    schema = "chunk long, bucket long, doc_id array<long>, n_bytes array<long>, sizes binary, ids binary, freq binary, lengths binary, words binary"
    rows = scratch.save(src.mapInArrow(_frequencies(model, buckets), schema), "frequencies")
    words = rows.filter("bucket is not null").select("bucket", "chunk", "ids", "lengths", "words")
    counts = words.groupBy("bucket").applyInArrow(_counted(model), "chunk long, ids binary, counts binary").withColumnRenamed("chunk", "part")
    packed = rows.filter("bucket is null").select("chunk", "doc_id", "n_bytes", "sizes", "ids", "freq")
    out = packed.groupBy("chunk").cogroup(counts.groupBy("part")).applyInArrow(_sums, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
