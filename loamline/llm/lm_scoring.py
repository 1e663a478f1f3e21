"""Cross-entropy difference of two matched n-gram language models (Moore and Lewis, 2010).

Target and background are bigram models over one vocabulary, the pieces of a public tokenizer, with the same absolute
discounting and the same smoothed unigrams below. The target is trained on the documents labelled good, the background
on all documents. A document's score is the mean over its tokens of target loss minus background loss: low is like the target.

A document is scored by models of all other documents: its own counts are taken out, or rare wording would look
likely to a model only because the document itself is in it.

Counts are exact and grow with the corpus, so they are never gathered in one place. Documents are tokenized once and dealt to chunks of
bounded size. A chunk counts its distinct bigrams once; counts are summed by bigram over chunks and sent back only to the
chunks that hold the bigram (one that occurs once in the corpus needs no answer). A bigram that is in every chunk has one row a chunk, summed before
the shuffle and joined to its one sum. What every task needs is one number a vocabulary entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..scratch import Scratch
from .textkit import released
from .tokenization import word_ids

#: Tokens after which a chunk is closed; tokens of whole documents that are worked on at once.
CHUNK_TOKENS, SLICE_TOKENS = 4_000_000, 400_000
DISCOUNT, ADD = 0.75, 0.5
#: Ids are below 2**16; BEGIN stands before each document's first token.
ID_BITS = 16
U = np.uint64


def _tokens(vocab: str):
    """(doc_id, text) -> (chunk, doc_id, ids), ids as 16-bit words."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(vocab)
        chunk, size = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            chunks, ids = [], []
            for t in b.column(1).to_pylist():
                x = np.frombuffer(words(t), "<u4").astype("<u2")
                chunks.append(chunk)
                ids.append(x.tobytes())
                size += len(x)
                if size >= CHUNK_TOKENS:
                    chunk, size = chunk + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), b.column(0), pa.array(ids, pa.binary())], names=["chunk", "doc_id", "ids"])

    return run


def _slices(col: pa.ChunkedArray, begin: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each slice of documents: (context << 16 | token) of all tokens, and the documents' numbers of tokens."""
    held, size = [], 0

    def out() -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(x) for x in held])
        flat = np.concatenate(held).astype(np.uint32)
        before = np.empty_like(flat)
        before[1:] = flat[:-1]
        before[(np.cumsum(n) - n)[n > 0]] = begin
        return (before << np.uint32(ID_BITS)) | flat, n

    for x in col:
        held.append(np.frombuffer(x.as_buffer(), "<u2"))
        size += len(held[-1])
        if size >= SLICE_TOKENS:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _tally(begin: int):
    """(chunk, doc_id, ids) with (part, id) of the target -> (chunk, key, n, n_target) of the chunk's distinct bigrams."""

    @released
    def run(docs: pa.Table, target: pa.Table) -> pa.Table:
        good = set(target.column("id").to_pylist())
        own = np.array([x in good for x in docs.column("doc_id").to_pylist()], bool)
        every, n, m, at = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64), 0
        for key, count in _slices(docs.column("ids"), begin):
            flag = np.repeat(own[at : at + len(count)], count)
            at += len(count)
            some, inverse = np.unique(key, return_inverse=True)
            # Added up slice by slice, so that a chunk holds its distinct bigrams only.
            parts = np.bincount(inverse, minlength=len(some)), np.bincount(inverse, weights=flag, minlength=len(some)).astype(np.int64)
            both, where = np.unique(np.concatenate((every, some)), return_inverse=True)
            n, m = (np.bincount(where, weights=np.concatenate((old, new)), minlength=len(both)).astype(np.int64) for old, new in zip((n, m), parts, strict=True))
            every = both
        chunk = docs.column("chunk")[0].as_py() if docs.num_rows else 0
        return pa.table({"chunk": pa.array(np.full(len(every), chunk, np.int64)), "key": pa.array(every.astype(np.int64)), "n": pa.array(n), "n_target": pa.array(m)})

    return run


class _Models:
    """What both models need for each vocabulary entry: unigram count, context count and number of continuations."""

    def __init__(self, size: int, contexts: list, tokens: list):
        self.uni, self.total, self.kinds = (np.zeros((2, size)) for _ in range(3))
        for r in contexts:
            self.total[:, r["id"]] = r["n"], r["m"]
            self.kinds[:, r["id"]] = r["kinds"], r["target_kinds"]
        for r in tokens:
            self.uni[:, r["id"]] = r["n"], r["m"]
        self.all = self.uni.sum(axis=1)

    def losses(self, doc: np.ndarray, key: np.ndarray, c: np.ndarray, n: np.ndarray, taken: np.ndarray) -> np.ndarray:
        """Bits under (background, target) of the distinct bigrams ``key`` of documents ``doc``, in this order, which occur ``c`` times there and ``n`` (2, k)
        times in all; ``taken`` (2, documents) says which models lose the document's own counts."""
        h, w = key >> ID_BITS, key & ((1 << ID_BITS) - 1)
        first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        own_total = np.add.reduceat(c, first)[group]
        words, which = np.unique((doc << ID_BITS) | w, return_inverse=True)
        own_uni = np.bincount(which, weights=c, minlength=len(words))[which]
        size = np.bincount(doc, weights=c)[doc]
        out = np.empty((2, len(key)))
        for i in range(2):
            t = taken[i][doc]
            mine = c * t
            uni = (self.uni[i, w] - own_uni * t + ADD) / (self.all[i] - size * t + ADD * self.uni.shape[1])
            total = self.total[i, h] - own_total * t
            kinds = self.kinds[i, h] - np.add.reduceat(((n[i] == mine) & t).astype(np.float64), first)[group]
            p = np.where(total > 0, np.maximum(n[i] - mine - DISCOUNT, 0) / np.maximum(total, 1) + DISCOUNT * kinds / np.maximum(total, 1) * uni, uni)
            out[i] = -np.log2(p)
        return out


def _score(begin: int, models, leave_out: bool):
    """(chunk, doc_id, ids) with (part, key, n, n_target) and, for the chunk's ids of the target, (part, id) -> (doc_id, n_tokens, ce_background, ce_target, score)."""

    @released
    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        m = models.value
        named = pc.is_valid(counts.column("id"))
        target, counts = set(counts.column("id").filter(named).to_pylist()), counts.filter(pc.invert(named))
        key = counts.column("key").to_numpy()
        order = np.argsort(key)
        key = key[order]
        n = np.stack([counts.column(c).to_numpy()[order] for c in ("n", "n_target")])
        good = np.array([x in target for x in docs.column("doc_id").to_pylist()], bool)
        sums, at = [], 0
        for flat, count in _slices(docs.column("ids"), begin):
            owner = np.repeat(np.arange(len(count), dtype=U), count)
            uniq, c = np.unique((owner << U(2 * ID_BITS)) | flat.astype(U), return_counts=True)
            doc, own = (uniq >> U(2 * ID_BITS)).astype(np.int64), (uniq & U(2**32 - 1)).astype(np.int64)
            all_n = np.stack((np.ones(len(own)), np.zeros(len(own))))  # what wasn't sent occurs once, and not in the target
            if len(key):
                place = np.minimum(np.searchsorted(key, own), len(key) - 1)
                all_n = np.where(key[place] == own, n[:, place], all_n)
            mine = good[at : at + len(count)]
            at += len(count)
            taken = np.stack((np.full(len(count), leave_out), mine & leave_out))
            if len(own):
                bits = m.losses(doc, own, c, all_n, taken) * c
                sums.append(np.stack([np.bincount(doc, weights=x, minlength=len(count)) for x in bits] + [count.astype(np.float64)]))
            else:
                sums.append(np.zeros((3, len(count))))
        total = np.concatenate(sums, axis=1) if sums else np.zeros((3, 0))
        some = total[2] > 0
        ce = total[:2] / np.maximum(total[2], 1)
        cols = [pa.array(x, pa.float64(), mask=~some) for x in (ce[0], ce[1], ce[1] - ce[0])]
        return pa.table([docs.column("doc_id"), pa.array(total[2].astype(np.int64)), *cols], names=["doc_id", "n_tokens", "ce_background", "ce_target", "score"])

    return run


def ce_difference(
    docs: DataFrame, target: DataFrame, vocab: str = "word_bpe_49k.json", begin: int = 49406, leave_out: bool = True, scratch: Scratch | None = None
) -> DataFrame:
    """(doc_id, n_tokens, ce_background, ce_target, score), in bits a token, for each row of ``docs`` (doc_id, text; others are ignored).

    ``target`` has the doc_ids of the target domain; repeats, nulls and ids without a document do no harm. With ``leave_out`` the models
    that score a row don't hold its own counts (other rows with its text or id stay). A text without tokens, as a null one, has null losses. Rows that repeat an id
    are documents of their own; a null id is never in the target. With an empty target, its model is uniform. Empty tables give no rows.
    A vocabulary of more than 2**16 entries is refused.
    """
    if max(begin + 1, Tokenizer.from_file(public_tokenizers.path(vocab)).get_vocab_size()) > 1 << ID_BITS:
        raise ValueError(f"{vocab} has more than {1 << ID_BITS} entries")
    scratch = scratch or Scratch(docs.sparkSession, "lm")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = scratch.save(src.mapInArrow(_tokens(vocab), "chunk long, doc_id long, ids binary"), "tokens")
    ids = target.select(F.col("doc_id").cast("long").alias("id")).filter("id is not null").distinct()
    members = tokens.select(F.col("chunk").alias("part"), F.col("doc_id").alias("id")).distinct().join(ids, "id", "left_semi")
    members = scratch.save(members.select("part", "id"), "members")
    counted = tokens.groupBy("chunk").cogroup(members.groupBy("part")).applyInArrow(_tally(begin), "chunk long, key long, n long, n_target long")
    counted = scratch.save(counted.select("chunk", "key", F.col("n").cast("int"), F.col("n_target").cast("int")), "counts")
    summed = scratch.save(counted.groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_target").alias("m")), "sums")

    contexts = summed.groupBy(F.shiftright("key", ID_BITS).alias("id")).agg(
        F.sum("n").alias("n"), F.sum("m").alias("m"), F.count("*").alias("kinds"), F.count_if(F.col("m") > 0).alias("target_kinds")
    )
    seen = summed.groupBy(F.col("key").bitwiseAND(F.lit((1 << ID_BITS) - 1)).alias("id")).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    models = _Models(1 << ID_BITS, contexts.collect(), seen.collect())  # rows of the vocabulary, at most 2**ID_BITS
    shared = docs.sparkSession.sparkContext.broadcast(models)
    back = counted.select(F.col("chunk").alias("part"), "key").join(summed.filter("n > 1 or m > 0"), "key")
    back = back.select("part", "key", "n", F.col("m").alias("n_target"), F.lit(None).cast("long").alias("id"))
    back = back.unionByName(members, allowMissingColumns=True)
    schema = "doc_id long, n_tokens long, ce_background double, ce_target double, score double"
    return tokens.groupBy("chunk").cogroup(back.groupBy("part")).applyInArrow(_score(begin, shared, leave_out), schema)
