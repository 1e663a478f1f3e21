"""Language identification by bit-sliced Bloom filters over character n-grams.

Every learned language has a Bloom filter of the n-grams that are common in it. The filters are bit-sliced: row r of the
table holds bit r of all filters in 64-bit words, so the AND of an n-gram's rows is the mask of all languages that (may) contain
it. A text's n-grams are looked up at once; per-language popcounts, corrected for the filters' false positives, decide.

The filters are fitted on a bounded sample of labelled documents (``SAMPLE_DOCS`` a language). Predictions read
whole texts and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches
from .textkit import released

U = np.uint64
#: Labelled documents that a language is learned from, at most about so many, chosen by hash.
SAMPLE_DOCS = 3000
#: An n-gram is in a language's filter if at least this share of its documents has it. So a language has at most
#: 1 / MIN_SHARE times the distinct n-grams of a mean document.
MIN_SHARE = 0.004
#: More languages are joined by a shuffle.
BROADCAST_LANGUAGES = 20_000
ORDERS = (2, 3, 4)
HASHES = 2
FOLDS, HELD_OUT = 4, 2
#: Characters that are looked up at once.
SLICE_CHARS = 100_000
UNKNOWN = "und"

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER  # noqa: PLW0603  built once for each process
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0x9FB21C651E98DF25)
    return h ^ (h >> U(28))


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of letters and word edges, and the index of each one's text.

    Texts are lower-cased, what is no letter becomes one space, and n-grams hold a space at an end only.
    """
    letter = _letters()
    body = "".join(f" {(t or '').lower()} " for t in texts)
    code = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len((t or "").lower()) + 2 for t in texts])
    code = np.where(letter[code], code, 32)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (owner[1:] != owner[:-1])
    code, owner = code[keep].astype(U), owner[keep]
    space = code == 32
    hashes, owners = [], []
    for n in ORDERS:
        if len(code) < n:
            continue
        m = len(code) - n + 1
        h = np.full(m, n, U)
        for j in range(n):
            h = h * U(0x100000001B3) + code[j : j + m]
        good = ~(space[:m] & space[n - 1 :]) if n == 2 else np.ones(m, bool)
        for j in range(1, n - 1):
            good &= ~space[j : j + m]
        hashes.append(_mix(h[good] * U(0xD6E8FEB86659FD93)))
        owners.append(owner[:m][good])
    if not hashes:
        return np.empty(0, U), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """(indexes, parts of these texts) of ``SLICE_CHARS`` together. A longer text is cut at spaces, which no n-gram spans, and a longer word anywhere."""
    index, part, size = [], [], 0
    for i, t in enumerate(texts):
        t, at = t or "", 0
        while at < len(t):
            to = at + SLICE_CHARS
            if to < len(t):
                to = max(t.rfind(" ", at, to), t.rfind("\n", at, to)) + 1 or to
            piece = t if at == 0 and to >= len(t) else t[at:to]
            if part and size + len(piece) > SLICE_CHARS:
                yield index, part
                index, part, size = [], [], 0
            index.append(i)
            part.append(piece)
            size += len(piece)
            at = to
    if part:
        yield index, part


class Filters:
    """The bit-sliced table. ``languages`` are in code-point order; ``fill`` is each filter's share of set bits."""

    def __init__(self, grams_of: dict[str, np.ndarray]):
        self.languages = sorted(grams_of, key=lambda s: s.encode())
        words = max(1, -(-len(self.languages) // 64))
        most = max((len(g) for g in grams_of.values()), default=1)
        self.bits = max(12, (6 * HASHES * most - 1).bit_length())
        self.table = np.zeros((1 << self.bits, words), U)
        for i, lang in enumerate(self.languages):
            for rows in self._rows(grams_of[lang]):
                np.bitwise_or.at(self.table[:, i // 64], rows, U(1) << U(i % 64))
        self.fill = np.array([((self.table[:, i // 64] >> U(i % 64)) & U(1)).mean() for i in range(len(self.languages))])

    def _rows(self, h: np.ndarray) -> list[np.ndarray]:
        step = (h >> U(32)) | U(1)
        return [((h + U(k) * step) & U((1 << self.bits) - 1)).astype(np.int64) for k in range(HASHES)]

    def masks(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram the languages that contain it, as 64-bit words."""
        rows = self._rows(h)
        out = self.table[rows[0]]
        for r in rows[1:]:
            out &= self.table[r]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text: the winner's share of n-grams, corrected for false positives; ties go to the first language."""
        false = self.fill**HASHES
        n_lang = max(1, len(self.languages))
        total, got = np.zeros(len(texts)), np.zeros((len(texts), n_lang))
        for index, part in _pieces(texts):
            h, owner = grams(part)
            owner = np.asarray(index)[owner]
            lo, n = index[0], index[-1] - index[0] + 1
            masks = self.masks(h)
            total[lo : lo + n] += np.bincount(owner - lo, minlength=n)
            for i in range(len(self.languages)):
                hit = ((masks[:, i // 64] >> U(i % 64)) & U(1)).astype(bool)
                got[lo : lo + n, i] += np.bincount(owner[hit] - lo, minlength=n)
        if self.languages:
            got = np.clip((got - total[:, None] * false) / (1 - false), 0, None)
        best = got.argmax(axis=1)
        lang, score = [], []
        for k in range(len(texts)):
            known = total[k] > 0 and self.languages
            lang.append(self.languages[best[k]] if known else UNKNOWN)
            score.append(float(min(1.0, got[k, best[k]] / total[k])) if known else 0.0)
        return lang, score


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; false for a null id (which isn't learned from either)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


@released
def _document_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, gram, number of documents with it) for each task."""
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            g, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    for b in batches:
        for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            parts = [np.unique(grams(part)[0]) for _, part in _pieces([t])]
            g = np.unique(np.concatenate(parts)) if parts else np.empty(0, U)
            held.setdefault(lang, []).append(g)
            size += len(g)
            if size > 4_000_000:
                yield from out()
                held, size = {}, 0
    yield from out()


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Filters:
    """Learns from ``docs`` (doc_id, text, lang) that aren't held out and have a text and a language.

    The sample is about ``sample_docs`` documents a language by hash of id; what comes to the driver is the common n-grams of each language, bounded by ``MIN_SHARE``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter("doc_id is not null and text is not null and lang is not null").filter(~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").agg(F.count("*").alias("docs"))
    share = counts.select("lang", (F.lit(float(sample_docs)) / F.col("docs")).alias("_share"))
    uniform = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_003)) / F.lit(1_000_003)
    # A row a language: up to a bound it is sent to all tasks, so that no text is shuffled.
    share = F.broadcast(share) if share.count() <= BROADCAST_LANGUAGES else share
    picked = rows.join(share, "lang").filter(uniform < F.col("_share")).select("lang", "text")
    got = picked.mapInArrow(_document_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sampled = F.least(F.col("docs").cast("double"), F.lit(float(sample_docs)))
    got = got.join(counts, "lang").filter(F.col("n") >= MIN_SHARE * sampled)
    got = got.select("lang", "gram").toPandas()
    return Filters({lang: g.gram.to_numpy(np.int64).view(U) for lang, g in got.groupby("lang")})


def identify(docs: DataFrame, filters: Filters | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs`` (doc_id, text, lang; others are ignored), with ``filters`` learned from it if none are given.

    A null text or one without letters is ``und`` with score 0, as is every text if nothing was learned. Repeated rows each count once
    for learning, as documents of their own. Empty tables give no rows.
    """
    bound_batches(docs.sparkSession)
    filters = filters or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # bounded by the sample, see MIN_SHARE

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    doc = F.col("doc_id").cast("long").alias("doc_id")
    src = docs.select(doc, F.col("text").cast("string").alias("text"), held_out(F.col("doc_id").cast("long")).alias("held_out"))
    return src.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, min_score: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with at least ``min_score``.

    Only texts go to Python and a flag comes back; null texts, empty ones and those without letters go. Repeated rows, null ids and
    columns of any name stay as they are.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    @F.arrow_udf("boolean")
    def known(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            lang, score = shared.value.predict(t.to_pylist())
            yield pa.array([x != UNKNOWN and s >= min_score for x, s in zip(lang, score, strict=True)], pa.bool_())

    return docs.filter(known(F.col("text").cast("string")))
