"""Periodic runs of words within a document, found by repeated k-gram masking and Main and Lorentz's divide and conquer.

A run is a stretch of words with a smallest period q that is at least ``MIN_LENGTH`` and 2 q words long and that no neighbouring word
extends keeping the period. Its words and those q places on are two copies that overlap or touch, each at least half as long as the run, so
every word of a run is in a k-gram that the document repeats, with k half of the least length. Words outside of repeated k-grams
are masked; what is left falls into segments, in which the test is made again with the k-grams that the segment itself repeats, until
nothing changes. Only these segments are searched (Main and Lorentz, "An O(n log n) algorithm for finding all
repetitions in a string", 1984): a segment is halved, and the runs over its middle come from the longest common extensions of the middle with
the places q before and behind it, for all q at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches
from .textkit import mix, released

U = np.uint64
MIN_LENGTH = 12
_ODD = np.random.default_rng(11_111).integers(1, 2**62, 64, dtype=np.uint64) * U(2) + U(1)


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers, different words different ones."""
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def _repeated(ids: np.ndarray, segment: np.ndarray, k: int) -> np.ndarray:
    """Which words are in a k-gram that occurs twice in its segment. A hash may take more words in, never fewer."""
    m = len(ids) - k + 1
    out = np.zeros(len(ids) + 1, np.int64)
    if m < 2:
        return out[:-1] > 0
    w, h = mix(ids.astype(U) + U(1)), mix(segment[:m].astype(U) * _ODD[63])
    for j in range(k):
        h += w[j : j + m] * _ODD[j]
    at = np.flatnonzero(segment[:m] == segment[k - 1 :])
    h = mix(h[at])
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = at[twice]
    out[at] += 1
    out[at + k] -= 1
    return out[:-1].cumsum() > 0


def segments(ids: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int]]:
    """(start, end) of the stretches of words that may hold runs."""
    k = -(-min_length // 2)
    at, segment, parts = np.arange(len(ids)), np.zeros(len(ids), np.int64), 1
    while len(at) >= min_length:
        keep = _repeated(ids[at], segment, k)
        new, old = at[keep], segment[keep]
        first = np.ones(len(new), bool)
        first[1:] = (np.diff(new) > 1) | (np.diff(old) != 0)
        segment = first.cumsum() - 1
        long = np.bincount(segment, minlength=1)[segment] >= min_length
        new, segment = new[long], segment[long]
        now = len(np.unique(segment))
        if len(new) == len(at) and now == parts:
            break
        at, parts = new, now
    else:
        return []
    edge = np.flatnonzero(np.diff(segment)) + 1
    return list(zip(at[np.append(0, edge)].tolist(), (at[np.append(edge, len(at)) - 1] + 1).tolist(), strict=True))


def _extensions(s: list[int]) -> list[int]:
    """For each place the length of the longest stretch from there that ``s`` begins with (0 for place 0)."""
    n, left, right = len(s), 0, 0
    z = [0] * n
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _over_middle(x: list[int], lo: int, mid: int, hi: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of repetitions of ``least`` words or more in x[lo:hi] that hold words on both sides of ``mid``.

    Such a one has a whole period to the right of the middle, or else to the left of it. A longer period's repetition is one of a shorter period if that divides it.
    """
    u, v = x[lo:mid], x[mid:hi]
    nu, nv = len(u), len(v)
    ahead, back = _extensions([*v, -1, *u]), _extensions([*u[::-1], -1, *v[::-1]])
    for q in range(1, nv + 1):
        behind = back[nu + 1 + nv - q]
        if behind:
            if behind == q < nu:
                behind += back[q]
            front = ahead[q] if q < nv else 0
            if front + behind >= q and front + behind + q >= least:
                yield mid - behind, mid + q + front, q
    for q in range(1, nu + 1):
        front = ahead[nv + 1 + nu - q]
        if 0 < front < q:  # with more, there is a whole period to the right
            behind = back[q] if q < nu else 0
            if front + behind >= q and front + behind + q >= least:
                yield mid - q - behind, mid + front, q


def runs_in(x: list[int], min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``x``, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    todo = [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < min_length:
            continue
        mid = (lo + hi) // 2
        for s, e, q in _over_middle(x, lo, mid, hi, min_length):
            if s and s == lo and x[s - 1] == x[s - 1 + q] or e == hi < len(x) and x[e] == x[e - q]:
                continue  # it goes on outside, and is found whole where it lies inside
            found[s, e] = min(q, found.get((s, e), q))
        todo += [(lo, mid), (mid, hi)]
    return sorted((s, e - s, q) for (s, e), q in found.items())


def find_runs(words: list[bytes], min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a document's words, by start, then period."""
    if len(words) < min_length:
        return []
    ids = word_numbers(words)
    found = [(a + s, n, q) for a, b in segments(ids, min_length) for s, n, q in runs_in(ids[a:b].tolist(), min_length)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those that a run has after its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        change[s + q] += 1
        change[s + n] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(change[:-1].cumsum() == 0).tolist()])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of ``docs`` (doc_id, text; others are ignored); no shuffle.

    ``runs`` has (start, length, period) by start, then period; ``collapsed`` the kept words joined by one space. A null text or one without words has
    no runs and an empty ``collapsed``. Repeated rows and null ids give rows of their own; an empty table gives none.
    A text of n words takes time in n log n and memory in n.
    """
    bound_batches(docs.sparkSession)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, runs, left = [], [], []
            for t in b.column(1).cast(pa.binary()):
                words = t.as_py().split() if t.is_valid else []
                found = find_runs(words, min_length)
                n.append(len(words))
                runs.append([{"start": s, "length": k, "period": q} for s, k, q in found])
                left.append(collapse(words, found))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(left, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def longest(runs: Column) -> Column:
    """The longest run (of those the first, of those the one of the shortest period) as a struct; null if there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(F.size(runs) > 0, F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def listed(runs: Column) -> Column:
    """A line ``start,length,period`` a run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of ``docs``, where a fixed tenth of the documents, by checksum of the id, repeats a stretch of its words from some word on to its end.

    With h the CRC-32 of the id's digits, g = h // 10 and n words, documents with h % 10 = 0 get runs: word i from a = g % n on becomes word a + (i - a) % p, with
    p = 1 + (n - a) // (3 + g % 8). Texts without words and those of null ids stay.
    """
    doc = F.col("doc_id").cast("long")
    h = F.crc32(doc.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.slice(w, a + 1, p)
        copies = F.ceil((n - a) / p).cast("int")
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(F.flatten(F.array_repeat(tail, copies)), F.lit(1), n - a)), " ")

    text = F.col("text").cast("string")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    changed = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w))), F.lit(0))
    return docs.select(doc.alias("doc_id"), F.when(h % 10 == 0, F.coalesce(changed, text)).otherwise(text).alias("text"))
