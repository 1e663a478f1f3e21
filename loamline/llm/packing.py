"""Best-fit packing of tokenized documents into fixed-length training sequences.

Documents are tokenized once, on the executors; a document longer than a sequence is cut into full pieces and a rest.
Pieces are dealt by hash to groups of bounded size, and each group is packed alone: best-fit decreasing, then a
local search over its underfull bins that exchanges one piece for one, two for one or one for two, or moves a piece, whenever that
raises the sum of squared fills, until a bin empties or the lower bound is reached. A group's least-filled bin is
then packed again together with those of many other groups.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .tokenization import word_ids
from .textkit import released

#: Pieces that one group holds on average; groups whose open bins are packed together.
GROUP_PIECES, GROUPS_TOGETHER = 40_000, 256


def best_fit(lengths: np.ndarray, cap: int) -> np.ndarray:
    """Bin of each piece by best-fit decreasing. A bit set of the free spaces in use finds the tightest bin at once."""
    out = np.empty(len(lengths), np.int64)
    spaces: list[list[int]] = [[] for _ in range(cap + 1)]
    used, n = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fit = used >> size
        if fit:
            r = size + (fit & -fit).bit_length() - 1
            b = spaces[r].pop()
            if not spaces[r]:
                used ^= 1 << r
        else:
            b, r, n = n, cap, n + 1
        out[i] = b
        if r > size:
            if not spaces[r - size]:
                used |= 1 << (r - size)
            spaces[r - size].append(b)
    return out


def _largest_usable(sizes: np.ndarray, pool: np.ndarray, y: int, least: int, gap: int, target: int, bins: np.ndarray, fill: np.ndarray) -> int:
    """Place of the largest of ``sizes`` that raises ``target`` by more than ``least`` and at most ``gap`` when it comes for ``y``, from one bin that is no
    fuller than ``target`` is then; -1 if there is none."""
    hi, step = int(np.searchsorted(sizes, y + gap, side="right")), 64
    for k in range(hi - 1, max(-1, hi - 5), -1):  # mostly one of the first few is usable
        if sizes[k] - y <= least:
            return -1
        come = np.atleast_1d(pool[k])
        source = int(bins[come[0]])
        if source != target and fill[target] + sizes[k] - y > fill[source] and (bins[come] == source).all():
            return k
    hi = max(0, hi - 4)
    lo = int(np.searchsorted(sizes, y + least, side="right"))
    while hi > lo:
        at = max(lo, hi - step)
        come = pool[at:hi]
        source = bins[come if come.ndim == 1 else come[:, 0]]
        ok = (source != target) & (fill[target] + sizes[at:hi] - y > fill[source])
        if come.ndim == 2:
            ok &= bins[come[:, 1]] == source
        found = np.flatnonzero(ok)
        if len(found):
            return at + int(found[-1])
        hi, step = at, 4 * step
    return -1


def _distinct(lengths: np.ndarray, own: list[int]) -> list[int]:
    """One piece of each length among ``own``."""
    return list({int(lengths[i]): i for i in own}.values())


def _pairs(lengths: np.ndarray, own: list[int]) -> list[tuple[int, int]]:
    """Two pieces for each sort of two lengths among ``own``. A bin of capacity c has fewer than sqrt(2 c) lengths, so these are fewer than c, however many pieces it has."""
    by: dict[int, list[int]] = {}
    for i in own:
        by.setdefault(int(lengths[i]), []).append(i)
    one = [x[0] for x in by.values()]
    return [(i, j) for x, i in enumerate(one) for j in one[x + 1 :]] + [(x[0], x[1]) for x in by.values() if len(x) > 1]


def local_search(lengths: np.ndarray, bins: np.ndarray, cap: int) -> np.ndarray:
    """Moves and exchanges pieces between underfull bins, each time raising the sum of squared fills, until bins empty.

    Bins are taken from the fullest down. Into each goes, from a bin no fuller, one piece or two of it for nothing, one
    or two of its own, so that it comes as near to full as any such step can bring it. What is free thus gathers in few bins, which
    empty. It ends at the lower bound or when no such step improves; every step raises a bounded whole number, so it does end. Pieces of
    one length in a bin are one choice, which bounds the steps that are looked at by lengths, not by pieces.
    """
    bins = bins.copy()
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    least = -(-int(lengths.sum()) // cap)
    better = True
    while better and (fill > 0).sum() > least:
        better = False
        members: dict[int, list[int]] = {int(b): [] for b in np.flatnonzero((fill > 0) & (fill < cap))}
        for i in np.flatnonzero(fill[bins] < cap).tolist():
            members[int(bins[i])].append(i)
        at = np.array([i for own in members.values() for i in _distinct(lengths, own)], np.int64)
        at = at[np.argsort(lengths[at], kind="stable")]
        pair = np.array([p for own in members.values() for p in _pairs(lengths, own)], np.int64).reshape(-1, 2)
        pair = pair[np.argsort(lengths[pair].sum(axis=1), kind="stable")]
        pools = [(lengths[at], at), (lengths[pair].sum(axis=1), pair)]
        for target in sorted(members, key=lambda b: (-fill[b], b)):
            gap = cap - int(fill[target])
            if gap == 0 or fill[target] == 0:
                continue
            own = members[target]
            leave: list[tuple[int, ...]] = [(), *((i,) for i in _distinct(lengths, own)), *_pairs(lengths, own)]
            away = np.array([sum(int(lengths[i]) for i in out) for out in leave], np.int64)
            best = None
            # What a step could gain at most if any piece or pair of the right length could come; the most promising first.
            hope = []
            for n, (sizes, _) in enumerate(pools):
                k = np.searchsorted(sizes, away + gap, side="right") - 1
                gain = np.where(k >= 0, sizes[np.maximum(k, 0)] - away, 0) if len(sizes) else np.zeros(len(away), np.int64)
                hope += [(-int(g), n, x) for x, g in enumerate(gain) if g > 0 and not (n == 1 and len(leave[x]) == 2)]
            for g, n, x in sorted(hope):
                if best and best[0] >= -g:
                    break
                sizes, pool = pools[n]
                y = int(away[x])
                k = _largest_usable(sizes, pool, y, best[0] if best else 0, gap, target, bins, fill)
                if k >= 0:
                    come = np.atleast_1d(pool[k])
                    best = (int(sizes[k]) - y, leave[x], come.tolist(), int(bins[come[0]]))
            if best:
                d, out, come, source = best
                for i in out:
                    bins[i] = source
                for i in come:
                    bins[i] = target
                members[target] = [i for i in own if i not in out] + come
                members[source] = [i for i in members[source] if i not in come] + list(out)
                fill[target] += d
                fill[source] -= d
                better = True
    return np.unique(bins, return_inverse=True)[1]


def pack(lengths: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; bins are numbered from 0 and hold pieces without gaps."""
    lengths = np.asarray(lengths, np.int64)
    if not len(lengths):
        return lengths, lengths
    bins = local_search(lengths, best_fit(lengths, cap), cap)
    order = np.argsort(bins, kind="stable")
    total = np.concatenate(([0], np.cumsum(lengths[order])))[:-1]
    first = np.concatenate(([True], np.diff(bins[order]) > 0))
    offset = np.empty(len(bins), np.int64)
    offset[order] = total - np.maximum.accumulate(np.where(first, total, 0))
    return bins, offset


def _pieces(vocab: str, cap: int, end_id: int):
    end = end_id.to_bytes(4, "little")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = word_ids(vocab), 0
        for b in batches:
            rows = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = words(t) + end
                for k, at in enumerate(range(0, len(ids), 4 * cap)):
                    part = ids[at : at + 4 * cap]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part, n))
                    n += 1
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "number"])

    return run


def _pack_group(cap: int, base: int, leave_open: bool):
    """Packs a group; ``leave_open`` marks its least-filled bin with a null sequence."""

    @released
    def run(t: pa.Table) -> pa.Table:
        lengths = t.column("length").to_numpy().astype(np.int64)
        # A fixed order of equal rows makes reruns agree.
        keys = [t.column(c).to_pandas().fillna(-1).to_numpy() for c in ("ids_crc32", "piece", "doc_id")]
        order = np.lexsort(keys)
        bins, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        bins[order], offset[order] = pack(lengths[order], cap)
        seq = base + (int(t.column("part")[0].as_py()) << 32) + bins
        fill = np.bincount(bins, weights=lengths)
        opened = bins == fill.argmin() if leave_open and fill.min() < cap else np.zeros(len(bins), bool)
        t = t.drop_columns([c for c in ("sequence_id", "offset") if c in t.column_names])
        return t.append_column("sequence_id", pa.array(seq, mask=opened)).append_column("offset", pa.array(offset, pa.int64()))

    return run


def pack_documents(
    docs: DataFrame, vocab: str = "word_bpe_49k.json", cap: int = 2048, end_id: int = 0, keep_ids: bool = False, scratch: Scratch | None = None
) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and with ``keep_ids`` the ids, 32-bit little-endian).

    ``docs`` has doc_id and text; other columns are ignored. Every document ends with ``end_id``, so a null or empty text
    is a piece of one token. Rows that repeat a doc_id and null ids are packed as documents of their own. Empty tables give no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    pieces = src.mapInArrow(_pieces(vocab, cap, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, number long")
    pieces = scratch.save(pieces.select(*names, "number"), "pieces")
    n = max(1, math.ceil(pieces.count() / GROUP_PIECES))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    # The number within its task spreads rows that are equal in all else, so that many repeats or null ids don't fill one group.
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "number"), F.lit(n)).cast("long")
    grouped = pieces.withColumn("part", part).drop("number").groupBy("part").applyInArrow(_pack_group(cap, 0, True), schema + ", part long, sequence_id long, offset long")
    grouped = scratch.save(grouped, "groups")
    again = grouped.filter("sequence_id is null").withColumn("part", F.expr(f"part div {GROUPS_TOGETHER}"))
    again = again.groupBy("part").applyInArrow(_pack_group(cap, 1 << 62, False), schema + ", part long, sequence_id long, offset long")
    return grouped.filter("sequence_id is not null").unionByName(again).select(*names, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, length, doc_ids) from rows of ``pack_documents(..., keep_ids=True)``; a group is one sequence, so it is bounded."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    out = packed.groupBy("sequence_id").agg(rows.alias("rows"), F.sum("length").alias("length"))
    ids = F.aggregate("rows", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return out.select("sequence_id", ids.alias("ids"), "length", F.transform("rows", lambda x: x["doc_id"]).alias("doc_ids"))
