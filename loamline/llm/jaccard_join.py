"""N-gram Jaccard self-join: a size-aware heavy-light join over distinct word shingles.

After Deng, Tao and Li, "Overlap set similarity joins with theoretical guarantees" (SIGMOD 2018).
Sets of up to ``boundary`` shingles are *light*: two of sizes s and t are similar exactly if they share a
subset of the least overlap c(s, t), so each light set emits its c-subsets for every partner size and
equal keys are links. Larger sets are *heavy*: they meet in inverted lists. A set of size s lists only
the s - c + 1 shingles that come first in one global order, since two similar sets share one of
these; light sets that a heavy one can match are listed too. The boundary is the largest size whose
subsets cost no more than its lists.

The order puts shingles of often-used cells of a count sketch last, so that a passage that many
documents share is rarely listed. The sketch only sets the order; any order gives the same links.

Equal sets are one node from the start. A list is first joined in two linear passes, of each set with its list's first and
the two before it, in order of size and in a random order; what these verified links connect needs no further
pairs, and a last pass takes all pairs between different components. So a group of n near copies costs about n pairs, not n
squared, and no component is missed. Candidate pairs pass a parity bitmap test (an upper bound, so nothing is lost), and the rest are
decided by exact intersections of the hashed sets.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .components import components
from .textkit import digest, mix, released, shingle_sets, slices

#: Cells of the count sketch that orders shingles (4 MB as 32-bit counts).
SKETCH_BITS = 20
#: Cost of one listed shingle in emitted subset keys: it is dealt out, sorted and paired.
LIST_COST = 8
U = np.uint64


def min_overlap(s: int, t: int, percent: int) -> int:
    """Least common size of sets of sizes s and t with 100 * common >= percent * union."""
    return -(-percent * (s + t) // (100 + percent))


def prefix_length(s: int, percent: int) -> int:
    """How many first shingles of a set of size s any similar set must share one of."""
    return s - -(-percent * s // 100) + 1 if s else 0


def light_boundary(percent: int) -> int:
    """Largest size for which subset enumeration costs no more than listing."""
    best, s = 1, 2
    while s <= 40:
        partners = range(-(-percent * s // 100), 100 * s // percent + 1)
        subsets = sum(math.comb(s, c) for t in partners if (c := min_overlap(s, t, percent)) <= s)
        if subsets > LIST_COST * prefix_length(s, percent):
            break
        best, s = s, s + 1
    return best


def _node(n: int, d1: int, d2: int) -> int:
    m = mix(np.array([(n * 0x9E3779B97F4A7C15 + d1 * 3 + d2 * 7) % 2**64], U))
    return int(m.view(np.int64)[0])


def _scan(k: int):
    """(doc_id, text, hash) -> a row (doc_id, hash, n, node) each, and at the end the task's sketch in blocks of cells."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in batches:
            texts, n, node = b.column(1).to_pylist(), [], []
            for _, part in slices(texts):
                sets = shingle_sets(part, k)
                n += [len(s) for s in sets]
                node += [_node(len(s), *digest(s)) for s in sets]
                if sets:
                    cells = (np.concatenate(sets) >> U(64 - SKETCH_BITS)).astype(np.int64)
                    counts += np.bincount(cells, minlength=len(counts)).astype(np.uint32)
            nul = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(node, pa.int64()), *nul], names=["doc_id", "hash", "n", "node", "block", "cells"])
        if counts.any():
            parts = counts.reshape(16, -1)
            nul = [pa.nulls(16, pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*nul, pa.array(range(16), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["doc_id", "hash", "n", "node", "block", "cells"])

    return run


@released
def _add_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    acc: dict[int, np.ndarray] = {}
    for b in batches:
        for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a = np.frombuffer(v, np.uint32).astype(np.uint64)
            acc[k] = acc[k] + a if k in acc else a
    for k, a in acc.items():
        # Quarter powers of two: the order needs no more, and the whole sketch then has one byte a cell.
        level = np.minimum(255, np.log2(a.astype(np.float64) + 1) * 4).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["block", "level"])


def _signature(s: np.ndarray) -> bytes:
    """Parity of the set's members in each of 2**j cells, 2**j the least power of two >= its size (at least 64)."""
    bits = 1 << max(6, (len(s) - 1).bit_length())
    par = np.bincount((s % U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(par.astype(np.uint8), bitorder="little").tobytes()


def _lists(k: int, percent: int, boundary: int, level):
    """Texts -> kind 0: (node, n, signature); kind 1: (token, node, n); kind 2: (subset key, node, n, the smaller size of the pairs it is for). Once for each node and task."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lev = np.frombuffer(level.value, np.uint8)
        seen: set[int] = set()
        listed = -(-percent * (boundary + 1) // 100)  # smaller sets match no heavy one
        for b in batches:
            for _, part in slices(b.column(1).to_pylist()):
                kinds, toks, nodes, sizes, least, sigs = [], [], [], [], [], []

                def add(kind, tok, node, n, low=0, kinds=kinds, toks=toks, nodes=nodes, sizes=sizes, least=least):
                    least.append(np.full(len(tok), low, np.int64))
                    kinds.append(np.full(len(tok), kind, np.int8))
                    toks.append(tok.view(np.int64))
                    nodes.append(np.full(len(tok), node, np.int64))
                    sizes.append(np.full(len(tok), n, np.int64))

                for s in shingle_sets(part, k):
                    n = len(s)
                    if not n:
                        continue
                    node = _node(n, *digest(s))
                    if node in seen:
                        continue
                    if len(seen) > 400_000:
                        seen.clear()
                    seen.add(node)
                    add(0, np.zeros(1, U), node, n)
                    sigs.append(_signature(s))
                    if n <= boundary:
                        for t in range(-(-percent * n // 100), 100 * n // percent + 1):
                            c = min_overlap(n, t, percent)
                            if t <= boundary and c <= n and not (t == n and c == n):
                                tag = U(((min(n, t) << 20) + max(n, t)) * 0x9E3779B97F4A7C15 % 2**64)
                                subs = np.array(list(itertools.combinations(mix(s + U(1)).tolist(), c)), U)
                                add(2, mix(subs.sum(axis=1, dtype=U) ^ tag), node, n, min(n, t))
                    if n >= listed:
                        p = prefix_length(n, percent)
                        rank = lev[(s >> U(64 - SKETCH_BITS)).astype(np.int64)]
                        add(1, s[np.argsort(rank, kind="stable")[:p]], node, n)
                if kinds:
                    kind = np.concatenate(kinds)
                    sig = np.full(len(kind), None, object)
                    sig[kind == 0] = sigs
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(kind), pa.array(np.concatenate(toks)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(least)), pa.array(sig, pa.binary())],
                        names=["kind", "token", "node", "n", "least", "sig"],
                    )

    return run


def _pairs_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    if len(lo) > 1:
        o = np.lexsort((hi, lo))
        lo, hi = lo[o], hi[o]
        keep = np.concatenate(([True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
        lo, hi = lo[keep], hi[keep]
    return pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], names=["a", "b"])


#: A set is paired with so many sets before it in its list.
CHAIN = 2


def _stars(percent: int):
    """Rows (token, n, node, comp) in order of token -> pairs of each set with the first of its list and the ``CHAIN`` before it, if in reach of size and of other components."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if not len(cols[0]):
                continue
            if last is not None:
                cols = [np.concatenate(x) for x in zip(last, cols, strict=True)]
            tok, n, node, comp = cols
            i = np.arange(len(tok))
            start = np.maximum.accumulate(np.where(np.concatenate(([True], tok[1:] != tok[:-1])), i, 0))
            left, right = [], []
            for other in (start, *(i - k for k in range(1, CHAIN + 1))):
                at = np.maximum(other, 0)
                lo, hi = np.minimum(n, n[at]), np.maximum(n, n[at])
                good = (other >= start) & (at != i) & (comp[at] != comp) & (100 * lo >= percent * hi)
                left.append(node[good])
                right.append(node[at[good]])
            yield _pairs_batch(np.concatenate(left), np.concatenate(right))
            # The open list's first and last sets go on into the next batch.
            carry = sorted({int(start[-1]), *(k for k in range(len(tok) - CHAIN, len(tok)) if k >= start[-1])})
            last = [x[carry] for x in cols]

    return run


@released
def _subset_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, n, node, least) sorted so -> links of each set with its key's first, if that has the smaller size the key is for.

    A key for sizes s <= t holds c(s, t) >= c(s, s) common shingles, so it links s with s and s with t, but not yet t with t.
    """
    last = None
    for b in batches:
        key, n, node, least = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if not len(key):
            continue
        if last is not None:
            key, n, node, least = (np.concatenate(x) for x in zip(last, (key, n, node, least), strict=True))
        first = np.concatenate(([True], key[1:] != key[:-1]))
        start = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        good = ~first & (n[start] == least[start])
        yield _pairs_batch(node[good], node[start[good]])
        last = [x[start[-1] : start[-1] + 1] for x in (key, n, node, least)]


_POP = np.array([bin(i).count("1") for i in range(256)], np.uint16)

#: Sets of one list that are compared with each other in one go.
LIST_BLOCK = 250
#: Bytes of the folded parity bitmap that list rows carry in the second pass.
FOLD = 256
#: Smallest tokens of a set's lists that they carry too.
LOW = 8


def _narrow(sig: bytes, width: int) -> bytes:
    """A parity bitmap of ``width`` bytes, or as it is if not wider."""
    x = np.frombuffer(sig, np.uint8)
    while len(x) > width:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


@released
def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_narrow(s, FOLD) for s in b.column(1).to_pylist()], pa.binary())], names=["node", "fold"])


def _cross(percent: int):
    """Rows (token, part, n, node, comp, block, fold, low) sorted so -> all pairs of a list's part in reach of size, of different components, whose bitmaps
    allow enough overlap. A part of two blocks gives the pairs between them, a part of one block its own.

    ``low`` has the smallest tokens of the set's lists. A pair for which these hold a smaller common one comes out of that list, so it is left out here.
    """

    def pairs(token: np.ndarray, n: np.ndarray, node: np.ndarray, comp: np.ndarray, block: np.ndarray, fold: list[bytes], low: np.ndarray) -> Iterator[pa.RecordBatch]:
        if (comp == comp[0]).all():
            return
        reach = np.searchsorted(n, 100 * n // percent, side="right")
        width = np.array([len(x) for x in fold])
        bits = {w: np.stack([np.frombuffer(_narrow(x, w), np.uint8) if len(x) >= w else np.zeros(w, np.uint8) for x in fold]) for w in set(width.tolist())}
        several = (block != block[0]).any()
        a, b, size = [], [], 0
        for i in range(len(n) - 1):
            j = np.arange(i + 1, reach[i])
            j = j[comp[j] != comp[i]]
            if several:
                j = j[block[j] != block[i]]
            for lo in range(0, len(j), 20_000):
                # Sets of a list are sorted by size, so the first's bitmap is no wider than the others'.
                k, w = j[lo : lo + 20_000], int(width[i])
                apart = _POP[bits[w][k] ^ bits[w][i]].sum(axis=1)
                total = n[i] + n[k]
                k = k[apart <= total - 2 * (-(-percent * total // (100 + percent)))]
                mine = low[i][low[i] < token[0]]
                if len(k) and len(mine):
                    k = k[~(low[k][:, :, None] == mine[None, None, :]).any(axis=(1, 2))]
                if len(k):
                    a.append(np.full(len(k), node[i], np.int64))
                    b.append(node[k])
                    size += len(k)
            if size > 200_000:
                yield _pairs_batch(np.concatenate(a), np.concatenate(b))
                a, b, size = [], [], 0
        if size:
            yield _pairs_batch(np.concatenate(a), np.concatenate(b))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        folds: list[bytes] = []

        def lists(allc: np.ndarray, own: list[bytes]) -> Iterator[pa.RecordBatch]:
            allc, low = allc[:6], allc[6:].T
            edges = np.concatenate(([0], np.flatnonzero((allc[:2, 1:] != allc[:2, :-1]).any(axis=0)) + 1, [allc.shape[1]]))
            for x, y in itertools.pairwise(edges.tolist()):
                if y - x > 1:
                    yield from pairs(allc[0, x:y], *allc[2:, x:y], own[x:y], low[x:y])

        for b in batches:
            cols = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3, 4, 5, *range(7, 7 + LOW))])
            if not cols.shape[1]:
                continue
            held.append(cols)
            folds += b.column(6).to_pylist()
            if (cols[:2, -1] != held[0][:2, 0]).any():
                allc = np.concatenate(held, axis=1)
                cut = int(np.flatnonzero((allc[:2, 1:] != allc[:2, :-1]).any(axis=0))[-1]) + 1
                yield from lists(allc[:, :cut], folds[:cut])
                held, folds = [allc[:, cut:]], folds[cut:]
        if held:
            yield from lists(np.concatenate(held, axis=1), folds)

    return run


def _plausible(percent: int):
    """(a, b, na, siga, nb, sigb) -> pairs whose parity bitmaps allow enough overlap."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            a, b, na, sa, nb, sb = (t.column(i).to_pylist() for i in range(6))
            keep = []
            for i in range(len(a)):
                width = min(len(sa[i]), len(sb[i]))
                x, y = (np.frombuffer(_narrow(z, width), np.uint8) for z in (sa[i], sb[i]))
                most = na[i] + nb[i] - 2 * min_overlap(na[i], nb[i], percent)
                keep.append(int(_POP[x ^ y].sum()) <= most)
            m = np.array(keep, bool)
            yield pa.RecordBatch.from_arrays([t.column(0).filter(pa.array(m)), t.column(1).filter(pa.array(m))], names=["a", "b"])

    return run


def _sets(k: int):
    """(node, text) -> (node, its set); rows whose text is not the node's, as a repeated doc_id brings them, go."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = b.column(0).to_pylist()
            for first, part in slices(b.column(1).to_pylist()):
                own = [(x, s.tobytes()) for x, s in zip(nodes[first:], shingle_sets(part, k)) if _node(len(s), *digest(s)) == x]  # noqa: B905
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in own], pa.int64()), pa.array([s for _, s in own], pa.binary())], names=["node", "items"])

    return run


def _decide(percent: int):
    """(a, b, seta, setb) -> the pairs that are similar, by exact intersection."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for x, y in zip(t.column(2), t.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            m = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column(0).filter(m), t.column(1).filter(m)], names=["a", "b"])

    return run


def _linked(docs: DataFrame, k: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((doc_id, hash, n, node) for each row of ``docs``; (node, comp) for the nodes that have links). Equal sets are one node; comp is the smallest node."""
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    ref = F.coalesce("doc_id", "hash")  # what a row is fetched by
    boundary = light_boundary(percent)

    scan = scratch.save(src.mapInArrow(_scan(k), "doc_id long, hash long, n long, node long, block int, cells binary"), "scan")
    digests = scan.filter("block is null").select("doc_id", "hash", "n", "node")
    levels = scan.filter("block is not null").select("block", "cells").repartition(16, "block").mapInArrow(_add_cells, "block int, level binary")
    whole = {r["block"]: bytes(r["level"]) for r in levels.collect()}  # at most 2**SKETCH_BITS bytes
    level = spark.sparkContext.broadcast(b"".join(whole.get(i, bytes(1 << SKETCH_BITS >> 4)) for i in range(16)))

    raw = scratch.save(src.mapInArrow(_lists(k, percent, boundary, level), "kind byte, token long, node long, n long, least long, sig binary"), "lists")
    nodes = raw.filter("kind = 0").groupBy("node").agg(F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = scratch.save(nodes, "nodes")
    # Lists of one set pair nothing, and most shingles are in one set only.
    lists = raw.filter("kind = 1").select("token", "n", "node").repartition("token").distinct()
    by_token = "count(1) over (partition by token)"
    lists = scratch.save(lists.withColumn("_c", F.expr(by_token)).filter("_c > 1").drop("_c"), "shared")
    subsets = raw.filter("kind = 2").select("token", "n", "node", "least").repartition("token").distinct()
    light = subsets.sortWithinPartitions("token", "n", "node").mapInArrow(_subset_stars, "a long, b long").distinct()

    def verified(pairs: DataFrame, screened: bool = False) -> DataFrame:
        likely = pairs
        if not screened:
            na, nb = (nodes.select(F.col("node").alias(x), F.col("n").alias("n" + x), F.col("sig").alias("s" + x)) for x in "ab")
            likely = pairs.join(na, "a").join(nb, "b").select("a", "b", "na", "sa", "nb", "sb")
            likely = scratch.save(likely.mapInArrow(_plausible(percent), "a long, b long"), "likely")
        needed = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
        holders = digests.groupBy("node").agg(F.min(ref).alias("ref")).join(needed, "node", "left_semi")
        texts = src.join(holders, ref == F.col("ref")).select("node", "text")
        sets = scratch.save(texts.mapInArrow(_sets(k), "node long, items binary"), "sets")
        sa, sb = (sets.select(F.col("node").alias(x), F.col("items").alias("i" + x)) for x in "ab")
        return scratch.save(likely.join(sa, "a").join(sb, "b").select("a", "b", "ia", "ib").mapInArrow(_decide(percent), "a long, b long"), "links")

    def in_lists(rows: DataFrame, order: str) -> DataFrame:
        return rows.repartition("token").withColumn("_o", F.expr(order)).sortWithinPartitions("token", "_o", "node").drop("_o")

    def between(comp: DataFrame) -> DataFrame:
        """Rows of the lists that still hold several components."""
        rows = lists.join(comp, "node", "left").select("token", "n", "node", F.coalesce("comp", "node").alias("comp"))
        several = "min(comp) over (partition by token) <> max(comp) over (partition by token)"
        return rows.withColumn("_m", F.expr(several)).filter("_m").drop("_m")

    # Linear passes: neighbours by size, then neighbours in a random order. What they link needs no more pairs.
    tried = scratch.save(in_lists(lists.withColumn("comp", F.col("node")), "n").mapInArrow(_stars(percent), "a long, b long").distinct(), "stars")
    links = scratch.save(verified(tried).unionByName(light), "links")
    comp = scratch.save(components(links, scratch), "comp")
    more = in_lists(between(comp), "xxhash64(node)").mapInArrow(_stars(percent), "a long, b long").distinct()
    more = scratch.save(more.join(tried, ["a", "b"], "left_anti"), "stars")
    if not more.isEmpty():
        links = scratch.save(links.unionByName(verified(more)), "links")
        comp = scratch.save(components(links, scratch), "comp")
    # All pairs that are left.
    folds = nodes.select("node", "sig").mapInArrow(_folded, "node long, fold binary")
    mixed = scratch.save(between(comp), "mixed")
    low = mixed.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("token")), 1, LOW).alias("_low"))
    lows = [F.coalesce(F.get("_low", F.lit(i)), F.lit(2**63 - 1)).alias(f"low{i}") for i in range(LOW)]
    # A long list is compared in parts of one or two blocks of about LIST_BLOCK sets, so that no task holds it all.
    long = scratch.save(mixed.groupBy("token").agg(F.ceil(F.count("*") / F.lit(LIST_BLOCK)).alias("blocks")).filter("blocks > 1"), "long")
    rows = mixed.join(long, "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumn("part", F.least("block", "other") * F.lit(2**31) + F.greatest("block", "other"))
    rows = rows.join(folds, "node").join(low, "node").select("token", "part", "n", "node", "comp", "block", "fold", *lows)
    cross = rows.repartition("token", "part").sortWithinPartitions("token", "part", "n", "node").mapInArrow(_cross(percent), "a long, b long").distinct()
    cross = scratch.save(cross.join(tried.unionByName(more), ["a", "b"], "left_anti"), "cross")
    if not cross.isEmpty():
        links = links.unionByName(verified(cross, screened=True))
        comp = scratch.save(components(links, scratch), "comp")

    return digests, comp


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of ``docs`` (doc_id, text; other columns are ignored).

    Two documents link when 100 * common >= percent * union of their distinct ``k``-word shingles.
    A null or wordless text has n_shingles 0 and links with nothing. Rows that repeat a doc_id each count
    with their own text; a null doc_id takes part, but names no component unless all of its members are null
    (then component_id is null). Empty tables give no rows.
    """
    digests, comp = _linked(docs, k, percent, scratch or Scratch(docs.sparkSession, "jaccard"))
    named = digests.groupBy("node").agg(F.min("doc_id").alias("least")).join(comp, "node", "left")
    named = named.withColumn("comp", F.coalesce("comp", "node"))
    label = named.groupBy("comp").agg(F.min("least").alias("label"))
    named = named.join(label, "comp").select("node", "label")
    return digests.join(named, "node").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("label")).alias("component_id")
    )


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """One row, with all columns, of each component of ``docs``: the one with the smallest doc_id, null last, and of these the one with the smallest hash of its text.

    Of rows with that id and text, which one stays is open. Rows without words all stay. Columns may have any name.
    """
    digests, comp = _linked(docs, k, percent, scratch or Scratch(docs.sparkSession, "jaccard"))
    rows = digests.filter("n > 0").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rows = rows.groupBy("comp", "doc_id", "hash").agg(F.count("*").alias("times"))  # a text has one node, so a key has one component
    order = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "hash")
    first = rows.groupBy("comp").agg(F.min(order).alias("first"))
    rows = rows.join(first, "comp").withColumn("stays", order == F.col("first"))
    # Few rows need anything: those that go, and those of which one of several stays.
    rows = rows.filter("not stays or times > 1").select(F.col("doc_id").alias("_i"), F.col("hash").alias("_h"), "stays")
    whole = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_doc"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_hash"))
    whole = whole.join(rows, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")), "left").filter("stays is null or stays")
    lone = whole.filter("stays is null").select("_doc.*")
    return lone.unionByName(whole.filter("stays").groupBy("_i", "_h").agg(F.first("_doc").alias("_doc")).select("_doc.*"))
