"""Embedding near-duplicates by a robust-pruned flat graph.

Vectors of one label (and length) are split into overlapping shards: k-means cells, where a vector also joins the cells whose centre is
almost as near as its own. A shard's graph is made of smaller cells, of which each vector joins the two nearest: in each, the nearest
neighbours are pruned robustly (Subramanya et al., DiskANN, 2019), and a vector's adjacency lists from its cells are united. Each vector
is then searched in its own shard by a
greedy walk from the shard's medoid that keeps widening while it finds vectors in range. Cosines are verified in
double precision. Recall is audited label by label: some vectors of each label that are known to have links, and some of all its vectors, are compared with
the whole label, and their recall is averaged over those that have links, so that a large group doesn't hide what small ones lose. Labels that fall short are
searched again with shards that overlap more, and after the last step exactly.

Equal vectors are one node from the start; links come out of a search as local components and counts, not as pairs, so a
group of n near copies gives n rows. A shard that no split makes small, as a tight group of many different vectors, isn't searched by
one task. Its vectors are laid into rings by their angle to one of them: by the triangle inequality, vectors of inner rings are all links, which are counted without a
comparison, and those of rings far apart are none. Only the rings between are compared, block against block.

Vectors travel as they came (single precision stays that) and are written as seldom as can be: splits are learned from samples and sent to all tasks,
a split that would only multiply vectors isn't made, cells that are only looked up aren't written, and a shard is built and searched in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .components import components
from .textkit import released

#: A shard of more vectors is split in FANOUT at most; a split is learned from about so many of its vectors.
MAX_SHARD, FANOUT, SPLIT_SAMPLE, SPLITS = 24_000, 32, 2000, 12
#: How much farther than the nearest centre (in cosine) another may be for a vector to join its cell too; steps the audit may take.
OVERLAP = (0.11, 0.25)
#: The pairs inside of the cells of a split, as a share of its shard's pairs: with more, the shard is compared block against block.
WORTH = 1.0
#: Vectors of a cell of a shard's graph, about.
CELL = 3000
DEGREE, POOL, ALPHA, BEAM = 24, 64, 1.2, 48
#: Audited vectors of a label: about so many of those with links, and of all; what their recall has to be on average.
AUDIT, TARGET = 32, 0.99
BLOCK = 128
#: Vectors on average in a block of the exact search.
EXACT_BLOCK = 16_000
SALT = 16
#: Rings as wide as the angle of a link.
RINGS = 8


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _stack(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Centres by spherical k-means with a fixed seed."""
    c = x[np.random.default_rng(7).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(12):
        own = (x @ c.T).argmax(axis=1)
        c = _unit(np.stack([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))]) + 1e-12)
    return c


def _centres(overlap: float):
    """A shard's sample (shard, n, node, vec) -> (shard, centres); null if a split of the shard isn't worth it."""

    @released
    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("node").to_numpy())
        x = _unit(_stack(t.column("vec")))[order]
        k = min(FANOUT, max(4, -(-16 * t.column("n")[0].as_py() // (5 * MAX_SHARD))))  # of two to three cells a vector
        c: list[np.ndarray] = []
        for v in _kmeans(x, k):  # a tight group keeps one of its centres; its vectors would join the cells of all
            if all(v @ u < 1 - overlap for u in c):
                c.append(v)
        sim = x @ np.stack(c).T
        share = (sim >= sim.max(axis=1, keepdims=True) - overlap).mean(axis=0)
        worth = len(c) > 1 and (share * share).sum() <= WORTH
        return pa.table({"shard": t.column("shard")[:1], "centres": pa.array([np.stack(c).ravel().tobytes() if worth else None], pa.binary())})

    return run


def _assign(overlap: float):
    """(node, vec, copies, shard, own, centres) -> the rows in their new cells; the nearest cell of an own row owns it."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = b.column(3).dictionary_encode()
            of, names, own = shard.indices.to_numpy(), shard.dictionary.to_pylist(), b.column(4).to_numpy(zero_copy_only=False)
            take, name, owns = [], [], []
            for k, s in enumerate(names):
                i = np.flatnonzero(of == k)
                if not b.column(5)[int(i[0])].is_valid:
                    take.append(i)
                    name += [s] * len(i)
                    owns.append(own[i])
                    continue
                x = _unit(_stack(b.column(1).take(pa.array(i))))
                sim = x @ np.frombuffer(b.column(5)[int(i[0])].as_buffer(), np.float64).reshape(-1, x.shape[1]).T
                best = sim.argmax(axis=1)
                r, j = np.nonzero(sim >= sim.max(axis=1, keepdims=True) - overlap)
                take.append(i[r])
                name += [f"{s}/{c}" for c in j.tolist()]
                owns.append(own[i[r]] & (j == best[r]))
            if take:
                at = pa.array(np.concatenate(take))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in range(3)), pa.array(name, pa.string()), pa.array(np.concatenate(owns), pa.bool_())], names=["node", "vec", "copies", "shard", "own"])

    return run


def _shards(nodes: DataFrame, overlap: float, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """((node, vec, copies, shard, own): each node once with own, and in the shards that it overlaps into; (shard, n) of all; a table that the first reads).

    A shard that a split doesn't make smaller, such as one tight group, isn't split; nor is any after SPLITS rounds, so that some may stay above MAX_SHARD.
    A split is written only if one of its cells has to be split again; centres are one for some thousands of vectors, and go to all tasks.
    """
    cur = nodes.select("node", "vec", "copies", "shard", F.lit(True).alias("own"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cur.schema)
    saved = None
    kept = nodes.select("shard").limit(0)
    for step in range(SPLITS + 1):
        sizes = scratch.save(cur.groupBy("shard").agg(F.count("*").alias("n")), "sizes")
        big = sizes.filter(F.col("n") > MAX_SHARD).join(kept, "shard", "left_anti")
        if step == SPLITS or big.isEmpty():
            break
        if step:
            old, saved = saved, scratch.save(cur, "shards")
            cur = saved
            if old is not None:
                scratch.drop(old)
        uniform = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1_000_003)) / F.lit(1_000_003)
        some = cur.join(F.broadcast(big), "shard").filter(uniform < F.lit(float(SPLIT_SAMPLE)) / F.col("n")).select("shard", "n", "node", "vec")
        centres = scratch.save(some.groupBy("shard").applyInArrow(_centres(overlap), "shard string, centres binary"), "centres")
        kept = scratch.save(kept.unionByName(centres.filter("centres is null").select("shard")), "kept")
        centres = centres.filter("centres is not null")
        if centres.isEmpty():
            break
        cur = cur.join(F.broadcast(centres), "shard", "left").select("node", "vec", "copies", "shard", "own", "centres").mapInArrow(_assign(overlap), kinds)
    return cur, sizes, saved


def _pruned(near: np.ndarray, sim: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Robust pruning of rows of candidates from near to far: whether each is kept, as no kept one is ALPHA times nearer to it (squared distances)."""
    c = x[near]
    apart = ALPHA * (2 - 2 * (c @ c.transpose(0, 2, 1)))
    far = 2 - 2 * sim
    live, keep, n = np.ones(near.shape, bool), np.zeros(near.shape, bool), np.zeros(len(near), np.int64)
    for k in range(near.shape[1]):
        now = live[:, k] & (n < DEGREE)
        keep[:, k] = now
        n += now
        live &= ~now[:, None] | (apart[:, k] > far)
    return keep


def _prune(near: np.ndarray, sim: np.ndarray, x: np.ndarray) -> list[int]:
    """The kept candidates of one vector."""
    return near[_pruned(near[None], sim[None], x)[0]].tolist()


def _cells(x: np.ndarray) -> list[np.ndarray]:
    """The vectors of cells of about CELL; each vector is in two, if there are more."""
    k = -(-2 * len(x) // CELL)
    if len(x) <= CELL:
        return [np.arange(len(x))]
    sim = x @ _kmeans(x[np.random.default_rng(5).choice(len(x), min(len(x), SPLIT_SAMPLE), replace=False)], k).T
    two = np.argpartition(-sim, 1, axis=1)[:, :2]
    return [c for i in range(k) if len(c := np.flatnonzero((two == i).any(axis=1)))]


def _build(x: np.ndarray) -> list[np.ndarray]:
    """The links of each vector: those of the robust-pruned graphs of its cells, united, and links back to those that it is the nearest of and to DEGREE in all."""
    n = len(x)
    edges, ranks = [np.empty(0, np.int64)], [np.empty(0, np.int64)]  # from * n + to
    for cell in _cells(x):
        y = x[cell]
        k = min(POOL, len(y) - 1)
        for lo in range(0, len(y) if k else 0, BLOCK):
            s = y[lo : lo + BLOCK] @ y.T
            rows = np.arange(len(s))
            s[rows, rows + lo] = -2
            near = np.argpartition(-s, k - 1, axis=1)[:, :k]
            order = np.lexsort((near, -np.take_along_axis(s, near, axis=1)), axis=1)
            near = np.take_along_axis(near, order, axis=1)
            keep = _pruned(near, np.take_along_axis(s, near, axis=1), y)
            edges.append(np.repeat(cell[lo : lo + BLOCK], keep.sum(axis=1)) * n + cell[near[keep]])
            ranks.append(keep.cumsum(axis=1)[keep])
    edge, rank = np.concatenate(edges), np.concatenate(ranks)
    to = edge % n
    order = np.lexsort((edge, rank, to))
    edge, to = edge[order], to[order]
    first = (np.arange(len(to)) - np.searchsorted(to, to) < DEGREE) | (rank[order] == 1)
    edge = np.unique(np.concatenate((edge, to[first] * n + edge[first] // n)))
    return np.split(edge % n, np.searchsorted(edge, np.arange(1, n) * n))


def range_search(x: np.ndarray, graph: list[np.ndarray], queries: np.ndarray, starts: list[int], low: float) -> Iterator[np.ndarray]:
    """For each block of queries a matrix of cosines, -inf where the walk didn't come; a walk begins at ``starts`` and at the query itself.

    A step expands the best unexpanded vectors among a query's BEAM best. When these are used up, every vector in range that isn't expanded
    yet is, all at once, so the beam is as wide as what is in range and the steps are as many as the graph is deep.
    """
    n = len(x)
    links, size = np.concatenate(graph), np.array([len(g) for g in graph])
    first = np.cumsum(size) - size
    for lo in range(0, len(queries), BLOCK):
        q = x[queries[lo : lo + BLOCK]]
        sim = np.full(len(q) * n, -np.inf, x.dtype)
        seen, done = np.zeros(len(sim), bool), np.zeros(len(sim), bool)
        row = np.arange(len(q))[:, None] * n
        beam = np.empty((len(q), 0), np.int64)  # places in sim; -1: none
        near = np.unique(np.concatenate((row + np.asarray(starts), row + queries[lo : lo + BLOCK, None]), axis=1))
        in_range: list[np.ndarray] = []
        while True:
            seen[near] = True
            for part in range(0, len(near), 100_000):
                r, c = np.divmod(near[part : part + 100_000], n)
                sim[near[part : part + 100_000]] = np.einsum("ij,ij->i", q[r], x[c])
            in_range.append(near[sim[near] >= low])
            if len(near):  # what was found may be among the best
                r = near // n
                count = np.bincount(r, minlength=len(q))
                new = np.full((len(q), count.max()), -1)
                new[r, np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)] = near
                beam = np.concatenate((beam, new), axis=1)
                if beam.shape[1] > BEAM:
                    rank = np.where(beam >= 0, sim[beam], -np.inf)
                    beam = np.take_along_axis(beam, np.argpartition(-rank, BEAM - 1, axis=1)[:, :BEAM], axis=1)
            rank = np.where((beam >= 0) & ~done[beam], sim[beam], -np.inf)
            some = np.argpartition(-rank, min(8, rank.shape[1] - 1), axis=1)[:, :8]  # the best few of each query at once
            at = np.take_along_axis(beam, some, axis=1)[np.take_along_axis(rank, some, axis=1) > -np.inf]
            if not len(at):
                at = np.concatenate(in_range)
                at, in_range = at[~done[at]], []
                if not len(at):
                    break
            done[at] = True
            parts = []
            for part in range(0, len(at), 10_000):
                some = at[part : part + 10_000]
                c = some % n
                count = size[c]
                to = np.repeat(some - c, count) + links[np.arange(count.sum()) + np.repeat(first[c] - np.cumsum(count) + count, count)]
                parts.append(to[~seen[to]])
            near = np.sort(np.concatenate(parts))
            near = near[np.diff(near, prepend=-1) > 0]
        yield sim.reshape(len(q), n)


class Labels:
    """Components of 0 to n - 1 as an array of labels, the smallest member of each."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def unite(self, i: int, others: np.ndarray) -> None:
        found = self.of[others]
        if (found != self.of[i]).any():
            every = np.unique(np.append(found, self.of[i]))
            self.of[np.isin(self.of, every)] = every[0]


def _search(low: float):
    """A shard (node, vec, own, copies) -> (node, links, root) of its own vectors: how many rows each links with, and its local component."""

    @released
    def run(t: pa.Table) -> pa.Table:
        node, own = t.column("node").to_numpy(), t.column("own").to_numpy()
        order = np.lexsort((node, ~own))
        node, raw, copies = node[order], _stack(t.column("vec"))[order], t.column("copies").to_numpy()[order]
        n, m = len(node), int(own.sum())  # the first m are own ones
        norm = np.sqrt((raw * raw).sum(axis=1))
        x = (raw / norm[:, None]).astype(np.float32)
        slack = 2e-7 * (x.shape[1] + 8)  # what the walk's cosines may be wrong by
        graph = _build(x)
        medoid = int((x @ x.mean(axis=0)).argmax())
        starts = [medoid, *_unreached(graph, medoid)]
        at, bits = [np.empty(0, np.int64)], [np.empty((0, -(-n // 8)), np.uint8)]  # of own vectors that link, a bit for each vector
        for k, sim in enumerate(range_search(x, graph, np.arange(m), starts, low - slack)):
            hit = sim >= low + slack
            r, c = np.nonzero((sim >= low - slack) & ~hit)
            i = r + k * BLOCK
            hit[r, c] = np.einsum("ij,ij->i", raw[i], raw[c]) / (norm[i] * norm[c]) >= low
            r = np.arange(len(hit))
            hit[r, r + k * BLOCK] = False
            r = np.flatnonzero(hit.any(axis=1))
            at.append(r + k * BLOCK)
            bits.append(np.packbits(hit[r], axis=1))
        at, bits = np.concatenate(at), np.concatenate(bits)
        found = np.unpackbits(np.bitwise_or.reduce(bits, axis=0), count=n).astype(bool) if len(at) else np.zeros(n, bool)
        also = np.flatnonzero(found[m:]) + m  # vectors of other shards that own ones link with
        only = np.setdiff1d(np.flatnonzero(found[:m]), at)
        at, bits = np.concatenate((at, only)), np.concatenate((bits, np.zeros((len(only), bits.shape[1]), np.uint8)))
        n_links, labels = copies[:m] - 1, Labels(n)
        for lo in range(0, len(at), BLOCK):
            i = at[lo : lo + BLOCK]
            hit = np.unpackbits(bits[lo : lo + BLOCK], axis=1, count=n).astype(bool)
            hit[:, at] |= (bits[:, i // 8] >> (7 - i % 8).astype(np.uint8) & 1).T.astype(bool)  # a search may miss what the search from the other end finds
            n_links[i] += hit @ copies
            for r, k in enumerate(i.tolist()):
                labels.unite(k, np.flatnonzero(hit[r]))
        at = np.concatenate((np.arange(m), also))
        links = pa.array(np.concatenate((n_links, np.zeros(len(also), np.int64))), pa.int64(), mask=np.arange(len(at)) >= m)
        return pa.table({"node": pa.array(node[at]), "links": links, "root": pa.array(node[labels.of[at]])})

    return run


def _unreached(graph: list[np.ndarray], start: int) -> list[int]:
    """One vector of each part of the graph that can't be reached from ``start``."""
    seen = np.zeros(len(graph), bool)
    out = []
    for s in [start, *range(len(graph))]:
        if seen[s]:
            continue
        if s != start:
            out.append(s)
        stack = [s]
        seen[s] = True
        while stack:
            g = graph[stack.pop()]
            new = g[~seen[g]]
            seen[new] = True
            stack += new.tolist()
    return out


def _audit(low: float):
    """Audited vectors (node, vec) and a block of their label (node, vec, copies) -> (node, n), how many rows each links with."""

    @released
    def run(q: pa.Table, t: pa.Table) -> pa.Table:
        if not len(q) or not len(t):
            return pa.table({"node": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        own, node, copies = q.column("node").to_numpy(), t.column("node").to_numpy(), t.column("copies").to_numpy()
        y, x = _stack(q.column("vec")), _stack(t.column("vec"))
        hit = (y @ x.T) / (np.linalg.norm(y, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]) >= low
        hit &= own[:, None] != node[None, :]
        return pa.table({"node": pa.array(own), "n": pa.array(hit @ copies)})

    return run


def _recall(found: DataFrame, nodes: DataFrame, low: float, scratch: Scratch) -> DataFrame:
    """(shard, recall) of the labels of ``nodes`` of which an audited vector has links; the others have nothing to be measured by."""
    uniform = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1_000_003)) / F.lit(1_000_003)

    def some(df: DataFrame) -> DataFrame:
        sizes = df.groupBy("shard").agg(F.count("*").alias("_n"))
        return df.join(sizes, "shard").filter(uniform < F.lit(float(AUDIT)) / F.col("_n")).select("node")

    counted = found.filter("links is not null").select("node", "links")
    linked = nodes.join(counted, "node").filter("links > copies - 1")
    picked = scratch.save(some(linked).unionByName(some(nodes)).distinct(), "picks")
    picked = scratch.save(nodes.join(picked, "node"), "picked")
    blocks = scratch.save(nodes.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(EXACT_BLOCK)).cast("int").alias("blocks")), "blocks")  # known to be small, so that no vector is shuffled for it
    q = picked.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    c = nodes.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("node", F.lit(6)), F.col("blocks")).cast("int"))
    sides = [df.select(*(F.col(x).alias(x) for x in ("shard", "block", "node", "vec", "copies"))).groupBy("shard", "block") for df in (q, c)]
    true = sides[0].cogroup(sides[1]).applyInArrow(_audit(low), "node long, n long").groupBy("node").agg(F.sum("n").alias("want")).filter("want > 0")
    each = picked.select("node", "shard", "copies").join(true, "node").join(counted, "node", "left")
    share = F.least("want", F.coalesce("links", F.lit(0)) - F.col("copies") + 1) / F.col("want")
    return scratch.save(each.groupBy("shard").agg(F.avg(F.greatest(share, F.lit(0.0))).alias("recall")), "recall")


def _ring(low: float):
    """(shard, node, vec, copies, own, centre) -> (shard, node, vec, copies, own, ring) by the angle to the centre.

    Outer rings are laid together by RINGS + 1, so that one is compared with itself and its neighbours alone.
    """
    width = (np.arccos(low) - 1e-6) / RINGS

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, c = _unit(_stack(b.column(2))), _unit(_stack(b.column(5)))
            ring = np.floor(np.arccos(np.clip((x * c).sum(axis=1), -1, 1)) / width)
            ring = np.where(ring < RINGS, ring, ring - (ring - RINGS) % (RINGS + 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(ring.astype(np.int32))], names=["shard", "node", "vec", "copies", "own", "ring"])

    return run


def _exact(low: float):
    """Two blocks (shard, node, vec, copies, first, second) of a shard -> (shard, node, n, root) of all their links; a block against itself comes alone."""

    @released
    def run(t: pa.Table) -> pa.Table:
        node = t.column("node").to_numpy()
        order = np.argsort(node)
        node, x = node[order], _stack(t.column("vec"))[order]
        norm = np.sqrt((x * x).sum(axis=1))
        copies, first, second = (t.column(c).to_numpy()[order] for c in ("copies", "first", "second"))
        a, b = np.flatnonzero(first), np.flatnonzero(second)
        n, labels = np.zeros(len(node), np.int64), Labels(len(node))
        for lo in range(0, len(a), BLOCK):
            i = a[lo : lo + BLOCK]
            hit = (x[i] @ x[b].T) / (norm[i][:, None] * norm[b][None, :]) >= low
            hit &= i[:, None] != b[None, :]
            n[i] += hit @ copies[b]
            if not first[b].all():  # two blocks: the links count from both ends
                n[b] += copies[i] @ hit
            for r, k in enumerate(i.tolist()):
                labels.unite(k, b[hit[r]])
        at = np.flatnonzero(n)
        shard = [t.column("shard")[0].as_py()] * len(at)
        return pa.table({"shard": pa.array(shard, pa.string()), "node": pa.array(node[at]), "n": pa.array(n[at]), "root": pa.array(node[labels.of[at]])})

    return run


def _searched_exactly(nodes: DataFrame, low: float, scratch: Scratch) -> DataFrame:
    """(node, links, root) of ``nodes`` (node, vec, shard, copies, own), exact, as ``_search`` gives them: links of own ones only."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kind = nodes.schema["vec"].dataType.simpleString()
    centres = scratch.save(nodes.groupBy("shard").agg(F.min_by("vec", "node").alias("centre")), "ring-centres")
    centres = centres.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))  # a hot shard is joined in parts
    rows = nodes.withColumn("salt", F.pmod(F.hash("node"), F.lit(SALT))).join(centres, ["shard", "salt"]).select("shard", "node", "vec", "copies", "own", "centre")
    rows = scratch.save(rows.mapInArrow(_ring(low), f"shard string, node long, vec {kind}, copies long, own boolean, ring int"), "rings")
    sizes = rows.groupBy("shard", "ring").agg(F.ceil(F.count("*") / F.lit(EXACT_BLOCK)).cast("int").alias("blocks"), F.sum("copies").alias("sum"), F.min("node").alias("least"))
    sizes = scratch.save(sizes, "sizes")  # a few rows a shard
    both = sizes.join(sizes.select("shard", *(F.col(c).alias("o_" + c) for c in ("ring", "blocks", "sum", "least"))), "shard")
    sure = F.col("ring") + F.col("o_ring") + 2 <= RINGS
    inner = both.filter(sure).groupBy("shard", "ring").agg(F.sum("o_sum").alias("sure"), F.min_by("o_least", "o_ring").alias("first"))
    between = both.filter(~sure & (F.col("ring") <= F.col("o_ring")) & (F.col("o_ring") - F.col("ring") <= RINGS + 1)).select("shard", "ring", "o_ring", "blocks", "o_blocks")
    between = scratch.save(between, "between")

    block = lambda n: F.pmod(F.xxhash64("node", F.lit(5)), F.col(n)).cast("int")
    one_ring, one_block = F.col("ring") == F.col("o_ring"), F.col("a") == F.col("b")
    left = rows.join(between, ["shard", "ring"]).withColumns({"a": block("blocks"), "b": every("o_blocks")}).filter(~one_ring | (F.col("a") <= F.col("b")))
    left = left.withColumns({"first": F.lit(True), "second": one_ring & one_block})
    right = rows.withColumnRenamed("ring", "o_ring").join(between, ["shard", "o_ring"]).withColumns({"b": block("o_blocks"), "a": every("blocks")})
    right = right.filter(~one_ring | (F.col("a") < F.col("b"))).withColumns({"first": F.lit(False), "second": F.lit(True)})
    columns = ["shard", "ring", "o_ring", "a", "b", "node", "vec", "copies", "first", "second"]
    parts = left.select(columns).unionByName(right.select(columns)).groupBy(columns[:5]).applyInArrow(_exact(low), "shard string, node long, n long, root long")
    parts = scratch.save(parts, "exact")

    count = rows.select("shard", "ring", "node", "copies", "own").join(inner, ["shard", "ring"], "left").join(parts.groupBy("shard", "node").agg(F.sum("n").alias("n")), ["shard", "node"], "left")
    itself = F.when(2 * F.col("ring") + 2 <= RINGS, F.col("copies")).otherwise(0)
    links = F.col("copies") - 1 + F.coalesce("sure", F.lit(0)) - itself + F.coalesce("n", F.lit(0))
    count = count.select("node", F.when(F.col("own"), links).cast("long").alias("links"), F.coalesce("first", "node").alias("root"))
    return count.unionByName(parts.select("node", F.lit(None).cast("long").alias("links"), "root"))


def near_duplicates(vectors: DataFrame, low: float = 0.93, scratch: Scratch | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall) for each row of ``vectors`` (vec_id, embedding, label; others are ignored).

    ``audit_recall`` is that of the row's label; null where no audited vector of the label has links, so that nothing was measured.

    Rows link when their labels are equal and not null and their cosine is at least ``low``. Vectors that are null, empty or zero or hold a
    null, NaN or infinite component, and those without a label, link with nothing. Vectors of different lengths don't link. Rows that
    repeat a vec_id are vectors of their own under that id; a null vec_id takes part, but names a component only if no member has an id.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "graph")
    inner = vectors.schema["embedding"].dataType.elementType.typeName()
    v = F.col("embedding").cast(f"array<{inner if inner == 'float' else 'double'}>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vec"), F.col("label").cast("string").alias("label"))
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & ~odd & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(good, F.lit(False)))
    shard = F.concat(F.col("label"), F.lit("|"), F.size("vec"))
    rows = rows.withColumn("shard", F.when(F.col("ok"), shard)).withColumn("node", F.when(F.col("ok"), F.xxhash64("shard", "vec")))
    given = scratch.save(rows.select("vec_id", "ok", "shard", "node", F.when(F.col("ok"), F.col("vec")).alias("vec")), "given")
    rows = scratch.save(given.drop("vec"), "rows")
    several = scratch.save(rows.filter("ok").groupBy("node").agg(F.count("*").cast("long").alias("copies")).filter("copies > 1"), "several")
    each = given.filter("ok").join(several, "node", "left").select("node", "vec", "shard", "copies")  # only vectors with copies have to meet
    more = each.filter("copies is not null").groupBy("node").agg(*(F.first(c).alias(c) for c in ("vec", "shard", "copies")))
    nodes = scratch.save(each.filter("copies is null").fillna(1, "copies").unionByName(more), "nodes")
    scratch.drop(given)

    def searched(some: DataFrame, overlap: float) -> DataFrame:
        shards, sizes, split = _shards(some, overlap, scratch)
        large = sizes.filter(F.col("n") > MAX_SHARD).select("shard")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (sizes.agg(F.sum("n")).first()[0] or 0) // CELL)  # few tasks get two large shards
        small = shards.join(F.broadcast(large), "shard", "left_anti").repartition(parts, "shard")
        found = small.groupBy("shard").applyInArrow(_search(low), "node long, links long, root long")
        if not large.isEmpty():
            found = found.unionByName(_searched_exactly(shards.join(F.broadcast(large), "shard"), low, scratch))
        found = scratch.save(found, "found")
        if split is not None:
            scratch.drop(split)
        return found

    def audited(found: DataFrame, some: DataFrame) -> tuple[DataFrame, DataFrame]:
        recall = _recall(found, some, low, scratch)
        return recall, recall.filter(F.col("recall") < TARGET).select("shard")

    todo, found = nodes, searched(nodes, OVERLAP[0])
    recall, short = audited(found, nodes)
    for overlap in (*OVERLAP[1:], None):  # None: exactly
        if short.isEmpty():
            break
        todo = scratch.save(todo.join(short, "shard", "left_semi"), "again")
        again = searched(todo, overlap) if overlap is not None else scratch.save(_searched_exactly(todo.withColumn("own", F.lit(True)), low, scratch), "found")
        found = scratch.save(found.join(todo.select("node"), "node", "left_anti").unionByName(again), "found")
        better, next_short = audited(again, todo)
        recall, short = scratch.save(recall.join(short, "shard", "left_anti").unionByName(better), "recall"), next_short
    comp = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    named = rows.filter("ok").groupBy("node").agg(F.min("vec_id").alias("least"))
    named = named.join(found.filter("links is not null").select("node", "links"), "node").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    label = named.groupBy("comp").agg(F.min("least").alias("label"))
    named = named.join(label, "comp").select("node", "links", "label")
    out = rows.select("vec_id", "node", "shard").join(named, "node", "left").join(recall, "shard", "left")
    first = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("label"))
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), first.alias("component_id"), F.col("vec_id").eqNullSafe(first).alias("kept"), F.col("recall").alias("audit_recall")
    )
