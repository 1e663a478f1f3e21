"""Connected components of an edge list, all on the cluster.

Edges are first contracted inside each partition by union-find, which leaves at most one edge for each
node and partition. Alternating large-star and small-star steps (Kiveris et al., "Connected components
in MapReduce and beyond", 2014) then shrink the graph to stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .textkit import released


class UnionFind:
    """Union-find over arbitrary integers; the root is the smallest member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            if a > b:
                a, b = b, a
            self.up[b] = a
            self.up.setdefault(a, a)


#: Edges that one contraction holds before it hands over what it has.
CONTRACT = 500_000


@released
def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uf = UnionFind()

    def out() -> pa.RecordBatch:
        nodes = [x for x in uf.up if uf.find(x) != x]
        roots = [uf.find(x) for x in nodes]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["a", "b"])

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            uf.union(x, y)
        if len(uf.up) > CONTRACT:
            yield out()
            uf = UnionFind()
    if uf.up:
        yield out()


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    joined = both.join(low, "a")
    if large:
        new = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        new = joined.select("b", "m").unionByName(low.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return new.filter("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, rounds: int = 40) -> DataFrame:
    """``edges`` (a long, b long) -> (node, comp) for every node with an edge; comp is the smallest node reachable.

    Null ends and self-links are ignored; repeated edges do no harm; no edges give no rows.
    """
    cur = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    cur = scratch.save(cur.mapInArrow(_contract, "a long, b long"), "contracted")
    cur = scratch.save(cur.repartition("a").mapInArrow(_contract, "a long, b long").distinct(), "contracted")
    for _ in range(rounds):
        # Done when each node but the roots hangs on exactly one root, and no root hangs on another.
        n = cur.agg(F.count("a").alias("n"), F.countDistinct("a").alias("d")).first()
        if n["n"] == n["d"] and cur.join(cur.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
        old, cur = cur, scratch.save(_stars(_stars(cur, True), False), "stars")
        scratch.drop(old)
    else:
        raise RuntimeError("components did not converge")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    )


def local_roots(pairs: np.ndarray) -> np.ndarray:
    """(k, 2) pairs -> (node, root) rows of their local components."""
    uf = UnionFind()
    for a, b in pairs.tolist():
        uf.union(a, b)
    return np.array([(x, uf.find(x)) for x in uf.up], np.int64).reshape(-1, 2)
