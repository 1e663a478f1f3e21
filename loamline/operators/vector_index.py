"""A stored vector index that respects readers' groups: coarse cells as table partitions, product-quantised codes, widening scans, exact re-ranking.

Vectors of length 1 lie in the cell of their nearest centre; what is left after the centre is coded in one byte for each ``SUB`` dimensions, with the length of what the code misses.
So a scan reads codes, not vectors, and knows how far each score may be off. A query scans its best cells first, sees only rows whose groups it shares, and
widens until it has enough of them. Only then are vectors read, of the candidates alone.

A search is exact if asked: no vector of a cell scores above the centre's score plus the cell's radius. The ``probes`` best cells give a query's least kth score; then it sees all cells that can reach
it, by strips of cells, and each task compares the vectors themselves and gives a query's ``k`` best at most, so nothing grows with the number of pairs but the comparisons.
Otherwise a query stops at ``rerank`` times k visible candidates after ``probes`` cells at least.

Centres and codes are learned from a bounded sample (``SAMPLE`` vectors); every vector is indexed. Appended vectors use them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, normalised
from ..scratch import Scratch

#: Vectors that centres and codes are learned from; most cells; dimensions and values of a code's byte; rows and queries that a task compares, and queries at once.
SAMPLE, MAX_CELLS, SUB, VALUES = 20_000, 4096, 4, 256
PART, BLOCK, AT_ONCE = 32_768, 1024, 64
#: Queries that an exact search compares with a strip, and bytes of a strip's vectors.
EXACT_BLOCK, STRIP_BYTES = 4096, 8 * 2**20
STORED = "id long, code binary, err double, groups array<string>, unit array<double>, cell int"
_ASKED = "query_id long, q array<double>, groups array<string>, floor double, cell int"


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest of ``c`` to each of ``x`` by distance."""
    return np.concatenate([((c * c).sum(axis=1)[None, :] - 2 * x[i : i + 4096] @ c.T).argmin(axis=1) for i in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """At most ``k`` centres by Lloyd's rounds; an empty one stays where it was."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


@dataclass
class Codes:
    """Centres of cells (cell, dimension) and values of the codes' bytes (byte, value, SUB)."""

    centres: np.ndarray
    values: np.ndarray

    @classmethod
    def learn(cls, x: np.ndarray, cells: int, seed: int = 3) -> Codes:
        rng = np.random.default_rng(seed)
        centres = _means(x, cells, 12, rng)
        rest = cls._padded(x - centres[_nearest(x, centres)])
        return cls(centres, np.stack([cls._filled(_means(np.ascontiguousarray(rest[:, j]), VALUES, 8, rng)) for j in range(rest.shape[1])]))

    @staticmethod
    def _filled(c: np.ndarray) -> np.ndarray:
        return np.concatenate((c, np.repeat(c[:1], VALUES - len(c), axis=0)))

    @staticmethod
    def _padded(x: np.ndarray) -> np.ndarray:
        parts = -(-x.shape[1] // SUB)
        return np.pad(x, ((0, 0), (0, parts * SUB - x.shape[1]))).reshape(len(x), parts, SUB)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cell, code, length of what the code misses, distance to the centre) of each vector."""
        cell = _nearest(x, self.centres)
        rest = self._padded(x - self.centres[cell])
        code = np.stack([_nearest(rest[:, j], self.values[j]) for j in range(rest.shape[1])], axis=1).astype(np.uint8)
        kept = np.stack([self.values[j][code[:, j]] for j in range(rest.shape[1])], axis=1)
        length = lambda y: np.sqrt((y * y).sum(axis=(1, 2)))
        return cell, code, length(rest - kept), length(rest)

    def scores(self, q: np.ndarray, cell: int, code: np.ndarray) -> np.ndarray:
        """(query, row) inner products with the coded vectors of a cell."""
        parts = self._padded(q)
        out = np.repeat((q @ self.centres[cell])[:, None], len(code), axis=1)
        for j in range(parts.shape[1]):
            out += (parts[:, j] @ self.values[j].T)[:, code[:, j]]
        return out


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _encoder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        for b in batches:
            if not len(b):
                continue
            cell, code, err, far = codes.encode(_matrix(b.column(1)))
            cols = [b.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(err), b.column(2), b.column(1), pa.array(cell.astype(np.int32)), pa.array(far)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "code", "err", "groups", "unit", "cell", "far"])

    return run


def _chosen(shared, lo: int, hi: int):
    """Queries (query_id, q, groups, floor) -> a row for each cell that they scan in this round: places lo to hi of their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, radius = shared.value
        for b in batches:
            if not len(b):
                continue
            near = _matrix(b.column(1)) @ codes.centres.T
            order = np.argsort(-near, axis=1, kind="stable")[:, lo:hi]
            i, j = np.nonzero(radius[order] >= 0)
            at = pa.array(i)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in range(4)), pa.array(order[i, j].astype(np.int32))], names=["query_id", "q", "groups", "floor", "cell"])

    return run


def _reaching(shared, slack: float):
    """Queries (query_id, q, groups, floor) -> a row for each strip with a cell that can reach the floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, radius, strips = shared.value
        for b in batches:
            if not len(b):
                continue
            ok = (radius >= 0) & (_matrix(b.column(1)) @ codes.centres.T + radius[None, :] >= b.column(3).to_numpy()[:, None] - slack)
            i, cell = np.nonzero(ok)
            i, strip = np.unique(np.stack((i, strips[cell])), axis=1)
            at = pa.array(i)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in range(4)), pa.array(strip.astype(np.int32))], names=["query_id", "q", "groups", "floor", "cell"])

    return run


def _sets(col) -> tuple[np.ndarray, list[frozenset]]:
    """Numbers of equal sets of groups, and the sets."""
    number: dict[frozenset, int] = {}
    of = [number.setdefault(frozenset(g for g in (x or ()) if g is not None), len(number)) for x in col.to_pylist()]
    return np.array(of, np.int64), list(number)


def _meets(q: pa.Table, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which sets of the queries' groups (first) meet which of the rows', and the number of each query's and each row's set."""
    (own, owns), (had, has) = _sets(q.column("groups")), _sets(rows.column("groups"))
    return np.array([[bool(a & b) for b in has] for a in owns]), own, had


def _scan(shared, keep: int):
    """Queries and a part of a cell -> (query_id, id, cell, score): the ``keep`` best visible rows by their codes."""

    def run(q: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(q) and len(rows):
            codes, _ = shared.value
            cell = rows.column("cell")[0].as_py()
            code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(rows), -1)
            ids, who = rows.column("id").to_numpy(), q.column("query_id").to_numpy()
            meets, own, had = _meets(q, rows)
            x = _matrix(q.column("q"))
            for at in range(0, len(x), AT_ONCE):
                part = slice(at, at + AT_ONCE)
                score = codes.scores(x[part], cell, code)
                seen = meets[own[part]][:, had]
                for i, (s, ok) in enumerate(zip(score, seen, strict=True)):
                    r = np.flatnonzero(ok)
                    if len(r) > keep:
                        r = r[np.argpartition(-s[r], keep - 1)[:keep]]
                    out.append((np.full(len(r), who[at + i]), ids[r], np.full(len(r), cell, np.int32), s[r]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, t) for t in (np.int64, np.int64, np.int32, float)]
        return pa.table(dict(zip(("query_id", "id", "cell", "score"), map(pa.array, cols), strict=True)))

    return run


def _compare(k: int, digits: int):
    """Queries and a part of a cell or strip -> (query_id, id, similarity): the ``k`` best visible rows that reach the query's floor, by rounded similarity, ties by id."""

    def run(q: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(q) and len(rows):
            ids, who, floor = rows.column("id").to_numpy(), q.column("query_id").to_numpy(), q.column("floor").to_numpy()
            meets, own, had = _meets(q, rows)
            x, y = _matrix(q.column("q")), _matrix(rows.column("unit"))
            for at in range(0, len(x), AT_ONCE):
                part = slice(at, at + AT_ONCE)
                score = x[part] @ y.T
                hit = (score >= floor[part, None] - 10.0**-digits) & meets[own[part]][:, had]
                for i, (s, ok) in enumerate(zip(score, hit, strict=True)):
                    r = np.flatnonzero(ok)
                    if not len(r):
                        continue
                    sim = np.round(s[r], digits)
                    if len(r) > k:
                        best = np.flatnonzero(sim >= np.partition(sim, len(r) - k)[len(r) - k])
                        best = best[np.lexsort((ids[r[best]], -sim[best]))[:k]]
                        r, sim = r[best], sim[best]
                    out.append((np.full(len(r), who[at + i]), ids[r], sim))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, t) for t in (np.int64, np.int64, float)]
        return pa.table(dict(zip(("query_id", "id", "similarity"), map(pa.array, cols), strict=True)))

    return run


class VectorIndex:
    """The index below ``path``: ``vectors`` partitioned by cell, ``cells`` with their sizes and radii, ``codes``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        stored = spark.read.parquet(f"{self.path}/codes").first()  # one row
        centres, values = (np.frombuffer(bytes(stored[c]), np.float64) for c in ("centres", "code_values"))
        self.codes = Codes(centres.reshape(-1, stored["dim"]), values.reshape(-1, VALUES, SUB))

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Indexes ``vectors`` (id, embedding, groups) of one length. Null ids, null and zero vectors are left out; rows without groups are visible to nobody.

        Cells are as many as the root of the number of vectors, or ``cells``, ``MAX_CELLS`` at most.
        """
        spark = vectors.sparkSession
        unit = Scratch(spark, "vector-index").save(_unit(vectors), "unit")
        n = unit.count()
        if not n:
            raise ValueError("there are no vectors to index")
        uniform = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1_000_003)) / F.lit(1_000_003)
        some = unit.filter(uniform < sample / n).orderBy("id", "unit").select("unit").collect() or unit.orderBy("id").limit(1).select("unit").collect()  # about ``sample`` rows
        codes = Codes.learn(np.array([r["unit"] for r in some]), max(1, min(MAX_CELLS, cells or round(n**0.5))))
        saved = (bytearray(codes.centres.tobytes()), bytearray(codes.values.tobytes()), codes.centres.shape[1])
        spark.createDataFrame([saved], "centres binary, code_values binary, dim int").coalesce(1).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/codes")
        out = cls(spark, path)
        out._add(unit, n)
        return out

    def append(self, vectors: DataFrame) -> None:
        """Adds ``vectors`` as ``build`` does, with the centres and codes that there are."""
        unit = _unit(vectors)
        self._add(unit, unit.count())

    def _add(self, unit: DataFrame, n: int) -> None:
        shared = self.spark.sparkContext.broadcast(self.codes)  # at most MAX_CELLS centres
        coded = unit.mapInArrow(_encoder(shared), STORED + ", far double")
        files = -(-n // (PART * len(self.codes.centres)))  # of a cell on average; a large one is written by several tasks
        coded = Scratch(self.spark, "vector-index").save(coded.repartition("cell", F.pmod(F.hash("id"), F.lit(files))), "coded")
        coded.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).coalesce(1).write.mode("append").parquet(f"{self.path}/cells")
        coded.drop("far").repartition("cell", F.pmod(F.hash("id"), F.lit(files))).write.mode("append").partitionBy("cell").parquet(f"{self.path}/vectors")

    def cells(self) -> dict[int, tuple[int, float]]:
        """Rows and radius of each cell that has rows; at most MAX_CELLS entries."""
        got = self.spark.read.parquet(f"{self.path}/cells").groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
        return {r["cell"]: (r["n"], r["radius"]) for r in got.collect()}

    def rows(self, cells: list[int]) -> DataFrame:
        """The stored rows of ``cells``: other partitions aren't read."""
        return self.spark.read.schema(STORED).parquet(f"{self.path}/vectors").filter(F.col("cell").isin(cells))

    def search(self, queries: DataFrame, k: int, exact: bool = False, probes: int = 8, rerank: int = 10, digits: int = 6) -> DataFrame:
        """(query_id, id, similarity, rank): the ``k`` best visible rows for each of ``queries`` (query_id, query, groups), by cosine rounded to ``digits``, ties by id.

        Query ids are distinct; null and zero queries, queries of another length and callers without groups find nothing. Rows that repeat an id are found each.
        """
        spark, dim = self.spark, self.codes.centres.shape[1]
        scratch = Scratch(spark, "vector-search")
        q = queries.select(F.col("query_id").cast("long").alias("query_id"), normalised(F.col("query")).alias("q"), "groups")
        q = scratch.save(q.filter((F.size("q") == dim) & (F.size("groups") > 0) & F.col("query_id").isNotNull()), "queries")
        sizes = self.cells()
        radius = np.array([sizes.get(c, (0, -1.0))[1] for c in range(len(self.codes.centres))])
        if not sizes:
            return spark.createDataFrame([], "query_id long, id long, similarity double, rank int")
        if exact:
            return self._exact(q, k, sizes, radius, probes, digits, scratch)
        shared = spark.sparkContext.broadcast((self.codes, radius))
        parts = self._parts(sizes, PART)
        todo, found, lo, step = q.withColumn("floor", F.lit(float("-inf"))), None, 0, max(1, probes)
        while lo < len(radius):
            asked = scratch.save(todo.select("query_id", "q", "groups", "floor").mapInArrow(_chosen(shared, lo, lo + step), _ASKED), "asked")
            cells = [r["cell"] for r in asked.select("cell").distinct().collect()]  # at most MAX_CELLS
            if not cells:
                break
            rows = self.rows(cells).select("id", "code", "groups", "cell", F.pmod(F.hash("id"), parts[F.col("cell")]).alias("part"))
            new = self._together(asked, rows, parts, -(-q.count() // BLOCK), _scan(shared, rerank * k), "query_id long, id long, cell int, score double")
            new = scratch.save(new, "candidates")
            found = new if found is None else found.unionByName(new)
            lo, step = lo + step, 2 * (lo + step)
            enough = found.groupBy("query_id").count().filter(F.col("count") >= rerank * k)
            todo = q.join(enough, "query_id", "left_anti").withColumn("floor", F.lit(float("-inf")))
        if found is None:
            return spark.createDataFrame([], "query_id long, id long, similarity double, rank int")
        return self._ranked(found, q, k, rerank * k, digits)

    @staticmethod
    def _parts(sizes: dict[int, tuple[int, float]], rows: int) -> Column:
        """A map of a cell to the parts of about ``rows`` rows that its rows are dealt to."""
        return F.create_map(*(x for c, (n, _) in sizes.items() for x in (F.lit(c), F.lit(-(-n // rows)))))

    @staticmethod
    def _together(asked: DataFrame, rows: DataFrame, parts: Column, blocks: int, compare, schema: str) -> DataFrame:
        """Brings each block of a cell's queries together with each part of its rows."""
        asked = asked.withColumns({"part": F.explode(F.sequence(F.lit(0), parts[F.col("cell")] - 1)), "block": F.pmod(F.hash("query_id"), F.lit(max(1, blocks)))})
        pairs = asked.select(F.col("cell").alias("cell"), F.col("block").alias("block")).distinct()
        keys = ["cell", "part", "block"]
        return asked.groupBy(*keys).cogroup(rows.join(pairs, "cell").groupBy(*keys)).applyInArrow(compare, schema)

    def _exact(self, q: DataFrame, k: int, sizes: dict[int, tuple[int, float]], radius: np.ndarray, probes: int, digits: int, scratch: Scratch) -> DataFrame:
        """The exact answer: floors from the nearest cells, then all that can reach them. A strip is a cell or several small ones, so there are about as many as the vectors fill."""
        dim, schema = self.codes.centres.shape[1], "query_id long, id long, similarity double"
        most, blocks = max(1, min(PART, STRIP_BYTES // (8 * dim))), -(-q.count() // EXACT_BLOCK)
        parts, order = self._parts(sizes, most), Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        shared = self.spark.sparkContext.broadcast((self.codes, radius))
        near = scratch.save(q.withColumn("floor", F.lit(float("-inf"))).mapInArrow(_chosen(shared, 0, max(1, probes)), _ASKED), "near")
        rows = self.rows(list(sizes)).select("id", "unit", "groups", "cell")  # at most MAX_CELLS
        first = self._together(near, rows.withColumn("part", F.pmod(F.hash("id"), parts[F.col("cell")])), parts, blocks, _compare(k, digits), schema)
        floors = scratch.save(first.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") == k).select("query_id", F.col("similarity").alias("floor")), "floors")
        strips, n = np.zeros(len(radius), np.int64), {}
        for c in sorted(sizes):  # a strip is full before the next one begins
            at = max(n, default=-1)
            at = at + 1 if at < 0 or n[at] + sizes[c][0] > most else at
            strips[c], n[at] = at, n.get(at, 0) + sizes[c][0]
        strip_of = F.create_map(*(x for c in sizes for x in (F.lit(c), F.lit(int(strips[c])))))
        parts = self._parts({c: (m, 0.0) for c, m in n.items()}, most)
        shared = self.spark.sparkContext.broadcast((self.codes, radius, strips))
        asked = q.join(floors, "query_id", "left").select("query_id", "q", "groups", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
        asked = scratch.save(asked.mapInArrow(_reaching(shared, 2 * 10.0**-digits + 1e-9), _ASKED), "asked")
        rows = rows.withColumn("cell", strip_of[F.col("cell")]).withColumn("part", F.pmod(F.hash("id"), parts[F.col("cell")]))
        found = scratch.save(self._together(asked, rows, parts, blocks, _compare(k, digits), schema), "found")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def similarities(self, pairs: DataFrame, queries: DataFrame, digits: int = 6) -> DataFrame:
        """(query_id, id, similarity) of ``pairs`` (query_id, id) for ``queries`` (query_id, query). Their cells are looked up first, and only these are read whole."""
        pairs = pairs.select("query_id", F.col("id").alias("_id"), F.col("id").cast("long").alias("id"))
        every = list(self.cells())
        placed = Scratch(self.spark, "vector-search").save(self.rows(every).select("id", "cell").join(pairs, "id"), "placed")
        cells = [r["cell"] for r in placed.select("cell").distinct().collect()]  # at most MAX_CELLS
        q = queries.select(F.col("query_id").cast("long").alias("query_id"), normalised(F.col("query")).alias("q")).filter(F.size("q") == self.codes.centres.shape[1])
        got = self.rows(cells).select("id", "cell", "unit").join(placed.distinct(), ["id", "cell"]).join(q, "query_id")
        return got.groupBy("query_id", F.col("_id").alias("id")).agg(F.max(F.round(dot(F.col("unit"), F.col("q")), digits)).alias("similarity"))

    def _ranked(self, found: DataFrame, q: DataFrame, k: int, keep: int, digits: int) -> DataFrame:
        """Reads the candidates' vectors and orders by exact similarity."""
        found = found.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("_r") <= keep)
        cells = [r["cell"] for r in found.select("cell").distinct().collect()]
        pairs = found.select("query_id", "id", "cell").distinct().join(q.select("query_id", "q", F.col("groups").alias("_g")), "query_id")
        hits = self.rows(cells).select("id", "cell", "unit", "groups").join(pairs, ["cell", "id"]).filter(F.arrays_overlap("groups", "_g"))
        hits = hits.select("query_id", "id", F.round(dot(F.col("unit"), F.col("q")), digits).alias("similarity"))
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _unit(vectors: DataFrame) -> DataFrame:
    out = vectors.select(F.col("id").cast("long").alias("id"), normalised(F.col("embedding")).alias("unit"), F.col("groups").cast("array<string>").alias("groups"))
    return out.filter("id is not null and unit is not null")
