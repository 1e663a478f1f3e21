"""Hard negatives by norm-bucketed maximum inner product search.

An anchor's positives are its best rows of its own label, by inner product; for each positive, its negatives are the best rows of other labels whose
score lies in a window of shares of the positive's. Both are searched alike. Candidates are sorted by norm into bands, then, inside a task, into
buckets, largest first. By Cauchy and Schwarz no row of a bucket scores more than the anchor's norm times the bucket's largest, so a band or bucket is
left out when that is under the window's lower limit or the anchor's running kth score. Bands are left out before anything is sent: a first round
over the band of the largest norms gives each anchor a kth score to begin with.

Anchors travel in blocks, so a task compares at most ``BLOCK`` anchors with ``PART`` candidates and sends on k rows an anchor and window. Bands of equal norms, or of one hot
label, are dealt over tasks by hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .textkit import released

#: Rows of a band on average, until there are MAX_BANDS of them; anchors and candidates that a task compares; rows of a bucket.
BAND_ROWS, MAX_BANDS = 16_384, 256
BLOCK, PART, BUCKET = 1024, 16_384, 512
#: A bound may fall short of a score by rounding.
SLACK = 1 + 1e-9
_FOUND = "uid long, slot int, cand long, cand_id long, score double"


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def best_in(q: np.ndarray, own: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, seed: np.ndarray, c: np.ndarray, cand: np.ndarray, cand_labels: np.ndarray, cand_ids: np.ndarray, k: int, same: bool):
    """(scores, places in ``c``) of the k best candidates of each query and window, -inf and -1 where there are fewer; and how many buckets were compared.

    A candidate counts when its label equals the query's (or differs, for ``same`` False), it isn't the query itself, and 100 times its score lies in the window.
    Scores that aren't above ``seed`` may be left out unless they equal it. Ties go to the smaller ``cand_ids``, then to the smaller ``cand``.
    """
    norm = np.sqrt((c * c).sum(axis=1))
    tie = np.empty(len(c), np.int64)
    tie[np.lexsort((cand, cand_ids))] = np.arange(len(c))
    order = np.lexsort((tie, -norm))
    q_norm = np.sqrt((q * q).sum(axis=1))
    scores, places = np.full((len(q), low.shape[1], k), -np.inf), np.full((len(q), low.shape[1], k), -1)
    buckets = 0
    for at in range(0, len(c), BUCKET):
        b = order[at : at + BUCKET]
        need = np.maximum(np.maximum(low / 100, seed), scores[:, :, -1]).min(axis=1)
        live = np.flatnonzero(q_norm * norm[b[0]] * SLACK >= need)
        if not len(live):
            break  # bounds only fall from here on, and limits only rise
        buckets += 1
        b = b[np.argsort(tie[b])]
        s = q[live] @ c[b].T
        ok = (labels[live][:, None] == cand_labels[b][None, :]) == same
        ok &= own[live][:, None] != cand[b][None, :]
        row = np.arange(len(live))
        for w in range(low.shape[1]):
            left = np.where(ok & (100 * s >= low[live, w][:, None]) & (100 * s <= high[live, w][:, None]), s, -np.inf)
            new_s, new_p = np.full((len(live), k), -np.inf), np.full((len(live), k), -1)
            for j in range(min(k, len(b))):
                i = left.argmax(axis=1)  # the first of equal ones, which has the smallest tie
                new_s[:, j] = left[row, i]
                if not np.isfinite(new_s[:, j]).any():
                    break
                new_p[:, j] = np.where(np.isfinite(new_s[:, j]), b[i], -1)
                left[row, i] = -np.inf
            all_s, all_p = np.concatenate((scores[live, w], new_s), axis=1), np.concatenate((places[live, w], new_p), axis=1)
            top = np.lexsort((np.where(all_p >= 0, tie[all_p], len(c)), -all_s), axis=-1)[:, :k]
            scores[live, w], places[live, w] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_p, top, 1)
    return scores, places, buckets


def _search(k: int, same: bool):
    """A block of queries (uid, label, vec, low, high, seed) and a part of a band (uid, vec_id, label, vec) -> the part's k best of each query and window."""

    @released
    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        if not len(q) or not len(c):
            return pa.table({"uid": pa.array([], pa.int64()), "slot": pa.array([], pa.int32()), "cand": pa.array([], pa.int64()), "cand_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        own, cand, ids = q.column("uid").to_numpy(), c.column("uid").to_numpy(), c.column("vec_id").combine_chunks()
        number: dict[str, int] = {}
        labels, cand_labels = (np.array([number.setdefault(x, len(number)) for x in t.column("label").to_pylist()], np.int64) for t in (q, c))
        order = ids.fill_null(2**63 - 1).to_numpy()
        scores, places, _ = best_in(_matrix(q.column("vec")), own, labels, *(_matrix(q.column(x)) for x in ("low", "high", "seed")), _matrix(c.column("vec")), cand, cand_labels, order, k, same)
        i, w, j = np.nonzero(places >= 0)
        p = places[i, w, j]
        return pa.table({"uid": pa.array(own[i]), "slot": pa.array(w.astype(np.int32)), "cand": pa.array(cand[p]), "cand_id": ids.take(pa.array(p)), "score": pa.array(scores[i, w, j])})

    return run


def _cut(value: Column, cuts: list[float]) -> Column:
    """How many of ``cuts`` (at most MAX_BANDS) are above ``value``."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x > value)) if cuts else F.lit(0)


def _quantiles(df: DataFrame, column: str, n: int, rows: int) -> list[float]:
    parts = min(MAX_BANDS, -(-n // rows))
    return sorted(set(df.approxQuantile(column, [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("uid", "slot").orderBy(F.desc("score"), F.asc_nulls_last("cand_id"), "cand")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _compared(queries: DataFrame, cands: DataFrame, bands: DataFrame, k: int, same: bool) -> DataFrame:
    """Searches the bands of ``bands`` (space, band, n, hi) that a block's queries (with seeds) can't leave out."""
    some = F.zip_with("low", "seed", lambda a, b: F.greatest(a / 100, b))
    need = F.array_min(some)
    q = queries.withColumn("req", F.when(need <= 0, F.lit(0.0)).when(F.col("norm") > 0, need / F.col("norm")).otherwise(F.lit(float("inf"))))
    n = q.count()
    q = q.withColumn("block", _cut(F.col("req"), _quantiles(q.filter("req < double('inf')"), "req", n, BLOCK)))
    sizes = q.groupBy("space", "block").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("q_parts"), F.min("req").alias("req"))
    parts = bands.select("space", "band", "hi", F.ceil(F.col("n") / F.lit(PART)).cast("int").alias("c_parts"))
    pairs = sizes.join(parts, "space").filter(F.col("hi") * SLACK >= F.col("req")).drop("req", "hi")  # a row for each piece of work
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("uid", F.lit(9)), F.col(n)).cast("int")
    q = q.join(pairs, ["space", "block"]).withColumn("q_part", dealt("q_parts")).withColumn("c_part", every("c_parts"))
    c = cands.join(pairs, ["space", "band"]).withColumn("c_part", dealt("c_parts")).withColumn("q_part", every("q_parts"))
    keys = ["space", "block", "band", "q_part", "c_part"]
    new = lambda df, *names: df.select(*(F.col(x).alias(x) for x in names)).groupBy(*keys)  # noqa: E731  both sides come from one table
    return new(q, *keys, "uid", "label", "vec", "low", "high", "seed").cogroup(new(c, *keys, "uid", "vec_id", "label", "vec")).applyInArrow(_search(k, same), _FOUND)


def _top(queries: DataFrame, cands: DataFrame, k: int, same: bool, scratch: Scratch) -> DataFrame:
    """(uid, slot, cand, cand_id, score, rank) of the k best candidates of each query (uid, label, vec, norm, space, low, high) and window among those (uid, vec_id, label, vec, norm, space, band) of its space."""
    bands = scratch.save(cands.groupBy("space", "band").agg(F.count("*").alias("n"), F.max("norm").alias("hi")), "bands")
    first = bands.groupBy("space").agg(F.min("band").alias("band"))
    queries = queries.withColumn("seed", F.transform("low", lambda x: F.lit(float("-inf"))))
    found = scratch.save(_best(_compared(queries, cands, bands.join(first, ["space", "band"]), k, same), k), "found")
    rest = bands.join(first, ["space", "band"], "left_anti")
    if rest.isEmpty():
        return found
    kth = found.filter(F.col("rank") == k).groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))  # an entry a window
    seeded = queries.join(kth, "uid", "left")
    seeded = seeded.withColumn("seed", F.transform("low", lambda x, i: F.coalesce(F.col("kth")[i], F.lit(float("-inf"))))).drop("kth")
    more = _compared(seeded, cands, rest, k, same)
    return scratch.save(_best(found.drop("rank").unionByName(more), k), "found")


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: float = 50, high: float = 95, band_rows: int = BAND_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``vectors`` (vec_id, embedding, label; others are ignored) where ``anchor`` holds.

    An anchor's positives are its first ``positives`` other rows of its label by inner product, ties by smaller vec_id. A positive's negatives are the first ``negatives``
    rows of other labels in that order with low * positive_score <= 100 * negative_score <= high * positive_score. Scores are doubles, exact where the components are
    integers and products stay under 2 ** 53.

    Rows with a null label, a null or empty vector, or a null, NaN or infinite component take no part; vectors of different lengths aren't compared. Rows that repeat
    a vec_id are rows of their own; a null vec_id is no anchor (a condition on it isn't true) and comes last among ties. Positives without negatives, and
    anchors without positives, give no rows; an empty table gives none.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "negatives")
    v = F.col("embedding").cast("array<double>")
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & ~odd)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x))
    rows = scratch.save(rows.withColumns({"norm": norm, "uid": F.monotonically_increasing_id()}), "rows")
    cuts = _quantiles(rows, "norm", rows.count(), band_rows)
    rows = rows.withColumn("band", _cut(F.col("norm"), cuts))
    length = F.size("vec").cast("string")
    mine = F.concat_ws("|", length, "label")
    any_score = lambda x: F.array(F.lit(float(x)))

    queries = rows.filter("anchor").select("uid", "vec_id", "label", "vec", "norm")
    cands = rows.select("uid", "vec_id", "label", "vec", "norm", "band")
    same = _top(queries.withColumns({"space": mine, "low": any_score("-inf"), "high": any_score("inf")}), cands.withColumn("space", mine), positives, True, scratch)
    found = same.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("rank", "cand_id", "score"))).alias("found"))  # at most ``positives`` entries
    # Every anchor has as many windows as positives were asked for, so that a block's windows form a matrix; no score lies in those that are left over.
    limit = lambda share, none: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("found", i)["score"] * share, F.lit(float(none))))
    windows = scratch.save(queries.join(found, "uid").withColumns({"low": limit(low, "inf"), "high": limit(high, "-inf")}), "windows")
    other = _top(windows.withColumn("space", length), cands.withColumn("space", length), negatives, False, scratch)
    named = windows.select("uid", F.col("vec_id").alias("anchor_id"), F.posexplode("found").alias("slot", "p"))
    out = other.join(named, ["uid", "slot"])
    return out.select("anchor_id", F.col("p.cand_id").alias("positive_id"), "rank", F.col("cand_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


def quantized(vectors: DataFrame) -> DataFrame:
    """``vectors`` with each component x as floor(256 x), and the labels of ids divisible by 7 moved on by one of ten."""
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)  # noqa: E731  larger ones are whole already
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vec = F.transform(F.col("embedding").cast("array<double>"), lambda x: whole(256 * x))
    return vectors.select("vec_id", label.alias("label"), vec.alias("embedding"))


#: The rows of op12 in SQL.
ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.uid, a.vec_id AS anchor_id, v.uid AS cand, v.vec_id AS cand_id, v.label = a.label AS same, list_inner_product(a.v, v.v)::BIGINT AS score
  FROM v AS a JOIN v ON a.vec_id % 50 = 0 AND a.uid <> v.uid AND len(a.v) = len(v.v)
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY uid ORDER BY score DESC, cand_id) <= 5
), n AS (
  SELECT p.anchor_id, p.cand_id AS positive_id, row_number() OVER (PARTITION BY p.uid, p.cand ORDER BY s.score DESC, s.cand_id)::INT AS rank,
         s.cand_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.uid = s.uid AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT * FROM n WHERE rank <= 3
"""
