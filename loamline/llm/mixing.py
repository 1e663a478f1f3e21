"""Mixing sources to target weights, in DataFrame expressions only.

Each source's documents are laid end to end and cut into blocks of a fixed number of words. The mix is a row of output shards of
fixed-length slots. Each shard draws its source counts from the multinomial of the target shares; slots are numbered by source over shards, and the
few that the draws put over a source's number (the sampling error) go to sources that fell short, so totals are as planned. The k-th slot of a
source takes the block at place k of the source's own permutation, a new permutation for every full pass, and slots and blocks are joined
by source and index.

Permutations are swap-or-not shuffles (Hoang, Morris and Rogaway, 2012): a few hashes for each index, any
length, no sort and no state. All numbers follow from the seed and the rows, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .quality_rules import let

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: A source's blocks have this many words, less where it has under 128 blocks, so that whole blocks meet small targets within a percent.
BLOCK_WORDS, LEAST_BLOCKS = 64, 128
SHARD_SLOTS = 4096
ROUNDS = 12
#: Rows of a bucket, whose places are one running total.
BUCKET_ROWS = 2000
#: Shards whose draws share one running total.
BATCH_SHARDS = 1024


def permute(index: Column, length: Column, *key: Column, seed: int) -> Column:
    """The image of ``index`` under a permutation of [0, ``length``) that ``seed`` and ``key`` choose."""

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(seed), r, *key), length) - x, length)
        coin = F.xxhash64(F.lit(seed + 7), r, *key, F.greatest(x, partner))
        return F.when(coin.bitwiseAND(F.lit(1).cast("bigint")) == 1, partner).otherwise(x)

    return F.aggregate(F.array(*(F.lit(r) for r in range(ROUNDS))), index.cast("bigint"), step)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int, block_words: int) -> DataFrame:
    """(source, source_size) -> one row a source with s_no, target, block_len, n_blocks, n_slots, first_slot and all_slots.

    Targets are shares of all words by weight, clipped at ``most`` times the source: the level that fills up the words is
    the largest of (words - what sources of smaller ratios can give) / (weights of the rest), in order of ratio.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("s_no") - 1, F.lit(len(weights)))).cast("double")
    df = sizes.withColumn("s_no", F.row_number().over(by_name)).withColumn("weight", w).withColumn("cap", most * F.col("source_size").cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "s_no")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    df = df.withColumn("_level", level).withColumn("target", F.least("cap", F.col("weight") * F.max("_level").over(every)))
    df = df.withColumn("target", F.greatest(F.lit(0.0), "target"))
    df = df.withColumn("block_len", F.greatest(F.lit(1), F.least(F.lit(block_words), F.expr(f"source_size div {LEAST_BLOCKS}"))).cast("long"))
    df = df.withColumn("n_blocks", F.expr("(source_size + block_len - 1) div block_len"))
    slots = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("long"), most * F.col("n_blocks")))
    df = df.withColumn("n_slots", F.coalesce(slots, F.lit(0).cast("long")))
    running = Window.orderBy("s_no").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("first_slot", F.coalesce(F.sum("n_slots").over(running), F.lit(0).cast("long")))
    return df.withColumn("all_slots", F.sum("n_slots").over(every)).drop("_level", "cap")


def lay_out(docs: DataFrame, weights: tuple[int, ...], most: int, block_words: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(documents with their place in their source, sources).

    Running totals are taken within buckets of a source and added up over buckets, so a hot source is spread over many tasks.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    src = src.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("text_hash"))
    src = scratch.save(src, "sizes")
    buckets = max(1, math.ceil(src.count() / BUCKET_ROWS))
    src = src.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(buckets)))
    part = src.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sources = scratch.save(source_targets(part.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, most, block_words), "sources")
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "bucket_size")
    part = part.withColumn("_from", F.coalesce(F.sum("bucket_size").over(before), F.lit(0).cast("long"))).drop("bucket_size")
    own = Window.partitionBy("source", "bucket").orderBy("doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = src.withColumn("_own", F.coalesce(F.sum("size").over(own), F.lit(0).cast("long")))
    placed = placed.join(part, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    placed = placed.withColumn("start", F.col("_from") + F.col("_own")).drop("_s", "_b", "_from", "_own", "bucket")
    mine = sources.select(F.col("source").alias("_s"), "s_no", "source_size", "target", "block_len")
    return scratch.save(placed.join(mine, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "placed"), sources


def shard_draws(sources: DataFrame, seed: int, shard_slots: int, scratch: Scratch) -> DataFrame:
    """(shard, s_no, n): how many slots of each output shard are of each source, a multinomial draw with the sources' shares of all slots.

    Each slot's hash falls into one source's interval of all slots. Intervals are found by cells of equal width, about four a source,
    so the join is by equal keys whatever the number of sources.
    """
    spark = sources.sparkSession
    total = sources.agg(F.max("all_slots").alias("n"), F.count("*").alias("s")).first()  # one row
    every = total["n"] or 0
    width = max(1, every // (4 * max(1, total["s"])))
    cells = sources.filter("n_slots > 0").select("s_no", "first_slot", (F.col("first_slot") + F.col("n_slots")).alias("end_slot"))
    cells = cells.withColumn("cell", F.explode(F.sequence(F.expr(f"first_slot div {width}"), F.expr(f"(end_slot - 1) div {width}"))))
    cells = scratch.save(cells, "cells")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = spark.range(0, -(-every // shard_slots), 1, tasks).withColumnRenamed("id", "shard")
    last = F.least(F.lit(shard_slots), F.lit(every) - F.col("shard") * shard_slots) - 1
    slots = slots.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    slots = slots.select("shard", F.pmod(F.xxhash64(F.lit(seed), "shard", "slot"), F.lit(max(1, every))).alias("x")).withColumn("cell", F.expr(f"x div {width}"))
    drawn = slots.join(cells, "cell").filter("x >= first_slot and x < end_slot")
    return drawn.groupBy("shard", "s_no").agg(F.count("*").alias("n"))


def slot_plan(sources: DataFrame, seed: int, shard_slots: int = SHARD_SLOTS, scratch: Scratch | None = None) -> DataFrame:
    """One row for each slot of the mix: shard, slot, s_no, k (which of its source's slots), pass_no and block (index in the source).

    Shards' counts are numbered through by source, so the k-th slot of a source stands in a shard that its draw chose. Draws leave sources
    a little over or short of their slots; what the last shards drew beyond a source's number goes to sources that are short.
    """
    scratch = scratch or Scratch(sources.sparkSession, "plan")
    draws = scratch.save(shard_draws(sources, seed + 1, shard_slots, scratch), "draws").withColumn("batch", F.expr(f"shard div {BATCH_SHARDS}"))
    # Numbers before each shard, by batches of shards, so that no window holds all shards of a source.
    sums = draws.groupBy("s_no", "batch").agg(F.sum("n").alias("batch_n"))
    before = Window.partitionBy("s_no").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_from", F.coalesce(F.sum("batch_n").over(before), F.lit(0).cast("long"))).drop("batch_n")
    own = Window.partitionBy("s_no", "batch").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    place = Window.partitionBy("shard").orderBy("s_no").rowsBetween(Window.unboundedPreceding, -1)  # a row a source
    draws = draws.withColumn("_own", F.coalesce(F.sum("n").over(own), F.lit(0).cast("long"))).withColumn("at", F.coalesce(F.sum("n").over(place), F.lit(0).cast("long")))
    draws = draws.join(sums, ["s_no", "batch"]).select("shard", "s_no", "n", "at", (F.col("_from") + F.col("_own")).alias("first_k"))
    # One row a source: what it drew beyond its slots, or lacks, numbered through over all sources.
    drawn = draws.groupBy("s_no").agg(F.sum("n").alias("drawn"))
    some = sources.select("s_no", "n_slots", "n_blocks").join(drawn, "s_no", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("long")))
    running = Window.orderBy("s_no").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    some = some.withColumn("over", F.greatest(zero, F.col("drawn") - F.col("n_slots"))).withColumn("short", F.greatest(zero, F.col("n_slots") - F.col("drawn")))
    some = some.withColumn("over_from", F.coalesce(F.sum("over").over(running), zero)).withColumn("short_from", F.coalesce(F.sum("short").over(running), zero))
    some = scratch.save(some, "corrections")
    draws = scratch.save(draws.join(some.select("s_no", "n_slots", "n_blocks", "over_from"), "s_no"), "numbered")

    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows become many: a given number isn't coalesced
    kept = draws.filter("first_k < n_slots").repartition(tasks, "shard")
    kept = kept.withColumn("k", F.explode(F.sequence("first_k", F.least(F.col("first_k") + F.col("n"), "n_slots") - 1)))
    kept = kept.select("shard", (F.col("at") + F.col("k") - F.col("first_k")).alias("slot"), "s_no", "k", "n_blocks")
    over = draws.filter("first_k + n > n_slots").withColumn("k", F.explode(F.sequence(F.greatest("first_k", "n_slots"), F.col("first_k") + F.col("n") - 1)))
    over = over.select("shard", (F.col("at") + F.col("k") - F.col("first_k")).alias("slot"), (F.col("over_from") + F.col("k") - F.col("n_slots")).alias("j"))
    short = some.filter("short > 0").withColumn("i", F.explode(F.sequence(zero, F.col("short") - 1)))
    short = short.select((F.col("short_from") + F.col("i")).alias("j"), "s_no", (F.col("drawn") + F.col("i")).alias("k"), "n_blocks")
    plan = kept.unionByName(over.join(short, "j").drop("j")).withColumn("pass_no", F.expr("k div n_blocks"))
    block = permute(F.col("k") % F.col("n_blocks"), F.col("n_blocks"), F.col("s_no"), F.col("pass_no"), seed=seed)
    return plan.select("shard", "slot", "s_no", "k", "pass_no", block.alias("block"))


def document_blocks(placed: DataFrame) -> DataFrame:
    """One row for each block that a document has words in: from_word (in the document) and n of these words."""
    last = F.expr("(start + size - 1) div block_len")
    df = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.expr("start div block_len"), last)))
    lo = F.greatest("start", F.col("block") * F.col("block_len"))
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("block_len"))
    return df.withColumn("from_word", lo - F.col("start")).withColumn("n", hi - lo)


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, block_words: int = BLOCK_WORDS, seed: int = 20240601, scratch: Scratch | None = None
) -> DataFrame:
    """doc_id, size, source_size, target and taken for each row of ``docs`` (doc_id, source, text; others are ignored).

    ``n_slots`` and ``first_shard`` say how many slots of the mix have words of the row and the first output shard that does (null if none).
    Null texts have size 0 and are never taken; null sources are one source, the last; repeated rows and null ids each have their own
    place. An empty table gives no rows; a corpus without words has targets of 0.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    placed, sources = lay_out(docs, weights, most, block_words, scratch)
    drawn = slot_plan(sources, seed, scratch=scratch).groupBy("s_no", "block").agg(F.count("*").alias("times"), F.min("shard").alias("shard"))
    parts = document_blocks(placed).join(drawn.hint("merge"), ["s_no", "block"], "left")  # both sides grow with the corpus
    out = ["doc_id", "size", "source_size", "target"]
    times, zero = F.coalesce("times", F.lit(0).cast("long")), F.lit(0).cast("long")
    taken = parts.groupBy("s_no", "start", *out).agg(F.sum(F.col("n") * times).alias("taken"), F.sum(times).alias("n_slots"), F.min("shard").alias("first_shard"))
    none = placed.filter("size = 0").select(*out, zero.alias("taken"), zero.alias("n_slots"), F.lit(None).cast("long").alias("first_shard"))
    return taken.drop("s_no", "start").unionByName(none)


def shard_parts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, block_words: int = BLOCK_WORDS, seed: int = 20240601, scratch: Scratch | None = None) -> DataFrame:
    """The mix by shard: (shard, slot, source, doc_id, from_word, n) for each document that a slot's block has words of, in the block's order by from_place.

    Texts without words and null texts give no rows; null sources are one source; repeated rows and null ids each have their own place. An empty table gives none.
    """
    scratch = scratch or Scratch(docs.sparkSession, "shards")
    placed, sources = lay_out(docs, weights, most, block_words, scratch)
    parts = slot_plan(sources, seed, scratch=scratch).join(document_blocks(placed).hint("merge"), ["s_no", "block"])
    return parts.select("shard", "slot", "source", "doc_id", "from_word", "n", (F.col("start") + F.col("from_word")).alias("from_place"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, block_words: int = BLOCK_WORDS, seed: int = 20240601, scratch: Scratch | None = None) -> DataFrame:
    """The mixed corpus in the columns of ``docs``: for each pass, what it takes of a document, with n_chars set where there is such a column.

    A document that a pass takes whole keeps its text; else the words it takes stay in order, with the white space after each. Null texts and texts without words are never
    taken; null sources are one source; repeated rows and null ids each have their own place; columns of any other name stay. An empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mixture")
    placed, sources = lay_out(docs, weights, most, block_words, scratch)
    parts = document_blocks(placed).join(slot_plan(sources, seed, scratch=scratch).hint("merge"), ["s_no", "block"])
    # A row is told from others with its id by its text and source, and equal rows by number.
    same = ["_id", "text_hash", "source"]
    number = F.row_number().over(Window.partitionBy(*same).orderBy("start"))
    placed = placed.filter("size > 0").withColumn("_id", F.coalesce("doc_id", "text_hash")).withColumn("_no", number)
    ranges = parts.groupBy("s_no", "start", "pass_no").agg(F.array_sort(F.collect_list(F.struct("from_word", "n"))).alias("_ranges"), F.sum("n").alias("_n"))
    ranges = scratch.save(placed.select(*same, "_no", "s_no", "start", "size").join(ranges.hint("merge"), ["s_no", "start"]).drop("s_no", "start"), "ranges")
    whole = docs.select(
        F.struct(*(F.col(c) for c in docs.columns)).alias("_doc"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))).alias("_id"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("source").cast("string").alias("_source"),
    )
    whole = whole.withColumn("_no", F.row_number().over(Window.partitionBy("_id", "text_hash", "_source").orderBy(F.lit(0))))
    ranges = ranges.select(F.col("_id").alias("_i"), F.col("text_hash").alias("_t"), F.col("source").alias("_s"), F.col("_no").alias("_k"), "size", "_ranges", "_n")
    got = whole.join(
        ranges, (F.col("_id") == F.col("_i")) & (F.col("text_hash") == F.col("_t")) & F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_no") == F.col("_k"))
    )
    spaced = F.regexp_extract_all("_doc.text", F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))  # words with the white space behind
    some = F.aggregate(  # ranges that follow each other are one
        "_ranges", F.array().cast("array<struct<a:bigint,b:bigint>>"),
        lambda acc, r: F.when(F.get(acc, F.size(acc) - 1)["b"] == r["from_word"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.get(acc, F.size(acc) - 1)["a"].alias("a"), (r["from_word"] + r["n"]).alias("b")))))
        .otherwise(F.concat(acc, F.array(F.struct(r["from_word"].alias("a"), (r["from_word"] + r["n"]).alias("b"))))),
    )
    cut = let(spaced, lambda w: F.array_join(F.transform(some, lambda r: F.array_join(F.slice(w, (r["a"] + 1).cast("int"), (r["b"] - r["a"]).cast("int")), "")), ""))
    got = got.withColumn("_text", F.when(F.col("_n") < F.col("size"), cut).otherwise(F.col("_doc.text")))
    put = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return got.select(*(put[c].alias(c) if c in put else F.col("_doc")[c].alias(c) for c in docs.columns))
