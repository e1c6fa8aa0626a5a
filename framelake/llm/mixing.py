"""Mixing sources to target weights, with DataFrame functions only.

Each source is one stream of words (its documents behind one another), cut into blocks of a fixed number of words. The
mix has as many slots of a source as its target needs; each slot falls into an output shard by a pseudorandom draw, which
makes the counts of a source over the shards multinomial while its total keeps to the target. Slots of a source are
numbered shard by shard and go through a keyed permutation of the source's block numbers (swap-or-not rounds, a bijection
for any number of blocks), one permutation for each pass over the source. Blocks are then joined by their number.

No source is gathered in one task: offsets are prefix sums over (source, bucket of documents), and slots are made in
ranges of a bounded length.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, n_words, reused

#: Weights of the sources in order of their names, repeating, and the share of all words that the mix has.
WEIGHTS, SHARE, REPEATS = (3, 1, 2), (3, 2), 2
ROUNDS = 8


class Mix(NamedTuple):
    """sources: key, source, source_size, target, blocks, slots. slots: key, shard, slot, epoch, block. pieces: a row for each document and block that it has words in. documents: each with its place in its source's stream."""

    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame
    documents: DataFrame


def source_key(column: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(column)), F.lit("n"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Targets of all sources: the mix's words by weight, none above REPEATS times the source, the excess reshared.

    A source is at its limit if limit / weight is at most what is left for each unit of weight after the smaller
    ratios have their limits; whole numbers keep this exact. The window has one row for each source.
    """
    big = lambda c: c.cast("decimal(38,0)")
    every, order = W.partitionBy(), W.orderBy("ratio", "n")
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("n", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("n") - 1) % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", REPEATS * F.col("source_size")).withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    s = s.withColumn("whole", F.sum("source_size").over(every) * SHARE[0])  # times SHARE[1]
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("rest", F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("full", big(SHARE[1] * F.col("cap")) * big(F.col("rest")) <= big(F.col("w")) * big(F.col("whole") - SHARE[1] * F.col("before")))
    s = s.withColumn("left", F.col("whole") - SHARE[1] * F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every))
    s = s.withColumn("open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(every))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("w") * F.col("left")).cast("double") / (SHARE[1] * F.col("open")).cast("double"))
    return s.select(source_key().alias("key"), "source", "source_size", target.alias("target"))


def permuted(x: Column, n: Column, *key: str, seed: int = 0) -> Column:
    """x sent through a keyed permutation of 0 .. n-1: swap-or-not rounds, folded so that the expression stays small."""

    def swap(x: Column, r: Column) -> Column:
        y = F.pmod(F.pmod(F.xxhash64(*key, F.lit(seed), r), n) - x, n)
        return F.when(F.xxhash64(F.greatest(x, y), *key, F.lit(seed), r + ROUNDS).bitwiseAND(1) == 1, y).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), x, swap)


def mix(docs: DataFrame, *, block_words: int = 64, shard_slots: int = 1 << 16, weights: tuple[int, ...] = WEIGHTS, seed: int = 17) -> Mix:
    """The mix of the documents (doc_id, text, source; other columns are ignored).

    Null text: no words. Null source: a source of its own, the last. Repeated rows count as often as they stand. An
    empty table gives empty frames. Documents without words have no piece.
    """
    sized = reused(docs.select("doc_id", "source", n_words().alias("size"), F.xxhash64("text").alias("mark")))  # tells rows without an id apart
    n_docs = sized.count()
    buckets = max(1, math.ceil(n_docs / 2_000))

    n, m = F.col("source_size"), F.lit(block_words)
    sources = source_targets(sized, weights)
    sources = sources.withColumn("blocks", F.ceil(n / m).cast("long"))
    passes = F.when(n > 0, F.floor(F.col("target") / n)).otherwise(0).cast("long")
    part = F.when(n > 0, F.least(F.floor((F.col("target") - passes * n) / m + 0.5).cast("long"), F.col("blocks"))).otherwise(0)
    sources = cut(sources.withColumn("slots", passes * F.col("blocks") + part), n_docs)

    # Where each document starts: sums over (source, bucket), then within each.
    d = sized.withColumn("key", source_key()).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(buckets)))
    sums = d.groupBy("key", "bucket").agg(F.sum("size").alias("in_bucket"))
    ahead = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("key", "bucket", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0)).alias("ahead"))
    within = W.partitionBy("key", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size", "mark").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums, ["key", "bucket"])
    d = d.select("doc_id", "source", "key", "size", (F.col("ahead") + F.col("within")).alias("start"))

    last = F.col("start") + F.col("size")
    pieces = d.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / m), F.floor((last - 1) / m))))
    pieces = pieces.withColumn("words", F.least(last, (F.col("block") + 1) * m) - F.greatest(F.col("start"), F.col("block") * m))

    total = sources.agg(F.sum("slots")).first()[0] or 0
    shards, span = max(1, math.ceil(total / shard_slots)), 8192
    parts = max(1, total // 50_000)  # rows grow in the tasks below, so their number is set by what they make
    ranges = sources.where("slots > 0").withColumn("range", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / span))))
    ranges = ranges.repartition(parts, "key", "range")
    drawn = ranges.select("key", F.explode(F.sequence(F.col("range") * span, F.least(F.col("slots"), (F.col("range") + 1) * span) - 1)).alias("draw"))
    counts = drawn.groupBy("key", F.pmod(F.xxhash64("key", "draw", F.lit(seed)), F.lit(shards)).alias("shard")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("to", F.sum("n").over(W.partitionBy("key").orderBy("shard")))
    slots = counts.repartition(parts, "key", "shard").select("key", "shard", F.explode(F.sequence(F.col("to") - F.col("n"), F.col("to") - 1)).alias("slot"))
    slots = slots.join(sources.select("key", "blocks"), "key")
    slots = slots.withColumn("epoch", F.floor(F.col("slot") / F.col("blocks"))).withColumn("block", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), "key", "epoch", seed=seed))
    return Mix(sources, slots.select("key", "shard", "slot", "epoch", "block"), pieces, d)


def taken(mixed: Mix) -> DataFrame:
    """Documents with the words that the mix takes of them: doc_id, source, size, source_size, target, taken."""
    uses = mixed.slots.groupBy("key", "block").agg(F.count("*").alias("uses"))
    some = mixed.pieces.join(uses, ["key", "block"], "left").groupBy("key", "start", "doc_id", "source", "size")
    some = some.agg(F.coalesce(F.sum(F.col("words") * F.col("uses")), F.lit(0)).cast("long").alias("taken"))
    none = mixed.documents.where("size = 0").select("key", "start", "doc_id", "source", "size", F.lit(0).cast("long").alias("taken"))
    out = some.unionByName(none).join(mixed.sources.select("key", "source_size", "target"), "key")
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")
