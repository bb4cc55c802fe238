"""Mixing sources to target weights, DataFrame functions only.

A source's share of all tokens is raised to an exponent and normalised. The exponent is
found by bisection: the largest that reaches the target entropy, or the smallest that
repeats no source more often than the limit. Every source then fills a quota of
weight x budget tokens with whole epochs and a part of one more; each epoch is a fresh
permutation of the source's documents, cut where the quota is filled. Positions in the
quota deal every source evenly over blocks of ``block_tokens`` tokens, and each block is
permuted.

Without a budget the smallest one that leaves no document unused is taken (the source
with the least weight per token gets exactly one epoch).

A document's tokens are its words (runs without white space) and an end token. Defined
cases: null text is the empty text (one token); a null source is a source of its own;
repeated rows are separate documents, in or out together at the cut; ties in the
permutation are ordered by doc_id; null doc_id is hashed as null; extra columns are kept
by ``mix``; an empty table gives no rows. One row per source comes to the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import stored


def tokens(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return (F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")) + 1).cast("long")


def weights(sizes: list[int], exponent: float) -> list[float]:
    total = sum(sizes)
    raised = [(s / total) ** exponent for s in sizes]
    return [r / sum(raised) for r in raised]


def entropy(p: list[float]) -> float:
    return -sum(x * math.log(x) for x in p if x > 0)


def repeats(sizes: list[int], p: list[float], budget: float | None) -> list[float]:
    """Epochs of each source."""
    budget = budget or max(s / x for s, x in zip(sizes, p))
    return [budget * x / s for s, x in zip(sizes, p)]


def bisect_exponent(sizes: list[int], target_entropy: float | None, max_repeats: float | None,
                    budget: float | None) -> float:
    """Both measures fall as the exponent grows from 0 (equal weights) to 1 (shares as they
    are). target_entropy: share of the entropy of equal weights."""
    if len(sizes) < 2:
        return 1.0

    def flat_enough(e):
        return entropy(weights(sizes, e)) >= target_entropy * math.log(len(sizes))

    def within(e):
        return max(repeats(sizes, weights(sizes, e), budget)) <= max_repeats

    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if target_entropy is not None:
            lo, hi = (mid, hi) if flat_enough(mid) else (lo, mid)
        else:
            lo, hi = (lo, mid) if within(mid) else (mid, hi)
    return lo if target_entropy is not None else hi


def permuted(seed: int) -> Column:
    """Place of a document in its source's permutation for an epoch: 63 bits."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", "epoch", F.lit(seed)), 1)


def schedule(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = 2.0,
             budget: int | None = None, block_tokens: int = 1 << 20, bucket_rows: int = 100_000,
             seed: int = 3) -> DataFrame:
    """One row per copy used: doc_id, source, tokens, weight, epoch, place, block, slot."""
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give target_entropy or max_repeats")
    base = stored(docs.select("doc_id", "source", tokens(F.col("text")).alias("tokens")), "tokens")
    per_source = base.groupBy("source").agg(F.sum("tokens").alias("size"), F.count("*").alias("rows"))
    found = per_source.collect()
    sizes = [r["size"] for r in found]
    if not sizes:
        exponent, goal, buckets = 1.0, 1.0, 1
    else:
        exponent = bisect_exponent(sizes, target_entropy, max_repeats, budget)
        p = weights(sizes, exponent)
        goal = float(budget or max(s / x for s, x in zip(sizes, p)))
        buckets = 1 << min(16, max(0, (max(r["rows"] for r in found) // bucket_rows).bit_length()))
    blocks = max(1, -(-int(goal) // block_tokens))
    everything = W.partitionBy()  # one row per source
    share = F.col("size") / F.sum("size").over(everything)
    sources = per_source.select("source", "size", share.alias("share"))
    sources = sources.withColumn("raised", F.pow("share", F.lit(exponent)))
    sources = sources.withColumn("weight", F.col("raised") / F.sum("raised").over(everything))
    # a quota that misses whole epochs by rounding only is whole
    quota = F.round(F.col("weight") * F.lit(goal)).cast("long")
    sources = sources.select(F.col("source").alias("s"), "size", "weight", F.greatest(quota, F.lit(1)).alias("quota"))
    copies = base.join(sources, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    last = F.ceil(F.col("quota") / F.col("size")).cast("int") - 1
    copies = copies.withColumn("epoch", F.explode(F.sequence(F.lit(0), last))).withColumn("place", permuted(seed))
    copies = copies.withColumn("bucket", F.shiftright("place", 63 - (buckets.bit_length() - 1)) if buckets > 1 else F.lit(0))
    # tokens before each bucket of an epoch, then before each document of the bucket
    sums = copies.groupBy("source", "epoch", "bucket").agg(F.sum("tokens").alias("n"))
    earlier = W.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("bucket").alias("b"),
                       F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = W.partitionBy("source", "epoch", "bucket").orderBy("place").rangeBetween(W.unboundedPreceding, -1)
    ranked = copies.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    ranked = ranked.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e"))
                         & (F.col("bucket") == F.col("b")))
    ranked = ranked.withColumn("at", F.col("epoch") * F.col("size") + F.col("before") + F.col("inside"))
    used = ranked.where(F.col("at") < F.col("quota"))
    used = used.withColumn("block", F.floor(F.col("at") / F.col("quota") * blocks).cast("long"))
    mixed = W.partitionBy("block").orderBy(F.xxhash64("place", F.lit(seed)), "source", "doc_id")
    return used.select("doc_id", "source", "tokens", "weight", "epoch", "place", "quota", "size", "block",
                       F.row_number().over(mixed).cast("long").alias("slot"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents as often as the schedule uses them, all columns kept: whole epochs
    and, of the last, the documents up to the place where the quota was filled."""
    seed = options.get("seed", 3)
    plan = schedule(docs, **options)
    ends = plan.groupBy("source", "quota", "size").agg(
        F.max("epoch").alias("last"), F.max(F.struct("epoch", "place")).alias("end"))
    ends = stored(ends.select(F.col("source").alias("_source"), "last", F.col("end.place").alias("end"),
                              (F.col("quota") % F.col("size") == 0).alias("whole")), "cuts")
    named = docs.withColumn("_row", F.struct(*docs.columns))
    copies = (named.select("_row", "doc_id", "source").join(ends, F.col("source").eqNullSafe(F.col("_source")))
              .withColumn("epoch", F.explode(F.sequence(F.lit(0), "last")))
              .where((F.col("epoch") < F.col("last")) | F.col("whole") | (permuted(seed) <= F.col("end"))))
    return copies.select("_row.*")
