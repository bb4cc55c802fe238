"""Sharding by sampled splitters.

A record's key orders records by a hash of the text, then by a hash of doc_id, so equal
texts are neighbours and a hot text can still be divided. A size-weighted sample of keys
(``samples`` records are drawn in expectation) gives quantile boundaries of many narrow
ranges; exact sizes of the ranges are counted, ranges over twice the mean are divided by
boundaries of a fresh sample drawn from them alone, until none is overfull or a range
holds one key. Inside each range records are ordered by key; the exact size before each
record then puts it into the shard whose share of all bytes it falls into.

Law `bytes`: sizes of shards are near equal. Equal texts stay in one shard unless the group holds more
than ``whole`` of a shard's share; such a group is divided record by record.

Defined cases: null text has no bytes (size 8) and the CRC of the empty text; repeated
rows are separate records; null doc_id is hashed as null; extra columns are ignored; an
empty table gives no rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import stored

DOC_BITS = 24  # low bits of the key: hash of doc_id; high bits: hash of the text


def records(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id"), text.alias("text"))
    key = F.shiftleft(F.shiftrightunsigned(F.xxhash64("text"), DOC_BITS + 1), DOC_BITS).bitwiseOR(
        F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - DOC_BITS))
    return d.select("doc_id", (F.octet_length("text") + 8).cast("long").alias("size"),
                    F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"), key.alias("key"))


def splitters(rows: DataFrame, total: int, parts: int, samples: int, seed: int) -> list[int]:
    """At most parts - 1 boundaries from a size-weighted sample of keys. A boundary that
    does not repeat is moved down to the first key of its text."""
    weight = F.col("size") * (samples / max(total, 1))
    u = F.shiftrightunsigned(F.xxhash64("key", "doc_id", F.lit(seed)), 11) / float(1 << 53)
    drawn = rows.select("key", (F.floor(weight) + (u < weight - F.floor(weight)).cast("int")).cast("int").alias("n"))
    drawn = drawn.where("n > 0").select(F.explode(F.array_repeat("key", F.col("n"))).alias("key"))
    cuts = [i / parts for i in range(1, parts)]
    got = drawn.agg(F.percentile_approx("key", cuts, 10 * parts).alias("b")).first()["b"] or []
    texts = [b >> DOC_BITS for b in got]
    return sorted({b if texts.count(t) > 1 else t << DOC_BITS for b, t in zip(got, texts)})


def range_of(bounds: list[int]):
    b = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def f(key):
        import pandas as pd

        return pd.Series(np.searchsorted(b, key.to_numpy(), side="right").astype(np.int32))

    return f("key")


def shard(docs: DataFrame, shards: int = 24, ranges_per_shard: int = 16, range_bytes: int = 256 << 20,
          max_ranges: int = 1 << 14, samples_per_range: int = 64, whole: float = 0.01, seed: int = 9) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot)."""
    rows = stored(records(docs), "records")
    total = rows.agg(F.sum("size")).first()[0] or 0
    parts = int(min(max_ranges, max(shards * ranges_per_shard, -(-total // range_bytes))))
    samples = parts * samples_per_range
    bounds = splitters(rows, total, parts, samples, seed)
    for turn in range(1, 9):
        sums = rows.groupBy(range_of(bounds).alias("r")).agg(
            F.sum("size").alias("size"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        over = [r for r in sums.where((F.col("size") > 2 * total // parts) & (F.col("lo") < F.col("hi"))).collect()]
        if not over:
            break
        finer = []
        for r in over:
            pieces = int(min(1024, max(2, -(-r["size"] * parts // total))))
            inside = rows.where(F.col("key").between(r["lo"], r["hi"])) if len(over) <= 4 else None
            if inside is None:  # many overfull ranges: halve each between its ends, no further pass
                finer.append((r["lo"] + r["hi"] + 1) // 2)
            else:
                finer += splitters(inside, r["size"], pieces, pieces * samples_per_range, seed + turn)
        more = sorted(set(bounds) | set(finer))
        if more == bounds:
            break
        bounds = more

    rows = rows.withColumn("r", range_of(bounds)).withColumn("group", F.shiftright("key", DOC_BITS))
    order = W.partitionBy("r").orderBy("key", "doc_id", "size")
    group = W.partitionBy("r", "group")
    ranked = stored(
        rows.withColumn("before", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("before", F.coalesce("before", F.lit(0)))
        .withColumn("n", F.row_number().over(order).cast("long"))
        .withColumn("group_bytes", F.sum("size").over(group)).withColumn("group_before", F.min("before").over(group)),
        "ranked")
    per_range = ranked.groupBy("r").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    earlier = W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)  # at most max_ranges + divisions rows
    offsets = per_range.select("r", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
                               F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"))
    share = max(total, 1) / shards
    start = F.col("bytes_before") + F.when(F.col("group_bytes") <= whole * share, F.col("group_before")).otherwise(F.col("before"))
    placed = ranked.join(F.broadcast(offsets), "r").select(
        "doc_id", "size", "text_crc32", (F.col("rows_before") + F.col("n") - 1).alias("place"),
        F.least(F.lit(shards - 1), F.floor(start / share)).cast("int").alias("shard"))
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))
