"""Limits, seeded sampling, shuffles and splits (L, T).

Seeded order everywhere: md5('<seed>:<key>') as text, then the key. The same order
is reproducible in any SQL engine with md5, and independent of partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import (
    first_n,
    hash_int,
    sampled_first_n,
    seeded_hash,
    seeded_row_number,
    top_n_per_group,
    with_seeded_bucket,
    _by,
)


def head_n(df: DataFrame, n: int, key: Sequence[Column | str]) -> DataFrame:
    """L1: first n rows in key order (whatever n, no task holds more than a range)."""
    return first_n(df, key, n)


def cap_rows(df: DataFrame, n: int, key: Sequence[Column | str]) -> DataFrame:
    """Source or small-run row cap (first n in key order)."""
    return first_n(df, key, n)


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """L2: seeded sample of min(n, rows) without replacement: the first n by seeded hash
    (a TakeOrdered, or for a large n a selection by the hash's histogram)."""
    return sampled_first_n(df, key, n, seed)


def shuffle(df: DataFrame, key: str, seed: int = 42, name: str = "position") -> DataFrame:
    """L3: seeded full shuffle: the 1-based position of every row."""
    return seeded_row_number(df, key, seed, name)


def pick_index(key: Column | str, n: int, seed: int = 42) -> Column:
    """L4: 0-based choice among n options, derived from the seeded hash of the key."""
    return (hash_int(seeded_hash(key, seed)) % F.lit(n)).cast("int")


def cap_per(df: DataFrame, cat: str, n: int, order: Sequence[Column | str]) -> DataFrame:
    """At most n rows per category, the first n in order (exact, salted two rounds)."""
    return top_n_per_group(df, [cat], order, n).drop("rn")


def split_positional(df: DataFrame, key: str, cuts: tuple[float, float] = (0.85, 0.95),
                     seed: int = 42, materialize: bool = False) -> DataFrame:
    """Shuffle by the seeded order, then cut at floor(c1 * n) and floor(c2 * n)
    (double arithmetic, as the reference). Adds ``position`` and ``split``.

    Rows are ranked inside hash buckets; bucket offsets come from per-bucket counts
    (at most 16^4 rows, broadcast). With ``materialize`` the bucket-ranked rows are
    written once (shared checkpoint folder) and the counts are read from that table,
    so the input is computed once instead of once per pass."""
    h = "__h"
    # Reuse a seeded bucket computed upstream (see ranking.with_seeded_bucket).
    tmp = df if {"__h", "__b"} <= set(df.columns) else with_seeded_bucket(df, key, seed)
    w = Window.partitionBy("__b").orderBy(F.col(h), F.col(key))
    local = tmp.withColumn("__l", F.row_number().over(w))
    if materialize:
        from ..session import cut_lineage

        local = cut_lineage(local, "positional")
    counts = local.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    wcum = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.partitionBy()
    offsets = counts.select("__b", F.coalesce(F.sum("__n").over(wcum), F.lit(0)).alias("__off"),
                            F.sum("__n").over(wall).alias("__total"))
    offsets, same = _by(["__b"], offsets)
    ranked = local.join(F.broadcast(offsets), same)
    pos = (F.col("__l") + F.col("__off")).cast("bigint")
    c1 = F.floor(F.lit(float(cuts[0])) * F.col("__total").cast("double"))
    c2 = F.floor(F.lit(float(cuts[1])) * F.col("__total").cast("double"))
    return (ranked.withColumn("position", pos)
            .withColumn("split", F.when(F.col("position") <= c1, "train").when(F.col("position") <= c2, "val")
                        .otherwise("test"))
            .drop(h, "__b", "__k___b", "__l", "__off", "__total"))


def _idiv(a: Column, b: Column) -> Column:
    """Integer division; 0 when the divisor is 0."""
    return F.when(b == 0, F.lit(0).cast("bigint")).otherwise(F.floor(a.cast("decimal(38,0)") / b).cast("bigint"))


def _largest_remainder(counts: DataFrame, label: str, size_col: str, total_col: str, part_total: str,
                       out: str) -> DataFrame:
    """Quota per label: floor(size * n_c / total) plus one for the labels with the
    largest remainders (ties by label), so quotas sum to ``size`` exactly.
    Integer arithmetic only. ``counts`` is one row per label (tiny)."""
    num = F.col(part_total) * F.col(size_col)
    base = _idiv(num, F.col(total_col))
    rem = num - base * F.col(total_col)
    c = counts.withColumn("__base", base).withColumn("__rem", rem)
    wall = Window.partitionBy()
    c = c.withColumn("__left", F.col(size_col) - F.sum("__base").over(wall))
    c = c.withColumn("__rk", F.row_number().over(Window.orderBy(F.col("__rem").desc(), F.col(label))))
    return c.withColumn(out, F.col("__base") + F.when(F.col("__rk") <= F.col("__left"), 1).otherwise(0)) \
        .drop("__base", "__rem", "__left", "__rk")


def split_stratified(df: DataFrame, label: str, key: str, train: float = 0.8, seed: int = 42) -> DataFrame:
    """Stratified train/val/test split with exact sizes.

    holdout = ceil(n * (1 - train)) in exact decimal arithmetic; test = ceil(holdout / 2);
    val = the rest. Both cuts are shared among labels by largest remainder. Within a
    label rows are taken in the seeded order: the first test_c rows are test, the
    next val_c are val. 8091 rows at train 0.8 give 6472 / 809 / 810.

    One aggregate over the data: counts per (label, hash bucket). From that table
    (at most #labels x 16^4 rows) come the bucket offsets, the class totals and the
    quotas; rows are ranked inside (label, bucket) and joined to it. Null labels are a label,
    null keys a hash bucket: no row is lost.
    """
    fr = Fraction(str(train))
    num, den = fr.numerator, fr.denominator
    tmp = with_seeded_bucket(df, key, seed)
    counts = tmp.groupBy(label, "__b").agg(F.count(F.lit(1)).cast("bigint").alias("__n"))
    wcum = Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(label, "__b", F.coalesce(F.sum("__n").over(wcum), F.lit(0)).alias("__off"))
    per = counts.groupBy(label).agg(F.sum("__n").cast("bigint").alias("__nc"))  # one row per class
    wall = Window.partitionBy()
    per = per.withColumn("__n", F.sum("__nc").over(wall))
    per = per.withColumn("__hold", _idiv(F.col("__n") * F.lit(den - num) + F.lit(den - 1), F.lit(den)))
    per = _largest_remainder(per, label, "__hold", "__n", "__nc", "__hq")
    per = per.withColumn("__test", _idiv(F.col("__hold") + 1, F.lit(2)))
    per = _largest_remainder(per, label, "__test", "__hold", "__hq", "__tq")
    quotas, same = _by([label], per.select(label, "__hq", "__tq"))
    side = offsets.join(quotas, same).drop(f"__k_{label}")
    side, same = _by([label, "__b"], side)  # labels x buckets rows: Spark chooses by its size
    w = Window.partitionBy(label, "__b").orderBy(F.col("__h"), F.col(key))
    ranked = tmp.withColumn("__l", F.row_number().over(w)).join(side, same)
    rn = F.col("__l") + F.col("__off")
    return (ranked.withColumn("split", F.when(rn <= F.col("__tq"), "test").when(rn <= F.col("__hq"), "val")
                              .otherwise("train"))
            .drop("__h", "__b", "__l", "__off", "__hq", "__tq", f"__k_{label}", "__k___b"))


def split_stats(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows and share per split."""
    g = df.groupBy(split).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def kfold(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """T4: stratified fold id = (rank within label in seeded order - 1) mod k."""
    r = seeded_row_number(df, key, seed, "__rn", partition=[label])
    return r.withColumn("fold", ((F.col("__rn") - 1) % k).cast("int")).drop("__rn")
