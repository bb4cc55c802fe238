"""Joins (J1-J5). Spark picks the strategy by measured sizes; no side is hinted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import first_n, row_number_by_key


def pair_by_rank(a: DataFrame, b: DataFrame, key: str, n: int | None = None, prefixes: tuple[str, str] = ("d1_", "d2_"),
                 cols: Sequence[str] | None = None) -> DataFrame:
    """I-th row of ``a`` with the i-th row of ``b`` (order of ``key``, any type), as many
    pairs as the shorter side; an empty side gives none. Both sides are ranked over sampled
    ranges; with ``n``, the first n of each are selected instead."""
    cols = list(cols) if cols is not None else a.columns
    ra, rb = (first_n(x.select(*cols), [key], n, "pair_rank") if n else row_number_by_key(x.select(*cols), key, "pair_rank")
              for x in (a, b))
    ra = ra.select("pair_rank", *[F.col(c).alias(prefixes[0] + c) for c in cols])
    rb = rb.select("pair_rank", *[F.col(c).alias(prefixes[1] + c) for c in cols])
    return ra.join(rb, "pair_rank")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """Left join to a lookup table + default for misses. Spark broadcasts the table
    where its measured size is small, and joins by sorting where it is not."""
    return (df.join(table.select(key, F.col(value).alias("__v")), key, "left")
            .withColumn(value, F.coalesce(F.col("__v"), F.lit(default))).drop("__v"))


def first_available(a: DataFrame, b: DataFrame, key: str = "metric", value: str = "value",
                    wanted: DataFrame | None = None) -> DataFrame:
    """Value from A, else from B, else missing ('N/A' in ``origin``).

    ``wanted`` lists the keys to report (default: keys of A or B)."""
    aa = a.select(key, F.col(value).alias("__a"))
    bb = b.select(key, F.col(value).alias("__b"))
    j = aa.join(bb, key, "full_outer")
    if wanted is not None:
        j = wanted.select(key).join(j, key, "left")
    return j.select(key, F.coalesce("__a", "__b").alias(value),
                    F.when(F.col("__a").isNotNull(), "A").when(F.col("__b").isNotNull(), "B")
                    .otherwise("N/A").alias("origin"))


def align(labels: DataFrame, preds: DataFrame, id_col: str = "id") -> DataFrame:
    """Labels with predictions on an id (the reference pairs them by position)."""
    return labels.join(preds, id_col, "inner")


def against_baseline(long: DataFrame, baseline: str, id_col: str = "model") -> DataFrame:
    """Every model's metric next to the baseline's (one row per metric on the
    baseline side; Spark chooses the join by its size)."""
    base = long.where(F.col(id_col) == baseline).select("metric", F.col("value").alias("baseline_value"))
    j = long.join(base, "metric")
    return j.withColumn("delta", F.col("value") - F.col("baseline_value"))
