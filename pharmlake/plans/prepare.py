"""Unified molecules -> validated, deduplicated, balanced, stratified splits.

Shuffles: one for the keep-first dedup (partial aggregate on the structure key),
one for the stratified split (rank inside (label, hash bucket)). Everything else is
narrow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clean import augment, canonicalize, dedup_first, map_label, source_rank, validate
from ..operators.splits import split_stratified
from ..session import cut_lineage


def unified_from_compounds(compounds: DataFrame) -> DataFrame:
    """P1 + P4 on the compounds binding: the five unified columns plus the row order."""
    return compounds.select("smiles", "name", "status", "source", map_label("status").alias("label"), "row_id")


def prepare_molecules(unified: DataFrame, train: float = 0.8, seed: int = 42, min_len: int = 1,
                      max_len: int = 10_000, validator: Callable | None = None, canon: Callable | None = None,
                      variants: Callable | None = None, n_variants: int = 2, order_col: str = "row_id",
                      materialize: bool = False) -> DataFrame:
    """Validate (V1-V4), canonicalise (V4), keep first per structure (U3),
    augment the minority class behind the balance gate (V5, V6), split (T1).

    Output: smiles, name, status, source, label, split."""
    v = validate(unified, "smiles", min_len, max_len, validator)
    v = canonicalize(v, "smiles", canon)
    d = dedup_first(v, "smiles", [source_rank("source"), F.col(order_col)])
    d = augment(d, variants, n_variants)
    if materialize:
        # The split reads this table twice (bucket counts, ranks). Spark reuses the
        # dedup exchange for both (ReusedExchange), so writing it is optional.
        d = cut_lineage(d, "molecules")
    s = split_stratified(d, "label", "smiles", train, seed)
    return s.select("smiles", "name", "status", "source", "label", "split")


def statistics(prepared: DataFrame) -> DataFrame:
    """K3 document content in one row: A1 counts and the per-source counts as a map
    (A2). One pass: counts per (source, split, label), a tiny table, then one aggregate."""
    from pyspark.sql import Window

    small = prepared.groupBy("source", "split", "label").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    small = small.withColumn("__src", F.sum("n").over(Window.partitionBy("source")))
    n, sp, lb = F.col("n"), F.col("split"), F.col("label")
    return small.agg(
        F.sum(n).alias("total_samples"),
        F.coalesce(F.sum(F.when(sp == "train", n)), F.lit(0)).alias("train_samples"),
        F.coalesce(F.sum(F.when(sp == "val", n)), F.lit(0)).alias("val_samples"),
        F.coalesce(F.sum(F.when(sp == "test", n)), F.lit(0)).alias("test_samples"),
        F.coalesce(F.sum(F.when(lb == 1, n)), F.lit(0)).alias("approved_samples"),
        F.coalesce(F.sum(F.when(lb == 0, n)), F.lit(0)).alias("failed_samples"),
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("source", "__src")))).alias("sources"))
