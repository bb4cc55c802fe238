"""Compounds (+ failure tables) -> instruction samples -> shuffle -> ChatML -> splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clean import dedup_first, source_rank, union_wide
from ..functions.text import chatml
from ..operators.instruct import branch_specs, render
from ..operators.splits import split_positional
from ..session import cut_lineage


def combined(compounds: DataFrame, failures: DataFrame | None = None, materialize: bool = True) -> DataFrame:
    """U2 + U3: compounds and failure tables in load order, then one row per structure
    over all of them (the first loaded). Adds ``uid`` and the load order ``ord``.

    Failure rows without a structure key (the tables of the bindings have none) cannot be
    told apart by it and all stay."""
    c = compounds.withColumn("uid", F.col("compound_id")) \
        .withColumn("ord", (source_rank("source") * F.lit(1 << 40) + F.col("row_id")).cast("bigint"))
    parts = [c]
    if failures is not None:
        f = failures.withColumn("uid", F.concat(F.lit("F"), F.col("row_id").cast("string"))) \
            .withColumn("ord", (F.lit(8) * F.lit(1 << 40) + F.col("row_id")).cast("bigint"))
        if "smiles" in f.columns:
            c, f = union_wide([c, f.where(F.col("smiles").isNotNull())]), f.where(F.col("smiles").isNull())
        parts.append(f)
    parts[0] = dedup_first(c, "smiles", ["ord"])
    out = union_wide(parts)
    # Five branches (and the split's count pass) read this table: write it once to the
    # shared checkpoint folder instead of re-running the dedup shuffle per branch.
    return cut_lineage(out, "compounds") if materialize else out


def instruction_dataset(compounds: DataFrame, failures: DataFrame | None = None, seed: int = 42,
                        max_samples: int | None = None, cuts: tuple[float, float] = (0.85, 0.95),
                        with_output: bool = True,
                        caps: tuple[int | None, int | None, int | None] = (None, None, None)) -> DataFrame:
    """Samples with ``text``, a seeded shuffle ``position`` and ``split`` (L3 + T2);
    ``with_output=False`` skips the report texts (instructions and splits only); ``caps``
    as in ``branch_specs``.

    The split ranks the compact per-sample rows; the report texts are rendered
    after it, so the rank shuffle never carries the text."""
    specs = branch_specs(combined(compounds, failures), max_samples, seed, caps)
    # Compact rows (no text yet): rank them, write once, render per task from the table.
    placed = split_positional(specs, "sample_id", cuts, seed, materialize=True)
    # Rendering is CPU-bound per row. A written table of compact rows can land in few
    # files; spread it over the cluster's task slots first (a no-op when the table
    # already has at least that many splits, as at scale).
    slots = placed.sparkSession.sparkContext.defaultParallelism
    if placed.rdd.getNumPartitions() < slots:
        placed = placed.repartition(slots)
    r = render(placed, seed, with_output)
    return r.withColumn("text", chatml("instruction", "input", "output")) if with_output else r
