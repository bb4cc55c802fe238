"""Sinks (K1-K4). Outputs are folders of part files written by the executors; no
result passes through the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """K1: CSV with a header; ``partition_by=['split']`` writes one folder per split."""
    w = df.write.mode(mode).option("header", "true").option("escape", '"')
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_jsonl(df: DataFrame, path: str, cols: Sequence[str] | None = None, partition_by: Sequence[str] = (),
                mode: str = "overwrite") -> None:
    """K2: JSON lines of a column subset; non-ASCII text is written as is
    (UTF-8), null fields are written as null."""
    out = df.select(*(list(cols) + list(partition_by))) if cols else df
    w = out.write.mode(mode).option("encoding", "UTF-8").option("ignoreNullFields", "false")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def write_stats(stats: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K3: a one-row statistics frame as one JSON document."""
    stats.coalesce(1).select(F.to_json(F.struct(*stats.columns)).alias("value")).write.mode(mode).text(path)


def write_metrics(metrics: DataFrame, path: str, per_sample: DataFrame | None = None,
                  sample_path: str | None = None, mode: str = "overwrite") -> None:
    """K4: metrics document(s) and optional per-sample results."""
    metrics.write.mode(mode).option("ignoreNullFields", "false").json(path)
    if per_sample is not None and sample_path:
        per_sample.write.mode(mode).option("ignoreNullFields", "false").json(sample_path)
