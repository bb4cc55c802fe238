"""Command-line jobs: the three end-to-end flows with their sinks.

    python -m pharmlake.jobs prepare  --tables /root/testdata/sf0.01 --out /path/prepared
    python -m pharmlake.jobs instruct --tables /root/testdata/sf0.01 --out /path/instruct
    python -m pharmlake.jobs evaluate --tables /root/testdata/sf0.01 --out /path/metrics

``--tables`` is a folder of parquet tables read through the bindings. On a cluster,
submit with spark-submit; the session's own settings (including
``spark.checkpoint.dir``) are used as given.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import sinks
from .plans.evaluation import evaluate_predictions, response_table
from .plans.instruct_set import instruction_dataset
from .plans.prepare import prepare_molecules, statistics, unified_from_compounds
from .session import ensure_checkpoint_dir
from .sources import bindings as B


def run_prepare(spark: SparkSession, tables: str, out: str, train: float = 0.8, seed: int = 42) -> None:
    """Splits as CSV (one folder per split), the full table, and the statistics document.
    The prepared table is written once (splits) and the full table and statistics are
    read back from it, so the preparation runs once."""
    p = prepare_molecules(unified_from_compounds(B.compounds(spark, tables)), train=train, seed=seed)
    sinks.write_csv(p, f"{out}/splits", partition_by=["split"])
    from .sources.readers import read_csv

    schema = "smiles string, name string, status string, source string, label int"
    p = read_csv(spark, f"{out}/splits", schema + ", split string")
    sinks.write_csv(p.drop("split"), f"{out}/full_dataset")
    sinks.write_stats(statistics(p), f"{out}/dataset_stats")


def run_instruct(spark: SparkSession, tables: str, out: str, seed: int = 42, max_samples: int | None = None) -> None:
    """Instruction samples as CSV and JSONL per split, plus task counts."""
    d = instruction_dataset(B.compounds(spark, tables), B.failures(spark, tables), seed, max_samples)
    sinks.write_csv(d.select("instruction", "input", "output", "task_type", "source", "text", "split"),
                    f"{out}/csv", partition_by=["split"])
    sinks.write_jsonl(d, f"{out}/jsonl", cols=["text", "instruction", "output", "task_type"], partition_by=["split"])
    counts = d.groupBy("task_type").agg(F.count(F.lit(1)).alias("count"))
    sinks.write_metrics(counts, f"{out}/task_counts")


def run_evaluate(spark: SparkSession, tables: str, out: str) -> None:
    """Per-model classification and ranking metrics; response metrics."""
    scored = B.scored(spark, tables).withColumnRenamed("score", "pos_prob")
    sinks.write_metrics(evaluate_predictions(scored, ("model",)), f"{out}/model_metrics")
    r = response_table(B.responses(spark, tables))
    from .operators.metrics import per_type, response_metrics, success_rate

    sinks.write_metrics(response_metrics(r), f"{out}/response_metrics", per_type(r), f"{out}/per_type")
    sinks.write_metrics(success_rate(r), f"{out}/success_rate")


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="pharmlake.jobs")
    ap.add_argument("job", choices=["prepare", "instruct", "evaluate"])
    ap.add_argument("--tables", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--seed", type=int, default=42)
    ap.add_argument("--train", type=float, default=0.8)
    ap.add_argument("--max-samples", type=int, default=None)
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName(f"pharmlake-{a.job}").getOrCreate()
    ensure_checkpoint_dir(spark)
    if a.job == "prepare":
        run_prepare(spark, a.tables, a.out, a.train, a.seed)
    elif a.job == "instruct":
        run_instruct(spark, a.tables, a.out, a.seed, a.max_samples)
    else:
        run_evaluate(spark, a.tables, a.out)


if __name__ == "__main__":
    main()
