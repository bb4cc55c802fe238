"""End-to-end jobs write their outputs (sf0.001)."""

import json
import os

from pharmlake import jobs
from pharmlake.sources import readers as RD

SF = "/root/testdata/sf0.001"


def test_prepare_job(spark, tmp_dir):
    jobs.run_prepare(spark, SF, tmp_dir)
    stats = json.loads(spark.read.text(f"{tmp_dir}/dataset_stats").first().value)
    assert stats["total_samples"] == stats["train_samples"] + stats["val_samples"] + stats["test_samples"]
    assert sum(stats["sources"].values()) == stats["total_samples"]
    assert os.path.isdir(f"{tmp_dir}/splits/split=train")


def test_instruct_job(spark, tmp_dir):
    jobs.run_instruct(spark, SF, tmp_dir)
    j = RD.read_jsonl(spark, f"{tmp_dir}/jsonl", "text string, instruction string, output string, task_type string")
    assert j.count() == spark.read.json(f"{tmp_dir}/task_counts").groupBy().sum("count").first()[0]
    assert j.where("text not like '<|im_start|>user%'").count() == 0


def test_evaluate_job(spark, tmp_dir):
    jobs.run_evaluate(spark, SF, tmp_dir)
    m = spark.read.json(f"{tmp_dir}/model_metrics")
    assert set(m.columns) >= {"model", "accuracy", "roc_auc", "pr_auc", "macro_f1"}


def test_full_dataset_written(spark, tmp_dir):
    jobs.run_prepare(spark, SF, tmp_dir)
    full = RD.read_csv(spark, f"{tmp_dir}/full_dataset", "smiles string, name string, status string, source string, label int")
    parts = RD.read_csv(spark, f"{tmp_dir}/splits", "smiles string, name string, status string, source string, label int, split string")
    assert full.count() == parts.count() > 0


def test_api_entry_points(spark):
    from pyspark.sql import functions as F

    from pharmlake import api
    from pharmlake.plans.prepare import unified_from_compounds
    from pharmlake.sources import bindings as B

    comp = B.compounds(spark, SF)
    train, val, test = api.prepare_dataset(unified_from_compounds(comp))
    assert train.count() > val.count() > 0
    prompts = api.analyze_drug(comp.select("smiles", "name")).select("prompt").first().prompt
    assert prompts.startswith("Analyze this drug candidate") or prompts.startswith("⚠️")
    r = api.generate_property_response(comp).select("response").first().response
    assert r.startswith("## Molecular Property Analysis")
    s = api.score_logits(B.logits(spark, SF))
    assert api.compute_classification_metrics(s.withColumn("label", (F.col("label") == 1).cast("int"))).count() == 1
