"""The stateless rule columns run unchanged on a file stream (availableNow)."""

import os

from pyspark.sql import functions as F

from pharmlake.sources import bindings as B
from pharmlake.streaming.rules_stream import run_once


def test_rules_on_file_stream(spark, tmp_dir):
    comp = B.compounds(spark, "/root/testdata/sf0.001").select("row_id", "smiles", "status", "max_phase",
                                                               "molecular_weight", "alogp", "hba", "hbd", "rtb", "psa")
    src = os.path.join(tmp_dir, "in")
    comp.repartition(3).write.parquet(src)
    sink, ckpt = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ckpt")
    run_once(spark, src, comp.schema.simpleString()[7:-1].replace(":", " "), sink, ckpt)
    out = spark.read.parquet(sink)
    assert out.count() == comp.count()
    batch = comp.where(F.col("status") == "approved").count()
    assert out.where(F.col("prediction") == "APPROVED").count() >= batch
