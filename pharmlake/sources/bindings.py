"""Bindings: the reference's input tables expressed over the driver's parquet tables.

Each binding is a lazy projection of one scan (plus one join for ``scored``), so
filters and column pruning of the queries built on top reach the parquet reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _mod(c: Column, m: int) -> Column:
    return c % F.lit(m)


def compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified compound table from ``part``: null, sentinel and duplicate keys,
    both sides of the weight/logP limits and null properties."""
    p = table(spark, sf_dir, "part")
    k, size, ptype = F.col("p_partkey"), F.col("p_size"), F.col("p_type")
    smiles = (
        F.when(_mod(k, 19) == 0, F.lit(None).cast("string"))
        .when(_mod(k, 13) == 0, F.lit("N/A (Antibody)"))
        .when(_mod(k, 31) == 0, F.lit("NC[C@H](N)O"))
        .otherwise(F.concat(F.repeat(F.lit("C"), (1 + _mod(size, 6)).cast("int")), F.lit("(=O)N"),
                            F.repeat(F.lit("c"), _mod(k, 97).cast("int"))))
    )
    source = (F.when(ptype.isin("ECONOMY", "STANDARD", "LARGE"), "chembl")
              .when(ptype == "PROMO", "drugbank").when(ptype == "SMALL", "fda_failed")
              .otherwise("fda_novel"))
    status = (F.when(ptype.isin("ECONOMY", "STANDARD"), "approved").when(ptype == "LARGE", "failed")
              .when(ptype == "SMALL", "withdrawn").when(ptype == "MEDIUM", "experimental")
              .when(_mod(size, 2) == 0, "approved").otherwise("withdrawn"))
    return p.select(
        k.alias("row_id"),
        F.concat(F.lit("CMP"), k.cast("string")).alias("compound_id"),
        F.col("p_name").alias("name"),
        smiles.alias("smiles"),
        source.alias("source"),
        status.alias("status"),
        _mod(k, 5).cast("int").alias("max_phase"),
        F.when(_mod(k, 29) == 0, F.lit(None).cast("double"))
        .otherwise((100 + _mod(k * 37, 700)).cast("double")).alias("molecular_weight"),
        F.when(_mod(k, 23) == 0, F.lit(None).cast("double"))
        .otherwise((size - 8).cast("double") / 8).alias("alogp"),
        _mod(k, 14).cast("int").alias("hba"),
        _mod(k, 8).cast("int").alias("hbd"),
        (size * 4).cast("double").alias("psa"),
        _mod(k, 13).cast("int").alias("rtb"),
        _mod(k, 3).cast("int").alias("num_ro5_violations"),
        (_mod(k, 101).cast("double") / 100).alias("qed_weighted"),
        (_mod(k, 9) == 0).alias("natural_product"),
    )


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial failures and withdrawals from ``orders``."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    prio = F.col("o_orderpriority")
    return o.select(
        k.alias("row_id"),
        F.concat(F.lit("Trial "), k.cast("string")).alias("name"),
        F.when(F.col("o_orderstatus") == "F", "Phase III").when(F.col("o_orderstatus") == "O", "Phase II")
        .otherwise("Post-market").alias("phase_failed"),
        F.when(_mod(k, 7) == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Signal in arm "), F.col("o_custkey").cast("string"))).alias("failure_reason"),
        F.when(_mod(k, 3) == 0, F.lit("Safety")).alias("warning_type"),
        F.when(prio == "1-URGENT", "Cardiotoxicity").when(prio == "2-HIGH", "Hepatotoxicity")
        .when(prio == "3-MEDIUM", "Lack of Efficacy").when(prio == "5-LOW", "Cardiovascular/Liver")
        .otherwise("Pharmacokinetics").alias("failure_category"),
        F.when(_mod(k, 2) == 0, "clinical_trial_failures").otherwise("drug_withdrawals").alias("source"),
        F.year("o_orderdate").cast("int").alias("year"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with model scores; ``lang`` stands for the model name."""
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    j = lab.join(docs, "doc_id")
    bucket = F.col("n_chars") % 97
    return j.select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("model"),
        F.col("quality").alias("label"),
        (bucket.cast("double") / 97).alias("score"),
        F.when(bucket >= 30, 1).otherwise(0).alias("pred"),
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions: the 64-element embedding used as logits, ``label`` as class."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label"),
                    F.col("embedding").cast("array<double>").alias("logits"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    cid = F.col("conv_id")
    return c.select(
        cid, F.col("turn"),
        F.concat(F.lit("type"), (cid % 5).cast("string")).alias("prompt_type"),
        F.col("text").alias("response"),
        F.length("text").alias("response_length"),
        F.when(cid % 6 == 0, F.lit("")).when(cid % 2 == 0, F.lit("the,tion,zzz")).otherwise(F.lit("er,Of"))
        .alias("keywords"),
    )


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation loss per (run, epoch); epoch is the event's position within its user
    (a two-level rank: a user with a third of all events is spread over buckets)."""
    from ..operators.history import rank_in

    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    r = rank_in(ev, ["user_id"], ["ts", "event_id"], "epoch")
    return r.select(F.col("user_id").alias("run_id"), F.col("epoch"), (F.col("value") / 100).alias("val_loss"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("run_id"), F.col("l_linenumber").alias("epoch"),
        F.col("l_discount").alias("loss"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("correct"), F.lit(1).alias("total"),
    )


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("checkpoint"),
                    F.col("o_orderdate").alias("saved_at"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "props")
