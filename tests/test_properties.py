"""Property tests on random inputs against plain pandas references (few examples:
each runs Spark jobs)."""

import math
from decimal import Decimal

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pharmlake.operators import clean as C
from pharmlake.operators import ranking as RK
from pharmlake.operators.splits import split_stratified

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(counts=st.lists(st.integers(min_value=0, max_value=40), min_size=1, max_size=3),
       train=st.sampled_from(["0.7", "0.8", "0.85", "0.9"]))
def test_stratified_split_sizes(spark, counts, train):
    rows = [(f"k{c}_{i}", c) for c, n in enumerate(counts) for i in range(n)]
    n = len(rows)
    if n == 0:
        return
    df = spark.createDataFrame(rows, "key string, label int")
    s = split_stratified(df, "label", "key", float(train))
    got = {(r["label"], r["split"]): r["count"] for r in s.groupBy("label", "split").count().collect()}
    hold = math.ceil(Decimal(n) * (1 - Decimal(train)))
    test = math.ceil(hold / 2)
    tot = {sp: sum(v for (lb, sp2), v in got.items() if sp2 == sp) for sp in ("train", "val", "test")}
    assert tot == {"train": n - hold, "val": hold - test, "test": test}
    for c, nc in enumerate(counts):
        h = got.get((c, "val"), 0) + got.get((c, "test"), 0)
        assert abs(h - nc * hold / n) < 1  # largest remainder keeps each class within one row


@SETTINGS
@given(data=st.lists(st.tuples(st.one_of(st.none(), st.sampled_from("abcde")), st.sampled_from(["chembl", "drugbank", "fda_failed"])),
                     min_size=1, max_size=40))
def test_dedup_first_matches_pandas(spark, data):
    rows = [(i, k, s) for i, (k, s) in enumerate(data)]
    df = spark.createDataFrame(rows, "row_id int, smiles string, source string")
    got = sorted(r.row_id for r in C.dedup_first(df, "smiles", [C.source_rank("source"), F.col("row_id")]).collect())
    pdf = pd.DataFrame(rows, columns=["row_id", "smiles", "source"])
    pdf["rank"] = pdf["source"].map({"chembl": 0, "drugbank": 1, "fda_failed": 2})
    exp = sorted(pdf.sort_values(["rank", "row_id"]).drop_duplicates("smiles", keep="first")["row_id"].tolist())
    assert got == exp


@SETTINGS
@given(vals=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 20)), min_size=1, max_size=60),
       n=st.integers(1, 5))
def test_top_n_per_group_matches_pandas(spark, vals, n):
    rows = [(i, g, v) for i, (g, v) in enumerate(vals)]
    df = spark.createDataFrame(rows, "k int, g int, v int")
    got = sorted(r.k for r in RK.top_n_per_group(df, ["g"], [F.col("v").desc(), "k"], n, salt=4).collect())
    pdf = pd.DataFrame(rows, columns=["k", "g", "v"]).sort_values(["g", "v", "k"], ascending=[True, False, True])
    exp = sorted(pdf.groupby("g").head(n)["k"].tolist())
    assert got == exp
