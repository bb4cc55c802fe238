"""Nested records: the parse is planned once, and string leaves keep their tolerance."""

import json

from pyspark.sql import functions as F

from pharmlake.sources import nested as N


def test_record_is_parsed_once_under_filters(spark):
    rows = [("IC50", "5", "C"), ("IC50", "n/a", "C"), ("EC50", "7", ""), ("ED50", "7", "C")]
    df = spark.createDataFrame(rows, "kind string, value string, smiles string")
    made = df.select(F.to_json(F.struct(F.col("kind").alias("standard_type"), F.col("value").alias("standard_value"),
                                        F.lit("nM").alias("standard_units"), F.lit("=").alias("standard_relation"),
                                        F.col("smiles").alias("canonical_smiles"))).alias("record"))
    out = N.bioactivity(N.records(made, "record", N.ACTIVITY_SCHEMA))
    assert [(r.activity_type, r.activity_value) for r in out.collect()] == [("IC50", 5.0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") == 1
    assert plan.count("struct<molecule_chembl_id") + plan.count("StructField(activity_id,LongType") <= 2


def test_string_leaves_that_look_like_json(spark):
    texts = ["{a}", "[1]", "", "x", {"a": 1}, [1], 5, True, None]
    lines = [json.dumps({"k": i, "s": t, "o": {"s": t, "n": t}, "l": [{"s": t}]}) for i, t in enumerate(texts)]
    lines += [json.dumps({"k": 20, "o": "no object", "l": {"s": "one"}}), "[1]", "7", "not json", "null"]
    df = spark.createDataFrame([(x,) for x in lines], "record string")
    schema = "k int, s string, o struct<s: string, n: int>, l array<struct<s: string>>"
    got = {r.k: r for r in N.records(df, "record", schema).collect()}
    kept = ["{a}", "[1]", "", "x", None, None, "5", "true", None]
    assert [got[i].s for i in range(9)] == kept
    assert [got[i].o.s for i in range(9)] == kept
    assert [got[i].l[0].s for i in range(9)] == kept
    assert [got[i].o.n for i in (3, 6)] == [None, 5]
    assert got[20].s is None and got[20].o is None and got[20].l[0].s == "one" and len(got) == 10
