"""User-function hooks, the baseline, tolerant nested records and rules over NaN."""

import json

import pytest
from pyspark.sql import functions as F

from pharmlake import api
from pharmlake.functions import rules as R
from pharmlake.operators import baseline as B
from pharmlake.operators import clean as C
from pharmlake.operators import hooks as X
from pharmlake.sources import nested as N


def test_scorer_is_loaded_once_per_worker(spark, tmp_dir):
    def load():
        import os
        import uuid

        open(f"{tmp_dir}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def scorer(a, b):
            import numpy as np

            assert len(a) <= 7
            return np.stack([a + b, a - b, a * 0 + len(a)], axis=1)

        return scorer

    df = spark.range(1000).selectExpr("id", "if(id % 10 = 3, null, cast(id as double)) a", "2.0D b").repartition(6)
    got = {r.id: r.logits for r in X.score_batches(df, load, "id", 7, ("a", "b")).collect()}
    assert len(got) == 1000 and all((got[i] is None) == (i % 10 == 3) for i in got)
    assert got[12][:2] == [14.0, 10.0] and max(x[2] for x in got.values() if x) <= 7
    import os

    loads = [name.split("-")[0] for name in os.listdir(tmp_dir)]
    assert 1 <= len(loads) == len(set(loads))
    none = X.score_batches(df.where("id < 0"), load, "id", 7, ("a", "b"))
    assert none.collect() == [] and dict(none.dtypes)["logits"] == "array<double>"


def test_alternative_spellings_of_the_minority(spark):
    rows = [(f"C{i}", "src", 0) for i in range(9)] + [("AB(=O)", "src", 1), ("AA", "src", 1), ("AA", "src", 1)]
    df = spark.createDataFrame(rows, "smiles string, source string, label int")
    got = C.augment(df, lambda s, n: [s, s[::-1], s.lower(), s.lower()][: n + 1], 2)
    extra = sorted(r.smiles for r in got.collect() if r.source == "src_aug")
    assert extra == sorted([")O=(BA", "ab(=o)", "aa", "aa"]) and got.count() == 16
    even = df.where("label = 1").unionByName(df.where("label = 0").limit(3))
    assert C.augment(even, lambda s, n: [s[::-1]], 2).count() == even.count()


def test_baseline_beats_the_majority_and_repeats(spark):
    rows = [(f"{'CCN' if i % 3 else 'OOS'}{'cn'[i % 2] * (1 + i % 5)}{i}", int(i % 3 == 0)) for i in range(240)] + [(None, 1)]
    df = spark.createDataFrame(rows, "smiles string, label int")
    model, scores = B.cross_validate(df.repartition(5), folds=3, regs=(0.01, 1.0), num_features=256, max_iter=8)
    again, same = B.cross_validate(df.repartition(2), folds=3, regs=(0.01, 1.0), num_features=256, max_iter=8)
    assert [round(s, 6) for _, s in scores] == [round(s, 6) for _, s in same] and max(s for _, s in scores) > 0.95
    out = B.predict(model, df).collect()
    assert len(out) == 240
    assert sum(r.pred == r.label for r in out) / 240 > 160 / 240 + 0.2  # the majority class has 160 of 240
    assert {r.smiles: r.pred for r in out} == {r.smiles: r.pred for r in B.predict(again, df).collect()}


def test_records_tolerate_changed_types(spark, tmp_dir):
    lines = [{"application_number": "A1", "sponsor_name": 7, "products": [{"brand_name": "b", "active_ingredients": [{"name": "x"}, {"name": None}]},
                                                                         "not a product", {"brand_name": {"odd": 1}, "active_ingredients": []}]},
             {"application_number": "A2", "products": {"brand_name": "single", "active_ingredients": {"name": 5, "strength": 2.5}}},
             {"application_number": ["list"], "products": "none"}, {"other": 1}, [1, 2], 5, None]
    with open(f"{tmp_dir}/a.json", "w") as f:
        f.write("\n".join(json.dumps(x) for x in lines))
    raw = spark.createDataFrame([(json.dumps(x),) for x in lines] + [("{broken",), (None,)], "record string")
    for df in (N.records(raw, "record", N.DRUGSFDA_SCHEMA), N.read_records(spark, f"{tmp_dir}/a.json", N.DRUGSFDA_SCHEMA)):
        assert df.count() == 4
        flat = sorted((r.application_number, r.brand_name, r.generic_name, r.strength, r.sponsor_name) for r in N.flatten_drugsfda(df).collect())
        assert flat == [("A1", "b", "", "", "7"), ("A1", "b", "x", "", "7"), ("A2", "single", "5", "2.5", "")]
    assert N.records(raw.limit(0), "record", N.DRUGSFDA_SCHEMA).collect() == []
    molecule = {"molecule_chembl_id": "M", "max_phase": "4", "molecule_structures": {"canonical_smiles": "C"},
                "molecule_properties": {"full_mwt": 12.5, "alogp": "NaN", "hba": "3", "hbd": "many"}}
    row = N.flatten_molecules(N.records(spark.createDataFrame([(json.dumps(molecule),)], "record string"), "record", N.MOLECULE_SCHEMA),
                              "approved").first()
    assert (row.max_phase, row.molecular_weight, row.alogp, row.hba, row.hbd, row.name) == (4, 12.5, None, 3, None, "")


def test_rules_take_nan_as_missing(spark):
    cols = "molecular_weight double, alogp double, psa double, hba int, hbd int, rtb int, num_ro5_violations int"
    null = spark.createDataFrame([(None, None, None, 1, 1, 1, 0)], cols)
    nan = spark.createDataFrame([(float("nan"),) * 3 + (1, 1, 1, 0)], cols)
    rules = {**R.admet_rules(), **R.range_flags(), "lipinski": R.lipinski(), "veber": R.veber(), "tier": R.likeness_tier()}
    a, b = ([r.asDict() for r in df.select(*[v.alias(k) for k, v in rules.items()]).collect()] for df in (null, nan))
    assert a == b


def test_sources_without_their_columns_are_skipped(spark, tmp_dir):
    files = {"a.csv": "smiles,name,status\nC,one,approved\n", "b.csv": "id,name,status\n1,two,failed\n",
             "c.csv": "NAME,Smiles,extra\nthree,CC,x\n"}
    for name, text in files.items():
        with open(f"{tmp_dir}/{name}", "w") as f:
            f.write(text)
    got = api.load_sources(spark, {"s": [f"{tmp_dir}/{n}" for n in files], "t": [f"{tmp_dir}/none.csv"]},
                           "smiles string, name string, status string").collect()
    assert sorted((r.smiles, r.name, r.status, r.source) for r in got) == [("C", "one", "approved", "s"), ("CC", "three", None, "s")]


@pytest.mark.parametrize("value,hit", [("a", 1), ("z", 0), (None, 0)])
def test_lookup_by_size(spark, value, hit):
    from pharmlake.operators.joins import lookup

    table = spark.createDataFrame([("a", 1)], "k string, v int")
    got = lookup(spark.createDataFrame([(value,)], "k string"), table, "k", "v", 0)
    assert got.first().v == hit and F is not None
