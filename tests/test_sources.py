"""Unit tests for sources and sinks on small landed files (fresh temporary folders)."""

import json
import os

from pyspark.sql import functions as F

from pharmlake.sources import nested as N
from pharmlake.sources import readers as RD
from pharmlake.sources.curated import load_curated
from pharmlake import sinks as K


def _jsonl(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        for r in rows:
            f.write(json.dumps(r, ensure_ascii=False) + "\n")
    return path


def test_flatten_molecules(spark, tmp_dir):
    p = _jsonl(f"{tmp_dir}/mol.jsonl", [
        {"molecule_chembl_id": "C1", "pref_name": "A", "max_phase": 4, "first_approval": 1990,
         "molecule_structures": {"canonical_smiles": "CCO"},
         "molecule_properties": {"full_mwt": "46.07", "alogp": "-0.03", "hba": 1, "hbd": 1, "psa": "20.2"}},
        {"molecule_chembl_id": "C2", "pref_name": None, "molecule_structures": {"canonical_smiles": "CCN"}},
        {"molecule_chembl_id": "C3", "molecule_structures": None},
        {"molecule_chembl_id": "C4", "molecule_structures": {"canonical_smiles": ""}},
        {"molecule_chembl_id": "C5", "molecule_structures": {"canonical_smiles": "CC"},
         "molecule_properties": {"full_mwt": "n/a"}},
    ])
    df = N.flatten_molecules(spark.read.schema(N.MOLECULE_SCHEMA).json(p), "approved")
    rows = {r.chembl_id: r for r in df.collect()}
    assert set(rows) == {"C1", "C2", "C5"}
    assert rows["C1"].molecular_weight == 46.07 and rows["C1"].status == "approved"
    assert rows["C2"].name == "" and rows["C2"].molecular_weight is None
    assert rows["C5"].molecular_weight is None  # non-numeric value -> null


def test_flatten_compounds_ro5(spark, tmp_dir):
    p = _jsonl(f"{tmp_dir}/c.jsonl", [
        {"molecule_chembl_id": "C1", "molecule_structures": {"canonical_smiles": "CCO"},
         "molecule_properties": {"num_ro5_violations": 0}},
        {"molecule_chembl_id": "C2", "molecule_structures": {"canonical_smiles": "CCC"},
         "molecule_properties": {"num_ro5_violations": 2}},
        {"molecule_chembl_id": "C3", "molecule_structures": {"canonical_smiles": "CCN"}}])
    rows = {r.chembl_id: r for r in N.flatten_compounds(spark.read.schema(N.MOLECULE_SCHEMA).json(p)).collect()}
    assert rows["C1"].ro5_compliant is True and rows["C2"].ro5_compliant is False and rows["C3"].ro5_compliant is None
    assert rows["C3"].natural_product is False and rows["C3"].max_phase == 0


def test_bioactivity_filters(spark, tmp_dir):
    base = {"canonical_smiles": "CCO", "standard_units": "nM", "standard_relation": "=", "standard_type": "IC50"}
    p = _jsonl(f"{tmp_dir}/act.jsonl", [
        {**base, "molecule_chembl_id": "A", "standard_value": "12.5", "activity_id": 1},
        {**base, "molecule_chembl_id": "B", "standard_value": "abc", "activity_id": 2},
        {**base, "molecule_chembl_id": "C", "standard_value": "3", "standard_units": "uM", "activity_id": 3},
        {**base, "molecule_chembl_id": "D", "standard_value": "3", "standard_type": "Potency", "activity_id": 4},
        {**base, "molecule_chembl_id": "E", "standard_value": "7", "canonical_smiles": None, "activity_id": 5},
        {**base, "molecule_chembl_id": "F", "standard_value": "7", "standard_relation": ">", "activity_id": 6},
        {**base, "molecule_chembl_id": "G", "standard_value": "8", "standard_type": "Kd", "activity_id": 7}])
    out = N.bioactivity(spark.read.schema(N.ACTIVITY_SCHEMA).json(p), limit=10).collect()
    assert [(r.chembl_id, r.activity_value) for r in out] == [("A", 12.5), ("G", 8.0)]
    assert out[0].target_id == ""


def test_projections_mechanism_indication_metabolism_warning(spark, tmp_dir):
    m = N.flatten_mechanisms(spark.read.schema(N.MECHANISM_SCHEMA).json(
        _jsonl(f"{tmp_dir}/m.jsonl", [{"molecule_chembl_id": "C1", "mechanism_of_action": "Inhibitor"}]))).first()
    assert m.mechanism_of_action == "Inhibitor" and m.action_type == ""
    i = N.flatten_indications(spark.read.schema(N.INDICATION_SCHEMA).json(_jsonl(f"{tmp_dir}/i.jsonl", [
        {"molecule_chembl_id": "C1", "efo_term": "", "mesh_heading": "Pain", "indication_refs": [{"ref_id": "x"}]},
        {"molecule_chembl_id": "C2", "efo_term": "Fever", "mesh_heading": "Pyrexia"}]))).collect()
    assert {r.chembl_id: r.indication for r in i} == {"C1": "Pain", "C2": "Fever"}
    assert [len(r.indication_refs) for r in sorted(i, key=lambda r: r.chembl_id)] == [1, 0]
    mt = N.flatten_metabolism(spark.read.schema(N.METABOLISM_SCHEMA).json(
        _jsonl(f"{tmp_dir}/mt.jsonl", [{"drug_chembl_id": "C1"}]))).first()
    assert mt.enzyme_name == ""
    w = N.flatten_warnings(spark.read.schema(N.WARNING_SCHEMA).json(
        _jsonl(f"{tmp_dir}/w.jsonl", [{"molecule_chembl_id": "C1", "warning_type": "Withdrawn", "warning_year": 2004}]))).first()
    assert w.warning_type == "Withdrawn" and w.warning_year == 2004 and w.efo_term == ""


def test_drugsfda_two_level_unnest(spark, tmp_dir):
    p = _jsonl(f"{tmp_dir}/fda.jsonl", [
        {"application_number": "N1", "sponsor_name": "S", "products": [
            {"brand_name": "B1", "active_ingredients": [{"name": "x", "strength": "1"}, {"name": "y", "strength": "2"}]},
            {"brand_name": "B2", "active_ingredients": []}]},
        {"application_number": "N2", "products": []},
        {"application_number": "N3", "sponsor_name": "Ünïcode", "products": [
            {"brand_name": "B3", "active_ingredients": [{"name": "z"}]}]}])
    out = N.flatten_drugsfda(spark.read.schema(N.DRUGSFDA_SCHEMA).json(p)).collect()
    assert sorted((r.application_number, r.generic_name) for r in out) == [("N1", "x"), ("N1", "y"), ("N3", "z")]
    assert any(r.sponsor_name == "Ünïcode" for r in out)
    assert N.flatten_drugsfda(spark.read.schema(N.DRUGSFDA_SCHEMA).json(p), limit=2).count() == 2


def test_ndc_pubchem_assays(spark, tmp_dir):
    ndc = N.flatten_ndc(spark.read.schema(N.NDC_SCHEMA).json(_jsonl(f"{tmp_dir}/ndc.jsonl", [
        {"product_ndc": "1", "route": ["ORAL", "IV"]}, {"product_ndc": "2", "route": []}, {"product_ndc": "3"}])))
    assert {r.product_ndc: r.route for r in ndc.collect()} == {"1": "ORAL", "2": "", "3": ""}
    pc = N.flatten_pubchem(spark.read.schema(N.PUBCHEM_TABLE_SCHEMA).json(_jsonl(f"{tmp_dir}/pc.jsonl", [
        {"PropertyTable": {"Properties": [{"CID": 1, "CanonicalSMILES": "C"}, {"CID": 2, "IUPACName": "x"}]}}])))
    assert pc.count() == 2
    fm = N.first_property_match(spark.read.schema(N.PUBCHEM_COMPOUND_SCHEMA).json(_jsonl(f"{tmp_dir}/fm.jsonl", [
        {"query": "CCO", "compounds": [{"cid": 702, "molecular_weight": "46.07"}, {"cid": 9}]},
        {"query": "X", "compounds": []}])))
    r = fm.collect()
    assert len(r) == 1 and r[0].pubchem_cid == 702 and r[0].molecular_weight == 46.07 and len(fm.columns) == 13
    asy = N.flatten_assays(spark.read.schema(N.ASSAY_SCHEMA).json(_jsonl(f"{tmp_dir}/a.jsonl", [
        {"cid": 1, "AssaySummaries": {"AssaySummary": [{"AID": i} for i in range(8)]}}, {"cid": 2}])), n=5)
    assert asy.count() == 5


def test_csv_optional_dir_and_vocabulary(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/comp")
    with open(f"{tmp_dir}/comp/b_withdrawals.csv", "w") as f:
        f.write('name,smiles,withdrawal_year\n"Rofecoxib, oral",CCO,2004\n')
    with open(f"{tmp_dir}/comp/a_trials.csv", "w") as f:
        f.write("name,smiles,failure_reason\nTorcetrapib,CCN,Mortality\n")
    with open(f"{tmp_dir}/comp/c_empty.csv", "w") as f:
        f.write("")
    df, bad = RD.read_dir_with_provenance(spark, f"{tmp_dir}/comp")
    rows = sorted(df.collect(), key=lambda r: r.file_rank)
    assert [r.source for r in rows] == ["a_trials", "b_withdrawals"]
    assert rows[1].name == "Rofecoxib, oral" and rows[0].withdrawal_year is None
    assert len(bad) == 1
    schema = "name string, smiles string, failure_reason string"
    assert RD.read_optional(spark, [f"{tmp_dir}/missing.csv"], schema).count() == 0
    assert RD.read_optional(spark, [f"{tmp_dir}/comp/a_trials.csv", f"{tmp_dir}/nope.csv"], schema).count() == 1
    with open(f"{tmp_dir}/vocab.csv", "w") as f:
        f.write('DrugBank ID,Common name,CAS\nDB1,"Name, with comma",50-78-2\nDB2,Short\n')
    v = RD.read_vocabulary(spark, f"{tmp_dir}/vocab.csv").collect()
    assert [(r.drugbank_id, r.name) for r in v] == [("DB1", "Name, with comma")]
    got = RD.read_or_else(spark, f"{tmp_dir}/absent.csv", f"{tmp_dir}/vocab.csv", RD.read_vocabulary)
    assert got.count() == 1


def test_jsonl_pages_and_sinks(spark, tmp_dir):
    _jsonl(f"{tmp_dir}/pages/p1.json", [{"results": [{"product_ndc": "1"}, {"product_ndc": "2"}]}])
    _jsonl(f"{tmp_dir}/pages/p2.json", [{"results": [{"product_ndc": "3"}]}])
    pages = RD.read_pages(spark, f"{tmp_dir}/pages", "product_ndc: string", limit=2)
    assert [r.product_ndc for r in pages.collect()] == ["1", "2"]
    df = spark.createDataFrame([("t1", "Ärzte", "train"), ("t2", "b", "test")], "text string, task_type string, split string")
    K.write_csv(df, f"{tmp_dir}/csv", partition_by=["split"])
    assert RD.read_csv(spark, f"{tmp_dir}/csv/split=train", "text string, task_type string").first().task_type == "Ärzte"
    K.write_jsonl(df, f"{tmp_dir}/jsonl", cols=["text", "task_type"])
    back = RD.read_jsonl(spark, f"{tmp_dir}/jsonl", "text string, task_type string")
    assert sorted(r.task_type for r in back.collect()) == ["b", "Ärzte"]
    raw = "".join(open(os.path.join(f"{tmp_dir}/jsonl", f), encoding="utf-8").read()
                  for f in os.listdir(f"{tmp_dir}/jsonl") if f.endswith(".json"))
    assert "Ärzte" in raw  # non-ASCII kept as is
    stats = spark.createDataFrame([(3, 2)], "total_samples long, train_samples long")
    K.write_stats(stats, f"{tmp_dir}/stats")
    doc = spark.read.text(f"{tmp_dir}/stats").first().value
    assert json.loads(doc) == {"total_samples": 3, "train_samples": 2}
    K.write_metrics(stats, f"{tmp_dir}/metrics", df, f"{tmp_dir}/samples")
    assert spark.read.json(f"{tmp_dir}/samples").count() == 2


def test_curated_drops_sentinels(spark, tmp_dir):
    p = _jsonl(f"{tmp_dir}/f.jsonl", [{"name": "A", "smiles": "CCO"}, {"name": "B", "smiles": "N/A (Antibody)"},
                                      {"name": "C", "smiles": None}])
    df = load_curated(spark, p, "failed_drugs")
    assert sorted(r.name for r in df.collect()) == ["A", "C"]


def test_batch_keys(spark):
    df = spark.range(1, 251).withColumnRenamed("id", "cid")
    b = {r.batch: r for r in N.batch_keys(df, "cid", 100).collect()}
    assert [b[i].n for i in range(3)] == [100, 100, 50]
    assert b[2].keys.split(",")[0] == "201"


def test_api_downloads_from_landed_records(spark, tmp_dir):
    from pharmlake import api

    base = {"molecule_structures": {"canonical_smiles": "CCO"}, "molecule_type": "Small molecule"}
    p = _jsonl(f"{tmp_dir}/mols.jsonl", [
        {**base, "molecule_chembl_id": "A", "max_phase": 4, "first_approval": 1999},
        {**base, "molecule_chembl_id": "B", "max_phase": 2},
        {**base, "molecule_chembl_id": "C", "max_phase": 0},
        {**base, "molecule_chembl_id": "D", "max_phase": 4, "molecule_type": "Antibody"},
        {**base, "molecule_chembl_id": "E", "max_phase": 3}])
    mols = spark.read.schema(N.MOLECULE_SCHEMA).json(p)
    appr = api.download_approved_drugs(mols).collect()
    assert [(r.chembl_id, r.status) for r in appr] == [("A", "approved")]
    failed = api.download_failed_drugs(mols, limit=1)
    assert "first_approval" not in failed.columns
    assert [r.chembl_id for r in failed.collect()] == ["B"]
    assert sorted(r.chembl_id for r in api.download_failed_drugs(mols).collect()) == ["B", "E"]
