"""Entry points named after the tasks a user of the original tool runs, each a thin
composition of the DataFrame operators (no local logic of its own).

Landed files replace network downloads: pass the landed JSON/CSV as frames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rules as R
from .functions.molecule import valid_smiles
from .operators import clean as C
from .operators import history as H
from .operators import hooks as X
from .operators import metrics as M
from .operators.instruct import request
from .operators.reports import with_report
from .operators.splits import cap_rows, sample_n
from .plans import evaluation as E
from .plans.instruct_set import instruction_dataset
from .plans.prepare import prepare_molecules
from .sources import nested as N
from .sources import readers as RD


# ---- sources (landed records) -------------------------------------------------
def download_approved_drugs(molecules: DataFrame, limit: int | None = None) -> DataFrame:
    """Approved small molecules (max_phase = 4) as flat rows, status 'approved'."""
    m = C.phase_filter(molecules.where(F.col("molecule_type") == "Small molecule"), eq=4)
    out = N.flatten_molecules(m, "approved", default_phase=4)
    return cap_rows(out, limit, ["chembl_id"]) if limit else out


def download_failed_drugs(molecules: DataFrame, limit: int | None = None) -> DataFrame:
    """Trial-phase small molecules (1 <= max_phase < 4), status 'failed' (no approval year)."""
    m = C.phase_filter(molecules.where(F.col("molecule_type") == "Small molecule"), lo=1, hi=4)
    out = N.flatten_molecules(m, "failed").drop("first_approval")
    return cap_rows(out, limit, ["chembl_id"]) if limit else out


def download_bioactivity_data(activities: DataFrame, limit: int | None = None) -> DataFrame:
    return N.bioactivity(activities, limit)


download_chembl_drug_mechanisms = N.flatten_mechanisms
download_chembl_drug_indications = N.flatten_indications
download_chembl_metabolism = N.flatten_metabolism
download_chembl_drug_warnings = N.flatten_warnings
download_chembl_compounds_detailed = N.flatten_compounds
download_fda_approved_drugs = N.flatten_drugsfda
download_fda_ndc_drugs = N.flatten_ndc
download_from_pubchem = N.flatten_pubchem
get_pubchem_properties = N.first_property_match
download_pubchem_bioassays = N.flatten_assays
download_drugbank_vocabulary = RD.read_vocabulary


def load_sources(spark: SparkSession, paths_by_source: dict[str, list[str]], schema: str,
                 label_of: dict[str, int] | None = None) -> DataFrame:
    """load_chembl_data / load_drugbank_data / load_fda_data: optional landed CSVs per
    source, tagged with the source name, unified to smiles, name, status, source, label,
    plus a load-order ``row_id``, a struct (source number, file number, block, place):
    sources as given, files by name, rows by place, however the files are split. A file
    without the columns ``smiles`` and ``name`` is skipped (P3)."""
    parts = []
    for number, (src, paths) in enumerate(paths_by_source.items()):
        usable = [p for p in paths if RD.exists(spark, p) and C.has_columns(RD.header_of(spark, p), ["smiles", "name"])]
        df = RD.read_optional(spark, usable, schema, order_col="__at")
        label = C.map_label("status") if not label_of or src not in label_of else F.lit(label_of[src])
        parts.append(df.select("smiles", F.coalesce("name", F.lit("")).alias("name"), "status",
                               F.lit(src).alias("source"), label.cast("int").alias("label"),
                               F.struct(F.lit(number).alias("source"), "__at.*").alias("row_id")))
    if not parts:
        return spark.createDataFrame([], "smiles string, name string, status string, source string, label int, "
                                         "row_id struct<source: int, file: int, block: bigint, place: bigint>")
    return C.union_same(parts)


# ---- preparation ----------------------------------------------------------------
validate_smiles = valid_smiles


def prepare_dataset(unified: DataFrame, augment: Callable | None = None, test_mode: bool = False,
                    train: float = 0.8, **kw) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Validated, deduplicated, balanced, stratified (train, val, test)."""
    if test_mode:  # sampled before the split, under another seed than the split's
        unified = sample_n(C.dedup_first(C.validate(unified), "smiles", ["row_id"]), 500, "smiles", seed=1042)
    p = prepare_molecules(unified, train=train, variants=augment, **kw)
    return tuple(p.where(F.col("split") == s).drop("split") for s in ("train", "val", "test"))  # type: ignore


# ---- instruction text ------------------------------------------------------------
def generate_approval_prediction_response(df: DataFrame) -> DataFrame:
    return with_report(df, "drug_analysis", "response")


def generate_failure_analysis_response(df: DataFrame) -> DataFrame:
    return with_report(df, "failure_analysis", "response")


def generate_comparison_response(pairs: DataFrame) -> DataFrame:
    """Pairs with d1_* and d2_* columns (see joins.pair_by_rank)."""
    return with_report(pairs, "comparison", "response")


def generate_property_response(df: DataFrame) -> DataFrame:
    return with_report(df, "property_analysis", "response")
create_instruction_tuning_dataset = instruction_dataset


def load_instruction_dataset(spark: SparkSession, train_path: str, val_path: str, test_mode: bool = False):
    schema = "text string, instruction string, output string, task_type string"
    tr = RD.read_jsonl(spark, train_path, schema).withColumn("__k", F.xxhash64("text", "instruction"))
    va = RD.read_jsonl(spark, val_path, schema).withColumn("__k", F.xxhash64("text", "instruction"))
    if test_mode:
        tr, va = cap_rows(tr, 100, ["__k", "text"]), cap_rows(va, 20, ["__k", "text"])
    return tr.drop("__k"), va.drop("__k")


# ---- evaluation and metrics ----------------------------------------------------
get_class_weights = M.class_weights
compute_classification_metrics = E.evaluate_predictions
score_logits = E.score_logits
benchmark_random_baseline = M.random_baseline
benchmark_majority_baseline = M.majority_baseline
generate_report_rows = M.report_rows
early_stopping = H.early_stop
best_epoch = H.best_epoch
find_latest_checkpoint = H.latest_run


def evaluate_generation_quality(prompts: DataFrame, responder: Callable[[str], str]) -> DataFrame:
    """Responses from a user responder, with length, tokens and keyword coverage;
    ``prompts`` has prompt, prompt_type and keywords (comma text)."""
    r = X.respond(prompts, responder, "prompt", "response").withColumn("response_length", F.length("response"))
    return E.response_table(r)


def compute_generation_metrics(results: DataFrame, min_len: int = 50) -> DataFrame:
    return M.response_metrics(results), M.success_rate(results, min_len), M.per_type(results)


# ---- app prompts ------------------------------------------------------------------
def analyze_drug(df: DataFrame) -> DataFrame:
    return df.withColumn("prompt", request("analysis"))


def analyze_failure(df: DataFrame) -> DataFrame:
    return df.withColumn("prompt", request("failure"))


def compare_drugs(df: DataFrame) -> DataFrame:
    return df.withColumn("prompt", request("comparison"))


def suggest_improvements(df: DataFrame) -> DataFrame:
    return df.withColumn("prompt", request("suggestion"))


chat_context = H.chat_context
outcome = R.outcome
