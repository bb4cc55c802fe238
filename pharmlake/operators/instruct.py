"""Instruction samples (M17-M20, P14): five lazy branches over one deduplicated
input, a seeded template choice per row, ChatML text, and request prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.molecule import present
from ..functions.text import chatml, fill, optional_part, pick, strip
from .clean import failed_or_reasoned, from_sources
from .joins import pair_by_rank
from .ranking import first_n, with_seeded_bucket
from .reports import REPORT_BUILDERS, cached, with_report
from .splits import pick_index

SAMPLE_COLS = ["sample_id", "task_type", "source", "instruction", "input", "output"]


def _templated(templates: list[str], key: Column, seed: int, **fields) -> Column:
    return pick([fill(t, **fields) for t in templates], pick_index(key, len(templates), seed))


def _ensure(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    for c, t in cols.items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(t))
    return df


WIDE = {"uid": "string", "smiles": "string", "name": "string", "status": "string", "source": "string",
        "max_phase": "int", "molecular_weight": "double", "alogp": "double", "hba": "int", "hbd": "int",
        "psa": "double", "rtb": "int", "num_ro5_violations": "int", "qed_weighted": "double",
        "natural_product": "boolean", "failure_reason": "string", "warning_type": "string",
        "phase_failed": "string", "failure_category": "string", "therapeutic_area": "string",
        "mechanism": "string", "detailed_reason": "string", "year": "int", "withdrawal_year": "int",
        "ord": "bigint"}


PAIR_COLS = ["uid", "ord", "name", "smiles", "status", "molecular_weight", "alogp", "psa"]


def branch_specs(data: DataFrame, max_samples: int | None = None, seed: int = 42,
                 caps: tuple[int | None, int | None, int | None] = (None, None, None)) -> DataFrame:
    """M17 selection: one compact row per sample (id, task, source and the input
    fields), before any text exists. ``data`` is the combined, deduplicated table
    with a unique ``uid`` and a load-order column ``ord``.

    Branches: every compound with a structure; the two failure sources; the
    failed-or-reasoned rows; the rows with a weight; the i-th approved with the i-th
    failed. ``caps`` keeps the first rows of the last three (each side of the pairs);
    None keeps all."""
    d = _ensure(data, WIDE)
    imp_cap, prop_cap, cmp_cap = caps
    fields = [c for c in WIDE if c not in ("uid", "ord", "source")]

    def spec(df: DataFrame, task: str, source: Column | None = None, cap: int | None = None) -> DataFrame:
        """Project to the sample shape first, then take the first ``cap`` rows by load
        order, so the limit sits directly on the sort (a bounded TakeOrdered)."""
        src = F.coalesce("source", F.lit("unknown")) if source is None else source
        out = df.select(F.concat(F.lit(task + ":"), F.col("uid")).alias("sample_id"), F.lit(task).alias("task_type"),
                        src.alias("source"), F.col("ord").alias("__o"), *fields)
        out = with_seeded_bucket(out, "sample_id", seed)
        caps_ = [x for x in (cap, max_samples) if x]
        return first_n(out, ["__o"], min(caps_)) if caps_ else out

    analysis = spec(d.where(present("smiles")), "drug_analysis")
    failure = spec(from_sources(d, V.FAILURE_SOURCES), "failure_analysis", F.col("source"))
    improve = spec(failed_or_reasoned(d), "improvement_suggestion", cap=imp_cap)
    prop = spec(d.where(F.col("molecular_weight").isNotNull()), "property_analysis", cap=prop_cap)
    appr = d.where(F.col("status") == "approved")
    fail = d.where(F.col("status").isin(*V.FAILED_STATUSES))
    pairs = pair_by_rank(appr, fail, "ord", cmp_cap, cols=PAIR_COLS)
    comp = pairs.select(F.concat(F.lit("comparison:"), F.col("d1_uid"), F.lit("|"), F.col("d2_uid")).alias("sample_id"),
                        F.lit("comparison").alias("task_type"), F.lit("generated").alias("source"),
                        F.col("pair_rank").cast("bigint").alias("__o"),
                        *[F.col(c) for c in pairs.columns if c.startswith(("d1_", "d2_"))])
    comp = with_seeded_bucket(comp, "sample_id", seed)
    if max_samples:
        comp = first_n(comp, ["__o", "sample_id"], max_samples)
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [analysis, failure, improve, prop, comp])


def _instruction(task: str, key: Column, seed: int) -> Column:
    if task == "drug_analysis":
        return _templated(V.ANALYSIS_TEMPLATES, key, seed, smiles="smiles", name="name")
    if task == "failure_analysis":
        return _templated(V.FAILURE_ANALYSIS_TEMPLATES, key, seed, name="name", smiles="smiles",
                          phase=F.coalesce("phase_failed", F.lit("clinical trials")))
    if task == "improvement_suggestion":
        return _templated(V.IMPROVEMENT_TEMPLATES, key, seed, name="name", smiles="smiles",
                          reason=F.coalesce("failure_reason", "warning_type", F.lit("toxicity")))
    if task == "property_analysis":
        return _templated(V.PROPERTY_TEMPLATES, key, seed, smiles="smiles")
    return _templated(V.COMPARISON_TEMPLATES, key, seed, smiles1="d1_smiles", name1="d1_name",
                      smiles2="d2_smiles", name2="d2_name")


REPORTS = list(REPORT_BUILDERS)


def render(specs: DataFrame, seed: int = 42, with_output: bool = True) -> DataFrame:
    """M17 text: instruction (seeded template choice per sample) and output report.

    One small projection chain per task type over a ``task_type`` filter (pushed to
    the scan when ``specs`` is a written table), then a union: each chain compiles to
    compact generated code, and rules a report prints several times are projected
    once before the text."""
    keep = [c for c in specs.columns if c not in SAMPLE_COLS and not c.startswith("__") and c not in WIDE
            and not c.startswith(("d1_", "d2_"))]
    parts = []
    for task in REPORTS:
        part = specs.where(F.col("task_type") == task)
        part = part.withColumn("instruction", _instruction_cached(task, seed))
        part = with_report(part, task, "output") if with_output else part.withColumn("output", F.lit(None).cast("string"))
        parts.append(part.select("sample_id", "task_type", "source", "instruction", F.lit("").alias("input"),
                                 "output", *keep))
    return reduce(lambda x, y: x.union(y), parts)  # identical column order


def _instruction_cached(task: str, seed: int) -> Column:
    return cached(_instruction_by_name, task, seed)


def _instruction_by_name(task: str, seed: int) -> Column:
    return _instruction(task, F.col("sample_id"), seed)


def build_instructions(data: DataFrame, seed: int = 42, max_samples: int | None = None) -> DataFrame:
    """M17 + M18: all samples with the ChatML ``text`` column."""
    r = render(branch_specs(data, max_samples), seed)
    return r.withColumn("text", chatml("instruction", "input", "output"))


# ---- M19 / P14: request prompts ---------------------------------------------
def request_prompt(kind: str) -> Column:
    """Request prompt from columns smiles, name, reason (failure), problem
    (suggestion), smiles2 and name2 (comparison)."""
    s = strip("smiles")
    if kind == "analysis":
        return F.concat(F.lit(V.PROMPT_ANALYSIS), s, optional_part("name", V.PROMPT_ANALYSIS_NAME))
    if kind == "failure":
        return F.concat(F.lit(V.PROMPT_FAILURE), F.coalesce(F.col("name"), F.lit("")), F.lit(V.PROMPT_FAILURE_SMILES),
                        s, optional_part("reason", V.PROMPT_FAILURE_REASON))
    if kind == "comparison":
        return F.concat(F.lit(V.PROMPT_COMPARISON), s, F.lit(" ("), F.coalesce(F.col("name"), F.lit("")), F.lit(")"),
                        F.lit(V.PROMPT_COMPARISON_SECOND), strip("smiles2"), F.lit(" ("),
                        F.coalesce(F.col("name2"), F.lit("")), F.lit(")"))
    if kind == "suggestion":
        return F.concat(F.lit(V.PROMPT_SUGGESTION), F.coalesce(F.col("problem"), F.lit("")),
                        F.lit(V.PROMPT_SUGGESTION_TAIL), s, optional_part("name", V.PROMPT_SUGGESTION_NAME))
    raise ValueError(kind)


def _blank(c: str) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def request_error(kind: str) -> Column:
    """The message shown instead of a prompt when a required field is blank; null otherwise."""
    if kind in ("analysis", "failure"):
        return F.when(_blank("smiles"), F.lit(V.ERROR_NO_SMILES))
    if kind == "comparison":
        return F.when(_blank("smiles") | _blank("smiles2"), F.lit(V.ERROR_NO_PAIR))
    if kind == "suggestion":
        return F.when(_blank("smiles") | _blank("problem"), F.lit(V.ERROR_NO_PROBLEM))
    if kind == "chat":
        return F.when(_blank("message"), F.lit(V.ERROR_NO_MESSAGE))
    raise ValueError(kind)


def request(kind: str) -> Column:
    """The prompt, or the error message when the request is rejected."""
    return F.coalesce(request_error(kind), request_prompt(kind))
