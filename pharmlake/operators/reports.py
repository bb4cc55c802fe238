"""Report texts (M5, M7, M10, M15, M16) as single concat expressions over rule
columns. Rule columns are tested exactly; the texts only print them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import rules as R
from ..functions.text import fixed

NUM = ["molecular_weight", "alogp", "hba", "hbd", "psa", "num_ro5_violations", "rtb", "qed_weighted"]


def _txt(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("nan"))


def _choose(test: Column, good: str, bad: str) -> Column:
    return F.when(test, F.lit(good)).otherwise(F.lit(bad))


def _row(label: str, value: Column, unit: str, assess: Column) -> Column:
    return F.concat(F.lit(f"| {label} | "), value, F.lit(f"{unit} | "), assess, F.lit(" |\n"))


def analysis_parts() -> dict[str, Column]:
    """Rule columns the analysis report prints more than once (computed once)."""
    s, ph = F.col("status"), F.col("max_phase")
    return {"__pred": R.outcome(s, ph), "__tier": R.likeness_tier(), "__section": R.status_section(s)}


def analysis_report() -> Column:
    """M5: the analysis report for one compound row (needs ``analysis_parts``)."""
    s, ph = F.col("status"), F.col("max_phase")
    pred = F.col("__pred")
    marker = (F.when(pred == V.OUTCOME_APPROVED[0], V.OUTCOME_APPROVED[2])
              .when(pred == V.OUTCOME_FAILED[0], V.OUTCOME_FAILED[2])
              .when(pred == V.OUTCOME_DEVELOPMENT[0], V.OUTCOME_DEVELOPMENT[2])
              .otherwise(V.OUTCOME_UNLIKELY[2]))
    flags = R.property_flags()
    vals = [fixed("molecular_weight", 1), fixed("alogp", 2), _txt(F.col("hba")), _txt(F.col("hbd")),
            fixed("psa", 1), _txt(F.col("num_ro5_violations"))]
    tests = [flags["mw_ok"], flags["logp_ok"], flags["hba_ok"], flags["hbd_ok"], flags["psa_ok"], flags["ro5_ok"]]
    rows = [_row(lbl, v, unit, _choose(t, good, bad))
            for (lbl, unit, good, bad), v, t in zip(V.ANALYSIS_ROWS, vals, tests)]
    tier = F.col("__tier")
    likeness = (F.when(tier == "excellent", V.LIKENESS_EXCELLENT).when(tier == "acceptable", V.LIKENESS_ACCEPTABLE)
                .otherwise(V.LIKENESS_POOR))
    reason = F.coalesce(F.col("failure_reason"), F.col("warning_type"), F.lit(V.DEFAULT_FAILURE_REASON))
    section = F.col("__section")
    tail = (F.when(section == "failure", F.concat(F.lit(V.FAILURE_SECTION_HEAD), reason, F.lit(V.FAILURE_SECTION_BODY)))
            .when(section == "success", F.lit(V.SUCCESS_SECTION)).otherwise(F.lit("")))
    body = F.concat(F.lit(V.ANALYSIS_HEAD), marker, F.lit(" "), pred, F.lit(V.ANALYSIS_CONFIDENCE),
                    R.confidence(s, ph), F.lit(V.ANALYSIS_TABLE_HEAD), *rows, F.lit(V.ANALYSIS_LIKENESS_HEAD),
                    likeness, tail)
    return F.btrim(body, F.lit(" \t\n\r"))


def failure_parts() -> dict[str, Column]:
    return {"__route": R.failure_route(F.coalesce(F.col("failure_category"), F.lit(V.FAILURE_DEFAULTS["category"])))}


def failure_report() -> Column:
    """M7: failure report; year = year else withdrawal_year; reason = failure_reason
    else detailed_reason; optional mechanism section; category-specific section
    (needs ``failure_parts``)."""
    d = V.FAILURE_DEFAULTS
    name = F.coalesce(F.col("name"), F.lit(d["name"]))
    phase = F.coalesce(F.col("phase_failed"), F.lit(d["phase"]))
    reason = F.coalesce(F.col("failure_reason"), F.col("detailed_reason"), F.lit(d["reason"]))
    category = F.coalesce(F.col("failure_category"), F.lit(d["category"]))
    year = F.coalesce(F.col("year").cast("string"), F.col("withdrawal_year").cast("string"), F.lit(""))
    area = F.coalesce(F.col("therapeutic_area"), F.lit(""))
    mech = F.col("mechanism")
    route = F.col("__route")
    fields = [F.lit(V.FAILURE_REPORT_FIELDS[0]), phase, F.lit("\n" + V.FAILURE_REPORT_FIELDS[1]), year,
              F.lit("\n" + V.FAILURE_REPORT_FIELDS[2]), area, F.lit("\n" + V.FAILURE_REPORT_FIELDS[3]), category]
    body = F.concat(
        F.lit(V.FAILURE_REPORT_HEAD), name, F.lit("\n\n### Summary\n"), *fields,
        F.lit(V.FAILURE_REPORT_REASON_HEAD), reason, F.lit("\n"),
        F.when(mech.isNotNull() & (mech != ""), F.concat(F.lit(V.FAILURE_REPORT_MECHANISM_HEAD), mech, F.lit("\n")))
        .otherwise(F.lit("")),
        F.when(route == "cardio", V.CARDIO_SECTION).when(route == "hepato", V.HEPATO_SECTION)
        .when(route == "efficacy", V.EFFICACY_SECTION).otherwise(F.lit("")),
        F.lit(V.TAKEAWAYS_SECTION))
    return F.btrim(body, F.lit(" \t\n\r"))


def comparison_parts(p1: str = "d1_", p2: str = "d2_") -> dict[str, Column]:
    hh = R.head_to_head(p1, p2)
    return {"__sw": hh["status_winner"], "__ww": hh["weight_winner"], "__lw": hh["logp_winner"],
            "__pw": hh["psa_winner"], "__verdict": R.verdict(p1, p2)}


def comparison_report(p1: str = "d1_", p2: str = "d2_") -> Column:
    """Head-to-head table and verdict for a pair row (columns d1_*, d2_*;
    needs ``comparison_parts``)."""
    n1 = F.coalesce(F.col(p1 + "name"), F.lit(V.COMPARISON_DEFAULT_NAMES[0]))
    n2 = F.coalesce(F.col(p2 + "name"), F.lit(V.COMPARISON_DEFAULT_NAMES[1]))
    s1 = F.coalesce(F.col(p1 + "status"), F.lit("nan"))
    s2 = F.coalesce(F.col(p2 + "status"), F.lit("nan"))
    hh = {"status_winner": F.col("__sw"), "weight_winner": F.col("__ww"), "logp_winner": F.col("__lw"),
          "psa_winner": F.col("__pw")}

    def win(c: Column) -> Column:
        return F.when(c == 1, F.concat(F.lit(V.COMPARISON_TROPHY), n1)).when(
            c == 2, F.concat(F.lit(V.COMPARISON_TROPHY), n2)).otherwise(F.lit(V.COMPARISON_NONE))

    def line(label: str, a: Column, b: Column, w: Column) -> Column:
        return F.concat(F.lit(f"| {label} | "), a, F.lit(" | "), b, F.lit(" | "), w, F.lit(" |\n"))

    table = F.concat(
        F.lit(V.COMPARISON_HEAD), n1, F.lit(" | "), n2, F.lit(" | Better |\n|----------|---------|---------|--------|\n"),
        line("Status", s1, s2, win(hh["status_winner"])),
        line("Mol. Weight", F.concat(fixed(p1 + "molecular_weight", 1), F.lit(" Da")),
             F.concat(fixed(p2 + "molecular_weight", 1), F.lit(" Da")), win(hh["weight_winner"])),
        line("LogP", fixed(p1 + "alogp", 2), fixed(p2 + "alogp", 2), win(hh["logp_winner"])),
        line("PSA", F.concat(fixed(p1 + "psa", 1), F.lit(" Å²")), F.concat(fixed(p2 + "psa", 1), F.lit(" Å²")),
             win(hh["psa_winner"])),
        F.lit("\n### Assessment\n\n"))
    v = F.col("__verdict")
    o1 = R.oral_outlook(F.col(p1 + "molecular_weight"), F.col(p1 + "alogp"))
    o2 = R.oral_outlook(F.col(p2 + "molecular_weight"), F.col(p2 + "alogp"))
    similar = F.concat(F.lit(V.COMPARISON_SIMILAR_HEAD), F.lit("- **"), n1, F.lit("** may have "), o1,
                       F.lit(" oral bioavailability\n- **"), n2, F.lit("** may have "), o2,
                       F.lit(" oral bioavailability\n"), F.lit(V.COMPARISON_SIMILAR_TAIL))
    verdict_text = (F.when(v == "first", F.concat(F.lit("**"), n1, F.lit("**" + V.COMPARISON_WINNER + "**"), n2,
                                                  F.lit("**" + V.COMPARISON_LOSER)))
                    .when(v == "second", F.concat(F.lit("**"), n2, F.lit("**" + V.COMPARISON_WINNER + "**"), n1,
                                                  F.lit("**" + V.COMPARISON_LOSER)))
                    .otherwise(similar))
    return F.btrim(F.concat(table, verdict_text), F.lit(" \t\n\r"))


def property_parts() -> dict[str, Column]:
    return {"__volume": R.admet_rules()["volume"]}


def property_report() -> Column:
    """Property table, QED, ADMET, Lipinski/Veber, optional natural-product
    section (needs ``property_parts``)."""
    rf = R.range_flags()
    ad = R.admet_rules()
    vals = [fixed("molecular_weight", 1), fixed("alogp", 2), _txt(F.col("hba")), _txt(F.col("hbd")),
            fixed("psa", 1), _txt(F.col("rtb"))]
    tests = [rf["mw_in_range"], rf["logp_in_range"], rf["hba_in_range"], rf["hbd_in_range"], rf["psa_in_range"],
             rf["rtb_in_range"]]
    rows = [F.concat(F.lit(f"| {lbl} | "), v, F.lit(f"{unit} | {rng} | "), _choose(t, "✓", "⚠"), F.lit(" |\n"))
            for (lbl, unit, rng), v, t in zip(V.PROPERTY_ROWS, vals, tests)]
    T = V.ADMET_TEXT

    vol = F.when(F.col("__volume") == "high", T["volume"][0]).when(F.col("__volume") == "moderate", T["volume"][1]) \
        .otherwise(T["volume"][2])
    body = F.concat(
        F.lit("## Molecular Property Analysis: "), F.coalesce(F.col("name"), F.lit("Unknown")),
        F.lit("\n\n### Structure\n```\n"), F.coalesce(F.col("smiles"), F.lit("")), F.lit("\n```\n\n"),
        F.lit("### Physicochemical Properties\n\n| Property | Value | Optimal Range | Status |\n"
              "|----------|-------|---------------|--------|\n"), *rows,
        F.lit("\n### Drug-Likeness Score\n**QED (Quantitative Estimate of Drug-likeness):** "),
        fixed("qed_weighted", 3),
        F.lit("\n- Score ranges from 0 (least drug-like) to 1 (most drug-like)\n"
              "- QED >0.5 is generally considered favorable\n\n### ADMET Predictions\n\n**Absorption:**\n- "),
        _choose(ad["good_absorption"], *T["absorption"]),
        F.lit("\n- "), _choose(ad["cns_penetrant"], *T["cns"]),
        F.lit("\n\n**Distribution:**\n- "), _choose(ad["high_binding"], *T["binding"]),
        F.lit("\n- Estimated Vd: "), vol,
        F.lit("\n\n**Metabolism:**\n- "), _choose(ad["cyp_substrate"], *T["metabolism"]),
        F.lit("\n- "), _choose(ad["cyp_inhibition"], *T["inhibition"]),
        F.lit("\n\n**Excretion:**\n- "), _choose(ad["hepatic_clearance"], *T["clearance"]),
        F.lit("\n- "), _choose(ad["long_half_life"], *T["half_life"]),
        F.lit("\n\n### Rule-Based Assessments\n\n**Lipinski's Rule of 5:** "),
        _choose(R.lipinski(), "✓ PASS", "⚠ FAIL"),
        F.lit("\n**Veber Rules (Oral Bioavailability):** "), _choose(R.veber(), "✓ PASS", "⚠ FAIL"), F.lit("\n"),
        F.when(F.coalesce(F.col("natural_product"), F.lit(False)), F.lit(V.NATURAL_PRODUCT_SECTION)).otherwise(F.lit("")))
    return F.btrim(body, F.lit(" \t\n\r"))


def improvement_report() -> Column:
    """Improvement suggestions; the issue is failure_reason else warning_type."""
    issue = F.coalesce(F.col("failure_reason"), F.col("warning_type"), F.lit(V.DEFAULT_FAILURE_REASON))
    return F.concat(F.lit("## Structural Improvement Suggestions for "), F.coalesce(F.col("name"), F.lit("Unknown")),
                    F.lit("\n\n### Original Issue\n"), issue, F.lit(V.IMPROVEMENT_BODY))


def improvement_parts() -> dict[str, Column]:
    return {}


# task -> (parts, text); parts are projected first so the text references each rule once
REPORT_BUILDERS = {
    "drug_analysis": (analysis_parts, analysis_report),
    "failure_analysis": (failure_parts, failure_report),
    "improvement_suggestion": (improvement_parts, improvement_report),
    "property_analysis": (property_parts, property_report),
    "comparison": (comparison_parts, comparison_report),
}

_CACHE: dict = {}


def cached(fn, *args):
    """Column trees are unresolved expressions, reusable across frames of one
    SparkContext: build each once (building them is many JVM calls)."""
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    # keyed by application id: unique per context, unlike an object address
    key = (sc.applicationId if sc is not None else None, fn.__name__, args)
    if key not in _CACHE:
        _CACHE[key] = fn(*args)
    return _CACHE[key]


def with_report(df: DataFrame, task: str, out: str = "output") -> DataFrame:
    """The report of ``task`` as column ``out`` (two projections: rule parts, then text)."""
    parts_fn, text_fn = REPORT_BUILDERS[task]
    parts = cached(parts_fn)
    staged = df.withColumns(parts) if parts else df
    return staged.withColumn(out, cached(text_fn)).drop(*parts.keys())
