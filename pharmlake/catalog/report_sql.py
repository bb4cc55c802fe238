"""SQL twins of the report texts, built from the same fixed values as
``operators/reports.py``. Fixed decimals use printf over round(x, n): for the
exactly representable ties in the test data this rounds half away from zero, as
Spark's format_string does."""

from __future__ import annotations

from ..functions import fixed_values as V


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def fixed(col: str, places: int) -> str:
    return (f"case when {col} is null or isnan({col}) then 'nan' "
            f"else printf('%.{places}f', round({col}, {places})) end")


def txt(col: str) -> str:
    return f"coalesce(cast({col} as varchar), 'nan')"


def choose(test: str, good: str, bad: str) -> str:
    return f"case when coalesce({test}, false) then {q(good)} else {q(bad)} end"


def btrim(expr: str) -> str:
    return f"trim({expr}, ' \t\n\r')"


def cat(*parts: str) -> str:
    return "(" + " || ".join(parts) + ")"


def improvement_sql() -> str:
    issue = f"coalesce(failure_reason, warning_type, {q(V.DEFAULT_FAILURE_REASON)})"
    return cat(q("## Structural Improvement Suggestions for "), "coalesce(name, 'Unknown')",
               q("\n\n### Original Issue\n"), issue, q(V.IMPROVEMENT_BODY))


def _contains_any(col: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower({col}), {q(w)})" for w in words) + ")"


def failure_sql() -> str:
    d = V.FAILURE_DEFAULTS
    category = f"coalesce(failure_category, {q(d['category'])})"
    route = (f"case when {_contains_any(category, V.ROUTE_CARDIO)} then {q(V.CARDIO_SECTION)} "
             f"when {_contains_any(category, V.ROUTE_HEPATO)} then {q(V.HEPATO_SECTION)} "
             f"when {_contains_any(category, V.ROUTE_EFFICACY)} then {q(V.EFFICACY_SECTION)} else '' end")
    f = V.FAILURE_REPORT_FIELDS
    body = cat(
        q(V.FAILURE_REPORT_HEAD), f"coalesce(name, {q(d['name'])})", q("\n\n### Summary\n"),
        q(f[0]), f"coalesce(phase_failed, {q(d['phase'])})", q("\n" + f[1]),
        "coalesce(cast(year as varchar), '')", q("\n" + f[2]), "''", q("\n" + f[3]), category,
        q(V.FAILURE_REPORT_REASON_HEAD), f"coalesce(failure_reason, {q(d['reason'])})", q("\n"),
        route, q(V.TAKEAWAYS_SECTION))
    return btrim(body)


def outcome_sql() -> str:
    return ("case when status = 'approved' or max_phase = 4 then 'APPROVED' "
            "when status in ('failed','withdrawn') then 'FAILED/WITHDRAWN' "
            "when max_phase >= 2 then 'IN DEVELOPMENT' else 'UNLIKELY TO SUCCEED' end")


def analysis_sql() -> str:
    """Analysis report over compound rows (no failure reason columns in the binding)."""
    pred = outcome_sql()
    marker = (f"case when {pred} = 'APPROVED' then {q(V.OUTCOME_APPROVED[2])} "
              f"when {pred} = 'FAILED/WITHDRAWN' then {q(V.OUTCOME_FAILED[2])} "
              f"when {pred} = 'IN DEVELOPMENT' then {q(V.OUTCOME_DEVELOPMENT[2])} else {q(V.OUTCOME_UNLIKELY[2])} end")
    conf = ("case when status = 'approved' or max_phase = 4 or status in ('failed','withdrawn') "
            "then 'High' else 'Medium' end")
    vals = [fixed("molecular_weight", 1), fixed("alogp", 2), txt("hba"), txt("hbd"), fixed("psa", 1),
            txt("num_ro5_violations")]
    tests = ["molecular_weight < 500", "alogp < 5", "hba <= 10", "hbd <= 5", "psa <= 140", "num_ro5_violations = 0"]
    rows = [cat(q(f"| {lbl} | "), v, q(f"{unit} | "), choose(t, good, bad), q(" |\n"))
            for (lbl, unit, good, bad), v, t in zip(V.ANALYSIS_ROWS, vals, tests)]
    tier = ("case when num_ro5_violations = 0 and molecular_weight < 500 and alogp < 5 then 'excellent' "
            "when num_ro5_violations <= 1 then 'acceptable' else 'poor' end")
    likeness = (f"case when {tier} = 'excellent' then {q(V.LIKENESS_EXCELLENT)} "
                f"when {tier} = 'acceptable' then {q(V.LIKENESS_ACCEPTABLE)} else {q(V.LIKENESS_POOR)} end")
    tail = (f"case when status in ('failed','withdrawn') then "
            f"{cat(q(V.FAILURE_SECTION_HEAD), q(V.DEFAULT_FAILURE_REASON), q(V.FAILURE_SECTION_BODY))} "
            f"when status = 'approved' then {q(V.SUCCESS_SECTION)} else '' end")
    body = cat(q(V.ANALYSIS_HEAD), marker, q(" "), pred, q(V.ANALYSIS_CONFIDENCE), conf, q(V.ANALYSIS_TABLE_HEAD),
               *rows, q(V.ANALYSIS_LIKENESS_HEAD), likeness, tail)
    return btrim(body)


def property_sql() -> str:
    T = V.ADMET_TEXT
    vals = [fixed("molecular_weight", 1), fixed("alogp", 2), txt("hba"), txt("hbd"), fixed("psa", 1), txt("rtb")]
    tests = ["molecular_weight >= 150 and molecular_weight <= 500", "alogp >= 0 and alogp <= 5", "hba <= 10",
             "hbd <= 5", "psa < 140", "rtb <= 10"]
    rows = [cat(q(f"| {lbl} | "), v, q(f"{unit} | {rng} | "), choose(t, "✓", "⚠"), q(" |\n"))
            for (lbl, unit, rng), v, t in zip(V.PROPERTY_ROWS, vals, tests)]
    vol = (f"case when alogp > 3 then {q(T['volume'][0])} when alogp > 1 then {q(T['volume'][1])} "
           f"else {q(T['volume'][2])} end")
    body = cat(
        q("## Molecular Property Analysis: "), "coalesce(name, 'Unknown')",
        q("\n\n### Structure\n```\n"), "coalesce(smiles, '')", q("\n```\n\n"),
        q("### Physicochemical Properties\n\n| Property | Value | Optimal Range | Status |\n"
          "|----------|-------|---------------|--------|\n"), *rows,
        q("\n### Drug-Likeness Score\n**QED (Quantitative Estimate of Drug-likeness):** "), fixed("qed_weighted", 3),
        q("\n- Score ranges from 0 (least drug-like) to 1 (most drug-like)\n"
          "- QED >0.5 is generally considered favorable\n\n### ADMET Predictions\n\n**Absorption:**\n- "),
        choose("psa < 140 and alogp < 5", *T["absorption"]), q("\n- "),
        choose("psa < 90 and alogp > 1 and alogp < 5", *T["cns"]),
        q("\n\n**Distribution:**\n- "), choose("alogp > 3", *T["binding"]), q("\n- Estimated Vd: "), vol,
        q("\n\n**Metabolism:**\n- "), choose("molecular_weight > 300 and alogp > 1", *T["metabolism"]),
        q("\n- "), choose("alogp > 4", *T["inhibition"]),
        q("\n\n**Excretion:**\n- "), choose("alogp > 1", *T["clearance"]),
        q("\n- "), choose("molecular_weight > 400 and alogp > 3", *T["half_life"]),
        q("\n\n### Rule-Based Assessments\n\n**Lipinski's Rule of 5:** "),
        choose("molecular_weight <= 500 and alogp <= 5 and hbd <= 5 and hba <= 10", "✓ PASS", "⚠ FAIL"),
        q("\n**Veber Rules (Oral Bioavailability):** "), choose("rtb <= 10 and psa < 140", "✓ PASS", "⚠ FAIL"),
        q("\n"), f"case when coalesce(natural_product, false) then {q(V.NATURAL_PRODUCT_SECTION)} else '' end")
    return btrim(body)


def comparison_sql() -> str:
    """Comparison report over the pair rows ``p`` of the pair binding (d1_*, d2_*)."""
    n1 = f"coalesce(d1_name, {q(V.COMPARISON_DEFAULT_NAMES[0])})"
    n2 = f"coalesce(d2_name, {q(V.COMPARISON_DEFAULT_NAMES[1])})"
    s1, s2 = "coalesce(d1_status, 'nan')", "coalesce(d2_status, 'nan')"
    t = q(V.COMPARISON_TROPHY)

    def win(test1: str, test2: str | None = None) -> str:
        second = f"when {test2} then {t} || {n2} " if test2 else ""
        other = f"{q(V.COMPARISON_NONE)}" if test2 else f"{t} || {n2}"
        return f"case when {test1} then {t} || {n1} {second}else {other} end"

    def line(label: str, a: str, b: str, w: str) -> str:
        return cat(q(f"| {label} | "), a, q(" | "), b, q(" | "), w, q(" |\n"))

    table = cat(
        q(V.COMPARISON_HEAD), n1, q(" | "), n2, q(" | Better |\n|----------|---------|---------|--------|\n"),
        line("Status", s1, s2, win("d1_status = 'approved'", "d2_status = 'approved'")),
        line("Mol. Weight", cat(fixed("d1_molecular_weight", 1), q(" Da")), cat(fixed("d2_molecular_weight", 1), q(" Da")),
             win("d1_molecular_weight < d2_molecular_weight")),
        line("LogP", fixed("d1_alogp", 2), fixed("d2_alogp", 2), win("abs(d1_alogp - 2) < abs(d2_alogp - 2)")),
        line("PSA", cat(fixed("d1_psa", 1), q(" Å²")), cat(fixed("d2_psa", 1), q(" Å²")), win("d1_psa < d2_psa")),
        q("\n### Assessment\n\n"))
    a1 = "coalesce(d1_status = 'approved', false)"
    a2 = "coalesce(d2_status = 'approved', false)"
    o1 = "case when d1_molecular_weight < 500 and d1_alogp < 5 then 'better' else 'challenging' end"
    o2 = "case when d2_molecular_weight < 500 and d2_alogp < 5 then 'better' else 'challenging' end"
    similar = cat(q(V.COMPARISON_SIMILAR_HEAD), q("- **"), n1, q("** may have "), o1, q(" oral bioavailability\n- **"),
                  n2, q("** may have "), o2, q(" oral bioavailability\n"), q(V.COMPARISON_SIMILAR_TAIL))
    verdict = (f"case when {a1} and not {a2} then "
               f"{cat(q('**'), n1, q('**' + V.COMPARISON_WINNER + '**'), n2, q('**' + V.COMPARISON_LOSER))} "
               f"when {a2} and not {a1} then "
               f"{cat(q('**'), n2, q('**' + V.COMPARISON_WINNER + '**'), n1, q('**' + V.COMPARISON_LOSER))} "
               f"else {similar} end")
    return btrim(cat(table, verdict))
