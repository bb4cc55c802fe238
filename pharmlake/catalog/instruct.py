"""Queries: instruction samples (M17, M18, T2 on samples) and report texts (rows-only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators.instruct import WIDE, _ensure
from ..operators.reports import with_report
from ..oracle_bindings import with_bindings as W
from ..plans.instruct_set import instruction_dataset
from ..sources import bindings as B
from . import register
from . import report_sql as RS
from .molecules import PAIRS_SQL, SRC_RANK_SQL, pairs
from .texts import DONE_SQL, TURN_SQL, USER_SQL, _sql_pick

ORD = f"(({SRC_RANK_SQL}) * 1099511627776 + row_id)"
ALL_SQL = W("compounds", "failures") + f"""
, cd AS (select * from (select *, row_number() over (partition by smiles order by {ORD}) as rn0 from compounds) where rn0 = 1),
a AS (select compound_id as uid, {ORD} as ord, smiles, name, status, source, max_phase, molecular_weight, alogp,
  hba, hbd, psa, rtb, num_ro5_violations, qed_weighted, natural_product,
  null::varchar as failure_reason, null::varchar as warning_type, null::varchar as phase_failed,
  null::varchar as failure_category, null::int as year from cd
  union all select 'F' || cast(row_id as varchar), 8 * 1099511627776 + row_id, null, name, null, source, null, null, null,
  null, null, null, null, null, null, null, failure_reason, warning_type, phase_failed, failure_category, year from failures),
s1 AS (select 'drug_analysis:' || uid as sample_id, 'drug_analysis' as task_type, coalesce(source, 'unknown') as source,
  {_sql_pick(V.ANALYSIS_TEMPLATES, "('drug_analysis:' || uid)", smiles="smiles", name="name")} as instruction,
  {RS.analysis_sql()} as output
  from a where smiles is not null and smiles <> ''),
s2 AS (select 'failure_analysis:' || uid, 'failure_analysis', source,
  {_sql_pick(V.FAILURE_ANALYSIS_TEMPLATES, "('failure_analysis:' || uid)", name="name", smiles="smiles",
             phase="coalesce(phase_failed, 'clinical trials')")}, {RS.failure_sql()}
  from a where source in ('clinical_trial_failures', 'drug_withdrawals')),
f3 AS (select * from a where status in ('failed', 'withdrawn') or failure_reason is not null),
s3 AS (select 'improvement_suggestion:' || uid, 'improvement_suggestion', coalesce(source, 'unknown'),
  {_sql_pick(V.IMPROVEMENT_TEMPLATES, "('improvement_suggestion:' || uid)",
             reason="coalesce(failure_reason, warning_type, 'toxicity')", name="name", smiles="smiles")},
  {RS.improvement_sql()} from f3),
f4 AS (select * from a where molecular_weight is not null),
s4 AS (select 'property_analysis:' || uid, 'property_analysis', coalesce(source, 'unknown'),
  {_sql_pick(V.PROPERTY_TEMPLATES, "('property_analysis:' || uid)", smiles="smiles")}, {RS.property_sql()} from f4),
ap AS (select *, row_number() over (order by ord) as pr from a where status = 'approved'),
fl AS (select *, row_number() over (order by ord) as pr from a where status in ('failed', 'withdrawn')),
pp AS (select ap.uid as u1, fl.uid as u2, ap.smiles as smiles1, ap.name as name1, fl.smiles as smiles2, fl.name as name2,
  ap.name as d1_name, ap.status as d1_status, ap.molecular_weight as d1_molecular_weight, ap.alogp as d1_alogp,
  ap.psa as d1_psa, fl.name as d2_name, fl.status as d2_status, fl.molecular_weight as d2_molecular_weight,
  fl.alogp as d2_alogp, fl.psa as d2_psa
  from ap join fl on ap.pr = fl.pr),
s5 AS (select 'comparison:' || u1 || '|' || u2, 'comparison', 'generated',
  {_sql_pick(V.COMPARISON_TEMPLATES, "('comparison:' || u1 || '|' || u2)", smiles1="smiles1", name1="name1",
             smiles2="smiles2", name2="name2")}, {RS.comparison_sql()} from pp),
samples AS (select * from s1 union all select * from s2 union all select * from s3 union all select * from s4
  union all select * from s5)
"""


def samples(spark, d, with_output: bool = False):
    return instruction_dataset(B.compounds(spark, d), B.failures(spark, d), seed=42, with_output=with_output)


@register("instruction_samples", ALL_SQL + "select sample_id, task_type, source, instruction, '' as input from samples")
def instruction_samples(spark, d):
    return samples(spark, d).select("sample_id", "task_type", "source", "instruction", "input")


@register("instruction_task_counts", ALL_SQL + "select task_type, count(*) as count from samples group by task_type")
def instruction_task_counts(spark, d):
    return samples(spark, d).groupBy("task_type").agg(F.count(F.lit(1)).cast("bigint").alias("count"))


@register("instruction_splits", ALL_SQL + """
, r AS (select sample_id, row_number() over (order by md5('42:' || sample_id), sample_id) as position, count(*) over () as n from samples)
select sample_id, position, case when position <= floor(0.85 * n::double) then 'train'
  when position <= floor(0.95 * n::double) then 'val' else 'test' end as split from r""")
def instruction_splits(spark, d):
    return samples(spark, d).select("sample_id", "position", "split")


# ---- report texts: rows-only checks (text prints rule columns tested above) ---
@register("instruction_texts", ALL_SQL + f"""
, r AS (select sample_id, instruction, output, row_number() over (order by md5('42:' || sample_id), sample_id) as position,
  count(*) over () as n from samples)
select sample_id, case when position <= floor(0.85 * n::double) then 'train'
  when position <= floor(0.95 * n::double) then 'val' else 'test' end as split,
  {USER_SQL} || instruction || {TURN_SQL} || output || {DONE_SQL} as text
from r""")
def instruction_texts(spark, d):
    return samples(spark, d, with_output=True).select("sample_id", "split", "text")


@register("analysis_reports", W("compounds") + f"select row_id, {RS.analysis_sql()} as output from compounds")
def analysis_reports(spark, d):
    c = _ensure(B.compounds(spark, d), {"failure_reason": "string", "warning_type": "string"})
    return with_report(c, "drug_analysis").select("row_id", "output")


@register("failure_reports", W("failures") + f"select row_id, {RS.failure_sql()} as output from failures")
def failure_reports(spark, d):
    f = _ensure(B.failures(spark, d), WIDE)
    return with_report(f, "failure_analysis").select("row_id", "output")


@register("comparison_reports", PAIRS_SQL + f"select pair_rank, {RS.comparison_sql()} as output from p")
def comparison_reports(spark, d):
    return with_report(pairs(spark, d), "comparison").select(F.col("pair_rank").cast("bigint").alias("pair_rank"), "output")


@register("property_reports", W("compounds") + f"select row_id, {RS.property_sql()} as output from compounds")
def property_reports(spark, d):
    return with_report(B.compounds(spark, d), "property_analysis").select("row_id", "output")


@register("improvement_reports", W("failures") + f"select row_id, {RS.improvement_sql()} as output from failures")
def improvement_reports(spark, d):
    f = _ensure(B.failures(spark, d), WIDE)
    return with_report(f, "improvement_suggestion").select("row_id", "output")
