"""Queries over the compounds and failures bindings: cleaning, validity, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import rules as R
from ..functions.molecule import valid_alphabet, valid_length
from ..oracle_bindings import with_bindings as W
from ..operators import clean as C
from ..operators.joins import lookup, pair_by_rank
from ..plans.instruct_set import combined
from ..plans.prepare import prepare_molecules, unified_from_compounds
from ..sources import bindings as B
from . import register

LABEL_SQL = ("cast(case status when 'approved' then 1 when 'failed' then 0 when 'withdrawn' then 0 "
             "when 'experimental' then 0 else 0 end as int)")
SRC_RANK_SQL = ("case source when 'chembl' then 0 when 'drugbank' then 1 when 'fda_failed' then 2 "
                "when 'fda_novel' then 3 else 4 end")
ALPHA_SQL = "regexp_full_match(smiles, '[CNOSPFClBrI\\[\\]()=#+\\-0-9@/\\\\cnops]*')"


def unified(spark, d):
    return unified_from_compounds(B.compounds(spark, d))


# ---- flagship: scan -> P6 -> V1/V2 -> U3 -> M1 -> count per prediction and source
def outcome_counts(spark, d):
    c = B.compounds(spark, d).select("row_id", "smiles", "source", "status", "max_phase")
    c = C.drop_sentinels(c, "smiles", V.SENTINEL_NAMES)
    c = c.where(valid_length("smiles", 1, 10000) & valid_alphabet("smiles"))
    # project before the dedup: struct fields packed into the aggregate are not pruned
    c = C.dedup_first(c, "smiles", [C.source_rank("source"), F.col("row_id")])
    return c.groupBy(R.outcome().alias("prediction"), "source").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


register("outcome_counts", W("compounds") + f"""
, v AS (select * from compounds where (smiles is null or smiles not in ('N/A', 'N/A (Antibody)'))
   and smiles is not null and smiles <> '' and length(smiles) between 1 and 10000 and {ALPHA_SQL}),
d AS (select * from (select *, row_number() over (partition by smiles order by {SRC_RANK_SQL}, row_id) rn from v) where rn = 1)
select case when status = 'approved' or max_phase = 4 then 'APPROVED' when status in ('failed','withdrawn') then 'FAILED/WITHDRAWN'
  when max_phase >= 2 then 'IN DEVELOPMENT' else 'UNLIKELY TO SUCCEED' end as prediction, source, count(*) as n
from d group by all""")(outcome_counts)


# ---- P1 / P2 / P4 / U1 / J2 --------------------------------------------------
@register("unify_compounds", W("compounds") + f"select row_id, smiles, name, status, source, {LABEL_SQL} as label from compounds")
def unify_compounds(spark, d):
    return unified(spark, d)


@register("tag_by_status", W("compounds") + """
select row_id, smiles, 'chembl_approved' as source, 1 as label from compounds where status = 'approved'
union all select row_id, smiles, 'chembl_failed' as source, 0 as label from compounds where status in ('failed', 'withdrawn')
union all select row_id, smiles, 'other' as source, 0 as label from compounds where status = 'experimental'""")
def tag_by_status(spark, d):
    c = B.compounds(spark, d).select("row_id", "smiles", "status")
    parts = [C.tag(c.where(F.col("status") == "approved"), "chembl_approved", 1),
             C.tag(c.where(F.col("status").isin("failed", "withdrawn")), "chembl_failed", 0),
             C.tag(c.where(F.col("status") == "experimental"), "other", 0)]
    return C.union_same([p.select("row_id", "smiles", "source", "label") for p in parts])


@register("map_status_label", W("compounds") + f"select row_id, status, {LABEL_SQL} as label from compounds")
def map_status_label(spark, d):
    return B.compounds(spark, d).select("row_id", "status", C.map_label("status").alias("label"))


@register("lookup_status_label", W("compounds") + """
select row_id, status, coalesce(m.label, -1) as label from compounds left join
 (values ('approved', 1), ('failed', 0), ('withdrawn', 0)) m(st, label) on compounds.status = m.st""")
def lookup_status_label(spark, d):
    c = B.compounds(spark, d).select("row_id", "status")
    table = spark.createDataFrame([("approved", 1), ("failed", 0), ("withdrawn", 0)], "status string, label int")
    return lookup(c, table, "status", "label", -1)


@register("union_sources", W("compounds") + """
select source, count(*) as n, count(smiles) as with_smiles from compounds group by source""")
def union_sources(spark, d):
    u = unified(spark, d)
    parts = [u.where(F.col("source") == s) for s in V.SOURCE_ORDER]
    allu = C.union_same(parts)
    return allu.groupBy("source").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                      F.count("smiles").cast("bigint").alias("with_smiles"))


@register("union_wide_failures", W("compounds", "failures") + """
select concat('CMP', cast(row_id as varchar)) as uid, smiles, status, null::varchar as failure_reason from compounds
union all select concat('F', cast(row_id as varchar)) as uid, null::varchar as smiles, null::varchar as status, failure_reason from failures""")
def union_wide_failures(spark, d):
    c = B.compounds(spark, d).select(F.concat(F.lit("CMP"), F.col("row_id").cast("string")).alias("uid"), "smiles", "status")
    f = B.failures(spark, d).select(F.concat(F.lit("F"), F.col("row_id").cast("string")).alias("uid"), "failure_reason")
    return C.union_wide([c, f]).select("uid", "smiles", "status", "failure_reason")


# ---- P5 / P6 / P7 / P8 / P9 / P11 / P12 / P13 --------------------------------
@register("present_smiles", W("compounds") + "select row_id, smiles from compounds where smiles is not null and smiles <> ''")
def present_smiles(spark, d):
    return C.keep_present(B.compounds(spark, d), "smiles").select("row_id", "smiles")


@register("drop_sentinel_smiles", W("compounds") + """
select row_id, smiles from compounds where smiles is null or smiles not in ('N/A', 'N/A (Antibody)')""")
def drop_sentinel_smiles(spark, d):
    return C.drop_sentinels(B.compounds(spark, d), "smiles", V.SENTINEL_NAMES).select("row_id", "smiles")


@register("failed_or_reasoned_rows", W("compounds", "failures") + """
, u AS (select concat('CMP', cast(row_id as varchar)) as uid, status, null::varchar as failure_reason from compounds
  union all select concat('F', cast(row_id as varchar)), null, failure_reason from failures)
select uid, status, failure_reason from u where status in ('failed', 'withdrawn') or failure_reason is not null""")
def failed_or_reasoned_rows(spark, d):
    u = union_wide_failures(spark, d)
    return C.failed_or_reasoned(u).select("uid", "status", "failure_reason")


@register("failure_source_rows", W("compounds", "failures") + """
, u AS (select concat('CMP', cast(row_id as varchar)) as uid, source from compounds
  union all select concat('F', cast(row_id as varchar)), source from failures)
select uid, source from u where source in ('clinical_trial_failures', 'drug_withdrawals')""")
def failure_source_rows(spark, d):
    c = B.compounds(spark, d).select(F.concat(F.lit("CMP"), F.col("row_id").cast("string")).alias("uid"), "source")
    f = B.failures(spark, d).select(F.concat(F.lit("F"), F.col("row_id").cast("string")).alias("uid"), "source")
    return C.from_sources(C.union_same([c, f]), V.FAILURE_SOURCES)


@register("phase_windows", W("compounds") + """
select row_id, max_phase, 'approved' as phase_set from compounds where max_phase = 4
union all select row_id, max_phase, 'trial' from compounds where max_phase >= 1 and max_phase < 4""")
def phase_windows(spark, d):
    c = B.compounds(spark, d).select("row_id", "max_phase")
    a = C.phase_filter(c, eq=4).withColumn("phase_set", F.lit("approved"))
    t = C.phase_filter(c, lo=1, hi=4).withColumn("phase_set", F.lit("trial"))
    return a.unionByName(t)


@register("drop_missing_properties", W("compounds") + """
select row_id from compounds where smiles is not null and molecular_weight is not null and alogp is not null""")
def drop_missing_properties(spark, d):
    return C.drop_missing(B.compounds(spark, d), ["smiles", "molecular_weight", "alogp"]).select("row_id")


@register("rename_and_constant", W("compounds") + f"""
select row_id, {LABEL_SQL} as labels, '' as input from compounds""")
def rename_and_constant(spark, d):
    u = unified(spark, d)
    u = C.require_columns(u, ["smiles", "label"])
    return C.with_constant(C.rename(u, "label", "labels"), "input", "").select("row_id", "labels", "input")


# ---- V1 / V2 / V3 / V6 / U3 / U4 --------------------------------------------
@register("smiles_validity", W("compounds") + f"""
select row_id, coalesce(smiles is not null and smiles <> '' and length(smiles) between 5 and 60, false) as valid_length,
  coalesce(smiles is not null and smiles <> '' and {ALPHA_SQL}, false) as valid_alphabet from compounds""")
def smiles_validity(spark, d):
    c = B.compounds(spark, d)
    return c.select("row_id", valid_length("smiles", 5, 60).alias("valid_length"),
                    valid_alphabet("smiles").alias("valid_alphabet"))


@register("balance_gate", W("compounds") + f"""
, u AS (select {LABEL_SQL} as label from compounds)
select count(*) filter (where label = 1) as n_pos, count(*) filter (where label = 0) as n_neg,
  case when count(*) filter (where label = 1) < count(*) filter (where label = 0) then 1 else 0 end as minority_label,
  coalesce(least(count(*) filter (where label = 1), count(*) filter (where label = 0)) > 0 and
    greatest(count(*) filter (where label = 1), count(*) filter (where label = 0))::double /
    least(count(*) filter (where label = 1), count(*) filter (where label = 0)) > 2, false) as needs_balance from u""")
def balance_gate(spark, d):
    return C.needs_balance(unified(spark, d))


@register("dedup_smiles_first", W("compounds") + f"""
select row_id, smiles, source from (select *, row_number() over (partition by smiles order by {SRC_RANK_SQL}, row_id) rn
 from compounds) where rn = 1""")
def dedup_smiles_first(spark, d):
    c = B.compounds(spark, d).select("row_id", "smiles", "source")
    return C.dedup_first(c, "smiles", [C.source_rank("source"), F.col("row_id")])


@register("dedup_text_first", """
select doc_id, lang from (select *, row_number() over (partition by text order by doc_id) rn from documents) where rn = 1""")
def dedup_text_first(spark, d):
    t = B.tokens(spark, d).select("doc_id", "text", "lang")
    return C.dedup_first(t, "text", ["doc_id"]).select("doc_id", "lang")


@register("distinct_classes", W("compounds") + f"""
select distinct {LABEL_SQL} as label from compounds""")
def distinct_classes(spark, d):
    return C.classes(unified(spark, d))


@register("distinct_languages", "select distinct lang from documents")
def distinct_languages(spark, d):
    return C.classes(B.tokens(spark, d), "lang")


# ---- M1-M4, M6, M8, M9, M11-M14 rule columns ---------------------------------
OUTCOME_SQL = """case when status = 'approved' or max_phase = 4 then 'APPROVED' when status in ('failed','withdrawn') then 'FAILED/WITHDRAWN'
  when max_phase >= 2 then 'IN DEVELOPMENT' else 'UNLIKELY TO SUCCEED' end"""


@register("outcome_rule", W("compounds") + f"""
select row_id, {OUTCOME_SQL} as prediction,
  case when status = 'approved' or max_phase = 4 or status in ('failed','withdrawn') then 'High' else 'Medium' end as confidence
from compounds""")
def outcome_rule(spark, d):
    c = B.compounds(spark, d)
    return c.select("row_id", R.outcome().alias("prediction"), R.confidence().alias("confidence"))


def _b(cond: str) -> str:
    return f"coalesce({cond}, false)"


@register("property_flags", W("compounds") + f"""
select row_id, {_b('molecular_weight < 500')} as mw_ok, {_b('alogp < 5')} as logp_ok, {_b('hba <= 10')} as hba_ok,
  {_b('hbd <= 5')} as hbd_ok, {_b('psa <= 140')} as psa_ok, {_b('num_ro5_violations = 0')} as ro5_ok from compounds""")
def property_flags(spark, d):
    c = B.compounds(spark, d)
    return c.select("row_id", *[v.alias(k) for k, v in R.property_flags().items()])


@register("likeness_tier", W("compounds") + """
select row_id, case when num_ro5_violations = 0 and molecular_weight < 500 and alogp < 5 then 'excellent'
  when num_ro5_violations <= 1 then 'acceptable' else 'poor' end as tier from compounds""")
def likeness_tier(spark, d):
    return B.compounds(spark, d).select("row_id", R.likeness_tier().alias("tier"))


@register("status_section", W("compounds") + """
select row_id, case when status in ('failed','withdrawn') then 'failure' when status = 'approved' then 'success'
  else 'none' end as section from compounds""")
def status_section(spark, d):
    return B.compounds(spark, d).select("row_id", R.status_section().alias("section"))


@register("failure_route", W("failures") + """
select row_id, case when lower(failure_category) like '%cardio%' or lower(failure_category) like '%cardiac%' then 'cardio'
  when lower(failure_category) like '%hepato%' or lower(failure_category) like '%liver%' then 'hepato'
  when lower(failure_category) like '%efficacy%' then 'efficacy' else 'other' end as route from failures""")
def failure_route(spark, d):
    return B.failures(spark, d).select("row_id", R.failure_route().alias("route"))


PAIRS_SQL = W("compounds") + """
, a AS (select * from compounds where status = 'approved'),
f AS (select * from compounds where status in ('failed','withdrawn')),
ra AS (select *, row_number() over (order by row_id) as pair_rank from a),
rf AS (select *, row_number() over (order by row_id) as pair_rank from f),
p AS (select ra.pair_rank, ra.row_id as d1_row_id, ra.name as d1_name, ra.status as d1_status,
  ra.molecular_weight as d1_molecular_weight, ra.alogp as d1_alogp, ra.psa as d1_psa,
  rf.row_id as d2_row_id, rf.name as d2_name, rf.status as d2_status,
  rf.molecular_weight as d2_molecular_weight, rf.alogp as d2_alogp, rf.psa as d2_psa
  from ra join rf on ra.pair_rank = rf.pair_rank)
"""


def pairs(spark, d):
    c = B.compounds(spark, d)
    cols = ["row_id", "name", "status", "molecular_weight", "alogp", "psa"]
    return pair_by_rank(c.where(F.col("status") == "approved"), c.where(F.col("status").isin("failed", "withdrawn")),
                        "row_id", cols=cols)


@register("pair_by_rank", PAIRS_SQL + "select pair_rank, d1_row_id, d2_row_id from p")
def pair_by_rank_q(spark, d):
    return pairs(spark, d).select(F.col("pair_rank").cast("bigint").alias("pair_rank"), "d1_row_id", "d2_row_id")


@register("head_to_head", PAIRS_SQL + """
select pair_rank, case when d1_status = 'approved' then 1 when d2_status = 'approved' then 2 else 0 end as status_winner,
  case when d1_molecular_weight < d2_molecular_weight then 1 else 2 end as weight_winner,
  case when abs(d1_alogp - 2) < abs(d2_alogp - 2) then 1 else 2 end as logp_winner,
  case when d1_psa < d2_psa then 1 else 2 end as psa_winner,
  case when coalesce(d1_status = 'approved', false) and not coalesce(d2_status = 'approved', false) then 'first'
       when coalesce(d2_status = 'approved', false) and not coalesce(d1_status = 'approved', false) then 'second'
       else 'similar' end as verdict,
  case when d1_molecular_weight < 500 and d1_alogp < 5 then 'better' else 'challenging' end as d1_outlook,
  case when d2_molecular_weight < 500 and d2_alogp < 5 then 'better' else 'challenging' end as d2_outlook
from p""")
def head_to_head(spark, d):
    from ..functions.text import nearer

    p = pairs(spark, d)
    hh = R.head_to_head()
    return p.select(F.col("pair_rank").cast("bigint").alias("pair_rank"), hh["status_winner"].alias("status_winner"),
                    hh["weight_winner"].alias("weight_winner"),
                    nearer("d1_alogp", "d2_alogp", 2.0).alias("logp_winner"), hh["psa_winner"].alias("psa_winner"),
                    R.verdict().alias("verdict"),
                    R.oral_outlook(F.col("d1_molecular_weight"), F.col("d1_alogp")).alias("d1_outlook"),
                    R.oral_outlook(F.col("d2_molecular_weight"), F.col("d2_alogp")).alias("d2_outlook"))


@register("range_flags", W("compounds") + f"""
select row_id, {_b('molecular_weight >= 150 and molecular_weight <= 500')} as mw_in_range,
  {_b('alogp >= 0 and alogp <= 5')} as logp_in_range, {_b('hba <= 10')} as hba_in_range, {_b('hbd <= 5')} as hbd_in_range,
  {_b('psa < 140')} as psa_in_range, {_b('rtb <= 10')} as rtb_in_range from compounds""")
def range_flags(spark, d):
    return B.compounds(spark, d).select("row_id", *[v.alias(k) for k, v in R.range_flags().items()])


@register("admet_rules", W("compounds") + f"""
select row_id, {_b('psa < 140 and alogp < 5')} as good_absorption, {_b('psa < 90 and alogp > 1 and alogp < 5')} as cns_penetrant,
  {_b('alogp > 3')} as high_binding, case when alogp > 3 then 'high' when alogp > 1 then 'moderate' else 'low' end as volume,
  {_b('molecular_weight > 300 and alogp > 1')} as cyp_substrate, {_b('alogp > 4')} as cyp_inhibition,
  {_b('alogp > 1')} as hepatic_clearance, {_b('molecular_weight > 400 and alogp > 3')} as long_half_life from compounds""")
def admet_rules(spark, d):
    return B.compounds(spark, d).select("row_id", *[v.alias(k) for k, v in R.admet_rules().items()])


@register("lipinski_veber", W("compounds") + f"""
select row_id, {_b('molecular_weight <= 500 and alogp <= 5 and hbd <= 5 and hba <= 10')} as lipinski_pass,
  {_b('rtb <= 10 and psa < 140')} as veber_pass from compounds""")
def lipinski_veber(spark, d):
    return B.compounds(spark, d).select("row_id", R.lipinski().alias("lipinski_pass"), R.veber().alias("veber_pass"))


# ---- M27: end-to-end molecule preparation ------------------------------------
def _t1_sql(source: str, key: str, label: str, num: int, den: int) -> str:
    return f"""
, per AS (select {label} as label, count(*) as nc from {source} group by 1),
t AS (select label, nc, sum(nc) over () as n from per),
h AS (select *, (n * {den - num} + {den - 1}) // {den} as hold from t),
q AS (select *, (nc * hold) // n as b1, (nc * hold) % n as r1 from h),
q2 AS (select *, hold - sum(b1) over () as left1, row_number() over (order by r1 desc, label) as rk1 from q),
q3 AS (select *, b1 + case when rk1 <= left1 then 1 else 0 end as hq, (hold + 1) // 2 as test from q2),
q4 AS (select *, case when hold = 0 then 0 else (hq * test) // hold end as b2,
  case when hold = 0 then 0 else (hq * test) % hold end as r2 from q3),
q5 AS (select *, test - sum(b2) over () as left2, row_number() over (order by r2 desc, label) as rk2 from q4),
quota AS (select label, hq, b2 + case when rk2 <= left2 then 1 else 0 end as tq from q5),
ranked AS (select s.*, row_number() over (partition by s.{label} order by md5('42:' || cast(s.{key} as varchar)), s.{key}) as rn
  from {source} s),
split_rows AS (select ranked.*, case when rn <= tq then 'test' when rn <= hq then 'val' else 'train' end as split
  from ranked join quota on ranked.{label} = quota.label)
"""


PREP_SQL = W("compounds") + f"""
, u AS (select smiles, name, status, source, {LABEL_SQL} as label, row_id from compounds),
v AS (select * from u where smiles is not null and smiles <> '' and length(smiles) between 1 and 10000 and {ALPHA_SQL}),
dd AS (select * from (select *, row_number() over (partition by smiles order by {SRC_RANK_SQL}, row_id) rn0 from v) where rn0 = 1)
""" + _t1_sql("dd", "smiles", "label", 4, 5)


@register("prepare_molecules", PREP_SQL + "select smiles, name, status, source, label, split from split_rows")
def prepare_molecules_q(spark, d):
    return prepare_molecules(unified(spark, d), train=0.8, seed=42)


@register("split_stratified", W("compounds") + f"""
, u AS (select compound_id, {LABEL_SQL} as label from compounds)
""" + _t1_sql("u", "compound_id", "label", 4, 5) + "select compound_id, label, split from split_rows")
def split_stratified_q(spark, d):
    from ..operators.splits import split_stratified

    u = B.compounds(spark, d).select("compound_id", C.map_label("status").alias("label"))
    return split_stratified(u, "label", "compound_id", 0.8, 42)


@register("prepared_statistics", PREP_SQL + """
, src AS (select source, count(*) as n from split_rows group by source)
select (select count(*) from split_rows) as total_samples,
  (select count(*) from split_rows where split = 'train') as train_samples,
  (select count(*) from split_rows where split = 'val') as val_samples,
  (select count(*) from split_rows where split = 'test') as test_samples,
  (select count(*) from split_rows where label = 1) as approved_samples,
  (select count(*) from split_rows where label = 0) as failed_samples""")
def prepared_statistics(spark, d):
    from ..plans.prepare import statistics

    return statistics(prepare_molecules_q(spark, d)).drop("sources")


@register("prepared_source_counts", PREP_SQL + "select source, count(*) as count from split_rows group by source")
def prepared_source_counts(spark, d):
    from ..operators.metrics import value_counts

    return value_counts(prepare_molecules_q(spark, d), "source")


@register("stage_funnel", W("compounds") + f"""
, v AS (select * from compounds where smiles is not null and smiles <> '' and length(smiles) between 1 and 10000 and {ALPHA_SQL}),
dd AS (select * from (select *, row_number() over (partition by smiles order by {SRC_RANK_SQL}, row_id) rn0 from v) where rn0 = 1)
select 'chembl' as stage, count(*) as n from compounds where source = 'chembl'
union all select 'drugbank', count(*) from compounds where source = 'drugbank'
union all select 'fda', count(*) from compounds where source in ('fda_failed', 'fda_novel')
union all select 'combined', count(*) from compounds
union all select 'valid', count(*) from v
union all select 'unique', count(*) from dd
union all select 'approved', count(*) from dd where status = 'approved'
union all select 'not_approved', count(*) from dd where status is distinct from 'approved'""")
def stage_funnel(spark, d):
    from ..functions.molecule import valid_smiles
    from ..operators.metrics import stage_funnel as funnel

    u = unified(spark, d)
    v = u.where(valid_smiles("smiles"))
    dd = C.dedup_first(v, "smiles", [C.source_rank("source"), F.col("row_id")])
    src = F.col("source")
    raw = {"chembl": src == "chembl", "drugbank": src == "drugbank", "fda": src.isin("fda_failed", "fda_novel"),
           "combined": F.lit(True), "valid": valid_smiles("smiles")}
    kept = {"unique": F.lit(True), "approved": F.col("label") == 1, "not_approved": F.col("label") == 0}
    return funnel([(u, raw), (dd, kept)])


@register("class_weights", W("compounds") + f"""
, g AS (select {LABEL_SQL} as label, count(*) as count from compounds group by 1)
select label, count, round(sum(count) over ()::double / (count(*) over () * count), 6) as weight from g""")
def class_weights_q(spark, d):
    from ..operators.metrics import class_weights

    w = class_weights(unified(spark, d))
    return w.select("label", "count", F.round("weight", 6).alias("weight"))
