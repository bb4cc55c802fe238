"""Queries: classification and ranking metrics, baselines, comparisons, logits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import metrics as M
from ..operators.joins import against_baseline, align, first_available
from ..oracle_bindings import with_bindings as W
from ..plans.evaluation import score_logits
from ..sources import bindings as B
from . import register


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _r(df, cols):
    return df.select(*[r6(c).alias(c) if c in cols else F.col(c) for c in df.columns])


CM_SQL = """count(*) filter (where label = 1 and pred = 1) as tp, count(*) filter (where label = 0 and pred = 0) as tn,
  count(*) filter (where label = 0 and pred = 1) as fp, count(*) filter (where label = 1 and pred = 0) as fn"""


def _div(a, b):
    return f"coalesce(({a})::double / nullif({b}, 0), 0)"


CLS_SQL = W("scored") + f"""
, cm AS (select model, {CM_SQL} from scored group by model),
m AS (select model, tp, tn, fp, fn, {_div('tp + tn', 'tp + tn + fp + fn')} as accuracy, {_div('tp', 'tp + fp')} as precision,
  {_div('tp', 'tp + fn')} as recall, {_div('tn', 'tn + fp')} as specificity, {_div('2 * tp', '2 * tp + fp + fn')} as f1_score,
  ({_div('2 * tp', '2 * tp + fp + fn')} + {_div('2 * tn', '2 * tn + fn + fp')}) / 2 as macro_f1 from cm)
"""

CURVE_SQL = """
, g AS (select model, score, sum(label) as p, count(*) as n from scored group by model, score),
c AS (select model, score, p, n, sum(p) over (partition by model order by score desc rows between unbounded preceding and current row) as tp,
  sum(n) over (partition by model order by score desc rows between unbounded preceding and current row) as k from g),
rk AS (select model, sum(p)::double as pp, sum(n)::double as nn, sum((n - p)::double * (tp - p::double / 2)) as auc_s,
  sum(p::double * tp / k) as ap_s from c group by model),
rm AS (select model, case when pp > 0 and pp < nn then auc_s / (pp * (nn - pp)) else 0.5 end as roc_auc,
  case when pp > 0 and pp < nn then ap_s / pp else 0.5 end as pr_auc from rk)
"""

WIDE_SQL = CLS_SQL + CURVE_SQL + """
, wide AS (select m.model, m.accuracy, m.f1_score, rm.roc_auc, rm.pr_auc from m join rm on m.model = rm.model),
long AS (select model, 'accuracy' as metric, accuracy as value from wide union all select model, 'f1_score', f1_score from wide
  union all select model, 'roc_auc', roc_auc from wide union all select model, 'pr_auc', pr_auc from wide)
"""


@register("confusion_matrix", W("scored") + f"select model, {CM_SQL} from scored group by model")
def confusion_matrix(spark, d):
    return M.confusion(B.scored(spark, d), ["model"])


@register("classification_metrics", CLS_SQL + """
select model, tp, tn, fp, fn, round(accuracy, 6) as accuracy, round(precision, 6) as precision, round(recall, 6) as recall,
  round(specificity, 6) as specificity, round(f1_score, 6) as f1_score, round(macro_f1, 6) as macro_f1 from m""")
def classification_metrics(spark, d):
    m = M.classification_metrics(B.scored(spark, d), ["model"])
    return _r(m, ["accuracy", "precision", "recall", "specificity", "f1_score", "macro_f1"])


@register("score_curve", W("scored") + CURVE_SQL +
         "select model, score, cast(p as bigint) as p, n, cast(tp as bigint) as tp, cast(k as bigint) as k from c")
def score_curve(spark, d):
    c = M.score_curve(B.scored(spark, d), ["model"])
    return c.select("model", "score", F.col("p").cast("bigint").alias("p"), "n",
                    F.col("tp").cast("bigint").alias("tp"), F.col("k").cast("bigint").alias("k"))


@register("ranking_metrics", W("scored") + CURVE_SQL + """
select model, round(roc_auc, 6) as roc_auc, round(pr_auc, 6) as pr_auc from rm""")
def ranking_metrics(spark, d):
    return _r(M.ranking_metrics(B.scored(spark, d), ["model"]), ["roc_auc", "pr_auc"])


@register("majority_baseline", W("scored") + """
, a AS (select model, count(*) as nn, sum(label) as pp from scored group by model),
b AS (select model, nn, pp, pp::double / nn as prior from a)
select model, case when prior >= 0.5 then 1 else 0 end as majority_class,
  round(case when prior >= 0.5 then prior else 1 - prior end, 6) as accuracy,
  round(case when prior >= 0.5 then 2 * pp::double / (nn + pp) else 0 end, 6) as f1_score, 0.5::double as roc_auc,
  round(case when prior >= 0.5 then prior else 1 - prior end, 6) as pr_auc from b""")
def majority_baseline(spark, d):
    return _r(M.majority_baseline(B.scored(spark, d), ["model"]), ["accuracy", "f1_score", "pr_auc"])


@register("random_baseline", W("scored") + """
, s AS (select model, label, cast(cast(('0x' || substr(md5('42:' || cast(id as varchar)), 1, 8)) as bigint) % 2 as int) as pred
  from scored),
cm AS (select model, count(*) filter (where label = 1 and pred = 1) as tp, count(*) filter (where label = 0 and pred = 0) as tn,
  count(*) filter (where label = 0 and pred = 1) as fp, count(*) filter (where label = 1 and pred = 0) as fn,
  avg(label::double) as prior from s group by model)
select model, round(coalesce((tp + tn)::double / nullif(tp + tn + fp + fn, 0), 0), 6) as accuracy,
  round(coalesce((2 * tp)::double / nullif(2 * tp + fp + fn, 0), 0), 6) as f1_score, 0.5::double as roc_auc, round(prior, 6) as pr_auc
from cm""")
def random_baseline(spark, d):
    return _r(M.random_baseline(B.scored(spark, d), ["model"], key="id"), ["accuracy", "f1_score", "pr_auc"])


@register("compare_models", WIDE_SQL + """
select model, metric, round(value, 6) as value, round(max(value) over (partition by metric), 6) as best,
  value = max(value) over (partition by metric) and value > 0.5 as is_best,
  upper(substr(model, 1, 1)) || lower(substr(model, 2)) as display_name from long""")
def compare_models(spark, d):
    return _r(M.compare_models(B.scored(spark, d)), ["value", "best"])


@register("metric_improvement", WIDE_SQL + """
, o AS (select metric, value as old_value from long where model = 'de'),
nw AS (select metric, value as new_value from long where model = 'en')
select o.metric, round(old_value, 6) as old_value, round(new_value, 6) as new_value,
  round(case when old_value > 0 then (new_value - old_value) / old_value * 100 else 0 end, 6) as improvement_pct,
  round((new_value - old_value) * 100, 6) as difference_points from o join nw on o.metric = nw.metric""")
def metric_improvement(spark, d):
    long = M.to_long(M.model_metrics(B.scored(spark, d)), "model")
    return _r(M.improvement(long, "de", "en"), ["old_value", "new_value", "improvement_pct", "difference_points"])


@register("auc_interpretation", WIDE_SQL + """
select model, round(roc_auc, 6) as roc_auc, coalesce(roc_auc > 0.7, false) as good_discrimination from wide""")
def auc_interpretation(spark, d):
    w = M.interpret(M.model_metrics(B.scored(spark, d)))
    return _r(w.select("model", "roc_auc", "good_discrimination"), ["roc_auc"])


@register("report_rows", WIDE_SQL + """
, o AS (select metric, value as old_value from long where model = 'de'),
nw AS (select metric, value as new_value from long where model = 'en')
select 'card' as section, model, metric, round(value, 6) as value from long
union all select 'interpretation', 'en', o.metric || '_change_points', round((new_value - old_value) * 100, 6)
  from o join nw on o.metric = nw.metric where o.metric in ('accuracy', 'roc_auc')
union all select 'interpretation', model, 'good_discrimination', case when coalesce(roc_auc > 0.7, false) then 1.0 else 0.0 end
  from wide where model = 'en'""")
def report_rows(spark, d):
    return _r(M.report_rows(B.scored(spark, d), "de", "en"), ["value"])


@register("metrics_against_baseline", WIDE_SQL + """
, b AS (select metric, value as baseline_value from long where model = 'en')
select model, long.metric, round(value, 6) as value, round(baseline_value, 6) as baseline_value,
  round(value - baseline_value, 6) as delta from long join b on long.metric = b.metric""")
def metrics_against_baseline(spark, d):
    long = M.to_long(M.model_metrics(B.scored(spark, d)), "model")
    return _r(against_baseline(long, "en"), ["value", "baseline_value", "delta"])


@register("metrics_first_available", WIDE_SQL + """
, a AS (select metric, value from long where model = 'en' and metric in ('accuracy', 'f1_score')),
b AS (select metric, value from long where model = 'fr'),
wanted AS (select * from (values ('accuracy'), ('f1_score'), ('roc_auc'), ('pr_auc'), ('precision'), ('recall')) t(metric))
select wanted.metric, round(coalesce(a.value, b.value), 6) as value,
  case when a.value is not null then 'A' when b.value is not null then 'B' else 'N/A' end as origin
from wanted left join a on wanted.metric = a.metric left join b on wanted.metric = b.metric""")
def metrics_first_available(spark, d):
    long = M.to_long(M.model_metrics(B.scored(spark, d)), "model")
    a = long.where((F.col("model") == "en") & F.col("metric").isin("accuracy", "f1_score"))
    b = long.where(F.col("model") == "fr")
    wanted = spark.createDataFrame([(m,) for m in ["accuracy", "f1_score", "roc_auc", "pr_auc", "precision", "recall"]],
                                   "metric string")
    return _r(first_available(a, b, "metric", "value", wanted), ["value"])


@register("align_labels_predictions", """
select l.doc_id as id, l.quality as label, case when d.n_chars % 97 >= 30 then 1 else 0 end as pred
from labels l join documents d on l.doc_id = d.doc_id""")
def align_labels_predictions(spark, d):
    labels = B.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    preds = B.table(spark, d, "documents").select(F.col("doc_id").alias("id"),
                                                  F.when(F.col("n_chars") % 97 >= 30, 1).otherwise(0).alias("pred"))
    return align(labels, preds, "id")


# ---- logits: F8-F12, M23 ----------------------------------------------------
LOGIT_SQL = W("logits") + """
, c AS (select id, label, list_transform(logits, lambda x: case when isnan(x) then 0.0 when x = 'infinity'::double then 100.0
  when x = '-infinity'::double then -100.0 else x end) as cl from logits),
e AS (select id, label, cl, list_transform(cl, lambda x: exp(x - list_max(cl))) as ex from c),
p AS (select id, label, cl, list_transform(ex, lambda x: x / list_sum(ex)) as probs from e)
"""


@register("score_logits", LOGIT_SQL + """
select id, label, cast(list_position(probs, list_max(probs)) - 1 as int) as pred,
  round(case when len(probs) >= 2 then probs[2] else probs[1] end, 6) as pos_prob,
  round(list_max(probs), 6) as max_prob, round(list_sum(probs), 6) as prob_sum from p""")
def score_logits_q(spark, d):
    s = score_logits(B.logits(spark, d))
    return s.select("id", "label", "pred", r6("pos_prob").alias("pos_prob"), r6(F.array_max("probs")).alias("max_prob"),
                    r6(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)).alias("prob_sum"))


@register("logit_arrays", W("logits") + """
select id, len(logits) as size, len(list_filter(logits, lambda x: x > 0)) as n_positive,
  round(list_sum(logits[1:3]), 6) as head_sum, cast(list_position(logits, list_max(logits)) - 1 as int) as argmax
from logits""")
def logit_arrays(spark, d):
    lg = B.logits(spark, d)
    return lg.select("id", F.size("logits").cast("bigint").alias("size"),
                     F.size(F.filter("logits", lambda x: x > 0)).cast("bigint").alias("n_positive"),
                     r6(F.aggregate(F.slice("logits", 1, 3), F.lit(0.0), lambda a, x: a + x)).alias("head_sum"),
                     A.argmax("logits").alias("argmax"))


@register("logit_metrics", LOGIT_SQL + """
, s AS (select id, case when label = 1 then 1 else 0 end as label, case when list_position(probs, list_max(probs)) - 1 = 1
  then 1 else 0 end as pred from p)
select count(*) filter (where label = 1 and pred = 1) as tp, count(*) filter (where label = 0 and pred = 0) as tn,
  count(*) filter (where label = 0 and pred = 1) as fp, count(*) filter (where label = 1 and pred = 0) as fn from s""")
def logit_metrics(spark, d):
    s = score_logits(B.logits(spark, d))
    s = s.select(F.when(F.col("label") == 1, 1).otherwise(0).alias("label"),
                 F.when(F.col("pred") == 1, 1).otherwise(0).alias("pred"))
    return M.confusion(s)
