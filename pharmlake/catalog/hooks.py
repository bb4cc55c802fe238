"""Queries with user functions: toolkit hooks, batch scorer, responder (with stand-in
functions that SQL can express too), and the Spark ML baseline (iterative, rows-only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hooks as X
from ..operators.baseline import predict, train_baseline
from ..plans.evaluation import evaluate_predictions, response_table, score_logits
from ..plans.prepare import prepare_molecules, unified_from_compounds
from ..sources import bindings as B
from ..oracle_bindings import with_bindings as W
from . import register
from .molecules import LABEL_SQL, SRC_RANK_SQL, _t1_sql


# Stand-ins for a chemistry toolkit: a parse check (balanced brackets and rings
# closed), a canonical form (aromatic atoms as written, branches kept) and
# alternative spellings. Users pass real toolkit functions.
def balanced(s: str) -> bool:
    depth = 0
    for ch in s:
        depth += ch == "("
        depth -= ch == ")"
        if depth < 0:
            return False
    return depth == 0 and s.count("[") == s.count("]")


def canonical(s: str) -> str:
    return s.strip()


def spellings(s: str, n: int) -> list[str]:
    out = [s]
    if "(" in s:
        out.append(s.replace("(=O)", "(O=)") if "(=O)" in s else s)
    out.append(s[::-1])
    return out[: n + 1]


BALANCED_SQL = """coalesce(length(replace({c}, '(', '')) = length(replace({c}, ')', ''))
  and length(replace({c}, '[', '')) = length(replace({c}, ']', ''))
  and list_min(list_transform(range(1, length({c}) + 1), lambda i: length(replace({c}[1:i], ')', '')) - length(replace({c}[1:i], '(', '')))) >= 0, false)"""


@register("toolkit_columns", W("compounds") + f"""
select row_id, {BALANCED_SQL.format(c='smiles')} as is_valid, trim(smiles) as canonical,
  cast(case when contains(smiles, '(') then 3 else 2 end as int) as n_variants from compounds where smiles is not null""")
def toolkit_columns(spark, d):
    c = B.compounds(spark, d).where(F.col("smiles").isNotNull()).select("row_id", "smiles")
    return X.with_toolkit(c, "smiles", valid=balanced, canon=canonical, variants=spellings, n=2) \
        .select("row_id", "is_valid", "canonical", F.size("variants").alias("n_variants"))


@register("prepare_with_toolkit", W("compounds") + f"""
, u AS (select trim(smiles) as smiles, name, status, source, {LABEL_SQL} as label, row_id from compounds
  where smiles is not null and smiles <> '' and length(smiles) between 1 and 10000 and {BALANCED_SQL.format(c='smiles')}),
dd AS (select smiles, name, status, source, label from (select *, row_number() over (partition by smiles order by {SRC_RANK_SQL}, row_id) rn0 from u) where rn0 = 1),
n AS (select count(*) filter (where label = 1) as pos, count(*) filter (where label = 0) as neg from dd),
gate AS (select case when pos < neg then 1 else 0 end as minority from n
  where least(pos, neg) > 0 and greatest(pos, neg)::double / least(pos, neg) > 2),
spelled AS (select dd.*, list_filter(list_distinct([smiles, case when contains(smiles, '(') then replace(smiles, '(=O)', '(O=)') end, reverse(smiles)]),
  lambda x: x is not null and x <> smiles) as alt from dd join gate on label = minority),
extra AS (select unnest(alt) as smiles, name, status, source || '_aug' as source, label from spelled),
al AS (select * from dd union all select * from extra)
""" + _t1_sql("al", "smiles", "label", 4, 5) + "select smiles, name, status, source, label, split from split_rows")
def prepare_with_toolkit(spark, d):
    u = unified_from_compounds(B.compounds(spark, d))
    return prepare_molecules(u, validator=balanced, canon=canonical, variants=spellings, n_variants=2)


SCORES_SQL = """WITH s AS (select l.doc_id as id, l.quality as label, d.n_chars::double / 1000.0 as x
  from labels l join documents d on l.doc_id = d.doc_id),
e AS (select id, label, exp(-x - greatest(-x, x)) as e0, exp(x - greatest(-x, x)) as e1 from s),
p AS (select id, label, e0 / (0.0 + e0 + e1) as p0, e1 / (0.0 + e0 + e1) as p1 from e),
scored AS (select id, label, case when p1 > p0 then 1 else 0 end as pred, p1 as pos_prob from p)
"""


def _scores_raw(spark, d):
    """X2 + M23: a user scorer, loaded once a worker, on batches of 16 rows; logits from
    text length."""

    def load():
        import numpy as np

        def scorer(n_chars):
            x = n_chars.astype(float) / 1000.0
            return np.stack([-x, x], axis=1)

        return scorer

    docs = B.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    s = X.score_batches(docs, load, "id", 16, ("n_chars",))
    labels = B.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return score_logits(s.join(labels, "id")).select("id", "label", "pred", "pos_prob")


@register("batch_scores", SCORES_SQL + "select id, label, pred, round(pos_prob, 6) as pos_prob from scored")
def batch_scores(spark, d):
    s = _scores_raw(spark, d)
    return s.select("id", "label", "pred", F.round("pos_prob", 6).alias("pos_prob"))


def _div(a: str, b: str) -> str:
    return f"coalesce(({a})::double / nullif({b}, 0), 0)"


@register("batch_score_metrics", SCORES_SQL + f"""
, cm AS (select count(*) filter (where label = 1 and pred = 1) as tp, count(*) filter (where label = 0 and pred = 0) as tn,
  count(*) filter (where label = 0 and pred = 1) as fp, count(*) filter (where label = 1 and pred = 0) as fn from scored),
g AS (select pos_prob, sum(label) as p, count(*) as n from scored group by pos_prob),
c AS (select p, n, sum(p) over (order by pos_prob desc rows between unbounded preceding and current row) as tp_,
  sum(n) over (order by pos_prob desc rows between unbounded preceding and current row) as k from g),
rk AS (select sum(p)::double as pp, sum(n)::double as nn, sum((n - p)::double * (tp_ - p::double / 2)) as auc_s,
  sum(p::double * tp_ / k) as ap_s from c)
select tp, tn, fp, fn, round({_div('tp + tn', 'tp + tn + fp + fn')}, 6) as accuracy, round({_div('tp', 'tp + fp')}, 6) as precision,
  round({_div('tp', 'tp + fn')}, 6) as recall, round({_div('tn', 'tn + fp')}, 6) as specificity,
  round({_div('2 * tp', '2 * tp + fp + fn')}, 6) as f1_score,
  round(({_div('2 * tp', '2 * tp + fp + fn')} + {_div('2 * tn', '2 * tn + fn + fp')}) / 2, 6) as macro_f1,
  round(case when pp > 0 and pp < nn then auc_s / (pp * (nn - pp)) else 0.5 end, 6) as roc_auc,
  round(case when pp > 0 and pp < nn then ap_s / pp else 0.5 end, 6) as pr_auc
from cm, rk""")
def batch_score_metrics(spark, d):
    m = evaluate_predictions(_scores_raw(spark, d))
    return m.select("tp", "tn", "fp", "fn", *[F.round(c, 6).alias(c) for c in
                                              ("accuracy", "precision", "recall", "specificity", "f1_score", "macro_f1",
                                               "roc_auc", "pr_auc")])


RESP = "lower('Response: ' || lower(text))"


@register("responder_coverage", f"""
select conv_id, turn, cast(length('Response: ' || lower(text)) as bigint) as response_length,
  case when conv_id % 2 = 0 then (cast(contains({RESP}, 'the') as int) + cast(contains({RESP}, 'of') as int))::double / 2
       else 1.0::double end as keyword_coverage
from conversations where role = 'user'""")
def responder_coverage(spark, d):
    """X3 + M22: a user responder on user turns, then keyword coverage."""
    users = B.chats(spark, d).where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    r = X.respond(users, lambda p: "Response: " + p.lower(), "prompt", "response")
    r = r.withColumn("response_length", F.length("response")).withColumn(
        "keywords", F.when(F.col("conv_id") % 2 == 0, F.lit("the,of")).otherwise(F.lit("")))
    return response_table(r).select("conv_id", "turn", F.col("response_length").cast("bigint").alias("response_length"),
                                    "keyword_coverage")


@register("baseline_predictions")
def baseline_predictions(spark, d):
    """Train on the train split of the prepared molecules, score the test split."""
    prepared = prepare_molecules(unified_from_compounds(B.compounds(spark, d)))
    model = train_baseline(prepared.where(F.col("split") == "train"))
    return predict(model, prepared.where(F.col("split") == "test")).select("smiles", "label", "pred", "pos_prob")


@register("baseline_metrics")
def baseline_metrics(spark, d):
    return evaluate_predictions(baseline_predictions(spark, d))
