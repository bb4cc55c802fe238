"""Classification, ranking and response metrics as aggregates (A, M22-M25).

All metrics are grouped by an optional model column, so one pass scores every
model. Division by zero gives 0 (try_divide + coalesce), as zero_division=0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import GOOD_AUC
from .ranking import _by, hash_int, seeded_hash

METRICS = ["accuracy", "f1_score", "roc_auc", "pr_auc"]


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


# ---- A1 / A2 / A3 / A17: dataset statistics ---------------------------------
def dataset_stats(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """A1: one row: total, per split, per label."""
    return df.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(F.col(split) == "train").alias("train_samples"),
        F.count_if(F.col(split) == "val").alias("val_samples"),
        F.count_if(F.col(split) == "test").alias("test_samples"),
        F.count_if(F.col(label) == 1).alias("approved_samples"),
        F.count_if(F.col(label) == 0).alias("failed_samples"),
    )


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """A2: count per value, most frequent first."""
    return df.groupBy(c).agg(F.count(F.lit(1)).cast("bigint").alias("count")).orderBy(F.desc("count"), F.col(c))


def value_counts_map(df: DataFrame, c: str) -> DataFrame:
    """A2 as a one-row map (for the statistics document). For low-cardinality columns."""
    vc = df.groupBy(c).agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    return vc.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(c), F.col("count"))))).alias(c))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """A3: weight = total / (classes x count) per class."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    wall = Window.partitionBy()
    return g.select(label, "count",
                    (F.sum("count").over(wall).cast("double")
                     / (F.count(F.lit(1)).over(wall) * F.col("count"))).alias("weight"))


def stage_funnel(passes: list[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """Rows per named stage as a long table. Each (frame, {stage: condition})
    pair is one aggregate pass with one ``count_if`` per stage (not one job per
    stage); the one-row results are unpivoted and unioned."""
    from functools import reduce

    parts = []
    for df, stages in passes:
        agg = df.agg(*[F.count_if(cond).cast("bigint").alias(name) for name, cond in stages.items()])
        parts.append(agg.select(F.explode(F.array(*[F.struct(F.lit(n).alias("stage"), F.col(n).alias("n"))
                                                   for n in stages])).alias("s")).select("s.stage", "s.n"))
    return reduce(lambda a, b: a.unionByName(b), parts)


# ---- A4-A6, M22: response metrics ------------------------------------------
def keyword_coverage(response: Column | str, keywords: Column | str) -> dict[str, Column]:
    """Keywords found (case folded substring) and their share; 1.0 if none expected."""
    r = F.lower(F.col(response) if isinstance(response, str) else response)
    kws = F.col(keywords) if isinstance(keywords, str) else keywords
    found = F.filter(kws, lambda k: F.coalesce(r.contains(F.lower(k)), F.lit(False)))
    cov = F.when(F.size(kws) == 0, F.lit(1.0)).otherwise(F.size(found).cast("double") / F.size(kws))
    return {"keywords_found": found, "keyword_coverage": cov}


def response_metrics(df: DataFrame) -> DataFrame:
    """A4: count and means of length, tokens and keyword coverage."""
    return df.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.avg("response_length").alias("avg_response_length"),
        F.avg("tokens_generated").alias("avg_tokens_generated"),
        F.avg("keyword_coverage").alias("avg_keyword_coverage"),
    )


def success_rate(df: DataFrame, min_len: int = 50) -> DataFrame:
    """A5: short responses (< min_len) and success rate; no row for an empty input."""
    agg = df.agg(F.count(F.lit(1)).alias("total_samples"),
                 F.count_if(F.col("response_length") < min_len).alias("failed_responses"))
    return agg.where(F.col("total_samples") > 0).select(
        "total_samples", "failed_responses",
        ((F.col("total_samples") - F.col("failed_responses")) / F.col("total_samples")).alias("success_rate"))


def per_type(df: DataFrame, type_col: str = "prompt_type") -> DataFrame:
    """A6 (long form): count and mean length per prompt type."""
    return df.groupBy(type_col).agg(F.count(F.lit(1)).alias("count"),
                                    F.avg("response_length").alias("avg_length"))


def per_type_wide(df: DataFrame, types: Sequence[str], type_col: str = "prompt_type") -> DataFrame:
    """A6 (wide form): ``{type}_count`` and ``{type}_avg_length`` columns. The type
    list is given, so the pivot needs no extra pass over the data."""
    p = df.groupBy().pivot(type_col, list(types)).agg(F.count(F.lit(1)).alias("count"),
                                                       F.avg("response_length").alias("avg_length"))
    return p


# ---- A7-A12: classification -------------------------------------------------
def confusion(df: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "pred",
              extra: Sequence[Column] = ()) -> DataFrame:
    """Tp, tn, fp, fn (plus any extra aggregates in the same pass)."""
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*by).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn"), *extra)


def from_confusion(cm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall (sensitivity), specificity, F1, macro F1."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    f1 = _div(2 * tp, 2 * tp + fp + fn)
    f1_neg = _div(2 * tn, 2 * tn + fn + fp)
    return cm.select(
        *by, "tp", "tn", "fp", "fn",
        _div(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _div(tp, tp + fp).alias("precision"),
        _div(tp, tp + fn).alias("recall"),
        _div(tn, tn + fp).alias("specificity"),
        f1.alias("f1_score"),
        ((f1 + f1_neg) / 2).alias("macro_f1"),
    )


def classification_metrics(df: DataFrame, by: Sequence[str] = (), label: str = "label",
                           pred: str = "pred") -> DataFrame:
    return from_confusion(confusion(df, by, label, pred), by)


def score_curve(df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score",
                rows_per_range: int | None = None) -> DataFrame:
    """Per distinct score, positives p and rows n, and running tp and k over
    scores in descending order.

    Rows are first reduced to one row per (model, score) (partial aggregation). The
    running sums use the two-level scan over sampled ranges of (model, score), so scores
    crowded into a narrow band, or one model with most rows, still spread over tasks; only
    models that straddle a boundary get offsets. Null scores rank last, like the smallest
    score; an empty table has an empty curve.
    """
    g = df.groupBy(*by, score).agg(F.sum(F.col(label).cast("bigint")).alias("p"),
                                   F.count(F.lit(1)).cast("bigint").alias("n"))
    return curve_of(g, by, score, rows_per_range)


def curve_of(counts: DataFrame, by: Sequence[str] = (), score: str = "score",
             rows_per_range: int | None = None) -> DataFrame:
    """The curve from one row per (by, score) with its positives p and rows n."""
    from .ranking import Ranges, running_sums

    ranges = Ranges.of(counts, [*by, score], rows_per_range)
    g = counts.withColumns({"__r": ranges.index(), "__s": ranges.straddles(len(by))})
    out = running_sums(g, list(by), [F.col(score).desc()], "__r", ["p", "n"], descending_buckets=True, straddles="__s")
    return out.drop("__r", "__s").withColumnRenamed("cum_p", "tp").withColumnRenamed("cum_n", "k")


def ranking_metrics(df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score",
                    rows_per_range: int | None = None) -> DataFrame:
    """A9 + A10: ROC-AUC (ties count half) and average precision; 0.5 with one class.

    AUC = sum((n - p) * (tp - p/2)) / (P * (N - P)); AP = sum(p/P * tp/k).
    """
    return ranking_of(score_curve(df, by, label, score, rows_per_range), by)


def ranking_of(c: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A9 + A10 from a curve."""
    p, n, tp, k = (F.col(x).cast("double") for x in ("p", "n", "tp", "k"))
    agg = c.groupBy(*by).agg(
        F.sum(p).alias("P"), F.sum(n).alias("N"),
        F.sum((n - p) * (tp - p / 2)).alias("__auc"),
        F.sum(p * tp / k).alias("__ap"))
    two = (F.col("P") > 0) & (F.col("P") < F.col("N"))
    return agg.select(
        *by,
        F.when(two, F.col("__auc") / (F.col("P") * (F.col("N") - F.col("P")))).otherwise(0.5).alias("roc_auc"),
        F.when(two, F.col("__ap") / F.col("P")).otherwise(0.5).alias("pr_auc"))


def majority_baseline(df: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Predict the majority class (1 if prior >= 0.5)."""
    agg = df.groupBy(*by).agg(F.count(F.lit(1)).alias("N"), F.sum(F.col(label).cast("bigint")).alias("P"))
    prior = F.col("P") / F.col("N")
    maj = F.when(prior >= 0.5, 1).otherwise(0)
    acc = F.when(maj == 1, prior).otherwise(1 - prior)
    f1 = F.when(maj == 1, _div(2 * F.col("P"), F.col("N") + F.col("P"))).otherwise(F.lit(0.0))
    return agg.select(*by, maj.alias("majority_class"), acc.alias("accuracy"), f1.alias("f1_score"),
                      F.lit(0.5).alias("roc_auc"), acc.alias("pr_auc"))


def random_baseline(df: DataFrame, by: Sequence[str] = (), label: str = "label", key: str = "id",
                    seed: int = 42) -> DataFrame:
    """Seeded hash prediction per row; AUC fixed 0.5, PR-AUC = class prior."""
    pred = (hash_int(seeded_hash(key, seed)) % 2).cast("int")
    cm = confusion(df.withColumn("__pred", pred), by, label, "__pred",
                   extra=[F.avg(F.col(label).cast("double")).alias("pr_auc")])
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return cm.select(*by, _div(tp + tn, tp + tn + fp + fn).alias("accuracy"),
                     _div(2 * tp, 2 * tp + fp + fn).alias("f1_score"), F.lit(0.5).alias("roc_auc"), "pr_auc")


def score_counts(df: DataFrame, model: str = "model", label: str = "label", score: str = "score",
                 pred: str = "pred") -> DataFrame:
    """One row per (model, score, prediction) with its positives, negatives, label sum p and
    rows n: everything the metrics of a model need. Written once, so whatever is derived
    from it reads this small table instead of the rows."""
    from ..session import cut_lineage

    y = F.col(label)
    table = df.groupBy(model, F.col(score).alias("score"), F.col(pred).alias("pred")).agg(
        F.count_if(y == 1).alias("positive"), F.count_if(y == 0).alias("negative"),
        F.sum(y.cast("bigint")).alias("p"), F.count(F.lit(1)).alias("n"))
    return cut_lineage(table, "score-counts")


def model_metrics(df: DataFrame, model: str = "model") -> DataFrame:
    """Accuracy, F1, ROC-AUC and PR-AUC per model (wide): one pass over the rows."""
    return metrics_of(score_counts(df, model), model)


def metrics_of(counts: DataFrame, model: str = "model") -> DataFrame:
    """The same from ``score_counts``."""
    said, denied = F.col("pred") == 1, F.col("pred") == 0
    zero = F.lit(0).cast("bigint")
    cm = counts.groupBy(model).agg(*[F.sum(F.when(on, F.col(c)).otherwise(zero)).alias(name) for name, on, c in (
        ("tp", said, "positive"), ("tn", denied, "negative"), ("fp", said, "negative"), ("fn", denied, "positive"))])
    cls = from_confusion(cm, [model]).select(model, "accuracy", "f1_score")
    rk = ranking_of(curve_of(counts.groupBy(model, "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), [model]), [model])
    rk, same = _by([model], rk)
    return cls.join(rk, same).drop(f"__k_{model}")


def to_long(wide: DataFrame, id_col: str, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Wide metric columns to (id, metric, value) rows."""
    return wide.select(id_col, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"),
                                                            F.col(m).cast("double").alias("value"))
                                                   for m in metrics])).alias("__m")) \
        .select(id_col, "__m.metric", "__m.value")


# ---- A13, A14, A16, M24, M25: comparisons and reports ------------------------
def mark_best(long: DataFrame, id_col: str = "model") -> DataFrame:
    """Best value per metric; a value is marked when it equals the best and is > 0.5."""
    w = Window.partitionBy("metric")
    return long.withColumn("best", F.max("value").over(w)) \
        .withColumn("is_best", (F.col("value") == F.col("best")) & (F.col("value") > 0.5))


def improvement(long: DataFrame, old: str, new: str, id_col: str = "model") -> DataFrame:
    """Per metric, (new - old)/old x 100 (0 when old <= 0) and the difference in points."""
    o = long.where(F.col(id_col) == old).select("metric", F.col("value").alias("old_value"))
    n = long.where(F.col(id_col) == new).select("metric", F.col("value").alias("new_value"))
    j = o.join(n, "metric")
    return j.select("metric", "old_value", "new_value",
                    F.when(F.col("old_value") > 0, (F.col("new_value") - F.col("old_value")) / F.col("old_value") * 100)
                    .otherwise(F.lit(0.0)).alias("improvement_pct"),
                    ((F.col("new_value") - F.col("old_value")) * 100).alias("difference_points"))


def interpret(metrics: DataFrame, auc_col: str = "roc_auc", cut: float = GOOD_AUC) -> DataFrame:
    """Good discriminative ability when AUC > cut."""
    return metrics.withColumn("good_discrimination", F.coalesce(F.col(auc_col) > cut, F.lit(False)))


def compare_models(df: DataFrame, model: str = "model") -> DataFrame:
    """Four metrics per model in long form with best marks, names capitalised."""
    from ..functions.text import capitalise

    long = to_long(model_metrics(df, model), model)
    return mark_best(long, model).withColumn("display_name", capitalise(model))


def report_rows(df: DataFrame, old: str, new: str, model: str = "model") -> DataFrame:
    """Report rows: one metric card per (model, metric), then the
    interpretation lines (accuracy and AUC change in points, AUC > 0.7 flag). The rows are
    read once (``score_counts``); the metrics, one row per model, are written once and
    every section reads them."""
    from ..session import cut_lineage

    wide = cut_lineage(model_metrics(df, model), "model-metrics")
    long = to_long(wide, model)
    cards = long.select(F.lit("card").alias("section"), F.col(model).alias("model"), "metric", "value")
    imp = improvement(long, old, new, model)
    lines = imp.where(F.col("metric").isin("accuracy", "roc_auc")).select(
        F.lit("interpretation").alias("section"), F.lit(new).alias("model"),
        F.concat(F.col("metric"), F.lit("_change_points")).alias("metric"),
        F.col("difference_points").alias("value"))
    good = interpret(wide.where(F.col(model) == new)).select(
        F.lit("interpretation").alias("section"), F.col(model).alias("model"),
        F.lit("good_discrimination").alias("metric"), F.col("good_discrimination").cast("double").alias("value"))
    return cards.unionByName(lines).unionByName(good)
