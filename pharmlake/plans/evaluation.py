"""Predictions -> score table -> metrics and baselines; responses -> response metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import clean_logits, positive_prob, with_softmax
from ..operators.metrics import classification_metrics, keyword_coverage, ranking_metrics


def score_logits(preds: DataFrame, logits: str = "logits") -> DataFrame:
    """Clean (F8), softmax (F9), argmax (F10), positive-class probability."""
    t = with_softmax(preds.withColumn("__clean", clean_logits(logits)), "__clean", "probs").drop("__clean")
    t = t.withColumn("__max", F.array_max("probs"))
    return t.select(*[c for c in t.columns if c != "__max"],
                    (F.array_position("probs", F.col("__max")) - 1).cast("int").alias("pred"),
                    positive_prob("probs").alias("pos_prob"))


def evaluate_predictions(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, precision, recall, specificity, F1, macro F1, ROC-AUC and PR-AUC."""
    keys = list(by) or ["__all"]
    s = scored if by else scored.withColumn("__all", F.lit(1))
    cls = classification_metrics(s, keys, "label", "pred")
    rk = ranking_metrics(s, keys, "label", "pos_prob")
    out = cls.join(rk, keys)
    return out if by else out.drop("__all")


def response_table(responses: DataFrame) -> DataFrame:
    """Per response: keywords array, tokens, keywords found and coverage."""
    kws = F.when(F.col("keywords") == "", F.array().cast("array<string>")).otherwise(F.split("keywords", ","))
    r = responses.withColumn("expected_keywords", kws) \
        .withColumn("tokens_generated", F.size(F.split(F.col("response"), " ")))
    kc = keyword_coverage("response", "expected_keywords")
    return r.select("*", kc["keywords_found"].alias("keywords_found"), kc["keyword_coverage"].alias("keyword_coverage"))
