"""Supervised baseline on SMILES text as a Spark ML job (replaces the GPU
fine-tune of the reference): character n-grams -> hashed term counts -> logistic
regression weighted by class weights (A3)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .metrics import class_weights
from .splits import kfold


def baseline_pipeline(num_features: int = 1 << 12, max_iter: int = 15, reg: float = 0.01) -> Pipeline:
    chars = RegexTokenizer(inputCol="smiles", outputCol="__chars", pattern="", gaps=True, toLowercase=False,
                           minTokenLength=1)
    bi = NGram(n=2, inputCol="__chars", outputCol="__bi")
    tri = NGram(n=3, inputCol="__chars", outputCol="__tri")
    tf1 = HashingTF(inputCol="__chars", outputCol="__f1", numFeatures=num_features)
    tf2 = HashingTF(inputCol="__bi", outputCol="__f2", numFeatures=num_features)
    tf3 = HashingTF(inputCol="__tri", outputCol="__f3", numFeatures=num_features)
    vec = VectorAssembler(inputCols=["__f1", "__f2", "__f3"], outputCol="features")
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=max_iter,
                            regParam=reg)
    return Pipeline(stages=[chars, bi, tri, tf1, tf2, tf3, vec, lr])


def with_class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Attach A3 weights (one row per class; Spark chooses the join by its size)."""
    w = class_weights(df, label).select(label, "weight")
    return df.join(w, label)


def train_baseline(train: DataFrame, **kw) -> PipelineModel:
    t = with_class_weights(train.where(F.col("smiles").isNotNull()).withColumn("label", F.col("label").cast("double")))
    return baseline_pipeline(**kw).fit(t)


def cross_validate(train: DataFrame, folds: int = 5, regs: tuple[float, ...] = (0.001, 0.01, 0.1), seed: int = 42,
                   key: str = "smiles", **kw) -> tuple[PipelineModel, list[tuple[float, float]]]:
    """M26 with T4: the regularisation is chosen by cross-validation over the stratified
    seeded folds (``CrossValidator`` on the fold column), so it repeats with the seed
    whatever the partitioning. Returns the model fitted on all rows and (reg, mean ROC-AUC
    over the folds) per candidate."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    rows = kfold(train.where(F.col(key).isNotNull()), "label", key, folds, seed)
    rows = cut_lineage(with_class_weights(rows.withColumn("label", F.col("label").cast("double"))), "folds")
    pipeline = baseline_pipeline(**kw)
    grid = ParamGridBuilder().addGrid(pipeline.getStages()[-1].regParam, list(regs)).build()
    cv = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=folds,
                        foldCol="fold", seed=seed)
    fitted = cv.fit(rows)
    return fitted.bestModel, list(zip(regs, fitted.avgMetrics))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Rows with ``pred`` (0/1) and ``pos_prob``; the rest of the columns kept."""
    p = model.transform(df.where(F.col("smiles").isNotNull()).withColumn("weight", F.lit(1.0)))
    keep = [c for c in df.columns]
    return p.select(*keep, F.col("prediction").cast("int").alias("pred"),
                    vector_to_array("probability")[1].alias("pos_prob"))
