"""User-function hooks (X1-X3): Arrow-batched pandas UDFs, predict_batch_udf and mapInPandas.

The library ships no chemistry toolkit or model; a user passes plain Python
functions and Spark runs them on Arrow batches inside the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_udf(fn: Callable, return_type: str):
    """Wrap a per-value function (value -> value; null stays null) as a pandas UDF."""

    @F.pandas_udf(return_type)
    def _u(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else fn(v))

    return _u


def series_udf(fn: Callable, return_type: str):
    """Wrap a Series -> Series function of equal length as a pandas UDF."""

    @F.pandas_udf(return_type)
    def _u(s: pd.Series) -> pd.Series:
        return fn(s)

    return _u


def array_udf(fn: Callable):
    """Per-value function returning a list of strings, as an array<string> pandas UDF (X1, UDTF case)."""

    @F.pandas_udf("array<string>")
    def _u(s: pd.Series) -> pd.Series:
        return s.map(lambda v: [] if v is None else list(fn(v)))

    return _u


def with_toolkit(df: DataFrame, c: str = "smiles", valid: Callable | None = None,
                 canon: Callable | None = None, variants: Callable | None = None, n: int = 2) -> DataFrame:
    """Add toolkit columns: ``is_valid``, ``canonical`` and ``variants`` (array). All
    three functions take one value."""
    out = df
    if valid is not None:
        out = out.withColumn("is_valid", F.coalesce(value_udf(valid, "boolean")(F.col(c)), F.lit(False)))
    if canon is not None:
        out = out.withColumn("canonical", F.coalesce(value_udf(canon, "string")(F.col(c)), F.col(c)))
    if variants is not None:
        out = out.withColumn("variants", array_udf(lambda s: variants(s, n))(F.col(c)))
    return out


def score_batches(df: DataFrame, load: Callable[[], Callable], id_col: str = "id",
                  batch: int = 16, input_cols: tuple[str, ...] = ()) -> DataFrame:
    """Score rows with a user's model in batches of at most ``batch`` rows.

    ``load`` is called once per Python worker and returns the scorer: a function of one
    numpy array per input column that gives a two-dimensional array of logits, one row
    each. Rows whose inputs hold a null are not scored (null logits). Output: id, logits
    array<double>."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, DoubleType

    score = predict_batch_udf(load, return_type=ArrayType(DoubleType()), batch_size=batch)
    whole = F.lit(True)
    for c in input_cols:
        whole = whole & F.col(c).isNotNull()
    rows = df.select(id_col, *input_cols)
    scored = rows.where(whole).select(id_col, score(*[F.col(c) for c in input_cols]).alias("logits"))
    return scored.unionByName(rows.where(~whole).select(id_col, F.lit(None).cast("array<double>").alias("logits")))


def respond(df: DataFrame, fn: Callable[[str], str], prompt_col: str = "prompt",
            out_col: str = "response") -> DataFrame:
    """A user responder applied to a prompt column on Arrow batches."""
    from pyspark.sql.types import StringType, StructField, StructType

    # A new StructType: StructType.add would change the frame's cached schema in place.
    schema = StructType(list(df.schema.fields) + [StructField(out_col, StringType(), True)])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pdf = pdf.copy()
            pdf[out_col] = pdf[prompt_col].map(lambda p: None if p is None else fn(p))
            yield pdf

    return df.mapInPandas(run, schema=schema)
