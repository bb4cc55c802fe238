"""Rule columns over a parquet file stream (Structured Streaming, ``availableNow``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.molecule import valid_smiles


def classify_stream(stream: DataFrame) -> DataFrame:
    """Stateless projection of compound rows: validity, outcome, Lipinski, Veber."""
    return stream.select("row_id", "smiles", "status", valid_smiles("smiles").alias("valid"),
                         R.outcome().alias("prediction"), R.lipinski().alias("lipinski_pass"),
                         R.veber().alias("veber_pass"))


def run_once(spark: SparkSession, source_dir: str, schema: str, sink_dir: str, checkpoint_dir: str) -> None:
    """Process every file present in ``source_dir`` once (``availableNow``) and stop.
    Progress is kept in ``checkpoint_dir`` (a shared folder on a cluster), so a
    restarted run continues where it stopped."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(source_dir)
    q = (classify_stream(stream).writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()


def stream_outcome_counts(stream: DataFrame) -> DataFrame:
    """Running counts per predicted outcome (a stateful aggregate, complete mode)."""
    return classify_stream(stream).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))
