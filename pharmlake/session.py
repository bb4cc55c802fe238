"""Session helpers.

The library never creates executor-local scratch space: lineage is cut with
``DataFrame.checkpoint()`` into the shared folder named by
``spark.checkpoint.dir``. Only tests and local runs set one, and only when the
session has none.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Local runs read small tables: merge tiny shuffle outputs up to the advisory size
    # instead of keeping one per core (fewer near-empty tasks and files). Cluster
    # sessions keep their own settings; the library never sets this.
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "pharmlake") -> SparkSession:
    """A local session for tests and the benchmark (never used on a cluster)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", "8g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; create a scratch one only if unset."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    # A machine-local scratch folder is only acceptable when everything runs on this
    # machine (local mode: tests, the benchmark). On a cluster the shared folder must
    # be named by spark.checkpoint.dir.
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder (e.g. on HDFS or object "
                           "storage) that every executor can read")
    path = tempfile.mkdtemp(prefix="pharmlake-ckpt-")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise ``df`` once as a parquet table in the shared checkpoint folder and
    read it back.

    Unlike ``DataFrame.checkpoint()`` on an uncached frame (which computes the input
    twice: once for the action, once to write), this computes it once; the result is
    columnar, so later readers prune columns and push filters. The folder is the
    cluster's shared ``spark.checkpoint.dir``, so the table survives executor loss.
    """
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)
