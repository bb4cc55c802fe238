"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pharmlake.session import ensure_checkpoint_dir

WHITESPACE = "[\\x20\\x09-\\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table, through Spark's reader only (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of the queries started inside are removed when each query ends, and
    not only once the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once as parquet into the shared checkpoint folder and read back (cuts the
    lineage; survives the loss of executors). Nothing reads the shuffles of the write again."""
    path = shared_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Removes a table made by ``stored`` once everything that reads it is stored itself."""
    context = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Bounds the Arrow batches that Spark hands to Python workers, by rows and by bytes,
    for the rest of this session: buffers on both sides stay small whatever the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def free_memory() -> None:
    """Hands memory that Python, Arrow and the C library keep for reuse back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def lean(run):
    """``run`` (batches to batches) with the memory given back at the task's end: Spark
    keeps Python workers for later tasks, beside whatever those need."""
    def body(batches):
        yield from run(batches)
        free_memory()

    return body


def range_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending quantile boundaries of a long column (a boundary
    repeats when one value fills several ranges). The list is bounded by ``parts``, not
    by the data."""
    if parts < 2:
        return []
    cuts = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(column, cuts, max(10_000, parts * 16)).alias("b")).first()
    return sorted(int(b) for b in (row["b"] or []))


def count_below(value: Column, bounds: list[int], inclusive: bool) -> Column:
    """How many boundaries are <= value (or < value): two short scans, over every 64th
    boundary and then inside one block. Null counts as below all of them."""
    step = 64
    if not bounds:
        return F.lit(0)

    def passed(b):
        return (b <= value) if inclusive else (b < value)

    def longs(xs):
        return F.expr("array(" + ", ".join(f"cast('{int(x)}' as bigint)" for x in xs) + ")")

    blocks = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    if len(blocks) == 1:
        n = F.size(F.filter(longs(bounds), passed))
    else:
        heads = F.size(F.filter(longs([b[0] for b in blocks]), passed))
        tables = F.array(*[longs(b) for b in blocks])
        inside = F.size(F.filter(F.element_at(tables, F.greatest(heads, F.lit(1))), passed))
        n = F.when(heads == 0, 0).otherwise((heads - 1) * step + inside)
    return F.when(value.isNull(), 0).otherwise(n).cast("int")
