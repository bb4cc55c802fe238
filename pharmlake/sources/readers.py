"""Landed-file readers (S1-S4, S14, S19, S21). Schemas are declared, never inferred,
except for the directory scan of differing CSV files (S3), whose files differ."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType


_NO_HOST = "^([A-Za-z0-9+.-]+):///+"  # listings and scans write file:///x or file:/x
ORDER_FIELDS = "file int, block bigint, place bigint"
ORDER_TYPE = "struct<file: int, block: bigint, place: bigint>"


def _fs_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths matching a glob via the Hadoop file system (driver-side listing only)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = p.getFileSystem(conf)
    st = fs.globStatus(p)
    return sorted(str(s.getPath().toString()) for s in st) if st else []


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_fs_paths(spark, path))


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def _typed(raw: DataFrame, st: StructType, as_is: Sequence[str] = ()) -> DataFrame:
    """Declared columns of a text frame by name: absent ones null, values that do not
    parse null, NaN null. Columns ``as_is`` pass unchanged."""
    by_name = {c.strip().lower(): c for c in raw.columns}
    cols = []
    for f in st.fields:
        if f.name.lower() not in by_name:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        v = F.col(f"`{by_name[f.name.lower()]}`")
        kind = f.dataType.simpleString()
        if f.name in as_is:
            pass
        elif kind.startswith(("array", "struct", "map")):
            v = F.from_json(v, kind)
        elif kind != "string":
            v = v.try_cast(f.dataType)
            v = F.when(~F.isnan(v), v) if kind in ("double", "float") else v
        cols.append(v.alias(f.name))
    return raw.select(*cols)


def _header(spark: SparkSession, uri: str, multi_line: bool = False) -> list[str]:
    """Column names of one CSV file from its first line that is not blank (only the start of
    the file is read; with ``multi_line`` a quoted name may hold line ends)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
    stream = path.getFileSystem(conf).open(path)
    try:
        plain = stream if codec is None else codec.createInputStream(stream)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8"))

        def lines():
            seen = False
            while (line := reader.readLine()) is not None:
                line = line if seen else line.removeprefix("\ufeff")
                if seen or line.strip():
                    yield line + "\n"
                    seen = True
                    if not multi_line:
                        return

        names = next(csv.reader(lines()), [])
    finally:
        stream.close()
    return [n.strip() or f"_c{i}" for i, n in enumerate(names)]


def _files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Data files below the paths, sorted, as URIs (a listing, no job)."""
    return sorted(spark.read.schema("value string").text(list(paths)).inputFiles()) if paths else []


def header_of(spark: SparkSession, path: str) -> DataFrame:
    """A frame without rows that has the columns of the CSV file(s) in lower case."""
    names = dict.fromkeys(n.lower() for f in _files(spark, [path]) for n in _header(spark, f))
    return empty(spark, StructType([StructField(n, StringType()) for n in names]))


def _scan(spark: SparkSession, paths: Sequence[str], headers: dict[str, list[str]], names: Sequence[str],
          multi_line: bool, about: dict[str, tuple] | None = None, about_schema: str = "") -> DataFrame:
    """One scan over CSV files with differing headers: the columns ``names`` as text (null
    in files without them), partition columns, the columns ``about`` gives for each file,
    and ``__at`` (file number, block, place): the order of the rows in their files.

    A column that stands at one place in all files is read from there. Otherwise a table
    with one row per listed file, joined on the file's path, says where; it is as long as
    the listing, which the driver holds already."""
    width = max([len(h) for h in headers.values()] + [1])
    text = StructType([StructField(f"_c{i}", StringType()) for i in range(width)])
    raw = spark.read.schema(text).option("header", "true").option("enforceSchema", "true") \
        .option("multiLine", str(multi_line).lower()).option("escape", '"').csv(list(paths))
    parts = raw.columns[width:]
    places = {f: [n.lower() for n in h] for f, h in headers.items()}
    where = {n: [h.index(n.lower()) if n.lower() in h else None for h in places.values()] for n in names}
    moved = [n for n in names if len(set(where[n])) > 1]
    schema = ", ".join(["__file string", "__n int", *[f"__p{i} int" for i in range(len(moved))],
                        *([about_schema] if about_schema else [])])
    table = spark.createDataFrame(
        [(re.sub(_NO_HOST, r"\1:/", f), i, *[where[n][i] for n in moved], *(about[f] if about else ())) for i, f in enumerate(headers)], schema)
    rows = raw.select("*", F.regexp_replace("_metadata.file_path", _NO_HOST, "$1:/").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
                      F.monotonically_increasing_id().alias("__place"))
    rows = rows.join(F.broadcast(table), "__file", "left")  # one row per listed file
    cols = []
    for n in names:
        if n not in moved:
            p = where[n][0] if where[n] else None
            v = F.lit(None).cast("string") if p is None else F.col(f"_c{p}")
        else:
            at, v = F.col(f"__p{moved.index(n)}"), F.lit(None).cast("string")
            for p in sorted({p for p in where[n] if p is not None}):
                v = F.when(at == p, F.col(f"_c{p}")).otherwise(v)
        cols.append(v.alias(n))
    known = {n.lower() for n in names}
    extra = [] if about is None else table.columns[2 + len(moved):]
    return rows.select(*cols, *[c for c in parts if c.lower() not in known], *extra,
                       F.struct(F.col("__n").alias("file"), F.col("__block").alias("block"),
                                F.col("__place").alias("place")).alias("__at"))


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType | str, multi_line: bool = False,
             order_col: str | None = None) -> DataFrame:
    """CSV files with header rows; the declared columns are taken by header name,
    whatever their order. One scan, however many files and headers; headers are read from
    the start of each file. ``multi_line`` allows line ends inside quoted fields (a file is
    then one task). ``order_col`` adds a struct (file, block, place) in the order of the
    rows: files by path, lines by place, whatever the splits."""
    st = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    paths = [path] if isinstance(path, str) else list(path)
    headers = {f: _header(spark, f, multi_line) for f in _files(spark, paths)}
    if not headers:
        at = [] if order_col is None else StructType.fromDDL(f"`{order_col}` {ORDER_TYPE}").fields
        return empty(spark, StructType([*st.fields, *at]))
    present = {n.lower() for h in headers.values() for n in h}
    raw = _scan(spark, paths, headers, [f.name for f in st.fields if f.name.lower() in present], multi_line)
    if order_col is None:
        return _typed(raw, st)
    kept = StructType([*st.fields, StructField("__at", StructType.fromDDL(ORDER_FIELDS))])
    return _typed(raw, kept, ("__at",)).withColumnRenamed("__at", order_col)


def read_optional(spark: SparkSession, paths: Sequence[str], schema: StructType | str,
                  fmt: str = "csv", order_col: str | None = None) -> DataFrame:
    """Only the paths that exist contribute; none gives an empty typed frame."""
    st = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    found = [p for p in paths if exists(spark, p)]
    if fmt == "csv":
        return read_csv(spark, found, st, order_col=order_col)
    if not found:
        return empty(spark, st)
    return spark.read.schema(st).format(fmt).load(found)


def read_dir_with_provenance(spark: SparkSession, directory: str, pattern: str = "*.csv",
                             types: StructType | str | None = None, multi_line: bool = False) -> tuple[DataFrame, list]:
    """S3: every CSV of a folder in sorted file-name order (the order decides later
    dedup winners), ``source`` = file stem; a file that cannot be read is reported
    and skipped. Files differ in columns, so they are unioned by name with nulls.
    Values are read as text; columns named in ``types`` are cast to the declared type
    (null where a value does not parse), so files may disagree about a column.
    Returns (frame, [(path, error)]). All files are one scan."""
    declared = {} if types is None else {
        f.name: f for f in (types if isinstance(types, StructType) else StructType.fromDDL(types)).fields}
    headers, about, good, bad = {}, {}, [], []
    for i, p in enumerate(_fs_paths(spark, f"{directory.rstrip('/')}/{pattern}")):
        stem = p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        try:
            (uri,) = _files(spark, [p])
            names = _header(spark, uri, multi_line)
            if not names:
                raise ValueError("no columns")
            headers[uri], about[uri] = names, (stem, i)
            good.append(p)
        except Exception as e:  # noqa: BLE001 - report and skip, as the reference does
            bad.append((p, str(e)[:200]))
    if not headers:
        return spark.createDataFrame([], "source string, file_rank int"), bad
    first: dict[str, str] = {}  # columns in the order of their first file, as spelled there
    for n in (n for h in headers.values() for n in h):
        first.setdefault(n.lower(), n)
    names = [n for k, n in first.items() if k not in ("source", "file_rank")]
    raw = _scan(spark, good, headers, names, multi_line, about, "source string, file_rank int")
    st = StructType([declared.get(n, StructField(n, StringType())) for n in names]
                    + [StructField("source", StringType()), StructField("file_rank", IntegerType())])
    return _typed(raw, st, ("source", "file_rank")), bad


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: StructType | str) -> DataFrame:
    """JSON lines with a declared schema."""
    return spark.read.schema(schema).json(path)


VOCABULARY_SCHEMA = "drugbank_id string, name string, cas_number string"


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Delimited vocabulary; header dropped, rows with at least three fields kept
    (a real CSV parser, so quoted names with commas stay whole)."""
    df = spark.read.option("header", "true").option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    cols = df.columns
    if len(cols) < 3:
        return empty(spark, StructType.fromDDL(VOCABULARY_SCHEMA + ", status string"))
    out = df.select(F.col(cols[0]).alias("drugbank_id"), F.col(cols[1]).alias("name"),
                    F.col(cols[2]).alias("cas_number"))
    return out.where(F.col("cas_number").isNotNull()).withColumn("status", F.lit("approved"))


def read_or_else(spark: SparkSession, primary: str, fallback: str, reader) -> DataFrame:
    """Read the primary source when it exists, else the fallback."""
    return reader(spark, primary if exists(spark, primary) else fallback)


PAGE_SCHEMA = "results array<string>"


def read_pages(spark: SparkSession, paths: str | Sequence[str], item_schema: str, limit: int | None = None,
               order: Sequence[str] = ()) -> DataFrame:
    """Landed API pages (``{"results": [...]}``) read as one scan, one row per item,
    optionally capped at ``limit`` rows in ``order`` (a file order column is kept)."""
    df = spark.read.schema(f"results array<struct<{item_schema}>>").json(paths) \
        .withColumn("__file", F.input_file_name())
    items = df.select("__file", F.posexplode("results").alias("__pos", "item")).select("__file", "__pos", "item.*")
    if limit is not None:
        items = items.orderBy(*(list(order) or ["__file", "__pos"])).limit(limit)
    return items
