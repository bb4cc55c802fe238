"""Fixed-size count tables over hashed keys: used only to choose a global order of tokens
and to skip rows that cannot matter, so every result is the same whatever they hold."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import shuffles_removed

COUNTS = "i int, " + ", ".join(f"n{j} long" for j in range(8))  # counts of buckets 8 * i to 8 * i + 7


def bucket_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def bucket_rows(batches, hashes_of, bits: int):
    """Body of a mapInArrow: adds up ``hashes_of(batch)`` per bucket over the task and
    emits a COUNTS row for each eight buckets of which one was seen."""
    import pyarrow as pa

    table = np.zeros(1 << bits, dtype=np.int64)
    for batch in batches:
        for h in hashes_of(batch):
            if len(h) * 8 < len(table):
                np.add.at(table, bucket_of(h, bits), 1)
            else:
                table += np.bincount(bucket_of(h, bits), minlength=1 << bits)
    table = table.reshape(-1, 8)
    seen = np.flatnonzero(table.any(axis=1))
    for a in range(0, len(seen), 100_000):
        part = seen[a:a + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *map(pa.array, np.ascontiguousarray(table[part].T))],
                                         names=["i", *(f"n{j}" for j in range(8))])


def count_classes(rows: DataFrame, bits: int) -> np.ndarray:
    """uint8 table of 2**bits entries: 0 = counted at most once, else
    round(8 * log2(count)). It reaches the driver packed, eight entries to a row."""
    sums = rows.groupBy("i").agg(*[F.sum(f"n{j}").alias(f"n{j}") for j in range(8)])
    classes = [F.when(F.col(f"n{j}") > 1, F.least(F.lit(255), F.round(8 * F.log2(f"n{j}"))).cast("long")).otherwise(0) for j in range(8)]
    packed = sums.select("i", reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(c, 8 * j) for j, c in enumerate(classes)]).alias("w"))
    with shuffles_removed(rows.sparkSession):
        packed = packed.where("w != 0").toPandas()
    table = np.zeros(1 << bits, dtype=np.uint8).reshape(-1, 8)
    table[packed["i"].to_numpy(dtype=np.int64)] = packed["w"].to_numpy(dtype="<i8").view(np.uint8).reshape(-1, 8)
    return table.reshape(-1)


def bit_table(rows: DataFrame, bits: int) -> np.ndarray:
    """Bool table of 2**bits entries from the int column ``b`` of rows; it reaches the
    driver packed, 64 entries to a row."""
    with shuffles_removed(rows.sparkSession):
        packed = bit_rows(rows).toPandas()
    table = np.zeros(1 << bits, dtype=bool).reshape(-1, 64)
    words = np.ascontiguousarray(packed["w"].to_numpy(dtype="<i8")).view(np.uint8).reshape(-1, 8)
    table[packed["i"].to_numpy(dtype=np.int64)] = np.unpackbits(words, axis=1, bitorder="little").astype(bool)
    return table.reshape(-1)


def bit_rows(rows: DataFrame) -> DataFrame:
    """(i, w): the int column ``b`` of rows as a bit table, 64 bits a row. At most
    2**(bits - 6) rows for ``bits`` bits, so it may be broadcast."""
    return rows.groupBy(F.shiftright("b", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("w"))


def with_bit(df: DataFrame, bit, table: DataFrame, name: str = "bit") -> DataFrame:
    """df with a boolean column: whether the row's bit is set in a ``bit_rows`` table. Inside
    the JVM: a broadcast join with at most 2**16 rows."""
    hit = F.coalesce(F.expr("shiftrightunsigned(w, cast(_b % 64 as int)) & 1 = 1"), F.lit(False))
    return (df.withColumn("_b", bit).join(F.broadcast(table), F.shiftright("_b", 6) == F.col("i"), "left")
            .withColumn(name, hit).drop("_b", "i", "w"))


def class_of(n: float) -> int:
    return min(255, int(round(8 * np.log2(max(n, 1)))))


def bitmap(keys: DataFrame, column: str, bits: int = 20) -> np.ndarray:
    """Bool table of 2**bits entries with the hashed values of a long column set
    (null counts as 0)."""
    return bit_table(keys.select(in_bitmap_bucket(column, bits).alias("b")), bits)


def in_bitmap_bucket(column, bits: int = 20):
    """The bucket column that matches ``bitmap``."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(column), F.lit(0).cast("long"))), 64 - bits).cast("int")
