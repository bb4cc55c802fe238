"""Projection, tagging, validation, union and keep-first deduplication (P, U, V)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import FAILED_STATUSES, LABEL_MAP, SOURCE_ORDER
from ..functions.molecule import present, valid_smiles

UNIFIED = ["smiles", "name", "status", "source", "label"]


# ---- P: projections and filters ---------------------------------------------
def unify(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Project to the unified five-column schema (label as int)."""
    return df.select(F.col("smiles").cast("string"), F.col("name").cast("string"),
                     F.col("status").cast("string"), F.col("source").cast("string"),
                     F.col("label").cast("int"), *extra)


def tag(df: DataFrame, source: str | None = None, label: int | None = None) -> DataFrame:
    """Add constant source and/or label columns."""
    if source is not None:
        df = df.withColumn("source", F.lit(source))
    if label is not None:
        df = df.withColumn("label", F.lit(label).cast("int"))
    return df


def has_columns(df: DataFrame, cols: Iterable[str]) -> bool:
    """True when every column is present (schema only, no job)."""
    return set(cols).issubset(df.columns)


def map_label(status: Column | str = "status", mapping: dict[str, int] | None = None) -> Column:
    """Status -> label through a literal map; unknown or missing -> 0."""
    mapping = LABEL_MAP if mapping is None else mapping
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    s = F.col(status) if isinstance(status, str) else status
    return F.coalesce(F.try_element_at(m, s), F.lit(0)).cast("int")


def keep_present(df: DataFrame, c: str) -> DataFrame:
    """P5: rows with a non-null, non-empty key."""
    return df.where(present(c))


def drop_sentinels(df: DataFrame, c: str, values: Sequence[str]) -> DataFrame:
    """Drop sentinel keys; a missing key is kept (it is not a sentinel)."""
    return df.where(~F.coalesce(F.col(c).isin(*values), F.lit(False)))


def failed_or_reasoned(df: DataFrame) -> DataFrame:
    """Status failed/withdrawn, or a failure reason is present."""
    cond = F.coalesce(F.col("status").isin(*FAILED_STATUSES), F.lit(False))
    if "failure_reason" in df.columns:
        cond = cond | F.col("failure_reason").isNotNull()
    return df.where(cond)


def from_sources(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows whose source is in the list."""
    return df.where(F.col("source").isin(*names))


def phase_filter(df: DataFrame, lo: int | None = None, hi: int | None = None, eq: int | None = None,
                 col: str = "max_phase") -> DataFrame:
    """max_phase = eq, or lo <= max_phase < hi. A plain comparison, pushed to the scan."""
    c = F.col(col)
    if eq is not None:
        return df.where(c == eq)
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (c >= lo)
    if hi is not None:
        cond = cond & (c < hi)
    return df.where(cond)


def require_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """P10: raise ValueError naming the absent columns."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with a null (or NaN) in any required column."""
    return df.dropna(subset=list(cols))


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    """P12."""
    return df.withColumnRenamed(old, new)


def with_constant(df: DataFrame, c: str, value) -> DataFrame:
    """P13."""
    return df.withColumn(c, F.lit(value))


# ---- U: unions, dedup, classes ----------------------------------------------
def union_same(dfs: Sequence[DataFrame]) -> DataFrame:
    """Union all by name, same schema."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def union_wide(dfs: Sequence[DataFrame]) -> DataFrame:
    """Union all of differing schemas; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def source_rank(c: Column | str = "source", order: Sequence[str] = SOURCE_ORDER) -> Column:
    """Load order of a source name (unknown sources last)."""
    x = F.col(c) if isinstance(c, str) else c
    m = F.create_map(*[v for i, s in enumerate(order) for v in (F.lit(s), F.lit(i))])
    return F.coalesce(F.try_element_at(m, x), F.lit(len(order)))


def dedup_first(df: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first in ``order``; all null keys form one group.

    Written as ``groupBy(key).agg(min(struct(order..., row...)))`` rather than a
    window: the aggregate is partial on the map side, so a key holding a third of
    the rows is reduced to one row per task before the shuffle. Project ``df`` to the
    needed columns first: fields packed into the struct are not pruned by Catalyst.
    """
    cols = df.columns
    oc = [F.col(o) if isinstance(o, str) else o for o in order]
    packed = F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(oc)],
                      *[F.col(c).alias(c) for c in cols if c != key])
    # Group by (64-bit hash, key): the sort behind the aggregate compares the hash
    # prefix first, so long keys (whole texts) are compared only on hash ties.
    winners = df.groupBy(F.xxhash64(key).alias("__kh"), key).agg(F.min(packed).alias("__w"))
    return winners.select(*[F.col(key) if c == key else F.col(f"__w.{c}").alias(c) for c in cols])


def classes(df: DataFrame, label: str = "label") -> DataFrame:
    """U4: distinct labels."""
    return df.select(label).distinct()


# ---- V: validity, toolkit hooks, balance ------------------------------------
def validate(df: DataFrame, c: str = "smiles", lo: int = 1, hi: int = 10_000,
             validator: Callable | None = None) -> DataFrame:
    """V1-V4: keep valid molecules. With a toolkit ``validator`` (value ->
    bool) it runs as an Arrow-batched pandas UDF; otherwise length + alphabet."""
    if validator is None:
        return df.where(valid_smiles(c, lo, hi))
    from .hooks import value_udf

    ok = value_udf(validator, "boolean")
    from ..functions.molecule import valid_length

    return df.where(valid_length(c, lo, hi) & F.coalesce(ok(F.col(c)), F.lit(False)))


def canonicalize(df: DataFrame, c: str = "smiles", fn: Callable | None = None) -> DataFrame:
    """V4: canonical form through a toolkit function; identity without one. A failed
    conversion (null) keeps the original."""
    if fn is None:
        return df
    from .hooks import value_udf

    canon = value_udf(fn, "string")
    return df.withColumn(c, F.coalesce(canon(F.col(c)), F.col(c)))


def needs_balance(df: DataFrame, label: str = "label", ratio: float = 2.0) -> DataFrame:
    """V6: one row: class counts, the minority label and whether to augment it
    (larger / smaller > ratio and smaller > 0)."""
    agg = df.agg(F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"))
    small = F.least("n_pos", "n_neg")
    big = F.greatest("n_pos", "n_neg")
    return agg.select(
        F.col("n_pos").cast("bigint").alias("n_pos"), F.col("n_neg").cast("bigint").alias("n_neg"),
        F.when(F.col("n_pos") < F.col("n_neg"), 1).otherwise(0).alias("minority_label"),
        F.coalesce((small > 0) & (big.cast("double") / small > ratio), F.lit(False)).alias("needs_balance"),
    )


def augment(df: DataFrame, variants: Callable | None, n: int = 2, c: str = "smiles",
            label: str = "label", ratio: float = 2.0) -> DataFrame:
    """V5 + V6: add up to n distinct alternative spellings per minority-class row
    (source + '_aug') when the balance gate opens. Without a toolkit function the
    input is returned unchanged (identity gives no new spelling)."""
    if variants is None:
        return df
    from .hooks import array_udf

    gate = needs_balance(df, label, ratio).where("needs_balance").select(F.col("minority_label").alias(label))
    spell = array_udf(lambda s: variants(s, n))
    minority = df.join(F.broadcast(gate), label, "left_semi")  # gate: one row at most
    alt = (minority.withColumn("__alt", F.array_except(F.array_distinct(spell(F.col(c))), F.array(F.col(c))))
           .withColumn("__alt", F.slice("__alt", 1, n))
           .withColumn(c, F.explode("__alt")).drop("__alt")
           .withColumn("source", F.concat(F.col("source"), F.lit("_aug"))))
    return df.unionByName(alt.select(*df.columns))
