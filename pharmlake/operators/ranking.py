"""Order-dependent primitives that stay distributed.

Spark has no row order, so every "first", "i-th" and "shuffle" of the reference
takes an explicit order key. A window without ``partitionBy`` pulls every row into
one task; the helpers below avoid that:

* ``ranked``: two-level rank by key columns of any type. ``Ranges`` cuts the rows at
  sampled splitters of the composite key; groups that straddle a splitter get prefix
  offsets, each range is ranked in its own task.
* ``global_row_number``: the same by a given bucket column that is monotone in the order
  (a hash prefix for seeded orders); a per-bucket count (one row per bucket, size bounded by the bucket
  parameter) gives prefix offsets that are broadcast back; each bucket is ranked in
  its own task.
* ``top_n_per_group``: exact top-n per group in two rounds; the first round ranks
  inside (group, salt) sub-groups so a hot group is spread over ``salt`` tasks and
  each sub-group keeps at most n rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Default number of buckets for two-level ranks: 16^4 = 65536. At ~10^12 rows a bucket
# holds ~10^7 rows (one window task); the offset table (one row per bucket and class)
# stays bounded by this parameter, so it has a proven size and is broadcast.
HEX_DIGITS = 4


def seeded_hash(key: Column | str, seed: int = 42) -> Column:
    """md5 of '<seed>:<key>' as hex text; same value in Spark and DuckDB."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def hash_int(hex_col: Column, digits: int = 8) -> Column:
    """Leading ``digits`` hex characters of an md5 as a non-negative bigint."""
    return F.conv(F.substring(hex_col, 1, digits), 16, 10).cast("bigint")


def hash_bucket(hex_col: Column, digits: int = HEX_DIGITS) -> Column:
    """Bucket id monotone in the hex order: its first ``digits`` characters."""
    return hash_int(hex_col, digits).cast("int")


def with_seeded_bucket(df: DataFrame, key: str, seed: int = 42, digits: int = HEX_DIGITS) -> DataFrame:
    """Add ``__h`` (seeded hash of key) and ``__b`` (its bucket). Computing them where
    the rows are produced keeps later ranks from pushing a projection through an
    ordered limit (which would turn a bounded TakeOrdered into a full sort)."""
    h = seeded_hash(key, seed)
    return df.withColumn("__h", h).withColumn("__b", hash_bucket(F.col("__h"), digits))


def _cols(xs: Sequence[Column | str]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _by(part: Sequence[str], side: DataFrame) -> tuple[DataFrame, Column]:
    """``side`` with its key columns renamed, and the null-safe condition that joins it."""
    cond = None
    for c in part:
        side = side.withColumnRenamed(c, f"__k_{c}")
        one = F.col(c).eqNullSafe(F.col(f"__k_{c}"))
        cond = one if cond is None else cond & one
    return side, cond


def global_row_number(
    df: DataFrame,
    order: Sequence[Column | str],
    bucket: Column | str,
    name: str = "rn",
    partition: Sequence[str] = (),
) -> DataFrame:
    """Exact ``row_number() over ([partition by p] order by <order>)`` without a
    single-partition window and without one task per hot group.

    ``bucket`` (an expression, or the name of a column already present) must be
    monotone in ``order``. Each (group, bucket) is ranked in its own task; offsets are
    prefix sums over the per-(group, bucket) counts. The offset table is broadcast when
    there are no groups (its size is then the bucket count); otherwise it is joined on
    (group, bucket) and Spark chooses by its size. Null groups are groups, null buckets
    come first (where Spark sorts null order keys): no row is lost.
    """
    part = list(partition)
    b = "__bucket"
    with_b = df.withColumn(b, F.col(bucket) if isinstance(bucket, str) else bucket)
    counts = with_b.groupBy(*part, b).agg(F.count(F.lit(1)).alias("__n"))
    wcum = Window.partitionBy(*part).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*part, b, F.coalesce(F.sum("__n").over(wcum), F.lit(0)).alias("__off"))
    w = Window.partitionBy(*part, b).orderBy(*_cols(order))
    ranked = with_b.withColumn("__local", F.row_number().over(w))
    offsets, same = _by([*part, b], offsets)
    side = F.broadcast(offsets) if not part else offsets
    out = ranked.join(side, same)
    drop = [b, "__local", "__off", *[f"__k_{c}" for c in (*part, b)]] + ([bucket] if isinstance(bucket, str) and bucket != b else [])
    return out.withColumn(name, (F.col("__local") + F.col("__off")).cast("bigint")).drop(*drop)


def seeded_row_number(df: DataFrame, key: str, seed: int = 42, name: str = "rn",
                      partition: Sequence[str] = (), digits: int = HEX_DIGITS) -> DataFrame:
    """Position of each row in the seeded order md5('<seed>:<key>'), then key."""
    h = seeded_hash(key, seed)
    tmp = df.withColumn("__h", h)
    out = global_row_number(tmp, [F.col("__h"), F.col(key)], hash_bucket(F.col("__h"), digits), name, partition)
    return out.drop("__h")


ROWS_PER_RANGE = 500_000
MAX_RANGES = 4096  # at 10^12 rows a range holds 2.5 * 10^8: one sort that spills, still one task's work
SAMPLES_PER_RANGE = 32
KEY_PREFIX = 64


class Ranges:
    """Splitters of a composite order (any orderable types, ascending, nulls first).

    A sample of the keys (``SAMPLES_PER_RANGE`` rows a range, so at most 131072 short keys
    whatever the table's size) is sorted by Spark and every 32nd key becomes a boundary.
    A row's range is found by a binary search in the boundaries, as a column expression.
    Strings take part with their first 64 characters and whether there are more; behind a
    string that has more, later key columns do not count (so the order is kept), and rows
    that agree up to there share a range. No rows, one distinct key or all-null keys simply
    give no boundary that separates anything."""

    def __init__(self, parts: Sequence[tuple[int, str, Column]], bounds: Sequence[tuple]):
        self.column, self.types, self.keys = (list(x) for x in zip(*parts))
        self.bounds = list(bounds)

    @staticmethod
    def parts_of(df: DataFrame, cols: Sequence[str]) -> list[tuple[int, str, Column]]:
        """(key column number, type, expression) of the short key's parts."""
        schema, parts, cut = dict(df.dtypes), [], F.lit(False)
        for i, c in enumerate(cols):
            x, t = F.when(~cut, F.col(c)), schema[c]
            if t == "string":
                longer = F.coalesce(F.length(F.col(c)) > KEY_PREFIX, F.lit(False))
                parts += [(i, "string", F.substring(x, 1, KEY_PREFIX)), (i, "boolean", F.when(~cut, longer))]
                cut = cut | longer
            else:
                parts.append((i, t, x))
        return parts

    @classmethod
    def of(cls, df: DataFrame, cols: Sequence[str], rows_per_range: int | None = None, seed: int = 42) -> Ranges:
        """Boundaries for about ``rows_per_range`` rows a range: one count, and one sample
        where there is more than one range to cut."""
        parts = cls.parts_of(df, cols)
        n = df.select(*cols[-1:]).count()
        ranges = min(MAX_RANGES, -(-n // (rows_per_range or ROWS_PER_RANGE)))
        if ranges < 2:
            return cls(parts, [])
        named = [k.alias(f"k{i}") for i, (_, _, k) in enumerate(parts)]
        wanted = min(1.0, SAMPLES_PER_RANGE * ranges / n)
        rows = df.select(*named).sample(wanted, seed).orderBy(*[f"k{i}" for i in range(len(parts))]).collect()
        step = max(1, -(-len(rows) // ranges))
        bounds = [tuple(r) for r in rows[step::step]]
        return cls(parts, [x for i, x in enumerate(bounds) if i == 0 or x != bounds[i - 1]])

    def _struct(self, values, depth: int) -> Column:
        return F.struct(*[v.cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(values[:depth], self.types))])

    def _count(self, depth: int, inclusive: bool) -> Column:
        """How many boundaries lie below the row's key (or at it), by its first ``depth``
        parts. Structs compare with nulls first, as the sort does."""
        if not self.bounds:
            return F.lit(0)
        n, key = len(self.bounds), self._struct(self.keys, depth)
        table = F.array(*[self._struct([F.lit(v) for v in b], depth) for b in self.bounds])
        steps = F.array(*[F.lit(1 << p) for p in range(n.bit_length() - 1, -1, -1)])

        def step(at: Column, width: Column) -> Column:
            bound = F.get(table, at + width - 1)
            return F.when((at + width <= n) & ((bound <= key) if inclusive else (bound < key)), at + width).otherwise(at)

        return F.aggregate(steps, F.lit(0), step)

    def index(self) -> Column:
        """The row's range, from 0; monotone in the order."""
        return self._count(len(self.keys), True)

    def straddles(self, parts: int) -> Column:
        """Whether the group named by the first ``parts`` key columns may lie in several
        ranges. At most as many groups as there are boundaries do."""
        if not self.bounds or parts == 0:
            return F.lit(bool(self.bounds))
        depth = sum(c < parts for c in self.column)
        return self._count(depth, True) > self._count(depth, False)


def ranked(df: DataFrame, order: Sequence[str], name: str = "rn", part: Sequence[str] = (),
           rows_per_range: int | None = None) -> DataFrame:
    """Exact ``row_number() over ([partition by part] order by order)`` for key columns of
    any type, without a task that holds a whole table or a hot group.

    Rows are cut into sampled ranges of (part, order) and ranked inside (part, range): one
    exchange. Only groups that straddle a boundary need offsets: prefix sums over their
    counts per range, at most 2 x 4096 rows (broadcast); without boundaries Catalyst drops
    that side. Rows equal in all order columns are numbered in any order."""
    part, order = list(part), list(order)
    ranges = Ranges.of(df, [*part, *order], rows_per_range)
    cut = df.withColumns({"__r": ranges.index(), "__s": ranges.straddles(len(part))})
    local = cut.withColumn("__l", F.row_number().over(Window.partitionBy(*part, "__r").orderBy(*order)))
    counts = cut.where("__s").groupBy(*part, "__r").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*part).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    offsets, same = _by([*part, "__r"], counts.select(*part, "__r", F.sum("__n").over(before).alias("__off")))
    out = local.join(F.broadcast(offsets), same, "left")
    return out.select(*df.columns, (F.col("__l") + F.coalesce("__off", F.lit(0))).cast("bigint").alias(name))


def row_number_by_key(df: DataFrame, key: str, name: str = "rn", rows_per_range: int | None = None) -> DataFrame:
    """``row_number() over (order by key)`` for a key of any type."""
    return ranked(df, [key], name, (), rows_per_range)


def top_n_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    n: int,
    salt_of: Column | None = None,
    salt: int = 64,
    name: str = "rn",
) -> DataFrame:
    """Rows ranked 1..n within each group (exact), with the rank in ``name``.

    Round 1 keeps the top n of every (group, salt) sub-group; the true top n of a
    group is contained in their union, so round 2 ranks at most n x salt rows per
    group.
    """
    g = list(group)
    oc = _cols(order)
    s = salt_of if salt_of is not None else F.xxhash64(*[F.col(c) for c in df.columns])
    pre = df.withColumn("__salt", F.pmod(s, F.lit(salt)))
    w1 = Window.partitionBy(*g, "__salt").orderBy(*oc)
    kept = pre.withColumn("__r1", F.row_number().over(w1)).where(F.col("__r1") <= n).drop("__r1", "__salt")
    w2 = Window.partitionBy(*g).orderBy(*oc)
    return kept.withColumn(name, F.row_number().over(w2)).where(F.col(name) <= n)


def first_n(df: DataFrame, order: Sequence[Column | str], n: int, name: str | None = None,
            rows_per_range: int | None = None) -> DataFrame:
    """First n rows in a key order, optionally numbered 1..n.

    Up to a range's worth of rows, a TakeOrdered: each task keeps n, one task merges them.
    For a larger n no task may hold n rows: counts per sampled range give the cut-off, whole
    ranges below it pass unsorted, and only the range it falls into is ranked."""
    limit = rows_per_range or ROWS_PER_RANGE
    if n <= limit or not all(isinstance(c, str) for c in order):
        oc = _cols(order)
        top = df.orderBy(*oc).limit(n)
        return top.withColumn(name, F.row_number().over(Window.orderBy(*oc))) if name else top
    if name:
        return ranked(df, list(order), name, (), rows_per_range).where(F.col(name) <= n)
    ranges = Ranges.of(df, list(order), rows_per_range)
    cut = df.withColumn("__r", ranges.index())
    sizes = sorted(map(tuple, cut.groupBy("__r").count().collect()))  # at most 4096 rows
    return _selected(cut, sizes, n, list(order)).select(*df.columns)


def _selected(cut: DataFrame, sizes: Sequence[tuple], n: int, order: Sequence[Column | str]) -> DataFrame:
    """The first n rows of ``cut`` (range id ``__r``, monotone in ``order``), given (id,
    rows) in ascending order."""
    seen = 0
    for at, size in sizes:
        if seen + size >= n:
            inside = cut.where(F.col("__r") == at) if at is not None else cut.where(F.col("__r").isNull())
            rest = inside.withColumn("__l", F.row_number().over(Window.partitionBy("__r").orderBy(*_cols(order))))
            rest = rest.where(F.col("__l") <= n - seen).drop("__l")
            return rest if at is None else cut.where((F.col("__r") < at) | F.col("__r").isNull()).unionByName(rest)
        seen += size
    return cut


def sampled_first_n(df: DataFrame, key: str, n: int, seed: int = 42, rows_per_range: int | None = None) -> DataFrame:
    """First n rows in the seeded order md5('<seed>:<key>'), then key: a TakeOrdered for an
    n that fits a task, else the same selection over a histogram of the hash's first digits
    (at most 65536 counts)."""
    if n <= (rows_per_range or ROWS_PER_RANGE):
        return df.orderBy(seeded_hash(key, seed), F.col(key)).limit(n)
    cut = df.withColumn("__h", seeded_hash(key, seed)).withColumn("__r", hash_bucket(F.col("__h")))
    sizes = sorted(map(tuple, cut.groupBy("__r").count().collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    return _selected(cut, sizes, n, ["__h", key]).select(*df.columns)


def running_sums(
    df: DataFrame,
    partition: Sequence[str],
    order: Sequence[Column],
    bucket: Column | str,
    cols: Sequence[str],
    descending_buckets: bool = False,
    prefix: str = "cum_",
    straddles: Column | str | None = None,
) -> DataFrame:
    """Exact inclusive running sums of ``cols`` in ``order`` within ``partition``,
    computed per bucket plus a prefix offset over bucket totals (two-level scan).

    ``bucket`` (an expression or an existing column name) must be monotone in
    ``order`` (descending when ``descending_buckets``). ``straddles`` may tell which rows
    belong to groups with several buckets; only those need offsets.
    """
    part = list(partition)
    b = "__bucket"
    with_b = df.withColumn(b, F.col(bucket) if isinstance(bucket, str) else bucket)
    some = with_b if straddles is None else with_b.where(straddles)
    tot = some.groupBy(*part, b).agg(*[F.sum(c).alias(f"__t_{c}") for c in cols])
    bo = F.col(b).desc() if descending_buckets else F.col(b).asc()
    wcum = Window.partitionBy(*part).orderBy(bo).rowsBetween(Window.unboundedPreceding, -1)
    offsets = tot.select(*part, b, *[F.coalesce(F.sum(f"__t_{c}").over(wcum), F.lit(0)).alias(f"__o_{c}")
                                     for c in cols])
    w = Window.partitionBy(*part, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = with_b.select("*", *[F.sum(c).over(w).alias(f"__l_{c}") for c in cols])
    offsets, same = _by([*part, b], offsets)
    out = local.join(offsets, same, "left")
    return out.select(*df.columns, *[(F.col(f"__l_{c}") + F.coalesce(f"__o_{c}", F.lit(0))).alias(f"{prefix}{c}") for c in cols])
