"""Embedding whitening by spectrum slicing.

Vectors become integers x = floor(scale * c). The fit list holds each distinct x once; its
count n and the sums S per dimension are exact integers, its covariance V (divisor n) is
summed from centred vectors, one d x d matrix a task, added per entry by Spark. Only V
(d x d, bounded by the dimension and not by the rows) reaches the driver. There

* the inertia of V - s I, counted from the pivots of a symmetric-pivoted LDL^T
  factorisation, says how many eigenvalues lie below s; bisection on these counts isolates
  each leading eigenvalue;
* Rayleigh quotient iteration from the isolating interval converges cubically to the pair;
* two more counts, just below and just above the result, certify that it is the eigenvalue
  with that number. A result that fails is thrown away and its interval halved further.

Rows are projected in the tasks that read them; a lost task is run again over its rows.

Defined cases: rows whose vector is null, empty, or holds a null or non-finite entry are
dropped; of vectors of several lengths the most frequent length stays (ties: the longer),
others are dropped, since they have no covariance with the rest. Repeated rows each give
their rows and count once in the fit list. Null ids stay null. Other columns are ignored. An empty table
gives no rows. An eigenvalue that is zero to working precision (fewer distinct directions
than components) has a null ``whitened`` and takes no part in ``identity_error``; with a
single distinct vector ``explained`` is null as well. ``deviation`` is null where it exceeds
a long; ``deviation_exact`` (38 digits) still holds it. Entries beyond 2^63 / scale become
the ends of the long range."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored

SCALE = 256.0
COMPONENTS = 4
EPS = float(np.finfo(np.float64).eps)


def integer_vectors(df: DataFrame, vector: str = "embedding", id_col: str = "vec_id", scale: float = SCALE) -> DataFrame:
    """(id, x array<long>) of the rows whose vector takes part."""
    usable = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    x = F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    return df.select(F.col(id_col), F.col(vector)).where(usable).select(id_col, x.alias("x"))


def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def _tables(column):
    """Chunks of at most 8192 rows of a record-batch column."""
    for a in range(0, len(column), 8192):
        yield column.slice(a, 8192)


def column_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """(n, exact sums per dimension): 32-bit halves are summed per task, then by Spark in
    decimals, so no sum overflows."""
    import pyarrow as pa

    def partial(batches: Iterator) -> Iterator:
        n, high, low = 0, np.zeros(d, object), np.zeros(d, object)
        for batch in batches:
            for part in _tables(batch.column("x")):
                x = _matrix(part, d)
                n += len(x)
                high += (x >> 32).sum(axis=0).astype(object)
                low += (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        if n:
            yield pa.record_batch({"i": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()),
                                   "high": pa.array([int(v) for v in high], pa.int64()),
                                   "low": pa.array([int(v) for v in low], pa.int64())})

    parts = fit.select("x").mapInArrow(partial, "i int, n long, high long, low long")
    total = parts.groupBy("i").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    rows = sorted(total.collect())
    return (int(rows[0]["n"]) if rows else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in rows]


def _summed_outer(df: DataFrame, size: int, rows_of: Callable) -> np.ndarray:
    """Sum over all vectors of v v^T, for v the rows of ``rows_of(batch)``: one matrix a
    task, its entries added by Spark. ``size`` x ``size`` numbers reach the driver."""
    import pyarrow as pa

    def partial(batches: Iterator) -> Iterator:
        total = np.zeros((size, size))
        for batch in batches:
            for part in _tables(batch.column("x")):
                v = rows_of(part)
                total += v.T @ v
        yield pa.record_batch({"i": pa.array(range(size), pa.int32()), "row": pa.array(total.tolist(), pa.list_(pa.float64()))})

    cells = df.select("x").mapInArrow(partial, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    out = np.zeros((size, size))
    for r in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r["i"], r["j"]] = r["v"]
    return (out + out.T) / 2


def negative_pivots(a: np.ndarray) -> int:
    """Number of negative eigenvalues of a symmetric matrix (Sylvester's law of inertia):
    LDL^T with 1 x 1 and 2 x 2 pivots, chosen for bounded growth (Bunch and Kaufman)."""
    a = np.array(a, dtype=float)
    alpha, k, n, negative = (1 + 17 ** 0.5) / 8, 0, len(a), 0

    def swap(p: int, q: int) -> None:
        if p != q:
            a[[p, q]] = a[[q, p]]
            a[:, [p, q]] = a[:, [q, p]]

    while k < n:
        width = 1
        if k + 1 < n:
            below = np.abs(a[k + 1:, k])
            r = k + 1 + int(below.argmax())
            largest = below[r - k - 1]
            if largest > 0 and abs(a[k, k]) < alpha * largest:
                others = np.abs(a[r, k:])
                others[r - k] = 0
                rest = others.max()
                if abs(a[k, k]) * rest < alpha * largest * largest:
                    if abs(a[r, r]) >= alpha * rest:
                        swap(k, r)
                    else:
                        swap(k + 1, r)
                        width = 2
        below = a[k + width:, k:k + width].copy()
        if width == 1:
            pivot = a[k, k]
            negative += pivot < 0
            if pivot != 0:
                a[k + 1:, k + 1:] -= below @ below.T / pivot
        else:
            block = a[k:k + 2, k:k + 2].copy()
            determinant = block[0, 0] * block[1, 1] - block[0, 1] * block[1, 0]
            negative += 1 if determinant < 0 else 2 * int(block[0, 0] + block[1, 1] < 0)
            a[k + 2:, k + 2:] -= below @ np.linalg.solve(block, below.T)
        k += width
    return int(negative)


class Slicer:
    """Eigenpairs of a symmetric matrix by number, from inertia counts."""

    def __init__(self, v: np.ndarray):
        self.v, self.d = v, len(v)
        radius = np.abs(v).sum(axis=1)
        self.size = float(radius.max()) if self.d else 0.0
        self.low, self.high = -self.size - 1e-300, self.size * (1 + 4 * EPS) + 1e-300
        self.counts = {}

    def below(self, s: float) -> int:
        """How many eigenvalues are smaller than ``s``."""
        if s not in self.counts:
            self.counts[s] = negative_pivots(self.v - s * np.eye(self.d))
        return self.counts[s]

    def isolate(self, m: int, lo: float, hi: float) -> tuple[float, float]:
        """Narrows (lo, hi) until it holds the m-th smallest eigenvalue and no other, or
        until equal eigenvalues cannot be told apart in working precision."""
        while not (self.below(lo) == m - 1 and self.below(hi) == m) and hi - lo > 4 * EPS * self.size:
            lo, hi = self.halve(m, lo, hi)
        return lo, hi

    def halve(self, m: int, lo: float, hi: float) -> tuple[float, float]:
        mid = lo + (hi - lo) / 2
        return (lo, mid) if self.below(mid) >= m else (mid, hi)

    def solve(self, shift: float, x: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
        """One step of inverse iteration, kept orthogonal to the pairs already found."""
        for nudge in (0.0, EPS, 4 * EPS, 64 * EPS):
            try:
                y = np.linalg.solve(self.v - (shift + nudge * self.size) * np.eye(self.d), x)
            except np.linalg.LinAlgError:
                continue
            if np.all(np.isfinite(y)):
                break
        else:
            y = x
        y = y / (np.abs(y).max() or 1.0)
        for _ in range(2):
            for u in found:
                y = y - (u @ y) * u
        norm = np.linalg.norm(y)
        return y / norm if norm > 0 else x

    def pair(self, number: int, found: list[np.ndarray]) -> tuple[float, np.ndarray]:
        """The ``number``-th largest eigenvalue and a unit eigenvector."""
        m = self.d - number + 1
        start = np.random.default_rng(number).standard_normal(self.d)
        for u in found:
            start = start - (u @ start) * u
        start /= np.linalg.norm(start)
        if self.size == 0:
            return 0.0, start
        lo, hi = self.isolate(m, self.low, self.high)
        while True:
            x = start
            for _ in range(2):  # the interval's own eigenvector comes to the front
                x = self.solve(lo + (hi - lo) / 2, x, found)
            best, rho = np.inf, float(x @ self.v @ x)
            for _ in range(30):  # Rayleigh quotient iteration: cubic, so few steps are ever used
                y = self.solve(rho, x, found)
                value = float(y @ self.v @ y)
                residual = float(np.linalg.norm(self.v @ y - value * y))
                if residual >= best:
                    break
                x, rho, best = y, value, residual
            margin = best + 8 * self.d * EPS * self.size if np.isfinite(best) else 0.0
            certified = self.below(rho - margin) <= m - 1 and self.below(rho + margin) >= m
            if (certified and best <= 1e-10 * self.size) or hi - lo <= 4 * EPS * self.size:
                return max(0.0, rho), x * np.sign(x[np.abs(x).argmax()])
            lo, hi = self.halve(m, lo, hi)

    def leading(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        """(values falling, vectors as rows) of the ``count`` largest eigenvalues."""
        values, found = [], []
        for number in range(1, min(count, self.d) + 1):
            value, vector = self.pair(number, found)
            values.append(value)
            found.append(vector)
        return np.array(values), np.array(found).reshape(len(found), self.d)


@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def usable(self) -> np.ndarray:
        """Which components have an eigenvalue above rounding."""
        return self.values > len(self.sums) * EPS * max(self.trace, 1e-300)

    def projector(self) -> np.ndarray:
        """Columns that turn centred vectors into whitened entries (zero where unusable)."""
        root = np.sqrt(np.where(self.usable, self.values, 1.0))
        return (self.vectors * np.where(self.usable, 1 / root, 0.0)[:, None]).T


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``integer_vectors`` rows; None without rows."""
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return None
    d = int(lengths[0]["d"])
    distinct = stored(rows.where(F.size("x") == d).select("x").distinct(), "fit-list")
    n, sums = column_sums(distinct, d)
    model = Whitening(n, sums, np.zeros(0), np.zeros((0, d)), 0.0, None)
    mean = model.mean
    v = _summed_outer(distinct, d, lambda part: _matrix(part, d) - mean) / n
    model.trace = float(np.trace(v))
    model.values, model.vectors = Slicer(v).leading(components)
    if model.usable.any():
        projector, k = model.projector()[:, model.usable], int(model.usable.sum())

        def with_one(part):  # a column of ones carries the sums for centring
            w = (_matrix(part, d) - mean) @ projector
            return np.hstack([w, np.ones((len(w), 1))])

        moments = _summed_outer(distinct, k + 1, with_one) / n
        whitened = moments[:k, :k] - np.outer(moments[:k, k], moments[:k, k])
        model.identity_error = float(np.abs(whitened - np.eye(k)).max())
    return model


def transform(rows: DataFrame, model: Whitening, id_col: str = "vec_id") -> DataFrame:
    """One row per vector of the fitted length and component: id, component, n, deviation,
    deviation_exact, whitened, explained, identity_error."""
    import pyarrow as pa

    d, mean, projector, usable = len(model.sums), model.mean, model.projector(), model.usable
    n, sums = model.n, np.array(model.sums, dtype=object)
    id_type = rows.schema[id_col].dataType.simpleString()

    def project(batches: Iterator) -> Iterator:
        for batch in batches:
            for a in range(0, batch.num_rows, 8192):
                part = batch.slice(a, 8192)
                x = _matrix(part.column("x"), d)
                spread = (((n * x.astype(object) - sums) ** 2).sum(axis=1)).tolist()
                w = (x - mean) @ projector
                yield pa.record_batch({id_col: part.column(id_col), "spread": pa.array([str(s) for s in spread], pa.string()),
                                       "w": pa.array(w.tolist(), pa.list_(pa.float64()))})

    out = rows.where(F.size("x") == d).mapInArrow(project, f"`{id_col}` {id_type}, spread string, w array<double>")
    explained = F.array(*[F.lit(float(e / model.trace) if model.trace > 0 else None).cast("double") for e in model.values])
    kept = F.array(*[F.lit(bool(u)) for u in usable])
    out = out.select(id_col, "spread", F.posexplode("w").alias("k", "value"))
    return out.select(
        id_col, (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"),
        F.col("spread").try_cast("long").alias("deviation"), F.col("spread").try_cast("decimal(38,0)").alias("deviation_exact"),
        F.when(F.get(kept, F.col("k")), F.col("value")).alias("whitened"), F.get(explained, F.col("k")).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"))


def whiten(df: DataFrame, vector: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS,
           scale: float = SCALE) -> DataFrame:
    """Fits on the distinct integer vectors of ``df`` and projects all its rows."""
    rows = integer_vectors(df, vector, id_col, scale)
    model = fit(rows, components)
    if model is None:
        model = Whitening(1, [0], np.zeros(1), np.ones((1, 1)), 0.0, None)
    return transform(rows, model, id_col)
