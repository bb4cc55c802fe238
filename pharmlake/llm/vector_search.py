"""Approximate nearest neighbours by inner product with a forest of random-projection
trees.

Trees are fitted on a bounded sample of vectors (``sample_rows``): a node splits at the
median of the projection on the difference of two random sample vectors. Vectors get one
more component so that the largest inner product is the smallest distance. Every row of
the table is indexed: it is routed to one leaf of each tree. A query searches all trees
through one priority queue (a branch's priority is the largest margin by which the query
lies on the other side of a split on its path) until it has visited ``share`` of the
leaves. Queries and leaf members meet by leaf, and all members of a visited leaf are
ranked by their exact inner product in double precision; the best of each task, then of all, remain.

Leaves with more than ``leaf_rows`` rows (many equal vectors, or a table far larger than
the sample can resolve) are divided by a hash and queries visit all divisions, so nothing is dropped.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do vectors whose length is not the most frequent one; ties go to the smaller vec_id; repeated
rows (equal vec_id and vector) count once; null vec_id takes no part; fewer candidates than k are all
returned if the visited leaves hold them; extra columns are ignored; an empty table gives no rows.

The visited share is what random-like vectors need for a recall of 0.9: distances of such
vectors are nearly equal, so the share does not fall as the table grows."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tables import stored


class Tree:
    """Complete binary tree: node i has children 2i+1, 2i+2; leaves follow the nodes."""

    def __init__(self, sample: np.ndarray, depth: int, rng):
        self.depth, n = depth, (1 << depth) - 1
        self.normals, self.cuts = np.zeros((n, sample.shape[1])), np.zeros(n)
        members = {0: np.arange(len(sample))}
        for i in range(n):
            own = members.pop(i, np.zeros(0, np.int64))
            pick = own if len(own) > 1 else np.arange(len(sample))
            a, b = sample[rng.choice(pick, 2, replace=len(pick) < 2)]
            w = a - b
            if not w.any():
                w = rng.normal(size=len(w))
            w = w / np.linalg.norm(w)
            side = sample[own] @ w
            cut = float(np.median(side)) if len(own) else 0.0
            self.normals[i], self.cuts[i] = w, cut
            members[2 * i + 1], members[2 * i + 2] = own[side <= cut], own[side > cut]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            side = np.einsum("ij,ij->i", x, self.normals[node]) > self.cuts[node]
            node = 2 * node + 1 + side
        return node - len(self.cuts)


class Forest:
    def __init__(self, sample: np.ndarray, trees: int, depth: int, top: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.depth, self.top = depth, top  # top: largest squared length
        self.trees = [Tree(self.raised(sample), depth, rng) for _ in range(trees)]

    def raised(self, x: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(self.top - (x * x).sum(1), 0.0))
        return np.concatenate([x, extra[:, None]], axis=1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf number in every tree [rows, trees], numbered through the forest."""
        x = self.raised(x)
        return np.stack([t.leaves(x) + (i << self.depth) for i, t in enumerate(self.trees)], 1)

    def visits(self, q: np.ndarray, wanted: int, sizes: np.ndarray, rows: int) -> list[list[int]]:
        """Leaves of each query in order of priority: ``wanted`` leaves, and on until they
        hold ``rows`` rows."""
        q = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
        margins = [q @ t.normals.T - t.cuts for t in self.trees]
        inner, out = (1 << self.depth) - 1, []
        for j in range(len(q)):
            queue = [(0.0, i, 0) for i in range(len(self.trees))]
            found, held = [], 0
            while queue and (len(found) < wanted or held < rows):
                p, i, node = heapq.heappop(queue)
                if node >= inner:
                    leaf = (i << self.depth) + node - inner
                    found.append(leaf)
                    held += int(sizes[leaf])
                    continue
                m = margins[i][j, node]
                heapq.heappush(queue, (max(p, m), i, 2 * node + 1))
                heapq.heappush(queue, (max(p, -m), i, 2 * node + 2))
            out.append(found)
        return out


def matrix(column, dtype) -> np.ndarray:
    """Rows of a binary column of equal-sized vectors, as doubles."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype=dtype).reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame) -> tuple[DataFrame, str]:
    """(vec_id, vec as bytes) of the rows that take part, and the component type."""
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    dtype, sql = ("<f4", "float") if kind == "float" else ("<f8", "double")
    v = F.col("embedding").cast(f"array<{sql}>")
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0))
    sizes = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    good = good.where(F.size("v") == (sizes[0]["n"] if sizes else 0))

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(dtype)
            rows = flat.reshape(b.num_rows, -1) if b.num_rows else flat.reshape(0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["vec_id", "vec"])

    return good.mapInArrow(pack, "vec_id long, vec binary"), dtype


def best_rows(query, score, vec, k):
    """The k best distinct (score, vec) of each query: larger scores, then smaller ids."""
    order = np.lexsort((vec, -score, query))
    query, score, vec = query[order], score[order], vec[order]
    new = np.ones(len(query), dtype=bool)
    new[1:] = (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])  # equal vectors have equal scores
    query, score, vec = query[new], score[new], vec[new]
    start = np.flatnonzero(np.diff(query, prepend=query[0] - 1)) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(start, np.diff(start, append=len(query)))
    top = place < k
    return query[top], score[top], vec[top]


def top_of(ids, members, query_ids, queries, k):
    """(query, exact score, vec_id) arrays: at least the k best of a block of members."""
    rough = queries @ members.T
    near = 1e-9 * (1 + np.abs(rough).max(initial=0))
    if len(ids) > k + 1:  # one may be the query itself
        kth = np.partition(rough, len(ids) - k - 1, axis=1)[:, len(ids) - k - 1]
        row, col = np.nonzero(rough >= kth[:, None] - near)
    else:
        row, col = (x.reshape(-1) for x in np.indices(rough.shape))
    other = ids[col] != query_ids[row]
    row, col = row[other], col[other]
    # summed row by row: equal vectors get equal scores wherever they stand
    exact = np.concatenate([(members[col[a:a + 8192]] * queries[row[a:a + 8192]]).sum(1) for a in range(0, len(row), 8192)] or [np.zeros(0)])
    return best_rows(query_ids[row], exact, ids[col], k)


def search(vectors: DataFrame, queries, k: int = 20, trees: int = 8, leaf_size: int = 200, share: float = 0.15,
           min_leaves: int = 48, max_depth: int = 6, subtree: int = 4,
           sample_rows: int = 50_000, leaf_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score). queries: condition on vec_id that marks the rows to
    ask for. A tree has at most 2**max_depth leaves, so a query visits as many leaves in a
    large table as in a small one; 2**subtree neighbouring leaves are ranked in one task,
    which keeps one list of k for a query."""
    spark = vectors.sparkSession
    clean, dtype = usable(vectors)
    clean = stored(clean, "vectors").distinct()
    total = clean.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if total == 0:
        return spark.createDataFrame([], schema)
    u = F.shiftrightunsigned(F.xxhash64("vec_id"), 11) / float(1 << 53)
    drawn = clean.where(u < 1.2 * sample_rows / total).orderBy(u).limit(sample_rows).select("vec")
    sample = np.stack([np.frombuffer(r[0], dtype=dtype) for r in drawn.collect()]).astype(np.float64)

    def lengths(batches):
        import pyarrow as pa

        for b in batches:
            x = matrix(b.column(0), dtype)
            yield pa.RecordBatch.from_arrays([pa.array([float((x * x).sum(1).max(initial=0))])], names=["top"])

    top = clean.select("vec").mapInArrow(lengths, "top double").agg(F.max("top")).first()[0]
    depth = max(0, min(max_depth, int(np.ceil(np.log2(max(total / leaf_size, 1)))), int(np.log2(max(len(sample) / 8, 1)))))
    forest = spark.sparkContext.broadcast(Forest(sample, trees, depth, top))
    leaves = trees << depth

    def route(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                at = forest.value.leaves(matrix(b.column(1), dtype))
                row = np.repeat(np.arange(b.num_rows), trees)
                yield pa.RecordBatch.from_arrays([pa.array(at.reshape(-1)), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row))],
                                                 names=["leaf", "id", "vec"])

    members = clean.mapInArrow(route, "leaf long, id long, vec binary")
    # leaf sizes: as many numbers as the forest has leaves, whatever the table holds
    counts = np.zeros(leaves, dtype=np.int64)
    for r in members.groupBy("leaf").count().collect():
        counts[r["leaf"]] = r["count"]
    parts = np.maximum(1, -(-counts // leaf_rows))
    base = np.cumsum(parts) - parts  # number of a leaf's first division
    tables = spark.sparkContext.broadcast((counts, parts, base))
    groups = (leaves >> subtree) + 1  # of neighbouring leaves, for each division
    wanted = max(min_leaves, int(np.ceil(share * leaves)))

    def place(batches):
        import pyarrow as pa

        _, parts, base = tables.value
        for b in route(batches):
            leaf, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            spread = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            division = spread % parts[leaf]
            yield pa.RecordBatch.from_arrays(
                [pa.array((leaf >> subtree) + division * groups), pa.array(base[leaf] + division),
                 pa.array(np.zeros(len(leaf), np.int32)), b.column(1), b.column(2)], names=["part", "bucket", "kind", "id", "vec"])

    def ask(batches):
        import pyarrow as pa

        counts, parts, base = tables.value
        for b in batches:
            for a in range(0, b.num_rows, 256):
                c = b.slice(a, 256)
                found = forest.value.visits(matrix(c.column(1), dtype), wanted, counts, 4 * k)
                row = np.concatenate([np.full(int(parts[f].sum()), i) for i, f in enumerate(found)]).astype(np.int64)
                division = np.concatenate([np.arange(parts[x]) for f in found for x in f])
                leaf = np.concatenate([np.full(parts[x], x) for f in found for x in f])
                yield pa.RecordBatch.from_arrays([pa.array((leaf >> subtree) + division * groups), pa.array(base[leaf] + division), pa.array(np.ones(len(row), np.int32)),
                                                  c.column(0).take(pa.array(row)), c.column(1).take(pa.array(row))],
                                                 names=["part", "bucket", "kind", "id", "vec"])

    shape = "part long, bucket long, kind int, id long, vec binary"
    met = clean.mapInArrow(place, shape).union(clean.where(queries).mapInArrow(ask, shape))

    def rank(batches):
        import pyarrow as pa

        held: list[tuple] = []
        rows = 0
        now, ids, vecs, asked = None, [], [], ([], [])

        def doubles(parts):
            return np.frombuffer(b"".join(parts), dtype=dtype).reshape(len(parts), -1).astype(np.float64)

        def answer():
            nonlocal rows
            if asked[0] and ids:
                held.append(top_of(np.array(ids), doubles(vecs), np.array(asked[0]), doubles(asked[1]), k))
                rows += len(held[-1][0])
                if rows > 1_000_000:
                    held[:] = [best_rows(*map(np.concatenate, zip(*held)), k)]
                    rows = len(held[0][0])
            asked[0].clear()
            asked[1].clear()

        def flush():
            nonlocal rows
            q, s, v = best_rows(*map(np.concatenate, zip(*held)), k) if held else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
            held.clear()
            rows = 0
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], names=["query_id", "vec_id", "score"])

        for b in batches:
            for bucket, kind, i, vec in zip(*(c.to_pylist() for c in b.columns[1:])):
                if bucket != now:
                    answer()
                    now = bucket
                    ids.clear()
                    vecs.clear()
                if kind == 0:  # sorted: the members come before the queries
                    ids.append(i)
                    vecs.append(vec)
                else:
                    asked[0].append(i)
                    asked[1].append(vec)
                    if len(asked[0]) >= 512:
                        answer()
            if rows > 800_000:  # more queries than one task keeps
                yield flush()
        answer()
        yield flush()

    found = (met.repartition("part").sortWithinPartitions("bucket", "kind")
             .mapInArrow(rank, "query_id long, vec_id long, score double"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
