"""Approximate nearest neighbours by stable projections and kd-trees (operator 5).

Every vector is projected to `dims` dimensions by one Gaussian (2-stable) matrix. The projections of a bounded sample (`sample` rows)
give the upper levels of a kd-tree, by which all vectors are dealt into shards, each with the box of its projections; a
shard orders its own vectors by a kd-tree of its own. A search takes neighbours one after another in the order of
their distance in the projection (leaves are opened as their boxes come near), and verifies them on the original vectors.
The squared ratio of projected to original distance follows a chi-square distribution of `dims` degrees, so it ends at the
neighbour at which a vector nearer than the k-th found would have come before with probability `sure`.

A query is searched in the shard whose box is nearest first; with the k-th distance from there, it goes on to those
shards only whose boxes pass the same test. Queries that go to one shard travel in blocks. No cap on candidates.

Vectors that are equal are one: of the rows that share it the k + 1 with the smallest ids take part, for no
other can be among the k nearest of anything. Vectors of each length are an index of their own.

Defined results: vectors that are null, zero, or hold null or non-finite components are
neither queries nor candidates; a query with fewer candidates of its length gets all of them; ties go to the smaller
vec_id; rows with a null vec_id take no part; of rows that share vec_id and vector one takes part; a vec_id with several vectors gets the nearest of
all of them, each vec_id once; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .vectors import lengths, matrix, usable

LEAF, STEP = 32, 32
#: Shards at most, so that their boxes are a table of known size; beyond `shard_rows` times as many vectors, shards grow.
MOST_SHARDS = 1 << 14


def projection(length: int, dims: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(length, dims))


def chi_square(x: np.ndarray | float, dims: int) -> np.ndarray | float:
    """Distribution function for an even number of degrees."""
    half, term, total = x / 2.0, 1.0, 1.0
    for k in range(1, dims // 2):
        term = term * half / k
        total = total + term
    return 1.0 - np.exp(-half) * total


def quantile(sure: float, dims: int) -> float:
    """Where chi_square reaches `sure`."""
    lo, hi = 0.0, 1.0
    while chi_square(hi, dims) < sure:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, dims) < sure else (lo, mid)
    return hi


def kd_leaves(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Order of the points and where each leaf starts: halves by the widest dimension until `leaf` points are left."""
    order, starts, todo = np.arange(len(points)), [], [(0, len(points))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= leaf:
            starts.append(lo)
            continue
        part = points[order[lo:hi]]
        mid = (hi - lo) // 2
        order[lo:hi] = order[lo:hi][np.argpartition(part[:, np.ptp(part, axis=0).argmax()], mid)]
        todo += [(lo + mid, hi), (lo, lo + mid)]
    return order, np.array(sorted(starts), np.int64)


def splits(points: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The upper `depth` levels of a kd-tree: for each level, the dimension and the value at which each of its nodes is split."""
    out, groups = [], [np.arange(len(points))]
    for _ in range(depth):
        dim, value, below = np.zeros(len(groups), np.int64), np.zeros(len(groups)), []
        for g, rows in enumerate(groups):
            part = points[rows]
            if len(rows):
                dim[g] = np.ptp(part, axis=0).argmax()
                value[g] = np.median(part[:, dim[g]])
            right = part[:, dim[g]] >= value[g] if len(rows) else np.zeros(0, bool)
            below += [rows[~right], rows[right]]
        out.append((dim, value))
        groups = below
    return out


def shard_of(points: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    for dim, value in levels:
        at = at * 2 + (points[np.arange(len(points)), dim[at]] >= value[at])
    return at


def box_distance(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of a point from each box; 0 within it."""
    gap = np.maximum(0.0, np.maximum(low - at, at - high))
    return (gap * gap).sum(axis=-1)


class Shard:
    """One shard's vectors in the order of its tree's leaves, their projections, and each leaf's box."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, project: np.ndarray):
        points = vectors @ project
        order, self.starts = kd_leaves(points)
        self.ids, self.vectors, self.points = ids[order], vectors[order], points[order]
        self.ends = np.append(self.starts[1:], len(ids))
        self.low, self.high = np.minimum.reduceat(self.points, self.starts), np.maximum.reduceat(self.points, self.starts)
        self.project, self.verified = project, 0

    def search(self, query_id: int, query: np.ndarray, k: int, stop: float, bound: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest that the test lets it find, nearest first.

        stop: quantile of the test. bound: the k-th distance found elsewhere.
        """
        at = query @ self.project
        far = box_distance(at, self.low, self.high)
        leaves = np.argsort(far, kind="stable")
        far = np.append(far[leaves], np.inf)
        slack = 1e-9 * (1.0 + at @ at)  # equal vectors may differ in their projections' last bits
        ids, dist = np.zeros(0, np.int64), np.zeros(0)
        rows, near = np.zeros(0, np.int64), np.zeros(0)
        opened, width = 0, 4
        while True:
            reach = min(bound, dist[-1] if len(ids) >= k else math.inf)
            if not len(rows) or near[0] > far[opened]:  # the next neighbour may be in a leaf that isn't open yet
                if opened == len(leaves) or far[opened] > stop * reach * reach + slack:
                    if not len(rows):
                        return ids, dist
                else:
                    more = np.concatenate([np.arange(self.starts[x], self.ends[x]) for x in leaves[opened : opened + width]])
                    opened, width = min(len(leaves), opened + width), width * 2
                    gap = self.points[more] - at
                    rows, near = np.concatenate([rows, more]), np.concatenate([near, (gap * gap).sum(axis=1)])
                    order = np.argsort(near, kind="stable")
                    rows, near = rows[order], near[order]
                    continue
            if near[0] > stop * reach * reach + slack:
                return ids, dist
            n = min(STEP, max(1, int(np.searchsorted(near, far[opened], side="right"))))
            d = self.vectors[rows[:n]] - query
            self.verified += n
            found, apart = self.ids[rows[:n]], np.sqrt((d * d).sum(axis=1))
            rows, near = rows[n:], near[n:]
            other = found != query_id
            ids, dist = np.concatenate([ids, found[other]]), np.concatenate([dist, apart[other]])
            best = np.lexsort((ids, dist))
            best = best[np.sort(np.unique(ids[best], return_index=True)[1])][:k]  # a vec_id with several vectors counts once
            ids, dist = ids[best], dist[best]


def nearest(vectors: DataFrame, queries: Column, *, k: int = 10, dims: int = 24, sure: float = 0.93, shard_rows: int = 4096, block: int = 64, sample: int = 65_536) -> DataFrame:
    """(query_id, rank, vec_id, score, verified) for rows that `queries` holds for, against all rows of (vec_id, embedding).

    score is the Euclidean distance in double precision; verified says how many vectors the query was held against.
    """
    if dims % 2:
        raise ValueError("dims must be even")
    base = vectors.where(usable() & F.col("vec_id").isNotNull()).withColumn("_asks", F.coalesce(queries, F.lit(False)))
    base = base.groupBy(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).agg(F.max("_asks").alias("asks"))
    base = common.written(base, "vectors")
    parts = [_of_length(base.where(F.size("embedding") == n), n, k, dims, sure, shard_rows, block, sample) for n in lengths(base)]
    out = parts[0] if parts else vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, verified long")
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"), F.sum("verified").alias("verified"))
    of_query = Window.partitionBy("query_id")
    out = out.withColumn("rank", F.row_number().over(of_query.orderBy("score", "vec_id"))).withColumn("verified", F.sum("verified").over(of_query))
    return out.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "verified")


def _of_length(base: DataFrame, length: int, k: int, dims: int, sure: float, shard_rows: int, block: int, sample: int) -> DataFrame:
    """(query_id, vec_id, score) from each shard that a query goes to."""
    project, stop = projection(length, dims), quantile(sure, dims)
    same = Window.partitionBy("embedding").orderBy("vec_id")
    rows = base.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1).drop("_n")
    n = base.count()
    depth = max(0, math.ceil(math.log2(max(1, min(MOST_SHARDS, n / shard_rows)))))
    chance = common.unit("vec_id", "embedding", seed=5)
    # the rows with the least hashes, whatever the partitions
    part = base.where(F.lit(depth > 0)).select("embedding", chance.alias("u")).where(F.col("u") < 1.1 * sample / max(n, 1)).orderBy("u", "embedding").limit(sample)
    levels = splits(_project(part.collect(), project), depth) if depth else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(shard_of(matrix(b.column("embedding")) @ project, levels)), *(b.column(c) for c in ("vec_id", "embedding"))], ["shard", "vec_id", "embedding"])

    dealt = rows.select("vec_id", "embedding").mapInArrow(common.lean(deal), "shard long, vec_id long, embedding array<double>")
    index = common.written(_packed(dealt, "shard", "own", min(1 << depth, 4000), 1 << 40, project), "index")
    boxes = np.array([(r.shard, *r.low, *r.high) for r in index.select("shard", "low", "high").collect()]).reshape(-1, 1 + 2 * dims)  # MOST_SHARDS rows at most
    shards, low, high = boxes[:, 0].astype(np.int64), boxes[:, 1 : 1 + dims], boxes[:, 1 + dims :]

    def route(first: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = matrix(b.column("embedding"))
                to, row = [], []
                for i, at in enumerate(x @ project if len(x) else []):
                    far = box_distance(at, low, high)
                    home = far.argmin()
                    go = np.array([home]) if first else np.flatnonzero(far <= stop * b.column("bound")[i].as_py() ** 2 + 1e-9)
                    go = go if first else go[go != home]
                    to.append(shards[go])
                    row.append(np.full(len(go), i))
                if to:
                    row = pa.array(np.concatenate(row))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to)), *(b.column(c).take(row) for c in ("vec_id", "embedding", "bound"))], ["shard", "vec_id", "embedding", "bound"])

        return run

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, None
        for b in batches:
            for key, ids, own, qi, qv, qb in zip(*(b.column(c) for c in ("shard", "own_ids", "own_vectors", "query_ids", "query_vectors", "query_bounds")), strict=True):
                if key.as_py() != now:
                    now = key.as_py()
                    shard = Shard(np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(own.as_buffer(), np.float64).reshape(-1, length), project)
                out = []
                for i, q, bound in zip(np.frombuffer(qi.as_buffer(), np.int64), np.frombuffer(qv.as_buffer(), np.float64).reshape(-1, length), np.frombuffer(qb.as_buffer()), strict=True):
                    before = shard.verified
                    found, dist = shard.search(int(i), q, k, stop, float(bound))
                    cost = np.zeros(len(found), np.int64)
                    cost[:1] = shard.verified - before
                    out.append((np.full(len(found), i), found, dist, cost))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query_id", "vec_id", "score", "verified"])

    def searched(asked: DataFrame, first: bool) -> DataFrame:
        sent = asked.mapInArrow(common.lean(route(first)), "shard long, vec_id long, embedding array<double>, bound double")
        blocks = _packed(sent.withColumn("_b", F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(max(1, n // 100 // (block * 4))))), "shard", "query", min(1 << depth, 4000), block, None, "_b")
        met = index.join(blocks, "shard").sortWithinPartitions("shard").select("shard", "own_ids", "own_vectors", "query_ids", "query_vectors", "query_bounds")
        return common.written(met.mapInArrow(common.lean(search), "query_id long, vec_id long, score double, verified long"), "near")

    asks = base.where("asks").select("vec_id", "embedding")
    home = searched(asks.withColumn("bound", F.lit(float("inf"))), True)
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    kth = home.withColumn("_n", ranked).where(F.col("_n") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    rest = asks.join(kth, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    return home.unionByName(searched(rest, False))


def _project(rows: list, project: np.ndarray) -> np.ndarray:
    return np.array([r.embedding for r in rows], np.float64).reshape(len(rows), -1) @ project if rows else np.zeros((0, project.shape[1]))


def _packed(rows: DataFrame, key: str, what: str, parts: int, most: int, project: np.ndarray | None, salt: str | None = None) -> DataFrame:
    """Rows of a key as arrays: <what>_ids, <what>_vectors (64-bit), and either their box (with `project`) or <what>_bounds; `most` rows in a row at most."""
    width = 0 if project is None else project.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]] = []
        now, size = None, 0

        def row() -> pa.RecordBatch:
            ids, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            columns = [pa.array([now], pa.int64()), pa.array([ids.tobytes()]), pa.array([x.astype(np.float64).tobytes()])]
            if width:
                y = x @ project
                return pa.RecordBatch.from_arrays([*columns, pa.array([y.min(axis=0)]), pa.array([y.max(axis=0)])], [key, f"{what}_ids", f"{what}_vectors", "low", "high"])
            return pa.RecordBatch.from_arrays([*columns, pa.array([np.concatenate([h[2] for h in held]).tobytes()])], [key, f"{what}_ids", f"{what}_vectors", f"{what}_bounds"])

        for b in batches:
            if not b.num_rows:
                continue
            keys, ids, x = b.column(key).to_numpy(), b.column("vec_id").to_numpy(), matrix(b.column("embedding"))
            bounds = None if width else b.column("bound").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if held and keys[lo] != now:
                    yield row()
                    held, size = [], 0
                now = int(keys[lo])
                while lo < hi:
                    to = min(hi, lo + most - size)
                    held.append((ids[lo:to], x[lo:to], None if width else bounds[lo:to]))
                    size, lo = size + to - lo, to
                    if size == most:
                        yield row()
                        held, size = [], 0
        if held:
            yield row()

    more = "low array<double>, high array<double>" if width else f"{what}_bounds binary"
    by = [key, salt] if salt else [key]
    together = rows.repartition(parts, *by).sortWithinPartitions(key)
    return together.select(key, "vec_id", "embedding", *([] if width else ["bound"])).mapInArrow(common.lean(run), f"{key} long, {what}_ids binary, {what}_vectors binary, {more}")


def op5_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
