"""Near-duplicate vectors by a pivot-permutation index (operator 9).

Reference vectors (pivots) are drawn, a bounded sample: the least by hash, `PIVOTS_PER_ROOT` times the square root of the number of
vectors, between 96 and 65,536. Each vector is described by the 10 to 16 pivots closest to it. The inverted list of a
pivot holds the vectors that name it; within a list, vectors meet if they share a second pivot, and are verified by
cosine in double precision. A pair counts in the list of the first pivot that both name, so once. Lists so hold about as many vectors
as the square root of the table's, however large it is. The chance that a pair at a cosine of 0.9 exactly shares two pivots, simulated in 64
dimensions: 0.9995 (96 pivots, 10 nearest), 0.999 (768, 10), 0.9975 (4,096, 12).

Long lists are cut into blocks by hash, and blocks compared two at a time, so no task holds a whole list; a vector goes to
a list once for each pair of blocks. Pairs are never emitted: a task gives each vector's number of links and a forest of links that joins
what it joined. Equal vectors are one class from the start. Vectors of each length are an index of their own.

Defined results: a vector that is null, zero, or holds null or non-finite components
links with nothing (n_links 0, its own component), nor do vectors of different lengths with each other; a null vec_id doesn't appear; rows that share a vec_id
are one vector, linked with what any of them is linked with (n_links is the sum); an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .vectors import lengths, matrix, usable

PIVOTS_PER_ROOT = 3.4


def pivots_for(n: int) -> tuple[int, int]:
    """How many pivots for n vectors, and how many of them describe one."""
    pivots = min(n, 1 << 16, max(96, round(PIVOTS_PER_ROOT * math.sqrt(n))))
    return pivots, min(pivots, 10 if pivots <= 1024 else 12 if pivots <= 8192 else 16)


def permutations(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The places of the nearest pivots of each row of x, nearest first."""
    out = np.empty((len(x), nearest), np.int32)
    step = max(1, (1 << 22) // len(pivots))
    for k in range(0, len(x), step):
        near = -(x[k : k + step] @ pivots.T)
        some = np.argpartition(near, nearest - 1, axis=1)[:, :nearest] if nearest < len(pivots) else np.tile(np.arange(nearest), (len(near), 1))
        out[k : k + step] = np.take_along_axis(some, np.argsort(np.take_along_axis(near, some, axis=1), axis=1, kind="stable"), axis=1)
    return out


def _shared(a: np.ndarray, b: np.ndarray, first: int, shared: int) -> np.ndarray:
    """For rows of sorted pivots: they share `shared` or more, `first` the least of them."""
    same = (a[:, :, None] == b[:, None, :]).any(axis=2)
    least = np.take_along_axis(a, same.argmax(axis=1)[:, None], axis=1)[:, 0]
    return (same.sum(axis=1) >= shared) & (least == first)


def _close(x: np.ndarray, one: np.ndarray, two: np.ndarray | None, threshold: float, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows of x with a cosine of `threshold` or more: one of `one` with one of `two`, or two of `one`."""
    single = x.astype(np.float32)
    found = []
    for k in range(0, len(one), step):
        other = one[k:] if two is None else two
        i, j = np.nonzero(single[one[k : k + step]] @ single[other].T >= np.float32(threshold - 1e-4))
        i, j = one[k : k + step][i], other[j]
        if two is None:
            i, j = i[i < j], j[i < j]
        ok = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
        found.append((i[ok], j[ok]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def compare(list_: int, i: int, j: int, own: np.ndarray, near: np.ndarray, x: np.ndarray, threshold: float, shared: int, direct: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Links of blocks i and j of a pivot's list: places of rows with unit vectors x and sorted pivots near.

    A short list is multiplied as a whole; in a longer one, vectors meet by each second pivot.
    """
    groups = [np.arange(len(x))]
    if len(x) > direct and shared > 1:
        row, col = np.nonzero(near > list_)
        second = near[row, col]
        order = np.argsort(second, kind="stable")
        groups = np.split(row[order], np.flatnonzero(np.diff(second[order])) + 1)
    found = []
    for g in groups:
        if len(g) > 1:
            a, b = _close(x, g, None, threshold) if i == j else _close(x, g[own[g] == i], g[own[g] == j], threshold)
            ok = _shared(near[a], near[b], list_, shared)
            found.append((a[ok], b[ok]))
    if not found:
        return (np.zeros(0, np.int64),) * 2
    a, b = (np.concatenate(c) for c in zip(*found, strict=True))
    pairs = np.unique(np.stack([a, b], axis=1), axis=0)  # two vectors may share several second pivots
    return pairs[:, 0], pairs[:, 1]


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Places of links that join what all of them join."""
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        rx, ry = find(x), find(y)
        if rx != ry:
            root[ry] = rx
            kept.append(k)
    return np.array(kept, np.int64)


def near_duplicate_vectors(vectors: DataFrame, *, threshold: float = 0.9, pivots: int | None = None, nearest: int | None = None, shared: int = 2, block: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each vec_id. pivots, nearest: see `pivots_for`."""
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null")
    good = base.where(usable()).dropDuplicates(["vec_id", "embedding"])
    heads = common.written(good.groupBy("embedding").agg(F.min("vec_id").alias("head"), F.count(F.lit(1)).alias("size")), "vector-classes")
    # a class's number: its head, unless one vec_id heads several
    heads = heads.withColumn("class", F.when(F.lit(_unique(heads)), F.col("head")).otherwise(F.xxhash64("head", "embedding")))
    out = base.select("vec_id").distinct()
    linked = None
    for length in lengths(heads):
        found = _links(heads.where(F.size("embedding") == length), threshold, pivots, nearest, shared, block)
        linked = found if linked is None else linked.unionByName(found)
    if linked is None:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counts = linked.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    members = good.join(heads.select("embedding", "class", "head", "size"), "embedding").select("vec_id", "class", "head", "size")
    members = common.written(members.join(counts, "class", "left").select("vec_id", "class", "head", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n")), "vector-members")
    to_head = heads.select("class", "head")
    tree = linked.where("b is not null").select("a", "b").join(to_head.toDF("a", "x"), "a").join(to_head.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = components(tree.unionByName(members.select(F.col("vec_id").alias("a"), F.col("head").alias("b")).where("a <> b")))
    each = members.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    out = out.join(each, "vec_id", "left").join(found.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _links(heads: DataFrame, threshold: float, pivots: int | None, nearest: int | None, shared: int, block: int) -> DataFrame:
    """For (class, size, embedding: of one length): rows (a, n: links of class a) and (a, b: a forest of links), told by b."""
    spark, n = heads.sparkSession, heads.count()
    pivots, nearest = (given or usual for given, usual in zip((pivots, nearest), pivots_for(n), strict=True))
    rows = heads.where(common.unit("head", "embedding", seed=3) < 2.0 * pivots / n) if n > 4 * pivots else heads
    drawn = np.array([r.embedding for r in rows.orderBy(F.xxhash64(F.lit(3), "head", "embedding")).limit(pivots).select("embedding").collect()], np.float64)
    drawn /= np.linalg.norm(drawn, axis=1, keepdims=True)
    nearest = min(nearest, len(drawn))
    model = spark.sparkContext.broadcast(drawn)  # 65,536 vectors at most
    shared = min(shared, nearest)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("embedding"))
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                near = np.sort(permutations(x, model.value, nearest), axis=1)
                near = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), nearest).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("class", "size", "embedding")), near], ["class", "size", "embedding", "near"])

    described = common.written(heads.select("class", "size", "embedding").mapInArrow(common.lean(describe), f"class long, size long, embedding {dict(heads.dtypes)['embedding']}, near array<int>"), "permutations")
    # the greatest pivots of a vector are no pair's least shared one
    posted = described.select("class", F.explode(F.slice("near", 1, nearest - shared + 1)).alias("list"))
    long_ = posted.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where("n > 1")  # a row for each pivot at most
    parts = F.ceil(F.col("n") / block)
    mine = described.withColumn("list", F.explode(F.slice("near", 1, nearest - shared + 1))).join(F.broadcast(long_), "list")
    mine = mine.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("class"), F.col("parts")))
    met = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("list", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "class", "size", "own", "near", "embedding")
    whole = met.repartition(F.col("list"), F.col("i"), F.col("j")).sortWithinPartitions("list", "i", "j")
    names = ("class", "size", "own", "near", "embedding")

    def result(key: tuple, held: list) -> pa.RecordBatch | None:
        cls, size, own, near, x = (np.concatenate(c) for c in zip(*held, strict=True))
        if len(cls) < 2:
            return None
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        a, b = compare(*key, own, near, x, threshold, shared)
        if not len(a):
            return None
        n = np.bincount(a, size[b], len(cls)) + np.bincount(b, size[a], len(cls))
        some, tree = np.flatnonzero(n), _forest(a, b, len(cls))
        nodes = np.concatenate([cls[some], cls[a[tree]]])
        to = pa.array(np.concatenate([np.zeros(len(some), np.int64), cls[b[tree]]]), mask=np.concatenate([np.ones(len(some), bool), np.zeros(len(tree), bool)]))
        return pa.RecordBatch.from_arrays([pa.array(nodes), to, pa.array(np.concatenate([n[some].astype(np.int64), np.zeros(len(tree), np.int64)]))], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in ("list", "i", "j")], axis=1).astype(np.int64)
            values = [b.column(c).to_numpy() for c in names[:3]] + [b.column("near").flatten().to_numpy().reshape(b.num_rows, -1), matrix(b.column("embedding"))]
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                key = tuple(keys[lo].tolist())
                if key != now:
                    if held and (done := result(now, held)):
                        yield done
                    now, held = key, []
                held.append([v[lo:hi] for v in values])
        if held and (done := result(now, held)):
            yield done

    return common.written(whole.mapInArrow(common.lean(run), "a long, b long, n long"), "vector-links")


def _unique(heads: DataFrame) -> bool:
    n = heads.agg(F.count("head"), F.count_distinct("head")).first()
    return n[0] == n[1]


def op9_embedding_dups(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
