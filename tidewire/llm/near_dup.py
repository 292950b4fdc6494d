"""Near-duplicate documents by improved consistent weighted sampling (operator 8).

Each document is a weighted set of five-word shingles: weight = occurrences * idf, where idf falls from 1
for a shingle of one document to 1 / (1 + `strength`) for one of all (why it isn't steeper: README). Document frequencies are counted
over all documents in a table of counters, more of them the more documents there are, from which what chance puts into a counter is taken off. Improved consistent
weighted sampling draws `bands` * `per_band` samples of each set; two sets agree in a sample with the
probability of their weighted Jaccard similarity. Documents that agree in a whole band are candidates, and
weighted Jaccard on the whole sets decides.

Groups are never expanded. Texts with the same words are one class from the start. First every member of a bucket is
compared with one leader, the one whose buckets hold the most, then in `rounds` more rounds with one drawn of
its bucket, as long as its buckets hold several components. Members apart from a bucket's largest component then meet
members of other components on the rarest shingles that they can share, which misses no pair alike enough. The exact
comparison follows a comparison of the samples alone. Links between different texts that share a bucket are so all found,
or lie within a component already.

Defined results: a document without words (null or empty text) is a class of its own; a document of fewer than
five words has one shingle of all of them; rows with a null doc_id take no part and don't appear; rows
that share a doc_id are compared each by its own text, and what any of them is linked with belongs to that doc_id's group; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE = 5
STRENGTH = 0.25


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """65,536 draws each of r ~ Gamma(2, 1), its reciprocal and ln c, c ~ Gamma(2, 1)."""
    rng = np.random.default_rng(88172645463325252 % (1 << 32))
    r = rng.gamma(2.0, 1.0, 1 << 16)
    return r.astype(np.float32), (1.0 / r).astype(np.float32), np.log(rng.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)


_R, _INV_R, _LN_C = _tables()


def samples(shingles: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """n consistent weighted samples of one set."""
    return samples_of_rows(shingles, np.array([0, len(shingles)]), weights, n)[0]


def samples_of_rows(shingles: np.ndarray, first: np.ndarray, weights: np.ndarray, n: int, step: int = 1 << 14) -> np.ndarray:
    """n consistent weighted samples of each row's set: a 64-bit print of (shingle, step) each; 0 for an empty set. first: each row's first shingle, and the end.

    For each shingle and sample, r, c and beta follow from the shingle's hash alone; t = floor(ln w / r + beta);
    the shingle with the least ln c - r (t - beta + 1) is drawn. With f, what floor takes off, that is ln c - ln w - r (1 - f).
    """
    out = np.zeros((len(first) - 1, n), np.uint64)
    lo = 0
    while lo < len(out):  # rows of about `step` shingles at a time, a longer row by itself
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + step, side="right")) - 1)
        _draw(shingles[first[lo] : first[hi]], first[lo : hi + 1] - first[lo], weights[first[lo] : first[hi]], out[lo:hi])
        lo = hi
    return out


def _draw(shingles: np.ndarray, first: np.ndarray, weights: np.ndarray, out: np.ndarray) -> None:
    some = np.flatnonzero(np.diff(first))
    if not len(some):
        return
    start, size, row = first[:-1][some], np.diff(first)[some], np.repeat(np.arange(len(some)), np.diff(first)[some])
    ln_w = np.log(weights).astype(np.float32)
    odd = np.flatnonzero(ln_w)  # where ln w is 0, t is 0 and f is beta
    x, y = np.empty(len(row), np.uint64), np.empty(len(row), np.uint64)
    f, r, t = (np.zeros(len(row), np.float32) for _ in range(3))
    for k, seed in enumerate(common.mix(np.arange(1, out.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))):
        np.bitwise_xor(shingles, seed, out=x)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= np.right_shift(x, np.uint64(32), out=y)
        x *= np.uint64(0xA0761D6478BD642F)
        one = np.right_shift(x, np.uint64(48), out=y).view(np.int64)
        np.take(_R, one, out=r, mode="clip")
        f[:] = x.view(np.uint32)[0::2]
        f *= np.float32(2.0**-32)
        if len(odd):
            whole = f[odd] + ln_w[odd] * _INV_R[one[odd]]
            t[odd] = np.floor(whole)
            f[odd] = whole - t[odd]
        f -= np.float32(1)
        f *= r
        np.right_shift(x, np.uint64(32), out=y)
        y &= np.uint64(0xFFFF)
        f += np.take(_LN_C, y.view(np.int64), out=r, mode="clip")
        f -= ln_w
        hit = np.flatnonzero(f == np.repeat(np.minimum.reduceat(f, start), size))
        hit = hit[np.append(True, row[hit][1:] != row[hit][:-1])]  # ties go to the smaller shingle
        out[some, k] = common.mix(shingles[hit] ^ (t[hit].astype(np.int64).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))


class Idf:
    """Weights of shingles from a table of counted document frequencies."""

    def __init__(self, counts: np.ndarray, n_docs: int, strength: float):
        middle = float(np.median(counts))
        df = np.maximum(1.0, counts - middle - 3.0 * math.sqrt(middle))
        self.n = len(counts)
        whole = math.log(max(2, n_docs))
        self.table = ((1.0 + strength * np.clip(np.log(max(2, n_docs) / df) / whole, 0.0, 1.0)) / (1.0 + strength)).astype(np.float64)

    def weights(self, shingles: np.ndarray, times: np.ndarray) -> np.ndarray:
        return times * self.table[(shingles % np.uint64(self.n)).astype(np.int64)]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser weights over sum of the greater ones. a, b: (sorted distinct shingles, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    whole = a[1].sum() + b[1].sum() - low
    return float(low / whole) if whole > 0 else 0.0


def sketch_size(n_docs: int) -> int:
    """Counters: 2**18 up to a million documents, then in proportion to the square root of their number, 2**22 at most."""
    return 1 << min(22, 18 + max(0, math.ceil(math.log2(max(1, n_docs) / 1e6) / 2)))


def count_shingles(docs: DataFrame, k: int = SHINGLE, sketch: int = 1 << 18) -> np.ndarray:
    """Documents by counter of their distinct shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sketch, np.int64)
        for b in batches:
            texts = common.strings(b.column("text"))
            for lo, hi in common.slices(texts):
                own, _, _ = common.distinct_by_row(*common.Words(texts[lo:hi]).shingles(k))
                total += np.bincount((own % np.uint64(sketch)).astype(np.int64), minlength=sketch)
        yield from common.vector_rows(total, common.task_salt())

    return common.sum_vectors(docs.select("text").mapInArrow(common.lean(count), common.VECTOR), sketch)


def sign(docs: DataFrame, idf: Idf, bands: int, per_band: int, k: int = SHINGLE) -> DataFrame:
    """(doc_id, text_a, text_b: 128 bits of the words, null for none; sig: 32 bits of each sample; keys: a number for each band)."""
    model = docs.sparkSession.sparkContext.broadcast(idf)  # a table of fixed size
    n = bands * per_band

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = model.value.weights
        lift = common.powers(0x9FB21C651E98DF25, per_band + 1)[1:]
        salt = np.arange(1, bands + 1, dtype=np.uint64)
        for b in batches:
            texts = common.strings(b.column("text"))
            for lo, hi in common.slices(texts):
                words = common.Words(texts[lo:hi])
                h, times, first = common.distinct_by_row(*words.shingles(k))
                s = samples_of_rows(h, first, weigh(h, times), n)
                one, two = words.sequence()
                none = np.diff(words.rows) == 0
                keys = common.mix((s.reshape(-1, bands, per_band) * lift).sum(axis=2, dtype=np.uint64) * np.uint64(2) + salt).view(np.int64)
                keys = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), bands).cast(pa.list_(pa.int64()))
                sigs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * n), hi - lo, [None, pa.py_buffer((s >> np.uint64(32)).astype("<u4").tobytes())]).cast(pa.binary())
                sigs, keys = (pc.if_else(pa.array(none), None, x) for x in (sigs, keys))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id")[lo:hi].cast(pa.int64()), pa.array(one.view(np.int64), mask=none), pa.array(two.view(np.int64), mask=none), sigs, keys],
                    ["doc_id", "text_a", "text_b", "sig", "keys"],
                )

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(common.lean(run), "doc_id long, text_a long, text_b long, sig binary, keys array<long>")


def _alike(pairs: DataFrame, least: int) -> DataFrame:
    """Of (a, b, sig_a, sig_b), the pairs (a, b) that agree in at least `least` samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u4").reshape(b.num_rows, -1) for c in ("sig_a", "sig_b"))
                ok = pa.array((x == y).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([b.column(c).filter(ok) for c in ("a", "b")], ["a", "b"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(common.lean(run), "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, idf: Idf, threshold: float, k: int) -> DataFrame:
    """Of (a, b), the pairs whose whole sets are alike enough, with their similarity."""
    model = pairs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = model.value.weights
        for batch in batches:
            a, b = common.strings(batch.column("text_a")), common.strings(batch.column("text_b"))
            for lo in range(0, batch.num_rows, 64):
                sets = []
                for side in (a, b):
                    h, times, first = common.distinct_by_row(*common.Words(side[lo : lo + 64]).shingles(k))
                    w = weigh(h, times)
                    sets.append([(h[x:y], w[x:y]) for x, y in zip(first[:-1], first[1:], strict=True)])
                s = np.array([weighted_jaccard(x, y) for x, y in zip(*sets, strict=True)])
                ok = pa.array(s >= threshold)
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[lo : lo + 64].filter(ok) for c in ("a", "b")), pa.array(s).filter(ok)], ["a", "b", "similarity"])

    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b").mapInArrow(common.lean(run), "a long, b long, similarity double")


def near_duplicates(docs: DataFrame, **how: float) -> DataFrame:
    """A row for each doc_id: component_id (the smallest doc_id of its class) and kept (it is that one). how: see `grouped`."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    rows, ids = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    found = grouped(docs, **how) if rows == ids else _of_repeated(docs, **how)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _of_repeated(docs: DataFrame, **how: float) -> DataFrame:
    """(doc_id, component_id) where several rows share a doc_id: rows are grouped by their texts, then groups that share a doc_id meet."""
    keyed = common.written(docs.withColumn("_key", F.monotonically_increasing_id()), "keyed")
    found = grouped(keyed.select(F.col("_key").alias("doc_id"), "text"), **how).toDF("_key", "c")
    of = common.written(keyed.select("doc_id", "_key").join(found, "_key").select("doc_id", "c").distinct(), "row-groups")
    first = of.groupBy("doc_id").agg(F.min("c").alias("first"))
    met = components(of.join(first, "doc_id").select(F.col("c").alias("a"), F.col("first").alias("b")).where("a <> b"))
    of = common.written(of.join(met.toDF("c", "whole"), "c", "left").select("doc_id", F.coalesce("whole", "c").alias("c")).distinct(), "row-groups")
    least = of.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return of.join(least, "c").select("doc_id", "component_id")


def _by_bucket(placed: DataFrame, of_bucket: DataFrame, part: int = 512) -> DataFrame:
    """Joins what is known of each bucket (band, key, n, ...) to its members; a long bucket is dealt out by `part` members."""
    parts = F.ceil(F.col("n") / part)
    many = of_bucket.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("n")
    return placed.withColumn("_part", F.pmod(F.xxhash64("doc_id"), parts)).join(many, ["band", "key", "_part"]).drop("_part")


def grouped(docs: DataFrame, *, threshold: float = 0.8, bands: int = 12, per_band: int = 4, k: int = SHINGLE, strength: float = STRENGTH, rounds: int = 1) -> DataFrame:
    """(doc_id, component_id: the smallest doc_id of its class) for rows (doc_id: long, each once; text)."""
    n_docs = docs.count()
    idf = Idf(count_shingles(docs, k, sketch_size(n_docs)), n_docs, strength)
    signed = common.written(sign(docs, idf, bands, per_band, k), "signatures")
    classes = signed.where("sig is not null").groupBy("text_a", "text_b").agg(F.min("doc_id").alias("leader"))
    members = common.written(signed.where("sig is not null").select("doc_id", "text_a", "text_b").join(classes, ["text_a", "text_b"]).select("doc_id", "leader"), "members")
    # one signature and one text of each class
    heads = common.written(signed.join(members.where("doc_id = leader").select("doc_id"), "doc_id", "left_semi").select("doc_id", "sig", "keys"), "heads")
    texts = docs.join(heads.select("doc_id"), "doc_id", "left_semi")
    rows = heads.select("doc_id", F.posexplode("keys").alias("band", "key"))
    buckets = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = common.written(rows.join(buckets, ["band", "key"]), "buckets")
    # how many share a document's buckets: greatest for the text that the others of a group come from
    middle = shared.groupBy("doc_id").agg(F.sum("n").alias("mid"))
    in_bucket = common.written(shared.select("band", "key", "n", "doc_id").join(middle, "doc_id"), "buckets")
    common.discard(signed, shared)
    least = int(threshold * bands * per_band - 5.0 * math.sqrt(threshold * (1 - threshold) * bands * per_band))

    def links(pairs: DataFrame) -> DataFrame:
        a = pairs.join(heads.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a")
        both = a.join(heads.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b")
        return common.written(_verified(_alike(both, least), texts, idf, threshold, k), "near-links")

    same = members.select(F.col("doc_id").alias("a"), F.col("leader").alias("b"))
    linked = found = None
    # a member meets one of the heads of its buckets, round by round, while its buckets hold several components ...
    for turn in range(rounds + 1):
        in_bucket = placed = _placed(in_bucket, found)
        drawn = F.xxhash64("doc_id", F.lit(turn))
        rank = F.struct(-F.col("mid"), drawn, "doc_id") if turn == 0 else F.struct(F.lit(0).cast("long"), drawn, "doc_id")
        heads_now = placed.withColumn("rank", rank).groupBy("band", "key").agg(F.min_by(F.struct("doc_id", "c", "rank"), "rank").alias("h"), F.max("n").alias("n"))
        met = _by_bucket(placed, heads_now).where("c <> h.c").groupBy("doc_id").agg(F.min_by("h.doc_id", "h.rank").alias("head"))
        more = links(met.select(F.least("doc_id", "head").alias("a"), F.greatest("doc_id", "head").alias("b")).distinct()).select("a", "b")
        linked = more if linked is None else common.written(linked.unionByName(more), "near-links")
        found = components(linked)
    # ... and what is apart from the largest component of a bucket after them meets members of other components by rare shingles
    placed = _placed(in_bucket, found)
    sizes = placed.groupBy("band", "key", "c").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n")).groupBy("band", "key").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.max("n").alias("n"))
    apart = _by_bucket(placed, sizes).where("c <> main").select("doc_id").distinct()
    rest = _prefix_pairs(placed.select("doc_id", "c").distinct(), apart, texts, idf, threshold, k)
    second = links(rest)
    found = components(linked.unionByName(second.select("a", "b")).unionByName(same.where("a <> b")))
    return docs.select("doc_id").join(found.toDF("doc_id", "component"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))


def _prefix_pairs(nodes: DataFrame, apart: DataFrame, texts: DataFrame, idf: Idf, threshold: float, k: int) -> DataFrame:
    """(a, b): every pair alike enough of one of `apart` and one of `nodes` (doc_id, c) of another c, and few others.

    The shingles of a document are put in order, those of the fewest `nodes` first. Sets of weights x and y that are alike
    enough share t / (1 + t) * (x + y) at least, so the first shingle they share comes, in either, before that
    much is left. Pairs so meet on it alone; the sizes are part of the key, in steps of `wide`, as the bound depends on them.
    """
    model = nodes.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = common.strings(batch.column("text"))
            for lo, hi in common.slices(text):
                h, first = common.Words(text[lo:hi]).shingles(k)
                own = [np.unique(h[first[d] : first[d + 1]], return_counts=True) for d in range(hi - lo)]
                each = [model.value.weights(u, n) for u, n in own]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi], batch.column("c")[lo:hi], pa.array([w.sum() for w in each], pa.float64()), pa.array([u.view(np.int64) for u, _ in own], pa.list_(pa.int64())), pa.array(each, pa.list_(pa.float64()))],
                    ["doc_id", "c", "whole", "shingle", "w"],
                )

    wide, part = 1.04, threshold / (1.0 + threshold)
    reach = math.ceil(-math.log(threshold) / math.log(wide))
    sets = texts.join(nodes, "doc_id").select("doc_id", "c", "text").mapInArrow(common.lean(run), "doc_id long, c long, whole double, shingle array<long>, w array<double>")
    sets = common.written(sets.select("doc_id", "c", "whole", F.explode(F.arrays_zip("shingle", "w")).alias("z")).select("doc_id", "c", "whole", "z.shingle", "z.w"), "shingles")
    often = sets.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ordered = Window.partitionBy("doc_id").orderBy("n", "shingle").rowsBetween(Window.unboundedPreceding, -1)
    placed = sets.join(often, "shingle", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("before", F.coalesce(F.sum("w").over(ordered), F.lit(0.0)))
    early = placed.where((F.col("n") > 1) & (F.col("before") <= F.col("whole") * (1.0 - threshold + 1e-6)))
    size = F.floor(F.log("whole") / math.log(wide))
    other = F.filter(F.sequence(size - reach, size + reach), lambda s: F.col("before") <= F.col("whole") * (1.0 + 1e-6) - part * (F.col("whole") + F.pow(F.lit(wide), s)))
    early = early.select("doc_id", "c", "whole", "before", "shingle", size.alias("size"), F.explode(other).alias("other"))
    early = common.written(early.select("doc_id", "c", "whole", "before", "shingle", F.least("size", "other").alias("lo"), F.greatest("size", "other").alias("hi"), "size"), "prefixes")
    x, y = early.join(apart, "doc_id", "left_semi").alias("x"), early.alias("y")
    least = part * (F.col("x.whole") + F.col("y.whole"))
    near = (F.col("x.before") <= F.col("x.whole") * (1.0 + 1e-6) - least) & (F.col("y.before") <= F.col("y.whole") * (1.0 + 1e-6) - least)
    same_key = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi")) & (F.col("x.size") + F.col("y.size") == F.col("x.lo") + F.col("x.hi"))
    met = x.join(y, same_key & (F.col("x.c") != F.col("y.c")) & near)
    return met.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def _placed(in_bucket: DataFrame, found: DataFrame | None) -> DataFrame:
    """(band, key, n, doc_id, mid, c: its component) of the buckets that hold several components."""
    if found is None:
        return in_bucket.withColumn("c", F.col("doc_id"))
    each = in_bucket.drop("c").join(found.select(F.col("node").alias("doc_id"), F.col("component").alias("c")), "doc_id", "left")
    each = common.written(each.withColumn("c", F.coalesce("c", "doc_id")), "placed")
    mixed = each.groupBy("band", "key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("n").alias("n")).where("lo <> hi").select("band", "key", "n")
    return common.written(_by_bucket(each, mixed), "mixed")


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))
