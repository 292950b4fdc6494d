"""Quality classifier by importance resampling (operator 1).

Two generative models over hashed n-grams (words and marks, one and two at a time, in `buckets` buckets) are
estimated: one from target texts, one from all raw texts. A document's log importance weight is the sum over
its n-grams of ln p_target - ln p_raw; as such sums grow with a text's length, documents are compared by the weight for each
n-gram (the logarithm of a geometric mean). They are sampled without replacement by the Gumbel top-k rule: the k largest of
weight an n-gram / `temperature` + Gumbel noise are kept, which draws in proportion to exp(weight an n-gram / temperature). The noise
depends on doc_id and `seed` alone. k is given, or a `share` of the documents with n-grams, or the number of documents whose
weight an n-gram is at least `floor`: those that the target model doesn't find less likely than raw text by more than that.
Ranking, k and temperature so have one scale: at the default temperature of 0.01 two documents whose weights differ by 0.01 an n-gram
have odds of e to 1, so who is kept is drawn near the k-th place and certain far from it.

Defined results: a null or empty text has weight 0 and is not kept (there is nothing to train on);
a null doc_id gets the noise of 0; of rows with equal keys at the k-th place (they share doc_id and weight) some are taken one by one;
an empty table, or no target text, gives weight 0 everywhere. Columns of
the input are passed on; log_weight, n_grams, gumbel_key and kept replace ones of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 18
#: Ids of good documents that are broadcast at most.
MOST_BROADCAST = 1 << 20
FLOOR, TEMPERATURE = -0.02, 0.01
_MARKS = np.isin(np.arange(256), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each row, and each row's first place: words, runs of marks, and pairs of neighbours."""
    words, marks = common.Words(texts), common.Words(texts, table=_MARKS)
    start = np.concatenate([words.starts, marks.starts])
    order = np.argsort(start, kind="stable")
    start, h = start[order], np.concatenate([words.hashes, marks.hashes])[order]
    rows = np.searchsorted(start, words.off)
    n = np.diff(rows)
    pair = common.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) else h
    inner = np.ones(len(pair), bool)
    edge = rows[1:-1] - 1
    inner[edge[(edge >= 0) & (edge < len(pair))]] = False
    one = (h % np.uint64(buckets)).astype(np.int64)
    two = (pair % np.uint64(buckets)).astype(np.int64)
    out = np.empty((len(h), 2), np.int64)
    out[:, 0], out[:, 1] = one, -1
    out[: len(two), 1] = np.where(inner, two, -1)
    return out, np.concatenate([[0], np.cumsum(n)])


def fit(docs: DataFrame, target: str, buckets: int = BUCKETS, smooth: float = 1.0) -> np.ndarray:
    """ln p_target - ln p_raw by bucket. target: name of a boolean column; raw is every row. Two counts a bucket reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets + 1), np.int64)
        for b in batches:
            texts, good = common.strings(b.column("text")), b.column("good").to_numpy(zero_copy_only=False)
            for lo, hi in common.slices(texts):
                grams, first = features(texts[lo:hi], buckets)
                total[0] += np.bincount(grams.ravel() + 1, minlength=buckets + 1)
                mine = np.repeat(good[lo:hi], np.diff(first))
                if mine.any():
                    total[1] += np.bincount(grams[mine].ravel() + 1, minlength=buckets + 1)
        yield from common.vector_rows(total[:, 1:].ravel(), common.task_salt())

    counted = docs.select("text", F.coalesce(F.col(target), F.lit(False)).alias("good")).mapInArrow(common.lean(count), common.VECTOR)
    raw, good = common.sum_vectors(counted, 2 * buckets).reshape(2, buckets).astype(np.float64)
    if not good.sum():
        return np.zeros(buckets, np.float32)
    base = (raw + smooth) / (raw.sum() + smooth * buckets)
    # the target's counts are drawn towards the raw model, so that rare buckets say little
    own = (good + 20.0 * smooth * buckets * base / 4) / (good.sum() + 20.0 * smooth * buckets / 4)
    return np.log(own / base).astype(np.float32)


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """Adds log_weight and n_grams."""
    docs = common.extra_columns(docs, "log_weight", "n_grams")
    kept, model, buckets = docs.schema.names, docs.sparkSession.sparkContext.broadcast(np.append(ratio, np.float32(0))), len(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value.astype(np.float64)
        for b in batches:
            texts = common.strings(b.column("text"))
            for lo, hi in common.slices(texts):
                grams, first = features(texts[lo:hi], buckets)
                total = np.concatenate([[0.0], np.cumsum(table[grams].sum(axis=1))])
                yield pa.RecordBatch.from_arrays([*(b.column(c)[lo:hi] for c in kept), pa.array(total[first[1:]] - total[first[:-1]]), pa.array(np.diff(first))], [*kept, "log_weight", "n_grams"])

    return docs.mapInArrow(common.lean(score), common.wider(docs.schema, "log_weight double, n_grams long"))


def kth_largest(keys: DataFrame, k: int, column: str, bins: int = 4096) -> tuple[float, int]:
    """The k-th largest value of a column without nulls, and how many of the rows that equal it are among the k.

    Histograms of `bins` bins narrow the range down until it holds one value; what reaches the driver is a
    histogram at a time.
    """
    lo, hi = keys.agg(F.min(column), F.max(column)).first()
    while True:
        width = (hi - lo) / bins
        if hi <= lo or lo + width == lo:
            return lo, k
        at = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.lit(lo)) / F.lit(width)))
        rows = keys.where(F.col(column).between(lo, hi)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r.bin):
            if k <= r.n:
                lo, hi = r.lo, r.hi
                break
            k -= r.n


def gumbel_top_k(weighed: DataFrame, k: int | None = None, *, share: float | None = None, floor: float = FLOOR, temperature: float = TEMPERATURE, seed: int = 1) -> DataFrame:
    """Adds gumbel_key and kept to rows with doc_id, log_weight and n_grams."""
    noise = -F.log(-F.log(common.unit(F.coalesce(F.col("doc_id"), F.lit(0)), seed=seed)))
    mean = F.col("log_weight") / F.col("n_grams")
    keyed = weighed.withColumn("gumbel_key", F.when(F.col("n_grams") > 0, mean / temperature + noise))
    some = keyed.where("n_grams > 0")
    total, above = some.agg(F.count(F.lit(1)), F.count_if(mean >= floor)).first()
    if k is None:
        k = above if share is None else round(share * total)
    if k <= 0 or k >= total:
        return keyed.withColumn("kept", (F.col("n_grams") > 0) & F.lit(k > 0))
    edge, left = kth_largest(some.select("gumbel_key"), k, "gumbel_key")
    at_edge = F.coalesce(F.col("gumbel_key") == edge, F.lit(False))
    above_edge = F.coalesce(F.col("gumbel_key") > edge, F.lit(False))
    if some.where(F.col("gumbel_key") == edge).count() == left:
        return keyed.withColumn("kept", above_edge | at_edge)
    # rows that equal the k-th are taken by number: a second search, no sort of what may be a third of all rows
    keyed = common.written(keyed.withColumn("_row", F.monotonically_increasing_id().cast("double")), "quality")
    last, _ = kth_largest(keyed.where(at_edge).select((-F.col("_row")).alias("_row")), left, "_row")
    return keyed.withColumn("kept", above_edge | (at_edge & (F.col("_row") <= -last))).drop("_row")


def with_target(docs: DataFrame, labels: DataFrame, name: str, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Marks documents that labels call good (quality 1, toxic not 1). A document with several labels needs all of them good.

    All good documents are the target. Up to `most_broadcast` of their ids are broadcast, so no text is shuffled; more of them are joined by shuffle, without a sort of texts.
    """
    fine = (F.col("quality") == 1) & ~F.coalesce(F.col("toxic") == 1, F.lit(False))
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce(fine, F.lit(False))).alias(name)).where(name)
    good = F.broadcast(good) if good.count() <= most_broadcast else good.hint("shuffle_hash")
    return common.extra_columns(docs, name).join(good, "doc_id", "left")


def classify(docs: DataFrame, labels: DataFrame, k: int | None = None, **how: float) -> DataFrame:
    """Every document with log_weight, gumbel_key and kept."""
    marked = with_target(docs.select("doc_id", "text"), labels, "good")
    ratio = fit(marked, "good")
    names = [c for c in docs.columns if c not in ("log_weight", "n_grams", "gumbel_key", "kept")]
    weighed = common.written(weigh(docs.select(*names), ratio), "quality")
    return gumbel_top_k(weighed, k, **how)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    marked = with_target(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"), "good")
    scored = common.written(weigh(marked.select("doc_id", "text"), fit(marked, "good")).drop("text"), "quality")
    return gumbel_top_k(scored).select("doc_id", "log_weight", "n_grams", "gumbel_key", "kept")
