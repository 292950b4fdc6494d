"""Ranked lexical search by a bit-sliced impact index (operator 12).

Documents are dealt out to blocks of about `block` by a hash. In a block, the impact of a term on each document, w * ((10^9 tf) div (1000 tf + 8 m)),
is kept as bitmaps: slice b holds bit b of every document's impact. An item's scores are the sum of its terms' impacts: bitmaps of three
numbers become two by bitwise carry arithmetic until two are left, which are added with rippling carries. The top k of a block come from the sum's slices, most significant first:
documents with the bit stay while at least k have it, else they are taken and the rest searched on. Blocks' winners meet by item.

Terms are told by 64 bits of hash. df, N and L are counted over all documents. Postings are written once, for terms that a bitmap of the items' terms lets
through (2^26 bits at most). Items go to the blocks in batches of `batch`, so a task holds one block and one batch, whatever the tables' sizes.

Defined results: null or empty text has no terms; a document without terms is counted nowhere and found by no item; an item without terms has no
rows; rows that share a doc_id are documents of their own, each with a rank of its own, and so are rows that share an item_id: each such item is
answered by itself under its id; a null doc_id comes last among equal scores; empty tables give no rows; equal scores
of equal doc_ids come in an order that follows from the rows' places. Other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .decontamination import words_of

BLOCK, BATCH, TOP = 4096, 256, 10
#: Of decoded slices, so many bytes are kept by a task.
CACHE_BYTES = 64 << 20


def terms_of(docs: DataFrame, key: str, bitmap=None) -> DataFrame:  # noqa: ANN001
    """(row, key, n, terms, tfs): distinct terms of each text and how often each stands there; with a bitmap, those that it lets through. n counts all terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else bitmap.value
        for b in batches:
            texts = common.strings(b.column("text"))
            for lo, hi in common.slices(texts):
                w = words_of(texts[lo:hi])
                n, h, first = np.diff(w.rows), w.hashes, w.rows
                if bits is not None:
                    has = ((bits[(h & np.uint64(len(bits) * 64 - 1)) >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1)).astype(bool)
                    h, first = h[has], np.concatenate([[0], np.cumsum(has)])[first]
                h, tf, first = common.distinct_by_row(h, first)
                off = pa.array(first.astype(np.int32))
                lists = [pa.ListArray.from_arrays(off, pa.array(x)) for x in (h.view(np.int64), tf.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([b.column("row")[lo:hi], b.column(key)[lo:hi], pa.array(n.astype(np.int64)), *lists], ["row", key, "n", "terms", "tfs"])

    keyed = docs.select(F.monotonically_increasing_id().alias("row"), key, "text")
    return keyed.mapInArrow(common.lean(run), f"row long, {key} {docs.schema[key].dataType.simpleString()}, n long, terms array<long>, tfs array<long>")


def _bitmap(terms: DataFrame) -> np.ndarray:
    """A set of bits for the terms, by their lowest bits."""
    bits = min(1 << 26, max(1 << 16, 1 << int(terms.agg(F.approx_count_distinct("term")).first()[0] * 32).bit_length()))
    slot = F.col("term").bitwiseAND(F.lit(bits - 1))
    words = terms.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


# ---------------------------------------------------------------- slices


def sliced(values: np.ndarray, ords: np.ndarray, bits: int, words: int) -> np.ndarray:
    """Bitmaps of the values' bits: slice b is row b, the document `ord` is bit ord."""
    if len(ords) * 16 < words * 64:  # a rare term: set bit by bit
        which, b = np.nonzero(np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits])
        out = np.zeros((bits, words), np.uint64)
        np.bitwise_or.at(out, (b, ords[which] >> 6), np.uint64(1) << (ords[which] & 63).astype(np.uint64))
        return out
    dense = np.zeros(words * 64, "<u8")
    dense[ords] = values
    each = np.unpackbits(dense.view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)], axis=1, bitorder="little")[:, :bits]
    return np.packbits(np.ascontiguousarray(each.T), axis=1, bitorder="little").view("<u8")


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[by:] = x[: len(x) - by]
    return out


def added(numbers: list[np.ndarray]) -> np.ndarray:
    """The sum of numbers in slices; all have the same count of slices, and the sum fits in it."""
    numbers = list(numbers)
    while len(numbers) > 2:
        three, numbers = numbers[:3], numbers[3:]
        a, b, c = three
        half = a ^ b
        numbers += [half ^ c, _shifted((a & b) | (half & c), 1)]
    if len(numbers) == 1:
        return numbers[0]
    a, b = numbers
    out, carry = np.empty_like(a), np.zeros(a.shape[1], np.uint64)
    half, both = a ^ b, a & b
    for k in range(len(a)):
        out[k] = half[k] ^ carry
        carry = both[k] | (half[k] & carry)
    return out


def _members(bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def top(slices: np.ndarray, k: int) -> np.ndarray:
    """Ordinals of the k greatest numbers above 0; of equal ones at the end, those with the smallest ordinals. In order of ordinals."""
    left = np.bitwise_or.reduce(slices, axis=0)
    taken = np.zeros_like(left)
    need = k
    for bits in slices[::-1]:
        with_bit = left & bits
        n = int(np.bitwise_count(with_bit).sum())
        if n >= need:
            left = with_bit
        else:
            taken |= with_bit
            need -= n
            left = left & ~bits
    return np.sort(np.concatenate([_members(taken), _members(left)[:need]]))


def values_at(slices: np.ndarray, ords: np.ndarray) -> np.ndarray:
    bit = (slices[:, ords >> 6] >> (ords & 63).astype(np.uint64)) & np.uint64(1)
    return (bit << np.arange(len(slices), dtype=np.uint64)[:, None]).sum(axis=0).astype(np.int64)


class BlockIndex:
    """A block's postings by term, and slices of impacts made of them when a term is asked for first."""

    def __init__(self, terms: np.ndarray, ords: np.ndarray, parts: np.ndarray, docs: int):
        order = np.lexsort((ords, terms))
        self.ords, self.parts, terms = ords[order], parts[order], terms[order]
        self.terms, self.first = np.unique(terms, return_index=True)
        self.first = np.append(self.first, len(terms))
        self.words = -(-docs // 64)
        most = max(1, CACHE_BYTES // (self.words * 8 * 40))
        self.slices = functools.lru_cache(maxsize=most)(self._slices)

    def _slices(self, at: int, weight: int) -> np.ndarray:
        lo, hi = self.first[at], self.first[at + 1]
        impacts = self.parts[lo:hi] * weight
        return sliced(impacts, self.ords[lo:hi], int(impacts.max()).bit_length(), self.words)

    def search(self, terms: np.ndarray, weights: np.ndarray, repeats: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ordinals of the k best documents and their scores; terms are distinct."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        here = np.flatnonzero((self.terms[at] == terms) & (weights > 0)) if len(self.terms) else []
        if not len(here):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        made = [(self.slices(int(at[x]), int(weights[x])), int(repeats[x])) for x in here]
        most = sum(((1 << len(s)) - 1) * c for s, c in made)
        numbers = []
        for s, c in made:
            for b in range(c.bit_length()):  # repeats are added as shifted copies
                if c >> b & 1:
                    number = np.zeros((most.bit_length(), self.words), np.uint64)
                    number[b : b + len(s)] = s
                    numbers.append(number)
        total = added(numbers)
        best = top(total, k)
        return best, values_at(total, best)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents."""
    asked = common.written(terms_of(items, "item_id"), "asked")
    item_terms = asked.select("row", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("row", F.col("t.terms").alias("term"), F.col("t.tfs").alias("c"))
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(item_terms))
    found = common.written(terms_of(docs, "doc_id", bitmap), "postings")
    n_docs, n_terms = found.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = item_terms.join(df, "term").withColumn("w", weight)
    queries = weighted.groupBy("row").agg(F.collect_list(F.struct("term", "w", "c")).alias("ts")).select(F.col("row").alias("item"), "ts")

    n_blocks, n_batches = max(1, -(-n_docs // block)), max(1, -(-asked.count() // batch))
    blocks = F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    docs_by = found.where(F.size("terms") > 0).select(blocks.alias("block"), every(n_batches).alias("batch"), "row", "doc_id", "n", "terms", "tfs")
    items_by = queries.select(every(n_blocks).alias("block"), F.pmod(F.xxhash64("item"), F.lit(n_batches)).cast("int").alias("batch"), "item", "ts")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"item": pa.array([], pa.int64()), "row": pa.array([], pa.int64()), "doc_id": left.column("doc_id")[:0], "score": pa.array([], pa.int64())})
        left = left.sort_by([("doc_id", "ascending"), ("row", "ascending")]).combine_chunks()  # nulls come last
        terms, tfs = (left.column(c).combine_chunks() for c in ("terms", "tfs"))
        size = np.diff(terms.offsets.to_numpy())
        n, tf = left.column("n").to_numpy(), tfs.flatten().to_numpy()
        m = np.array([25 + 75 * int(x) * n_docs // n_terms for x in n], np.int64)
        index = BlockIndex(terms.flatten().to_numpy(), np.repeat(np.arange(left.num_rows), size), 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, size)), left.num_rows)
        item, ords, scores = [], [], []
        for q, ts in zip(right.column("item").to_pylist(), right.column("ts").combine_chunks(), strict=True):
            v = ts.values
            best, score = index.search(*(v.field(c).to_numpy() for c in ("term", "w", "c")), k)
            item.append(np.full(len(best), q))
            ords.append(best)
            scores.append(score)
        ords = np.concatenate(ords)
        return pa.table({"item": np.concatenate(item).astype(np.int64), "row": left.column("row").take(pa.array(ords)), "doc_id": left.column("doc_id").take(pa.array(ords)), "score": np.concatenate(scores)})

    kind = found.schema["doc_id"].dataType.simpleString()
    hits = docs_by.groupBy("block", "batch").cogroup(items_by.groupBy("block", "batch")).applyInArrow(run, f"item long, row long, doc_id {kind}, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    # winners of the blocks: first those of each item within a part of the blocks, then all
    salted = hits.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(64)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.join(asked.select(F.col("row").alias("item"), "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM benchmark),
total AS (SELECT count(*) AS big_n, CAST(sum(len(t)) AS BIGINT) AS big_l FROM d WHERE len(t) > 0),
asked AS (SELECT q, item_id, term, count(*) AS c FROM (SELECT q, item_id, unnest(t) AS term FROM b) GROUP BY ALL),
post AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, total),
score AS (SELECT q, item_id, r, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l)))) AS score
  FROM asked JOIN w USING (term) JOIN post USING (term), total GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r) AS rank FROM score WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10
"""
