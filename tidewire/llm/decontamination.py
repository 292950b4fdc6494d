"""Benchmark decontamination by winnowing (operator 11).

Words are runs of ASCII letters, digits and any other characters beyond ASCII; only A-Z are lower-cased. An item's windows are its runs of
`span` words, or all its words if it has fewer. A window of n words has the fingerprint that winnowing keeps of it: the least hash of
its k-grams, k = (n + 1) div 2. The same words give the same fingerprint wherever they stand, so every shared window shares its fingerprint.

Documents' windows are looked up in a bitmap of the benchmark's fingerprints (2^26 bits at most, whatever the benchmark's size: beyond some
millions of fingerprints it lets more through, and nothing is lost). What is left is joined with the benchmark's windows by fingerprint, and
hits are extended to the whole window by 128 bits of hash over its words. Windows that stand in the same set of items share that
set's number, so a passage of many items meets each document once; lists of items are made once for each distinct set of sets.

Defined results: null text (of a document or an item) has no words; an item without words has no window; items that share an item_id are one item,
and a null item_id counts as one whose id is empty; rows that share a doc_id are documents of their own, with null doc_id as well; an empty
table of either kind gives no hits or no rows; texts of any length are read whole. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPAN = 10
#: The bitmap of fingerprints: so many bits a fingerprint, and at most so many in all.
BITS_EACH, BITS_MOST = 32, 1 << 26
_GRAM, _WIDE, _OTHER = 0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25, 0xD1342543DE82EF95


def words_of(texts: pa.Array) -> common.Words:
    return common.Words(pc.ascii_lower(texts), lower=False)


def _runs(h: np.ndarray, n: int, base: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of runs of n values, at all places or the given ones."""
    start = np.arange(len(h) - n + 1) if at is None else at
    return common.mix(common.sums_over(h, start, start + n, base, pow(base, -1, 1 << 64)) + np.uint64(n))


def winnow(h: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint of each window of n words: the least hash of its k-grams."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    k = (n + 1) // 2
    grams = _runs(h, k, _GRAM)
    least = grams[: len(h) - n + 1].copy()
    for j in range(1, n - k + 1):
        np.minimum(least, grams[j : j + len(least)], out=least)
    return common.mix(least + np.uint64(n))


def _digests(h: np.ndarray, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _runs(h, n, _WIDE, at).view(np.int64), _runs(common.mix(h + np.uint64(_OTHER)), n, _OTHER, at).view(np.int64)


def windows_of(items: DataFrame, span: int = SPAN) -> DataFrame:
    """(item, n, fp, d1, d2): a row for each window of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = common.strings(b.column("text")), b.column("item")
            for lo, hi in common.slices(texts):
                w = words_of(texts[lo:hi])
                size = np.diff(w.rows)
                for n in np.unique(np.minimum(size[size > 0], span)).tolist():
                    mine = size >= span if n == span else size == n
                    row = np.repeat(np.arange(len(size)), np.where(mine, size - n + 1, 0))
                    first = np.concatenate([[0], np.cumsum(np.where(mine, size - n + 1, 0))])
                    at = w.rows[:-1][row] + np.arange(len(row)) - first[:-1][row]
                    d1, d2 = _digests(w.hashes, n, at)
                    fp = winnow(w.hashes, n)[at].view(np.int64)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(lo + row)), pa.array(np.full(len(row), n, np.int32)), *map(pa.array, (fp, d1, d2))], ["item", "n", "fp", "d1", "d2"])

    keyed = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return keyed.mapInArrow(common.lean(run), "item string, n int, fp long, d1 long, d2 long")


def bitmap_of(windows: DataFrame) -> np.ndarray:
    """A set of bits for the fingerprints, by their lowest bits. At most BITS_MOST bits come to the driver."""
    n = windows.agg(F.approx_count_distinct("fp")).first()[0]
    bits = min(BITS_MOST, max(1 << 16, 1 << int(n * BITS_EACH).bit_length()))
    slot = F.col("fp").bitwiseAND(F.lit(bits - 1))
    words = windows.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def _scan(docs: DataFrame, sizes: list[int], bitmap) -> DataFrame:  # noqa: ANN001
    """Of each document: its words, and its windows whose fingerprints are in the bitmap; equal ones once, with all their places."""

    def found(w: common.Words, bits: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """row, n, fp, d1, d2 of each distinct window in order of rows; where its places start, and the places."""
        cols: list[list[np.ndarray]] = [[] for _ in range(6)]
        for n in sizes:
            fp = winnow(w.hashes, n)
            at = np.flatnonzero((bits[(fp & np.uint64(len(bits) * 64 - 1)) >> np.uint64(6)] >> (fp & np.uint64(63))) & np.uint64(1))
            row = np.searchsorted(w.rows, at, side="right") - 1  # rows without words share a place with the next
            whole = at + n <= w.rows[row + 1]
            at, row = at[whole], row[whole]
            cols_n = (row, np.full(len(at), n), fp[at].view(np.int64), *_digests(w.hashes, n, at), at - w.rows[row])
            for c, x in zip(cols, cols_n, strict=True):
                c.append(x)
        row, n, fp, d1, d2, place = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)
        order = np.lexsort((place, d2, d1, n, row))
        row, n, fp, d1, d2, place = (x[order] for x in (row, n, fp, d1, d2, place))
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (n[1:] != n[:-1]) | (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
        one = np.flatnonzero(new)
        return [x[one] for x in (row, n, fp, d1, d2)], np.append(one, len(row)), place

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for b in batches:
            texts = common.strings(b.column("text"))
            for lo, hi in common.slices(texts):
                w = words_of(texts[lo:hi])
                (row, n, fp, d1, d2), starts, place = found(w, bits)
                places = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(place.astype(np.int32)))
                hits = pa.StructArray.from_arrays([pa.array(n.astype(np.int32)), pa.array(fp), pa.array(d1), pa.array(d2), places], ["n", "fp", "d1", "d2", "places"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)), hits)
                yield pa.RecordBatch.from_arrays([b.column("row")[lo:hi], b.column("doc_id")[lo:hi], pa.array(np.diff(w.rows).astype(np.int64)), lists], ["row", "doc_id", "n_words", "hits"])

    keyed = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    return keyed.mapInArrow(common.lean(run), f"row long, doc_id {kind}, n_words long, hits array<struct<n:int, fp:long, d1:long, d2:long, places:array<int>>>")


def _merged(intervals: Column) -> Column:
    """Intervals (start, end) in order of start, joined where they touch or overlap."""
    one = "struct<start:int, end:int>"
    empty = F.struct(F.array().cast(f"array<{one}>").alias("done"), F.lit(None).cast(one).alias("open"))

    def step(acc: Column, x: Column) -> Column:
        wider = F.struct(acc["open"]["start"].alias("start"), F.greatest(acc["open"]["end"], x["end"]).alias("end"))
        joins = x["start"] <= acc["open"]["end"]
        return F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), x.alias("open"))).when(joins, F.struct(acc["done"].alias("done"), wider.alias("open"))).otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), x.alias("open")))

    return F.aggregate(intervals, empty, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def decontaminate(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, item_ids) for each document: its words, how many are hit, the hit words as spans (first word, word after the last), and the items, in order, whose windows occur."""
    key = ["n", "fp", "d1", "d2"]
    windows = common.written(windows_of(items, span).distinct(), "windows")
    sizes = sorted(r.n for r in windows.select("n").distinct().collect())  # span different ones at most
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(windows))
    scanned = common.written(_scan(docs, sizes, bitmap), "scanned")

    mark = windows.groupBy(*key).agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("item")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("y"))
    sets = common.written(mark.select(*key, F.xxhash64("m", "x", "y").alias("set_id")), "sets")
    first = sets.groupBy("set_id").agg(F.min(F.struct(*key)).alias("k")).select("set_id", "k.*")
    members = windows.join(first, key).select("set_id", "item")

    hits = scanned.where(F.size("hits") > 0).select("row", F.inline("hits")).join(sets, key)
    intervals = F.transform("places", lambda p: F.struct(p.alias("start"), (p + F.col("n")).alias("end")))
    by_row = hits.select("row", "set_id", intervals.alias("i")).groupBy("row").agg(F.sort_array(F.collect_set("set_id")).alias("set_ids"), F.sort_array(F.flatten(F.collect_list("i"))).alias("i"))
    by_row = common.written(by_row.select("row", "set_ids", _merged(F.col("i")).alias("spans")), "hit-rows")
    lists = by_row.select("set_ids").distinct().select("set_ids", F.explode("set_ids").alias("set_id")).join(members, "set_id").groupBy("set_ids").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    found = by_row.join(lists, "set_ids").select("row", "spans", "item_ids")

    # documents without candidates, all but a few, take no part in a shuffle
    base = ["row", "doc_id", "n_words"]
    clean = scanned.where(F.size("hits") == 0).select(*base, F.lit(None).cast(found.schema["spans"].dataType).alias("spans"), F.lit(None).cast("array<string>").alias("item_ids"))
    rest = scanned.where(F.size("hits") > 0).select(*base).join(found, "row", "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return clean.unionByName(rest).select("doc_id", "n_words", F.coalesce(n_hit, F.lit(0)).alias("n_hit"), F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def op11_decontamination(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.sha2(F.concat_ws(",", "item_ids"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS t FROM bw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
dt AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS t FROM dw),
hit AS (SELECT r, dt.n, i, item FROM dt JOIN win ON dt.t = win.t AND dt.n = win.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, n, i FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
