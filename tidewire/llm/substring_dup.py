"""Substring deduplication by content-defined chunking (operator 3).

A gear rolling hash (window of 16 bytes) is taken at each word's end; a chunk ends where the hash is
the greatest among those of `radius` words on either side, so chunks have radius + 1 words or more, follow the
content alone, and fall back into step a few words after an insertion. A chunk's digest is 64 bits of its
words. A digest that stands in several documents belongs to the smallest doc_id; elsewhere, and again
within its document, it is a repeat. Runs of neighbouring repeats with `min_words` words or more are cut out of
the text; shorter ones stay, for they are phrases that meet by chance. A passage of 50 words holds at least
`min_words` = 18 words of whole chunks at radius 3.

Defined results: null and empty texts stay as they are; a document that is a copy of another loses its whole
text (it becomes empty); rows with a null doc_id stay as they are, and are no one's origin; rows that share a
doc_id count as one document, so what they have in common stays in each; an empty table gives no rows.
Columns of the input are passed on; text is replaced, and removed_words and removed_spans (start and end in
characters of the old text) replace ones of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, LONGEST = 16, 64
_GEAR = np.random.default_rng(31337).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_GEAR[[9, 10, 11, 12, 13]] = _GEAR[32]  # how lines are broken doesn't matter


def gear(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: sum of gear[byte] << distance, over the last 16 bytes of its own row. off: first byte of each row, and the end."""
    h = _GEAR[raw]
    width = 1
    while width < WINDOW:
        near = off[:-1, None] + np.arange(width)
        near = near[near < off[1:, None]]  # what stands `width` bytes before these is another row's
        own = h[near]
        h[width:] += h[:-width].copy() << np.uint32(width)
        h[near] = own
        width *= 2
    return h & np.uint32(0xFFFF)


def chunk_ends(values: np.ndarray, rows: np.ndarray, radius: int) -> np.ndarray:
    """True for each word that ends a chunk. values: the hash at each word's end; rows: first word of each document.

    Words less than `radius` from a document's edge end no chunk but at the edge itself; ties go to the later word.
    """
    n = len(values)
    ends = np.zeros(n, bool)
    if n:
        wide = values.astype(np.int64)
        at, row = np.arange(n), np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        ends = (at - rows[row] >= radius) & (rows[row + 1] - 1 - at >= radius)
        for k in range(1, radius + 1):
            ends[k:] &= wide[k:] >= wide[:-k]
            ends[:-k] &= wide[:-k] > wide[k:]
        ends[rows[1:][np.diff(rows) > 0] - 1] = True
    return ends


class Chunks:
    """The chunks of a block of documents: first and last word (exclusive), digest, row, and again: the digest stands earlier in its row.

    All but the numbering of words and rows follows a row's own text alone.
    """

    def __init__(self, texts: pa.Array, radius: int):
        self.words = w = common.Words(texts, table=common.NOT_SPACE, lower=False)
        n = len(w.starts)
        last = np.flatnonzero(chunk_ends(gear(w.raw, w.off)[w.ends - 1] if n else np.zeros(0, np.uint32), w.rows, radius)) + 1
        first = np.concatenate([[0], last[:-1]]) if n else last
        long_ = last - first > LONGEST
        if long_.any():
            more = [np.arange(a + LONGEST, b, LONGEST) for a, b in zip(first[long_], last[long_], strict=True)]
            last = np.sort(np.concatenate([last, *more]))
            first = np.concatenate([[0], last[:-1]])
        self.first, self.last = first, last
        self.digest = common.mix(common.sums_over(w.hashes, first, last, 0x9FB21C651E98DF25, pow(0x9FB21C651E98DF25, -1, 1 << 64)) + (last - first).astype(np.uint64)).view(np.int64)
        self.row = np.searchsorted(w.rows, first, side="right") - 1
        order = np.lexsort((np.arange(len(self.row)), self.digest, self.row))
        self.again = np.zeros(len(self.row), bool)
        self.again[order[1:]] = (self.digest[order[1:]] == self.digest[order[:-1]]) & (self.row[order[1:]] == self.row[order[:-1]])


def chunks(docs: DataFrame, radius: int) -> DataFrame:
    """(digest, doc_id, again: it stands earlier in the row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = common.strings(b.column("text")), b.column("doc_id").to_numpy()
            for lo, hi in common.slices(texts):
                c = Chunks(texts[lo:hi], radius)
                if len(c.row):
                    yield pa.RecordBatch.from_arrays([pa.array(c.digest), pa.array(ids[lo:hi][c.row]), pa.array(c.again)], ["digest", "doc_id", "again"])

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(common.lean(run), "digest long, doc_id long, again boolean")


def cut(docs: DataFrame, repeats: DataFrame, radius: int, min_words: int) -> DataFrame:
    """Documents without the runs of repeated chunks: those in repeats (doc_id, _digests: array of long), and those that stand earlier in their row.

    Documents that aren't in repeats stay as they are.
    """
    docs = common.extra_columns(docs, "removed_words", "removed_spans", "_digests")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, digests = b.column("text"), b.column("_digests").to_pylist()
            new, words_out, spans_out = [], [], []
            hit = [k for k, p in enumerate(digests) if p is not None]
            done: dict[int, tuple[str, int, list]] = {}
            some = common.strings(texts.take(pa.array(hit, pa.int64()))) if hit else None
            for lo, hi in common.slices(some) if hit else ():
                c = Chunks(some[lo:hi], radius)
                bounds = np.searchsorted(c.row, np.arange(hi - lo + 1))
                for d in range(hi - lo):
                    its = slice(bounds[d], bounds[d + 1])
                    first, last = c.first[its], c.last[its]
                    own = np.flatnonzero(c.again[its] | np.isin(c.digest[its], np.array(digests[hit[lo + d]], np.int64)))
                    runs = np.split(own, np.flatnonzero(np.diff(own) > 1) + 1)
                    runs = [(first[r[0]], last[r[-1]]) for r in runs if len(r) and last[r[-1]] - first[r[0]] >= min_words]
                    if runs:
                        off = c.words.off[d]
                        raw = c.words.raw[off : c.words.off[d + 1]].tobytes()
                        parts, spans, at = [], [], 0
                        whole_end = c.words.rows[d + 1]
                        for a, z in runs:
                            start = c.words.starts[a] - off
                            end = c.words.starts[z] - off if z < whole_end else len(raw)
                            parts.append(raw[at:start])
                            spans.append((int(start), int(end)))
                            at = end
                        parts.append(raw[at:])
                        places_in_text = [{"start": len(raw[:s].decode()), "end": len(raw[:e].decode())} for s, e in spans]
                        text = b"".join(parts).decode()
                        done[hit[lo + d]] = (text.rstrip() if spans[-1][1] == len(raw) else text, int(sum(z - a for a, z in runs)), places_in_text)
            for k in range(b.num_rows):
                text, n, spans = done.get(k, (texts[k].as_py(), 0, []))
                new.append(text)
                words_out.append(n)
                spans_out.append(spans)
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            columns = [pa.array(new, pa.string()) if c == "text" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(words_out, pa.int32()), pa.array(spans_out, span)], [*names, "removed_words", "removed_spans"])

    own = repeats.withColumnRenamed("doc_id", "_of")
    joined = docs.join(own, docs.doc_id.cast("long") == own["_of"], "left").drop("_of")
    return joined.mapInArrow(common.lean(run), common.wider(docs.schema, "removed_words int, removed_spans array<struct<start:int,end:int>>"))


def dedup_substrings(docs: DataFrame, *, radius: int = 3, min_words: int = 18) -> DataFrame:
    """Documents with repeats cut out."""
    found = common.written(chunks(docs.select("doc_id", "text"), radius), "chunks")
    several = found.where("not again").groupBy("digest").agg(F.min("doc_id").alias("origin"), F.max("doc_id").alias("most")).where("origin < most").select("digest", "origin")
    elsewhere = found.where("not again").join(several, "digest").where("doc_id > origin").select("doc_id", "digest")
    # cut() finds what stands earlier in a row by itself, so of these only the doc_id is told: collect_list leaves nulls out
    within = found.where("again").select("doc_id", F.lit(None).cast("long").alias("digest"))
    repeats = elsewhere.unionByName(within).groupBy("doc_id").agg(F.collect_list("digest").alias("_digests"))
    return cut(docs, repeats, radius, min_words)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return dedup_substrings(docs)
