"""Language identification as inference of a mixture of languages (operator 4).

Training counts byte n-grams (1 to 4 bytes, within words and their edges, hashed into `buckets`) for every
language of the training rows. A word's likelihood under a language is the product of its n-grams', raised to 1 / 4, as each
byte is told four times, by n-grams that overlap. For each document, expectation-maximisation estimates the proportions in which the languages of a set produced
its words; sets grow by one language at a time while the log-likelihood gains more than `penalty` * ln(words)
(a Bayesian information criterion), so most documents end with one language.

Defined results: a text that is null, empty or without a letter gets `und`, score 0 and no proportions; so
does every text if nothing could be learned. Ties go to the language that sorts first. Repeated rows each
get their own prediction. Other columns are passed on by `predict`; columns that it adds replace ones
of the same name. Very long texts are scored whole, at a cost in proportion to their length. At most `most` labels are learned,
the most frequent ones: a bound for labels that are dirty, half a megabyte of counters each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UND = "und"
BUCKETS = 1 << 16
_HAS_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])


def _grams(words: common.Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram that ends at each byte of a word or just after it, and where each word's n-grams start."""
    raw = np.append(words.raw, np.uint8(0))
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[words.starts] += 1
    inside[words.ends] -= 1
    # a word's bytes and one mark after it; the mark of one word may be the place of another's first byte
    length = words.ends - words.starts + 1
    first = np.concatenate([[0], np.cumsum(length)])
    place = np.repeat(words.starts - first[:-1], length) + np.arange(first[-1])
    code = raw[place].astype(np.uint64) + np.uint64(1)
    code[first[1:] - 1] = 0
    at = np.arange(first[-1]) - np.repeat(first[:-1], length)
    out = np.empty((first[-1], 4), np.int32)
    gram = np.zeros_like(code)
    shifted = code
    for k in range(4):
        if k:
            shifted = np.concatenate([np.zeros(1, np.uint64), shifted[:-1]])
            shifted[at < k] = 300
        gram = gram * np.uint64(521) + shifted + np.uint64(1)
        h = (gram + np.uint64(k << 60)) * np.uint64(0x9E3779B97F4A7C15)
        out[:, k] = (h >> np.uint64(40)).astype(np.int64) % buckets
    return out, first


def train(rows: DataFrame, buckets: int = BUCKETS, most: int = 512) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log-probabilities by bucket. rows: text, lang (null: not learned from).

    What comes to the driver is a number for each language and bucket.
    """
    often = rows.where(F.col("lang").isNotNull()).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most)
    langs = sorted(r.lang for r in often.collect())
    if not langs:
        return [], np.zeros((0, buckets), np.float32)
    size = len(langs) * buckets

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            texts = common.strings(b.column("text"))
            code = np.searchsorted(langs, b.column("lang").to_numpy(zero_copy_only=False).astype(str))
            for lo, hi in common.slices(texts):
                words = common.Words(texts[lo:hi])
                grams, first = _grams(words, buckets)
                row = np.repeat(np.arange(hi - lo), np.diff(first[words.rows]))
                total += np.bincount((grams + (code[lo:hi][row] * buckets)[:, None]).ravel(), minlength=size)
        yield from common.vector_rows(total, common.task_salt())

    counted = rows.where(F.col("lang").isin(langs) & F.col("text").isNotNull()).select("text", "lang").mapInArrow(common.lean(count), common.VECTOR)
    counts = common.sum_vectors(counted, size).reshape(len(langs), buckets).astype(np.float64)
    smooth = counts + 0.5
    return langs, np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)


def _mixture(like: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood for documents whose words' likelihoods (scaled) stand in `like`, by EM.

    like: a row for each word, a column for each language of its document's set. start: first word of each document.
    """
    n = np.diff(np.append(start, len(like)))
    row = np.repeat(np.arange(len(start)), n)
    share = np.full((len(start), like.shape[1]), 1.0 / like.shape[1])
    for _ in range(rounds):
        part = like * share[row]
        part /= part.sum(axis=1, keepdims=True)
        share = np.add.reduceat(part, start, axis=0) / n[:, None]
    return share, np.add.reduceat(np.log((like * share[row]).sum(axis=1)), start)


def infer(scores: np.ndarray, rows: np.ndarray, penalty: float, rounds: int = 12) -> np.ndarray:
    """Proportions of languages for each document; zero for one without words. A set grows as long as a language is worth its penalty.

    scores: log-likelihood of each word by language. rows: first word of each document, and the end.
    """
    n, langs = np.diff(rows), scores.shape[1]
    share = np.zeros((len(n), langs))
    some = np.flatnonzero(n)
    if not len(some):
        return share
    start, count = rows[:-1][some], n[some]
    peak = scores.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(scores - peak, -30.0)).astype(np.float64)
    total = np.add.reduceat(np.log(like), start, axis=0)
    chosen = total.argmax(axis=1)[:, None]
    best = total[np.arange(len(some)), chosen[:, 0]]
    share[some, chosen[:, 0]] = 1.0
    open_ = np.arange(len(some))
    while len(open_) and chosen.shape[1] < langs:
        # the language that gains most: what it adds to words that the set explains badly
        word = np.concatenate([np.arange(start[k], start[k] + count[k]) for k in open_])
        first = np.concatenate([[0], np.cumsum(count[open_])[:-1]])
        row = np.repeat(np.arange(len(open_)), count[open_])
        now = (like[word] * share[some[open_]][row]).sum(axis=1)
        gain = np.add.reduceat(np.log(0.9 * now[:, None] + 0.1 * like[word]), first, axis=0) - np.add.reduceat(np.log(now), first)[:, None]
        np.put_along_axis(gain, chosen, -np.inf, axis=1)
        add = gain.argmax(axis=1)
        try_ = gain[np.arange(len(open_)), add] > 0
        if not try_.any():
            break
        keep_word = try_[row]
        chosen = np.concatenate([chosen[try_], add[try_][:, None]], axis=1)
        open_, word = open_[try_], word[keep_word]
        first = np.concatenate([[0], np.cumsum(count[open_])[:-1]])
        row = np.repeat(np.arange(len(open_)), count[open_])
        part, value = _mixture(np.take_along_axis(like[word], chosen[row], axis=1), first, rounds)
        better = value - best[open_] > penalty * np.log(count[open_] + 1.0)
        done = open_[better]
        best[done] = value[better]
        share[some[done]] = 0.0
        np.put_along_axis(wide := np.zeros((len(done), langs)), chosen[better], part[better], axis=1)
        share[some[done]] = wide
        open_, chosen = done, chosen[better]
    return share


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray, penalty: float = 1.5) -> DataFrame:
    """Adds lang_pred, score (the proportion of lang_pred) and langs (map of language to proportion)."""
    model = docs.sparkSession.sparkContext.broadcast(logp)  # languages x buckets x 4 bytes
    buckets = logp.shape[1]
    docs = common.extra_columns(docs, "lang_pred", "score", "langs")
    kept = docs.schema.names

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.ascontiguousarray(model.value.T)
        for b in batches:
            texts = common.strings(b.column("text"))
            for lo, hi in common.slices(texts):
                part = texts[lo:hi]
                words = common.Words(part)
                grams, first = _grams(words, buckets)
                n, names, share = hi - lo, [UND] * (hi - lo), np.zeros((hi - lo, max(1, len(langs))))
                if len(langs) and len(words.starts):
                    each = table[grams[:, 0]]
                    for k in range(1, 4):
                        each += table[grams[:, k]]
                    share = infer(np.add.reduceat(each, first[:-1], axis=0) / 4, words.rows, penalty)
                letter = _ASCII_LETTER[words.raw]
                has = np.add.reduceat(np.append(letter, 0), words.off[:-1]) > 0 if len(letter) else np.zeros(n, bool)
                has &= np.diff(words.off) > 0
                for k in np.flatnonzero(~has & (np.diff(words.off) > 0)):
                    has[k] = bool(_HAS_LETTER.search(part[int(k)].as_py()))
                best, top = share.argmax(axis=1), share.max(axis=1)
                ok = has & (top > 0)
                for k in np.flatnonzero(ok):
                    names[k] = langs[best[k]]
                at, lang = np.nonzero(share * ok[:, None])
                places = np.searchsorted(at, np.arange(n + 1)).astype(np.int32)
                maps = pa.MapArray.from_arrays(pa.array(places), pa.array([langs[x] for x in lang], pa.string()), pa.array(share[at, lang], pa.float64()))
                yield pa.RecordBatch.from_arrays([*(b.column(c)[lo:hi] for c in kept), pa.array(names), pa.array(np.minimum(1.0, np.where(ok, top, 0.0))), maps], [*kept, "lang_pred", "score", "langs"])

    return docs.mapInArrow(common.lean(score), common.wider(docs.schema, "lang_pred string, score double, langs map<string,double>"))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    langs, logp = train(docs.where(~held_out()).select("text", "lang"))
    found = predict(docs.select("doc_id", "text", held_out().alias("held_out")), langs, logp)
    return found.select("doc_id", "held_out", "lang_pred", "score", "langs")
