"""Alignment of two tokenizers' tokens (operator 13).

Tasks make tokens with numpy, a block of texts at a time: ids of each text by a byte-level BPE of the tokenizers library (A) and by a sentencepiece model (B). A text is cut into units, which are what both
tokenizers keep apart (a word with the blank before it); a text that can't be cut is a unit. A unit is tokenised and measured once, and remembered (up to a bound) for the worker's later blocks: its numbers of tokens,
its groups as text, `a1,a2|b1`, and its links. The ends that both lists of tokens share cut them into groups; each stretch between two ends of either list lies in one token of A and one of B, which is a link.

All of a document that needs no other is known then. How often an id pair is linked is known to the corpus alone: a block gives its distinct pairs with their numbers, and each document's links as places among
them. Spark sums the pairs, finds the highest of each B id, and brings both numbers back to the blocks' pairs; a document's are sums over its links. So what is shuffled is a row for each distinct pair of a block,
and none for each token, unit or group.

Defined results: null and empty texts, and those whose tokens' bytes differ from space + text (a text that holds U+2581, say), have no tokens: all numbers are 0 and
the digest is ''; rows that share a doc_id, or have none, are documents of their own; an empty table gives no rows; texts of any length are
encoded whole. Other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .pieces import PieceTable
from .sentencepiece_io import BYTE, SPACE, codec_of, parse_model, units
from .token_files import default_tokenizer

#: A block has so many bytes of text, or one longer text.
BLOCK_BYTES = 1 << 19
#: Pieces of text that each encoder remembers.
CACHED = 200_000
#: Units that a worker remembers; beyond, those go that weren't met again since the last ones went.
MOST_UNITS = 300_000
#: The greatest table of distinct pairs that is broadcast, in rows of three numbers; a greater one is joined by shuffle.
MOST_BROADCAST = 1 << 20


# ---------------------------------------------------------------- tokens and their bytes


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """The bytes of each id, on end."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def byte_level_tokens(path: str) -> list[bytes]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    letters, own = byte_alphabet(), {i: a.content for i, a in t.get_added_tokens_decoder().items()}
    names = {i: s for s, i in t.get_vocab().items()}
    return [own[i].encode() if i in own else bytes(letters[c] for c in names.get(i, "")) for i in range(t.get_vocab_size())]


def piece_tokens(path: str) -> list[bytes]:
    return [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(SPACE, " ").encode() for p, _, kind in parse_model(path).pieces]


#: Of a byte of a text of ASCII and Latin letters: 0 white space, 1 letter, 2 digit, 3 anything else.
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 13, 32]], _KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 0, 1, 1, 2, 1
SAFE = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")


def byte_level_pieces(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a byte-level BPE's pattern cuts texts of ASCII and Latin letters: starts and ends, and the first of each text. off: each text's first byte, and the end.

    Letters, digits and other marks stand in runs, each with the one blank before it; other white space before a run is a piece without its last character, which is one of its own unless it
    is that blank; the contractions of English are pieces where no blank and no other mark stands before.
    """
    n = len(raw)
    kind = _KIND[raw]
    first = np.zeros(n + 1, bool)
    first[off] = True
    begin = first.copy()
    begin[1:n] |= kind[1:] != kind[:-1]
    after = np.flatnonzero((kind[1:] != 0) & (kind[:-1] == 0) & ~first[1:n]) + 1 if n else np.zeros(0, np.int64)
    begin[after - 1] = True
    begin[after[raw[after - 1] == 32]] = False
    mark = np.flatnonzero(raw == 39)
    if len(mark):
        before = np.where(first[mark], 0, kind[mark - 1])
        blank = ~first[mark] & (raw[mark - 1] == 32)
        mark = mark[(before != 3) & ~blank]
        padded, inner = np.concatenate([raw, np.zeros(3, np.uint8)]), ~np.concatenate([first, np.ones(2, bool)])
        x, y = padded[mark + 1], padded[mark + 2]
        two = np.isin(x, [115, 116, 109, 100]) & inner[mark + 1]
        three = ((((x == 114) | (x == 118)) & (y == 101)) | ((x == 108) & (y == 108))) & inner[mark + 1] & inner[mark + 2] & ~two
        for hit, size in ((two, 2), (three, 3)):
            begin[mark[hit] + 1] = False
            begin[mark[hit] + size] = True
    edges = np.flatnonzero(begin)
    return edges[:-1], edges[1:], np.searchsorted(edges[:-1], off)


class ByteLevelEncoder:
    """The tokenizers library's ids of a byte-level BPE without special tokens, behind a bounded cache of pieces.

    Texts beyond ASCII and Latin letters, and all texts of a tokenizer that is built otherwise, go to the library whole.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        pre = spec.get("pre_tokenizer") or {}
        self.plain = spec.get("normalizer") is None and (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex")) == ("ByteLevel", False, True)
        self.table = PieceTable(self._encode_pieces, self.dtype, most)
        self.tokens = Vocabulary(byte_level_tokens(path))

    def _encode_pieces(self, pieces: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        # pieces that begin with a blank stay apart in a line, and are cut where their bytes end
        made: dict[str, np.ndarray] = {}
        blank = [x for x in pieces if len(x) > 1 and x[0] == " " and not x[1].isspace()]
        odd = [x for x in pieces if not (len(x) > 1 and x[0] == " " and not x[1].isspace())]
        lines = [blank[k : k + 128] for k in range(0, len(blank), 128)]
        for line, e in zip(lines, self.tokenizer.encode_batch_fast(["".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            ends, want = np.cumsum(self.tokens.size[ids]), np.cumsum([len(x.encode()) for x in line])
            at = np.searchsorted(ends, want)
            if not (ends[at] == want).all():
                raise ValueError("pieces can't be told apart in a line")
            bounds = [0, *(at + 1).tolist()]
            made.update(zip(line, (ids[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)), strict=True))
        made.update(zip(odd, (np.array(x.ids, self.dtype) for x in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)), strict=True))
        return [made[x] for x in pieces], np.zeros(len(pieces), bool)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self.plain and SAFE.fullmatch(t) is not None for t in texts]
        raw, off = common.utf8(pa.array([t for t, p in zip(texts, plain, strict=True) if p], pa.string()))
        found = iter(self.table.lookup(raw, *byte_level_pieces(raw, off))[0])
        return [next(found) if p else self.whole(t) for t, p in zip(texts, plain, strict=True)]


# ---------------------------------------------------------------- units: groups and links


class Measured(NamedTuple):
    """Of units: how many tokens, groups and links they have, whether their tokens' bytes differ from theirs (they have no groups and links then), their groups as text, and all links on end, B's id above 32 bits of A's."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    lossy: np.ndarray
    texts: list[str]
    links: np.ndarray

    def take(self, at: np.ndarray) -> Measured:
        start = np.cumsum(self.n_links) - self.n_links
        return Measured(*(x[at] for x in self[:5]), [self.texts[k] for k in at.tolist()], spread(self.links, start[at], self.n_links[at]))

    def plus(self, other: Measured) -> Measured:
        return Measured(*(x + y if isinstance(x, list) else np.concatenate([x, y]) for x, y in zip(self, other, strict=True)))


def spread(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start : start + size] for each pair, on end."""
    ends = np.cumsum(size)
    return values[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def _until(ends: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """0, and for each mark how many of `ends` aren't beyond it."""
    return np.concatenate([[0], np.searchsorted(ends, marks, side="right")])


def measure(units: list[bytes], a_ids: list[np.ndarray], b_ids: list[np.ndarray], a_words: Vocabulary, b_words: Vocabulary) -> Measured:
    n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a_ids, b_ids))
    lossy = ~(_same(units, a_ids, a_words) & _same(units, b_ids, b_words))
    good = np.flatnonzero(~lossy).tolist()
    a, b = (np.concatenate([np.zeros(0, np.int64), *(ids[k] for k in good)]).astype(np.int64) for ids in (a_ids, b_ids))
    # good units have the same bytes on either side, so they stand on end at the same places
    a_ends, b_ends = np.cumsum(a_words.size[a]), np.cumsum(b_words.size[b])
    ends = np.cumsum([len(units[k]) for k in good], dtype=np.int64)
    cuts, shared = np.union1d(a_ends, b_ends), np.intersect1d(a_ends, b_ends, assume_unique=True)
    links = b[np.searchsorted(b_ends, cuts)] << 32 | a[np.searchsorted(a_ends, cuts)]
    a_said, b_said = list(map(str, a.tolist())), list(map(str, b.tolist()))
    a_at, b_at = _until(a_ends, shared).tolist(), _until(b_ends, shared).tolist()
    said = [f"{','.join(a_said[i:j])}|{','.join(b_said[k:m])}" for i, j, k, m in zip(a_at[:-1], a_at[1:], b_at[:-1], b_at[1:], strict=True)]
    group_at, texts = _until(shared, ends), [""] * len(units)
    for k, lo, hi in zip(good, group_at[:-1].tolist(), group_at[1:].tolist(), strict=True):
        texts[k] = said[lo] if hi == lo + 1 else ";".join(said[lo:hi])
    n_groups, n_links = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
    n_groups[good], n_links[good] = np.diff(group_at), np.diff(_until(cuts, ends))
    return Measured(n_a, n_b, n_groups, n_links, lossy, texts, links)


def _same(units: list[bytes], ids: list[np.ndarray], words: Vocabulary) -> np.ndarray:
    """Whether each unit's tokens have the unit's bytes."""
    if not units:
        return np.zeros(0, bool)
    flat, raw = np.concatenate(ids), np.frombuffer(b"".join(units), np.uint8)
    sizes = np.concatenate([[0], np.cumsum(words.size[flat])])[np.concatenate([[0], np.cumsum([len(x) for x in ids])])]
    if (np.diff(sizes) == [len(x) for x in units]).all():
        return np.diff(np.concatenate([[0], np.cumsum(words.joined(flat) != raw)])[sizes]) == 0
    return np.array([words.joined(i).tobytes() == x for i, x in zip(ids, units, strict=True)])


class Aligner:
    """Both encoders of a worker, and the units that it remembers, by 64 bits of their bytes and of the cuts inside (with 300,000 held, two share them about once in 6 * 10**13 looked up)."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a = ByteLevelEncoder(byte_path, CACHED)
        self.b = codec_of(piece_path, 1, check=False)
        self.b.table.most = CACHED  # smaller than a single encoder's: a worker holds two
        self.a_words, self.b_words = self.a.tokens, Vocabulary(piece_tokens(piece_path))
        self.cuts = self.a.plain and self.b.plain and self.b.cuts is not None and self.b.model.dummy_prefix and not self.b.user
        # hashes in order, the place of each in `known`, and whether what stands there was met again
        self.hashes, self.numbers, self.again = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.known = measure([], [], [], self.a_words, self.b_words)

    def _forget(self) -> None:
        stay = self.again[self.numbers]
        self.hashes, self.numbers = self.hashes[stay], (np.cumsum(self.again) - 1)[self.numbers[stay]]
        self.known, self.again = self.known.take(np.flatnonzero(self.again)), np.zeros(len(self.numbers), bool)

    def _units(self, texts: list[str]) -> tuple[Measured, np.ndarray, np.ndarray]:
        """The distinct units of texts that can be cut, the numbers of all units in order, and the first of each text."""
        raw, off = common.utf8(pa.array([" " + t for t in texts], pa.string()))
        a_start, a_end, _ = byte_level_pieces(raw, off)
        b_start, b_end, _ = units(raw, off, self.b.cuts)
        start = np.intersect1d(a_start, b_start, assume_unique=True)
        end = np.append(start[1:], len(raw))[: len(start)]
        # equal units have equal bytes and equal cuts inside
        value = common._BYTE[raw]
        value[a_start] += np.uint64(0x9E3779B97F4A7C15)
        value[b_start] += np.uint64(0xC2B2AE3D27D4EB4F)
        base = 0xD1342543DE82EF95
        h = common.mix(common.sums_over(value, start, end, base, pow(base, -1, 1 << 64)) + (end - start).astype(np.uint64))
        distinct, one, number = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hashes) > MOST_UNITS:
            self._forget()
        at = np.searchsorted(self.hashes, distinct)
        there = self.hashes[np.minimum(at, len(self.hashes) - 1)] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        self.again[self.numbers[at[there]]] = True
        if not there.all():
            new, at = one[~there], at[~there]
            made = []
            for table, s, e in ((self.a.table, a_start, a_end), (self.b.table, b_start, b_end)):
                lo = np.searchsorted(s, start[new])
                n = np.searchsorted(s, end[new]) - lo
                which = spread(np.arange(len(s)), lo, n)
                made.append(table.lookup(raw, s[which], e[which], np.concatenate([[0], np.cumsum(n)]))[0])
            learned = measure([raw[lo:hi].tobytes() for lo, hi in zip(start[new].tolist(), end[new].tolist(), strict=True)], *made, self.a_words, self.b_words)
            self.numbers = np.insert(self.numbers, at, len(self.known.texts) + np.arange(len(new)))
            self.hashes, self.known, self.again = np.insert(self.hashes, at, distinct[~there]), self.known.plus(learned), np.append(self.again, np.zeros(len(new), bool))
        return self.known.take(self.numbers[np.searchsorted(self.hashes, distinct)]), number, np.searchsorted(start, off)

    def block(self, texts: list[str]) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text n_a, n_b, n_groups and n_links (four arrays), and its groups; the block's distinct pairs, the most frequent first, and how often each stands; links as places among them, and each text's first."""
        some = [k for k, t in enumerate(texts) if t and SPACE not in t]
        safe = [k for k in some if self.cuts and SAFE.fullmatch(texts[k])]
        found, number, first = self._units([texts[k] for k in safe])
        of = [np.zeros(0, np.int64)] * len(texts)
        for k, lo, hi in zip(safe, first[:-1].tolist(), first[1:].tolist(), strict=True):
            of[k] = number[lo:hi]
        if whole := sorted({*some} - {*safe}):
            for n, k in enumerate(whole, len(found.texts)):
                of[k] = np.array([n])
            said = [texts[k] for k in whole]
            found = found.plus(measure([(" " + t).encode() for t in said], [self.a.whole(" " + t) for t in said], self.b.ids(said)[0], self.a_words, self.b_words))
        if found.lossy.any():  # such a text has no tokens
            of = [u[:0] if found.lossy[u].any() else u for u in of]
        flat = np.concatenate([np.zeros(0, np.int64), *of])
        at = np.concatenate([[0], np.cumsum([len(u) for u in of], dtype=np.int64)])
        sums = [np.concatenate([[0], np.cumsum(x[flat])])[at] for x in found[:4]]
        pairs, place = np.unique(found.links, return_inverse=True)
        links = spread(place, (np.cumsum(found.n_links) - found.n_links)[flat], found.n_links[flat])
        count = np.bincount(links, minlength=len(pairs))
        order = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]
        rank = np.zeros(len(pairs), np.int32)
        rank[order] = np.arange(len(order))
        groups = [";".join([found.texts[k] for k in u.tolist()]) for u in of]
        return [np.diff(x) for x in sums], groups, pairs[order], count[order], rank[links], sums[3]


@functools.lru_cache(maxsize=2)
def _aligner(byte_path: str, piece_path: str) -> Aligner:
    """One for each Python worker: what it remembers serves the worker's later tasks too."""
    return Aligner(byte_path, piece_path)


BLOCKS = "block long, docs array<struct<doc_id:long, n_a:long, n_b:long, n_groups:long, n_links:long, groups:string>>, links binary, first array<long>, pairs array<long>, counts array<long>"


def blocks(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """A row for each block: its documents, their links on end as places among the block's distinct pairs (unsigned numbers of two bytes, or of four where there are more pairs), each document's first link (and the end), and how often each pair stands in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_path, piece_path)
        one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, kind))
        for b in batches:
            texts = common.strings(b.column("text"))
            for lo, hi in common.slices(texts, BLOCK_BYTES):
                numbers, groups, pairs, counts, links, first = aligner.block(texts[lo:hi].to_pylist())
                rows = [b.column("doc_id")[lo:hi], *(pa.array(x, pa.int64()) for x in numbers), pa.array(groups, pa.string())]
                rows = pa.StructArray.from_arrays(rows, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"])
                links = links.astype("<u2" if len(pairs) <= 1 << 16 else "<u4")
                cols = [one(rows, None), pa.array([links.tobytes()], pa.binary()), *(one(x, pa.int64()) for x in (first, pairs, counts))]
                yield pa.RecordBatch.from_arrays([b.column("row")[lo : lo + 1], *cols], ["block", "docs", "links", "first", "pairs", "counts"])

    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return keyed.mapInArrow(common.lean(run, every=2), BLOCKS)


# ---------------------------------------------------------------- counts of the corpus, in Spark


SUMS = ("n_best", "count_sum")


def _totals(rows: DataFrame) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups): sums over each document's links. numbers: (place, count, best) of the block's pairs, in order."""
    names = [f.name for f in rows.schema["docs"].dataType.elementType.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                docs = b.column("docs")[k].values
                raw, first = b.column("links")[k].as_buffer(), b.column("first")[k].values.to_numpy()
                links = np.frombuffer(raw, "<u2" if raw.size == 2 * first[-1] else "<u4")
                cols = dict(zip(names, docs.flatten(), strict=True))
                for name, of in zip(SUMS, ("bests", "counts"), strict=True):
                    value = b.column(of)[k].values
                    value = value.to_numpy() if value is not None else np.zeros(0, np.int64)  # a block without links
                    cols[name] = pa.array(np.diff(np.concatenate([[0], np.cumsum(value[links])])[first]), pa.int64())
                yield pa.RecordBatch.from_arrays([cols[c] for c in [*names[:-1], *SUMS, names[-1]]], [*names[:-1], *SUMS, names[-1]])

    kind = rows.schema["docs"].dataType.elementType.fields[-1].dataType.simpleString()
    return rows.mapInArrow(common.lean(run, every=2), ", ".join([f"{c} long" for c in [*names[:-1], *SUMS]] + [f"{names[-1]} {kind}"]))


def align(docs: DataFrame, byte_path: str, piece_path: str, told: Callable[[Column], Column] = lambda text: text, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each document; groups as a text, `a1,a2|b1;a3|b2,b3`, or what `told` makes of it; that is made before blocks are written, so a digest travels and not the text."""
    made = blocks(docs, byte_path, piece_path)
    kept = F.transform("docs", lambda d: d.withField("groups", told(d["groups"])))
    found = common.written(made.withColumn("docs", kept), "blocks")
    each = found.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "p")).select("block", "place", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    pairs = each.groupBy("pair").agg(F.sum("n").alias("count"))
    # an id of B meets the ids of A at most
    highest = F.max("count").over(Window.partitionBy(F.shiftright("pair", 32)))
    pairs = common.written(pairs.select("pair", "count", (F.col("count") == highest).cast("long").alias("best")), "pairs")
    valued = each.drop("n").join(F.broadcast(pairs) if pairs.count() <= most_broadcast else pairs, "pair")
    # a block's distinct pairs at most, in order of their places
    numbers = valued.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "count", "best"))).alias("numbers"))
    rows = found.drop("pairs", "counts").join(numbers, "block", "left")
    return _totals(rows.select("docs", "links", "first", F.col("numbers.count").alias("counts"), F.col("numbers.best").alias("bests")))


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    digest = lambda text: F.when(text == "", "").otherwise(F.sha2(text, 256))
    found = align(common.documents(spark, sf_dir), default_tokenizer("byte_bpe_50k.json"), default_tokenizer("piece_bpe_32k.model"), digest)
    return found.withColumnRenamed("groups", "groups_sha256")
