"""SentencePiece encoding and decoding on the tokenizers library (operator 2).

`parse_model` reads the model's protobuf; `rebuild` makes a tokenizer of the tokenizers library from it: the
normaliser (what the model says, dummy prefix, metaspace mark), the model with its scores (unigram scores as they are;
for a BPE model, merges in the order of its scores) and byte fallback. `Codec` encodes batches on several threads (`threads`: two, or
spark.task.cpus where that is more), decodes their ids, and holds what it makes against the sentencepiece library.

A text's ids don't depend on anything beyond a unit of it: no piece of the vocabulary holds the two characters
on either side of a unit's edge (checked when the model is read), and user-defined pieces are units. Units are cached; each distinct one
is encoded by the tokenizers library (and held against the sentencepiece library where `check` says so). Every text is held against the
sentencepiece library as a whole.

Defined results: a null text is encoded as an empty one (no ids); texts of any length are encoded whole; other
columns are passed on; ids, n_tokens, decoded, lossless and parity replace ones of the same name; an empty table
gives no rows. `lossless` says that decoding the ids gives the text again (for a null one: an empty text), `parity` that both libraries agree
on all of it.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .pieces import PieceTable
from .token_files import default_tokenizer

SPACE = "▁"
#: Kinds of pieces and of models in the protobuf.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of one protobuf message: number and value (bytes, or an integer; fixed 32 bits as bytes)."""

    def varint(at: int) -> tuple[int, int]:
        shift = value = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            n, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    normalizer: str = ""
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix: bool = False


def parse_model(path: str) -> Model:
    m = Model()
    for number, value in _fields(open(path, "rb").read()):
        if number == 1:
            own = dict(_fields(value))
            m.pieces.append((own.get(1, b"").decode(), float(np.frombuffer(own.get(2, bytes(4)), "<f4")[0]), own.get(3, NORMAL)))
        elif number == 2:
            own = dict(_fields(value))
            m.kind, m.byte_fallback, m.unk_id, m.suffix = own.get(3, UNIGRAM), bool(own.get(35, 0)), own.get(40, 0), bool(own.get(24, 0))
        elif number == 3:
            own = dict(_fields(value))
            m.normalizer, m.charsmap = own.get(1, b"").decode(), own.get(2, b"")
            m.dummy_prefix, m.squeeze, m.escape = (bool(own.get(k, 1)) for k in (3, 4, 5))
    return m


def rebuild(m: Model, normalise: bool = True):  # noqa: ANN201
    """The same tokenizer for the tokenizers library; without `normalise`, for units that are normalised."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if m.suffix or not m.escape:
        raise ValueError("white space as suffix, or not escaped, isn't rebuilt")
    if m.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=m.unk_id, byte_fallback=m.byte_fallback)
    elif m.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        made = {p: s for p, s, kind in m.pieces if kind in (NORMAL, USER_DEFINED)}
        pairs = [(-s, vocab[p[:k]], vocab[p[k:]], p[:k], p[k:]) for p, s in made.items() for k in range(1, len(p)) if p[:k] in made and p[k:] in made]
        model = models.BPE(vocab, [(a, b) for *_, a, b in sorted(pairs)], unk_token=m.pieces[m.unk_id][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        raise ValueError(f"models of kind {m.kind} aren't rebuilt")
    t = Tokenizer(model)
    steps = []
    if m.charsmap:
        steps.append(normalizers.Precompiled(m.charsmap))
    if m.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE))
    steps.append(normalizers.Replace(" ", SPACE))
    if normalise:
        t.normalizer = normalizers.Sequence(steps)
    t.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix and normalise else [])])
    return t


def separators(m: Model) -> bytes | None:
    """ASCII marks at which texts may be cut: between different characters of which one is such a mark no piece of the vocabulary lies.

    None if a piece holds a metaspace mark after another character: then texts can't be cut before blanks.
    """
    pairs = {(p[k], p[k + 1]) for p, _, kind in m.pieces if kind in (NORMAL, USER_DEFINED) for k in range(len(p) - 1)}
    if any(b == SPACE and a != SPACE for a, b in pairs):
        return None
    return "".join(c for c in "\n\t.,;:!?\"()[]{}|<>=+*/\\-_'%$&#@~" if not any((a == c) != (b == c) for a, b in pairs)).encode()


def units(raw: np.ndarray, off: np.ndarray, apart: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the units of texts whose metaspace marks stand as blanks, and the first of each text: runs of one separator, and what else
    stands between separators and blanks, with the blanks before it."""
    kind = np.zeros(256, np.uint8)
    kind[32] = 1
    kind[list(apart)] = 2
    of = kind[raw]
    begin = np.ones(len(raw) + 1, bool)
    if len(raw):
        differ = raw[1:] != raw[:-1]
        begin[1:-1] = differ & ((of[1:] != 0) | (of[:-1] == 2))
    begin[off] = True
    edges = np.flatnonzero(begin)
    return edges[:-1], edges[1:], np.searchsorted(edges[:-1], off)


class Codec:
    def __init__(self, path: str, most: int = 500_000, threads: int = 2, check: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        self.model = parse_model(path)
        self.whole, self.units_of = rebuild(self.model), rebuild(self.model, normalise=False)
        user = {p: i for i, (p, _, kind) in enumerate(self.model.pieces) if kind == USER_DEFINED}
        self.apart_at = re.compile("(" + "|".join(map(re.escape, sorted(user, key=len, reverse=True))) + ")").split if user else None
        self.cuts = separators(self.model)
        if self.cuts is None and user:
            raise ValueError("user-defined pieces beside pieces that hold a mark inside aren't rebuilt")
        self.plain = not (self.model.charsmap or self.model.squeeze)
        self.peer = sentencepiece.SentencePieceProcessor(model_file=path)
        self.threads, self.check = threads, check
        self.dtype = np.dtype("<u2") if len(self.model.pieces) <= 1 << 16 else np.dtype("<u4")
        self.user = {p: np.array([i], self.dtype) for p, i in user.items()}
        self.table = PieceTable(self._learn, self.dtype, most)
        unit = self.peer.piece_to_id(SPACE)
        self.space = unit if unit != self.model.unk_id else None
        self.apart = "\n" if self.cuts and b"\n" in self.cuts else None
        self.lead = self.peer.encode("\n") if self.apart else None
        self.marks = np.array([p.startswith(SPACE) for p, _, _ in self.model.pieces])

    def normalised(self, text: str) -> str:
        """With blanks for metaspace marks."""
        if not self.plain:
            return self.whole.normalizer.normalize_str(text).replace(SPACE, " ")
        return (" " if self.model.dummy_prefix and text else "") + text.replace(SPACE, " ")

    def _learn(self, new: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """The ids of units, held against the other library where `check` says so; True for those on which they differ.

        Units of one leading mark go by the line: their ids are cut where a piece carries a mark. A line on which
        anything differs is done again unit by unit.
        """
        new = [u.replace(" ", SPACE) for u in new]
        made, faults, odd, plain = {}, set(), [], []
        for u in new:
            (plain if u[0] == SPACE and len(u) > 1 and u[1] != SPACE else odd).append(u)
        lines = [plain[k : k + 128] for k in range(0, len(plain), 128)]
        joined = ["".join(x) for x in lines]
        ids = [e.ids for e in self.units_of.encode_batch_fast(joined, add_special_tokens=False)]
        peer = self.peer.encode([x[1:] for x in joined], num_threads=self.threads) if self.check else ids
        for line, i, p in zip(lines, ids, peer, strict=True):
            flat = np.array(i, self.dtype)
            starts = np.flatnonzero(self.marks[flat]).tolist()
            if i != p or len(starts) != len(line):
                odd += line
            else:
                made.update(zip(line, (flat[lo:hi] for lo, hi in zip(starts, [*starts[1:], len(flat)], strict=True)), strict=True))
        ids = [e.ids for e in self.units_of.encode_batch_fast(odd, add_special_tokens=False)]
        if self.check:
            # the other library puts a mark before each text: given a unit that starts with one, it is the unit's own;
            # before others a line break keeps it away
            peer = self.peer.encode([u[1:] if u[0] == SPACE else (self.apart or "") + u for u in odd], num_threads=self.threads)
            for u, i, p in zip(odd, ids, peer, strict=True):
                if u[0] == SPACE:
                    same = i == ([self.space] if len(u) == 1 else p)
                else:
                    same = self.lead is not None and p[: len(self.lead)] == self.lead and p[len(self.lead) :] == i
                if not same:
                    faults.add(u)
        made.update(zip(odd, (np.array(i, self.dtype) for i in ids), strict=True))
        return [made[u] for u in new], np.array([u in faults for u in new], bool)

    def _with_user_pieces(self, text: str) -> np.ndarray:
        """The ids of a normalised text that may hold user-defined pieces: each of them is one, whatever stands around it."""
        parts = self.apart_at(text.replace(" ", SPACE))
        return np.concatenate([self.user[p] if k % 2 else np.array(self.units_of.encode(p, add_special_tokens=False).ids, self.dtype) for k, p in enumerate(parts) if p] or [np.zeros(0, self.dtype)])

    def ids(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Each text's ids, and whether it needs a look at the whole."""
        if self.cuts is None:
            return [np.array(e.ids, self.dtype) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)], np.ones(len(texts), bool)
        normal = [self.normalised(t) for t in texts]
        own = [k for k, t in enumerate(normal) if self.apart_at and any(p in t for p in self.user)]
        rest = list(normal)
        for k in own:
            rest[k] = ""
        raw, off = common.utf8(pa.array(rest, pa.string()))
        coded, doubt = self.table.lookup(raw, *units(raw, off, self.cuts))
        for k in own:
            coded[k], doubt[k] = self._with_user_pieces(normal[k]), True
        return coded, doubt

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.whole.decode_batch([i.tolist() for i in ids], skip_special_tokens=False)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, str, bool]]:
        """For each text: ids, what they decode to, and whether both libraries agree."""
        coded = self.ids(texts)[0]
        same = [ids.tolist() == peer for ids, peer in zip(coded, self.peer.encode(texts, num_threads=self.threads), strict=True)]
        return list(zip(coded, self.decode(coded), same, strict=True))


@functools.lru_cache(maxsize=2)
def codec_of(path: str, threads: int, check: bool = True) -> Codec:
    """One for each Python worker: its cache serves the worker's later tasks too."""
    return Codec(path, threads=threads, check=check)


def encode(docs: DataFrame, path: str, *, threads: int | None = None, keep_text: bool = False) -> DataFrame:
    """Adds ids (array of int), n_tokens, lossless and parity; with keep_text, decoded."""
    threads = threads or max(2, int(docs.sparkSession.sparkContext.getConf().get("spark.task.cpus", "1")))
    docs = common.extra_columns(docs, "ids", "n_tokens", "decoded", "lossless", "parity")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, threads, check=False)  # whole texts are held against the other library
        for b in batches:
            texts = common.strings(b.column("text"))
            for lo, hi in common.slices(texts):
                rows = texts[lo:hi].to_pylist()
                coded = codec.encode(rows)
                n = np.array([len(i) for i, _, _ in coded])
                flat = np.concatenate([i for i, _, _ in coded]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
                more = [ids, pa.array(n.astype(np.int32)), pa.array([t == r for (_, t, _), r in zip(coded, rows, strict=True)]), pa.array([p for _, _, p in coded])]
                if keep_text:
                    more.append(pa.array([t for _, t, _ in coded]))
                yield pa.RecordBatch.from_arrays([*(b.column(c)[lo:hi] for c in names), *more], [*names, "ids", "n_tokens", "lossless", "parity", *["decoded"] * keep_text])

    return docs.mapInArrow(common.lean(run), common.wider(docs.schema, "ids array<int>, n_tokens int, lossless boolean, parity boolean" + ", decoded string" * keep_text))


def decode(coded: DataFrame, path: str) -> DataFrame:
    """Adds decoded: the text of `ids`."""
    coded = common.extra_columns(coded, "decoded")
    names = coded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = rebuild(parse_model(path))
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = tokenizer.decode_batch([x or [] for x in part.column("ids").to_pylist()], skip_special_tokens=False)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(texts, pa.string())], [*names, "decoded"])

    return coded.mapInArrow(common.lean(run), common.wider(coded.schema, "decoded string"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (as little-endian unsigned 32-bit numbers), lossless, parity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = [zlib.crc32(x.values.to_numpy().astype("<u4").tobytes()) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "n_tokens", "lossless", "parity")), pa.array(crc, pa.int64())], ["doc_id", "n_tokens", "lossless", "parity", "ids_crc32"])

    coded = encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path).drop("text")
    return coded.mapInArrow(common.lean(run), "doc_id long, n_tokens int, lossless boolean, parity boolean, ids_crc32 long")


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir), default_tokenizer("piece_bpe_32k.model"))
