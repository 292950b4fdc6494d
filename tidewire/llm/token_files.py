"""Token ids as Arrow stream files of fixed-size lists (operator 10).

`write_token_files` deals documents out to shards by ranges of doc_id (and of a hash of the text, so that one doc_id on many rows
makes no large shard), encodes them in order, and writes for each shard two files in Arrow's stream format: `<shard>.seq.arrow` with batches of `batch_rows` sequences
(`input_ids: fixed_size_list<uint16 or uint32>[seq_len]`, `mask: fixed_size_list<bool>[seq_len]`) and
`<shard>.idx.arrow` with a row for each document (`doc_id`, `start` in the shard, `n_tokens`). Only a
shard's last sequence is filled up, under a false mask. `SequenceFile` maps a file into memory and gives any
sequence as a view of it, without a copy.

Defined results: a null or empty text is the end id alone; a null doc_id sorts first; rows that share a
doc_id are all written, in the order of a hash of their texts; an empty table gives no file. Other columns of
the input are ignored.

Survival: a shard is written under a name of its own task attempt and renamed when it is whole, so a
repeated task replaces it with the same bytes.
"""

from __future__ import annotations

import functools
import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .pieces import PieceTable

#: Fixed value: the pattern by which the tokenizer file splits normalised text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


_KIND = np.full(256, 3, np.uint8)  # of a byte of lower-cased text: 0 white space, 1 letter, 2 digit, 3 anything else
_KIND[[9, 10, 13, 32]], _KIND[97:123], _KIND[48:58], _KIND[128:] = 0, 1, 2, 1


def pre_tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of what WORD_PATTERN finds in lower-cased texts of ASCII and Latin letters, and the first of each text. off: each text's first byte, and the end."""
    kind = _KIND[raw]
    begin = np.ones(len(raw) + 1, bool)
    begin[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    begin[off] = True
    before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]]) if len(kind) else kind
    edge = np.zeros(len(raw) + 3, bool)
    edge[off] = True
    mark = np.flatnonzero((raw == 39) & ((before != 3) | edge[: len(raw)]))
    if len(mark):  # 's 't 're 've 'm 'll 'd at a piece's start, within one text
        padded = np.concatenate([raw, np.zeros(3, np.uint8)])
        x, y, in1, in2 = padded[mark + 1], padded[mark + 2], ~edge[mark + 1], ~edge[mark + 2]
        two, three = np.isin(x, [115, 116, 109, 100]) & in1, (((x == 114) | (x == 118)) & (y == 101) | (x == 108) & (y == 108)) & in1 & in2
        for hit, n in ((two, 2), (three & ~two, 3)):
            at = mark[hit]
            begin[at + 1] = False
            begin[at + n] = True
    edges = np.flatnonzero(begin)
    inner = kind[edges[:-1]] != 0
    starts, ends = edges[:-1][inner], edges[1:][inner]
    return starts, ends, np.searchsorted(starts, off)


class CachedEncoder:
    """The tokenizers library's ids, with a bounded cache of pre-tokens in front of it.

    The tokenizer file lower-cases text and splits it by WORD_PATTERN; ids never depend on anything beyond
    a pre-token. For texts of ASCII and precomposed Latin letters `pre_tokens` finds the same pre-tokens,
    and the library encodes each distinct one once. Any other text, or one that may hold a special token,
    goes to the library whole, as does every text of a tokenizer that is built otherwise.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.table = PieceTable(self._encode_pieces, self.dtype, most)
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        self.plain = kinds == ["NFC", "Replace", "Lowercase"] and split == WORD_PATTERN and bool(spec["model"].get("end_of_word_suffix")) and self.dtype.itemsize == 2
        self.safe = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
        self.ends_word = np.zeros(1 << 16, bool)
        if self.plain:
            self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(spec["model"]["end_of_word_suffix"])]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _encode_pieces(self, pieces: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        # each pre-token ends with a piece that carries the word-end mark, so many are encoded as one line and cut there
        out = []
        lines = [pieces[k : k + 256] for k in range(0, len(pieces), 256)]
        for line, e in zip(lines, self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
            if len(ends) != len(line):
                raise ValueError("pre-tokens can't be told apart in a line")
            out += [ids[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)]
        return out, np.zeros(len(out), bool)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids."""
        plain = [self.plain and self.safe.fullmatch(t) is not None and not any(s in t for s in self.special) for t in texts]
        raw, off = common.utf8(pc.utf8_lower(pa.array([t for t, p in zip(texts, plain, strict=True) if p], pa.string())))
        found = iter(self.table.lookup(raw, *pre_tokens(raw, off))[0])
        return [next(found) if p else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.dtype) for t, p in zip(texts, plain, strict=True)]


@functools.lru_cache(maxsize=2)
def encoder_of(path: str) -> CachedEncoder:
    """One for each Python worker: its cache serves the worker's later tasks too."""
    return CachedEncoder(path)


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def sequence_schema(seq_len: int, dtype: np.dtype) -> pa.Schema:
    ids = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
    return pa.schema([("input_ids", pa.list_(ids, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))], metadata={"seq_len": str(seq_len)})


INDEX_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class _ShardWriter:
    """Writes one shard as documents come; holds one batch of sequences at most, and the documents' places (24 bytes each)."""

    def __init__(self, folder: str, shard: int, seq_len: int, batch_rows: int, dtype: np.dtype):
        self.fs, base = _filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.final = [f"{base}/{shard:08d}.{k}.arrow" for k in ("seq", "idx")]
        self.own = [f"{p}.{uuid.uuid4().hex}" for p in self.final]
        self.shard, self.seq_len, self.rows, self.dtype = shard, seq_len, batch_rows, dtype
        self.schema = sequence_schema(seq_len, dtype)
        self.out = self.fs.open_output_stream(self.own[0])
        self.stream = pa.ipc.new_stream(self.out, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = self.total = 0
        self.ids: list[int | None] = []
        self.ends = array("q")

    def add(self, doc_id: int | None, ids: np.ndarray, end: np.ndarray) -> None:
        n = len(ids) + len(end)
        self.ids.append(doc_id)
        self.total += n
        self.ends.append(self.total)
        self.held += n
        self.parts += [ids, end]
        if self.held >= self.seq_len * self.rows:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, self.dtype)
        step, n = self.seq_len * self.rows, self.seq_len
        while len(ids) >= step or last and len(ids):
            part, ids = ids[:step], ids[step:]
            full = -(-len(part) // n) * n
            mask = np.zeros(full, bool)
            mask[: len(part)] = True
            part = np.concatenate([part, np.zeros(full - len(part), self.dtype)])
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), n) for x in (part, mask)]
            self.stream.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.parts, self.held = ([ids.copy()], len(ids)) if len(ids) else ([], 0)

    def close(self) -> tuple[int, int, int]:
        self._flush(True)
        self.stream.close()
        self.out.close()
        ends = np.frombuffer(self.ends, np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        columns = self.ids, starts, ends - starts
        with self.fs.open_output_stream(self.own[1]) as out, pa.ipc.new_stream(out, INDEX_SCHEMA) as stream:
            stream.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=INDEX_SCHEMA))
        for own, final in zip(self.own, self.final, strict=True):
            self.fs.move(own, final)
        return self.shard, len(self.ids), self.total


class SequenceFile:
    """Random access to one `.seq.arrow` file. A local file is mapped: what `ids` and `mask` give are views."""

    def __init__(self, path: str):
        fs, place = _filesystem(path)
        source = pa.memory_map(place) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(place)
        with pa.ipc.open_stream(source) as stream:
            self.schema = stream.schema
            self.batches = list(stream)
        self.seq_len = self.schema.field("input_ids").type.list_size
        self.per_batch = self.batches[0].num_rows if self.batches else 1

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def _row(self, name: str, k: int) -> pa.Array:
        batch = self.batches[k // self.per_batch]
        return batch.column(name).slice(k % self.per_batch, 1).flatten()

    def ids(self, k: int) -> np.ndarray:
        return self._row("input_ids", k).to_numpy(zero_copy_only=True)

    def mask(self, k: int) -> pa.BooleanArray:
        return self._row("mask", k)

    def all_ids(self) -> np.ndarray:
        """Every id that the mask lets through; only a file's end is masked."""
        if not self.batches:
            return np.zeros(0, np.uint16)
        ids = np.concatenate([b.column("input_ids").flatten().to_numpy() for b in self.batches])
        return ids[: sum(b.column("mask").flatten().true_count for b in self.batches)]


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, *, end_id: int = 1, seq_len: int = 2048, batch_rows: int = 64, shard_bytes: int = 32 << 20
) -> DataFrame:
    """Writes the files into `folder`; returns the manifest: shard, path, n_docs, n_tokens, start (ids before the shard).

    Shards are ranges of doc_id with about `shard_bytes` of text. The manifest is a table with a row for each
    shard, written beside the files.
    """
    spark = docs.sparkSession
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    shards = max(1, min(size.n or 1, -(-(size.b or 0) // shard_bytes)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        end = np.array([end_id], encoder.dtype)
        out: _ShardWriter | None = None
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), common.strings(b.column("text"))
            for lo, hi in common.slices(texts):
                out = out or _ShardWriter(folder, TaskContext.get().partitionId(), seq_len, batch_rows, encoder.dtype)
                for doc_id, coded in zip(ids[lo:hi], encoder.encode(texts[lo:hi].to_pylist()), strict=True):
                    out.add(doc_id, coded, end)
        if out:
            shard, n, total = out.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f"{folder}/{shard:08d}.seq.arrow"]), pa.array([n], pa.int64()), pa.array([total], pa.int64())], ["shard", "path", "n_docs", "n_tokens"])

    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash")]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"))
    dealt = keyed.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    manifest = f"{folder}/manifest"
    dealt.mapInArrow(common.lean(write), "shard int, path string, n_docs long, n_tokens long").write.mode("overwrite").parquet(manifest)
    # starts: within blocks of shards first, then from block to block (a row for each 4,096 shards)
    rows = spark.read.parquet(manifest).withColumn("_block", F.shiftright("shard", 12))
    blocks = rows.groupBy("_block").agg(F.sum("n_tokens").alias("_n"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(F.broadcast(blocks), "_block")
    return rows.select("shard", "path", "n_docs", "n_tokens", (F.col("start") + F.col("_before")).cast("long").alias("start"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """A row for each document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids_sum."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                ids = SequenceFile(path).all_ids()
                fs, place = _filesystem(path.replace(".seq.arrow", ".idx.arrow"))
                with fs.open_input_stream(place) as source, pa.ipc.open_stream(source) as stream:
                    index = stream.read_all()
                first, n = index["start"].to_numpy(), index["n_tokens"].to_numpy()
                crc = [zlib.crc32(ids[s : s + k].astype("<u4").tobytes()) for s, k in zip(first, n, strict=True)]
                yield pa.RecordBatch.from_arrays([index["doc_id"].combine_chunks(), pa.array(first + start), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.select("path", "start").repartition(F.col("path"))
    return spread.mapInArrow(common.lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    folder = common.new_path(spark, "token-files")
    return read_token_files(write_token_files(common.documents(spark, sf_dir), folder, default_tokenizer()))
