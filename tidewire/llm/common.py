"""What the operators of this subpackage share: shared folders, text blocks, hashing, sums of vectors.

Text is handled in blocks of about a megabyte of UTF-8 with numpy: one polynomial prefix sum gives
the hash of every word, so a task's memory doesn't depend on how long its partition is.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BLOCK_BYTES = 1 << 20
_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and the master is local (tests)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_dir:
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not now.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_dir = now.get() if now.isDefined() else "file://" + tempfile.mkdtemp(prefix="tidewire-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder; removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tidewire/{what}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _MADE:
        try:
            remove_path(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone; the files then stay for the folder's owner
            return


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows, written to the shared folder and read again: computed once, and no lineage left to lose."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of `written` that nothing reads any more: their successors are written themselves."""
    for df in tables:
        if path := getattr(df, "_written_to", None):
            remove_path(df.sparkSession, path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---------------------------------------------------------------- blocks of text


def strings(column: pa.Array) -> pa.Array:
    """Nulls become empty, offsets 32-bit."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def slices(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with about `most` bytes of text; a longer text is a run of its own."""
    if not len(texts):
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(texts):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield lo, hi
        lo = hi


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows on end, and where each row starts (one more entry for the end)."""
    off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


_M64 = (1 << 64) - 1
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base & _M64, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
        if len(have) > 1 << 22:  # for one very long text; not kept
            del _powers[base]
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[128:] = True
    table[[ord(c) for c in chars]] = True
    return table


LETTERS_DIGITS = _class("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
NOT_SPACE = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def sums_over(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, inverse: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for each pair, the same wherever the run stands."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=total[1:])
    return (total[ends] - total[starts]) * powers(inverse, n + 1)[starts]


def byte_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of raw[start:end] for each pair; to be mixed."""
    return sums_over(_BYTE[raw], starts, ends, _ODD, _INVERSE)


class Words:
    """The words of a block of rows: `hashes`, `starts` and `ends` (byte places), `rows` (first word of each row)."""

    def __init__(self, texts: pa.Array, table: np.ndarray = LETTERS_DIGITS, lower: bool = True):
        self.raw, self.off = utf8(pc.utf8_lower(texts) if lower else texts)
        raw, off, n = self.raw, self.off, len(self.raw)
        inside = table[raw]
        change = np.empty(n + 1, bool)
        if n:
            change[0], change[n] = inside[0], inside[-1]
            np.not_equal(inside[1:], inside[:-1], out=change[1:n])
        else:
            change[0] = False
        cut = off[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < n)])
        joined = cut[inside[cut] & inside[cut - 1]] if len(cut) else cut
        edges = np.flatnonzero(change)
        if len(joined):  # a word that ends at a row's end and one that starts there
            edges = np.sort(np.concatenate([edges, joined, joined]))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.hashes = mix(byte_hashes(raw, self.starts, self.ends))
        self.rows = np.searchsorted(self.starts, off)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each run of k words within a row (of all words, if a row has fewer), and each row's first place."""
        h, rows = self.hashes, self.rows
        n = np.diff(rows)
        per = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
        first = np.concatenate([[0], np.cumsum(per)])
        row = np.repeat(np.arange(len(n)), per)
        start = rows[:-1][row] + (np.arange(first[-1]) - first[:-1][row])
        end = np.minimum(start + k, rows[1:][row])
        return mix(sums_over(h, start, end, 0xC2B2AE3D27D4EB4F, pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64)) + (end - start).astype(np.uint64)), first

    def sequence(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each row's words in order, as two arrays."""
        out = []
        for base in (0x9FB21C651E98DF25, 0xD1342543DE82EF95):
            h = sums_over(mix(self.hashes + np.uint64(base)), self.rows[:-1], self.rows[1:], base, pow(base, -1, 1 << 64))
            out.append(mix(h + np.diff(self.rows).astype(np.uint64)))
        return out[0], out[1]


def distinct_by_row(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each row in order, how often each stands there, and where each row's start. first: each row's first value, and the end."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.argsort(h)
    small = row[order].astype(np.uint16 if len(first) <= 1 << 16 else np.int64)
    order = order[np.argsort(small, kind="stable")]  # a radix sort for 16 bits
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), np.searchsorted(row[at], np.arange(len(first)))


# ---------------------------------------------------------------- memory of Python workers


def _release() -> None:
    """Gives freed memory back to the system: allocators keep it else, and workers live on through the stages that follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], every: int = 16) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for mapInArrow, but freed memory goes back after each `every` batches out and at a task's end."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for k, b in enumerate(run(batches), 1):
                yield b
                if k % every == 0:
                    _release()
        finally:
            _release()

    return wrapped


# ---------------------------------------------------------------- sums of vectors

VECTOR = "block int, salt int, counts binary"
_STEP = 1 << 14


def vector_rows(vector: np.ndarray, salt: int) -> Iterator[pa.RecordBatch]:
    """One task's counts, cut into blocks; blocks of nothing are left out."""
    for k in range(0, len(vector), _STEP):
        if (part := vector[k : k + _STEP]).any():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k // _STEP], pa.int32()), "salt": pa.array([salt], pa.int32()), "counts": pa.array([part.astype(np.int64).tobytes()], pa.binary())})


def sum_vectors(df: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' vectors, on the driver: `size` numbers, a constant, however many tasks there are.

    Blocks meet by (block, salt) first and by block then; each task adds up as it reads, so a block's
    rows are never held together.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column("block").to_pylist(), b.column("counts"), strict=True):
                part = np.frombuffer(c.as_buffer(), np.int64)
                if k in held:
                    held[k] += part
                else:
                    held[k] = part.copy()
        for k, v in held.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "salt": pa.array([0], pa.int32()), "counts": pa.array([v.tobytes()], pa.binary())})

    first = df.repartition(F.col("block"), F.col("salt")).mapInArrow(lean(add), VECTOR)
    out = np.zeros(-(-size // _STEP) * _STEP, np.int64)
    for r in first.repartition(F.col("block")).mapInArrow(lean(add), VECTOR).toLocalIterator():
        part = np.frombuffer(r.counts, np.int64)
        out[r.block * _STEP : r.block * _STEP + len(part)] += part
    return out[:size]


def task_salt(n: int = 16) -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return (context.partitionId() if context else 0) % n


def unit(*columns: str | Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the columns and the seed alone."""
    return (F.abs(F.xxhash64(F.lit(seed), *columns) % F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))


def extra_columns(df: DataFrame, *drop: str) -> DataFrame:
    """A document's columns under their own names, without those that an operator is about to add."""
    return df.drop(*[c for c in drop if c in df.columns])


def wider(schema: StructType, ddl: str) -> StructType:
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])
