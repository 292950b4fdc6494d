"""Token counts as delta-maintained rollups (operator 7).

A store holds additive totals by source, language and tokenizer version. A batch of changes (insert, delete,
revise) is summed to one signed row a key, written to a folder of its own, and committed by an empty file whose name tells the batch and
the folder. Every attempt has a folder and a file of its own, so nothing is ever overwritten and no file system needs to
create a file exclusively: of several attempts at one batch (two writers, or a writer that came again) readers count the first
by name, which begins with the time. Reading takes one listing, and no file of the commits is opened.

`compact` writes one snapshot: the totals, and the names of the batches in them. The listing that it starts from decides both. Commits and
folders that the snapshot before it held already are removed then, so readers that began before have what they need, and the
listing stays as long as two snapshots' batches. Batches of a snapshot stay known, so none of them is ever applied again.

Changes: (op, source, lang, tokenizer, n_tokens, old_tokens). insert adds a document of n_tokens, delete takes one
of n_tokens away, revise replaces old_tokens by n_tokens. A document that moves to another key, such as a new tokenizer version, is a delete and an insert.

Defined results: nulls in source, lang or tokenizer are keys like others; a null count is 0; another op fails
the batch before anything is committed; equal rows in a batch count each; an empty batch commits and adds nothing; keys whose
totals come to 0 documents and 0 tokens don't appear. Other columns are ignored. `count_tokens` counts a null or empty text as 0 tokens.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .sentencepiece_io import codec_of
from .token_files import default_tokenizer, encoder_of

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """A batch's changes as one row for each key."""
    n, old = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)), F.coalesce(F.col("old_tokens").cast("long"), F.lit(0))
    wrong = F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null"))))
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(wrong.cast("int"))
    tokens = F.when(F.col("op") == "insert", n).when(F.col("op") == "delete", -n).otherwise(n - old)
    return changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))


class RollupStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for folder in ("commits", "snapshots"):
            self.fs.mkdirs(self._path(f"{self.path}/{folder}"))

    def _names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.path}/{folder}")))

    def _touch(self, name: str) -> None:
        self.fs.create(self._path(f"{self.path}/{name}"), False).close()

    def _commits(self) -> dict[str, str]:
        """Batch (its digest) to the folder that counts for it."""
        found: dict[str, str] = {}
        for name in self._names("commits"):
            found.setdefault(name.split(".")[0], f"data/{name}")
        return found

    def _snapshot(self) -> str | None:
        """The folder of the newest snapshot; of several attempts at one number, the first."""
        names = self._names("snapshots")
        newest = [n for n in names if names and n.split(".")[0] == names[-1].split(".")[0]]
        return f"data/{newest[0]}" if newest else None

    def _batches(self, snapshot: str | None) -> DataFrame:
        if snapshot is None:
            return self.spark.createDataFrame([], "batch string")
        return self.spark.read.schema("batch string").parquet(f"{self.path}/{snapshot}/batches")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commits a batch; False, and no work, if it is committed already."""
        key = hashlib.sha256(batch.encode()).hexdigest()
        if key in self._commits() or not self._batches(self._snapshot()).where(F.col("batch") == key).isEmpty():
            return False
        name = f"{key}.{time.time_ns():020d}-{uuid.uuid4().hex}"
        signed(changes).write.parquet(f"{self.path}/data/{name}")
        self._touch(f"commits/{name}")
        return True

    def _totals(self, snapshot: str | None, commits: dict[str, str]) -> DataFrame:
        known = {r.batch for r in self._batches(snapshot).where(F.col("batch").isin(list(commits))).collect()} if snapshot and commits else set()
        paths = [d for b, d in commits.items() if b not in known] + ([f"{snapshot}/totals"] if snapshot else [])
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{p}" for p in paths])
        both = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return both.where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        # commits first: what a snapshot made in between holds too is then known from it
        commits = self._commits()
        return self._totals(self._snapshot(), commits)

    def compact(self) -> None:
        """One snapshot of all that is committed now."""
        commits, base = self._commits(), self._snapshot()
        number = int(base.split("/")[1].split(".")[0]) + 1 if base else 1
        name = f"{number:012d}.{time.time_ns():020d}-{uuid.uuid4().hex}"
        self._totals(base, commits).write.parquet(f"{self.path}/data/{name}/totals")
        now = self.spark.createDataFrame([(b,) for b in commits], "batch string")
        self._batches(base).unionByName(now).distinct().write.parquet(f"{self.path}/data/{name}/batches")
        self._touch(f"snapshots/{name}")
        if base:
            old = {r.batch for r in self._batches(base).where(F.col("batch").isin(list(commits))).collect()}
            for gone in [n for n in self._names("commits") if n.split(".")[0] in old]:
                self.fs.delete(self._path(f"{self.path}/commits/{gone}"), False)
                self.fs.delete(self._path(f"{self.path}/data/{gone}"), True)


def count_tokens(docs: DataFrame, word_path: str, piece_path: str) -> DataFrame:
    """Adds n_word and n_piece, the tokens of each whole text by a tokenizer of the tokenizers library and by a sentencepiece model, without special ones."""
    docs = common.extra_columns(docs, "n_word", "n_piece")
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, piece = encoder_of(word_path), codec_of(piece_path, 1, check=False)
        for b in batches:
            texts = common.strings(b.column("text"))
            for lo, hi in common.slices(texts):
                rows = texts[lo:hi].to_pylist()
                n = [pa.array([len(i) for i in ids], pa.int64()) for ids in (word.encode(rows), piece.ids(rows)[0])]
                yield pa.RecordBatch.from_arrays([*(b.column(c)[lo:hi] for c in names), *n], [*names, "n_word", "n_piece"])

    return docs.select(*names, "text").mapInArrow(common.lean(run), common.wider(docs.select(*names).schema, "n_word long, n_piece long"))


VERSIONS = {"word_bpe_49k": "n_word", "piece_bpe_32k": "n_piece"}


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """Documents come in with counts estimated from n_chars and are revised by counts of their whole texts; a second tokenizer version's counts come in; toxic documents are deleted from both. The first batch comes twice."""
    docs = common.documents(spark, sf_dir).select("doc_id", "source", "lang", F.coalesce(F.floor(F.col("n_chars") / 5), F.lit(0)).cast("long").alias("guess"), "text")
    counted = common.written(count_tokens(docs, default_tokenizer("word_bpe_49k.json"), default_tokenizer("piece_bpe_32k.model")), "counts")
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select("doc_id").distinct()
    old, new = VERSIONS

    def changes(rows: DataFrame, op: str, tokenizer: str, n: str, before: str | None = None) -> DataFrame:
        old_tokens = F.lit(None).cast("long") if before is None else F.col(before)
        return rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(n).alias("n_tokens"), old_tokens.alias("old_tokens"))

    gone = counted.join(toxic, "doc_id", "left_semi")
    load = changes(counted, "insert", old, "guess")
    store = RollupStore(spark, common.new_path(spark, "rollup"))
    store.apply("load", load)
    store.apply("recount", changes(counted, "revise", old, VERSIONS[old], "guess"))
    store.compact()
    store.apply("load", load)
    store.apply("second version", changes(counted, "insert", new, VERSIONS[new]))
    store.apply("toxic", changes(gone, "delete", old, VERSIONS[old]).unionByName(changes(gone, "delete", new, VERSIONS[new])))
    store.compact()
    return store.totals()
