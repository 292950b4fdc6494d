"""The corpus pipeline: documents in, encoded documents out.

Each stage takes the documents that the stage before kept, and is written as a table before the next reads it.
Stages keep whole documents, but for substring deduplication, which cuts repeats out of texts. A document that
loses all its words there goes; one that came without words has gone with the first stage.

Defined results: a null or empty text goes with the first stage; a null doc_id, or one that stands on several rows, is a document a row all
the way; a null lang or source is a group of its own in the mixture; of equal rows one stays; an empty table gives no rows;
a text of any length is handled whole. Columns beyond those of documents are passed on as they are, also where an operator adds one
of the same name (kept, domain, epoch, n_tokens, ...); only the ids' own columns replace such ones in the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import common, mixing, near_dup, quality, sentencepiece_io, substring_dup
from tidewire.llm.token_files import default_tokenizer

#: Of the tokens that are left, the part that the mixture takes; each document once at most.
MIX_SHARE = 0.9


def _with_own(docs: DataFrame, *added: str) -> tuple[DataFrame, list]:
    """Documents with the columns that an operator adds out of its way, and what gives all columns their names again."""
    aside = {c: f"_own_{c}" for c in docs.columns if c in added}
    return docs.withColumnsRenamed(aside), [F.col(aside.get(c, c)).alias(c) for c in docs.columns]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps (operator 1)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs, names = _with_own(docs, "log_weight", "n_grams", "gumbel_key", "kept")
    return quality.classify(docs, labels).where("kept").select(*names)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (operator 8): the one with the smallest doc_id; a null doc_id comes last.

    Each row is a document, also where doc_id is null or stands on several rows. One without words is a group of its own.
    """
    rows, ids = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if rows == ids:
        kept = near_dup.near_duplicates(docs).where("kept").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    keyed = common.written(docs.withColumn("_key", F.monotonically_increasing_id()), "keyed")
    found = near_dup.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), "component_id")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "_key")
    kept = keyed.select("doc_id", "_key").join(found, "_key").groupBy("component_id").agg(F.min_by("_key", first).alias("_key")).select("_key")
    return keyed.join(kept, "_key", "left_semi").select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand in an earlier document (operator 3); n_chars follows the text."""
    docs, names = _with_own(docs, "removed_words", "removed_spans")
    cut = substring_dup.dedup_substrings(docs)
    left = (F.col("removed_words") == 0) | F.col("text").rlike(r"\S")
    return cut.where(F.coalesce(left, F.lit(True))).withColumn("n_chars", F.length("text").cast("long")).select(*names)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources (operator 6)."""
    docs, names = _with_own(docs, "domain", "n_tokens", "epoch")
    return mixing.mix(docs, mixing.WEIGHTS, share=MIX_SHARE, max_epochs=1).select(*names)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text (operator 2), in place of the text."""
    return sentencepiece_io.encode(docs, default_tokenizer("piece_bpe_32k.model")).drop("text")


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", near_dup_stage),
    ("substring dedup", substring_stage),
    ("mixing sources", mixing_stage),
    ("sentencepiece encoding", encode_stage),
]

#: Hashed n-gram models, sampled similarities and rolling hashes have no form in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
