"""Models and checks take all rows, no sample of them."""

from pyspark.sql import functions as F

from tidewire.llm import quality, sentencepiece_io
from tidewire.llm.token_files import default_tokenizer


def test_all_good_documents_are_the_target(spark):
    n = 250_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    for most in (n, 10):
        assert quality.with_target(docs, labels, "good", most_broadcast=most).where("good").count() == n


def test_every_text_is_held_against_the_other_library_whole():
    codec = sentencepiece_io.codec_of(default_tokenizer("piece_bpe_32k.model"), 1, check=False)
    texts = [f"text number {k} of many" for k in range(40)]
    peer, seen = codec.peer, []

    class Counted:
        def encode(self, rows, **how):  # noqa: ANN001, ANN003
            seen.extend(rows)
            return peer.encode(rows, **how)

    codec.peer = Counted()
    try:
        assert all(same for _, _, same in codec.encode(texts))
    finally:
        codec.peer = peer
    assert {*texts} <= {*seen}
