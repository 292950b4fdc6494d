"""Ranking, candidates and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import numbers, sentences, token_set


def queue(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first rows by the given order: each task keeps its own first, and those meet."""
    return rows.orderBy(*order).limit(limit)


def postable(stories: DataFrame, now: Column, not_news: DataFrame, *, hours: float = 6, most: int = 50) -> DataFrame:
    """Candidates for a post: stories (effective_at, source) from now back to `hours`, of sources that bring news, the newest `most` (ties: smaller id).

    not_news (source): sources that never give posts. A story without a time or from the future is none; one without source is. The limit is the feature: each task keeps its own first, and those meet.
    """
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("effective_at").cast("timestamp"))
    fresh = stories.where(age.between(0, F.lit(int(hours * 3_600_000_000))))
    return queue(fresh.join(not_news.select("source").distinct(), "source", "left_anti"), most, F.desc("effective_at"), F.asc("id"))


def shortlists(rows: DataFrame, kind: str, most: dict[str, int], *order: Column) -> DataFrame:
    """The first rows of each kind, as many as `most` says, with their place from 1; other kinds and null give none. Each kind is a limit of its own, so none is gathered whole."""
    place = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    first = [queue(rows.where(F.col(kind) == k), n, *order) for k, n in most.items()]
    out = first[0]
    for x in first[1:]:
        out = out.unionByName(x)
    return out.withColumn("place", place)


def sentence_rows(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, pos, sentence), pos from 0."""
    return docs.select(key, F.posexplode(sentences(F.col(text))).alias("pos", "sentence"))


def fact_score(sentence: Column) -> Column:
    """Three points for up to two numbers each, one for up to two capitalised words inside."""
    inner = F.regexp_extract_all(sentence, F.lit(r"([a-z,] [A-Z][a-z]+)"), F.lit(1))
    return 3 * F.least(F.lit(2), F.size(numbers(sentence))) + F.least(F.lit(2), F.size(inner))


def top_sentences(rows: DataFrame, key: str, k: int = 4) -> DataFrame:
    """Each key's k best sentences: with facts first, by score, then in order; equal sentences once."""
    norm = F.trim(F.regexp_replace(F.lower("sentence"), "[^a-z0-9]+", " "))
    once = rows.withColumn("norm", norm).where("norm <> ''").groupBy(key, "norm").agg(F.min(F.struct("pos", "sentence")).alias("s")).select(key, "s.*")
    scored = once.withColumn("score", fact_score(F.col("sentence")))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "pos"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(key, "rank", "pos", "score", "sentence")


def meaningful(rows: DataFrame, key: str, least: int = 4) -> DataFrame:
    """How many different sentences of `least` tokens or more a key has."""
    norm = F.array_join(F.array_sort(token_set(F.col("sentence"))), " ")
    return rows.withColumn("norm", norm).where(F.size(F.split("norm", " ")) >= least).groupBy(key).agg(F.count_distinct("norm").alias("n"))


def attributed(turns: DataFrame, group: str, pos: str, says: Column, speaker: Column) -> DataFrame:
    """Rows that `says` holds for, with whether they or a neighbour name a speaker."""
    order = Window.partitionBy(group).orderBy(pos)
    near = speaker | F.coalesce(F.lag("_speaker").over(order), F.lit(False)) | F.coalesce(F.lead("_speaker").over(order), F.lit(False))
    marked = turns.withColumn("_speaker", speaker).withColumn("attributed", near)
    return marked.where(says).drop("_speaker")
