"""Event memory: stories in order of arrival against the events known so far, those of the same run included.

Each story sees the events that earlier ones founded. An event's identity never changes after it is founded, so a
run needs no walk over its stories: who founds an event is leader clustering (operators/leaders), and what a story adds
to its event is the first appearance of a fact or source by order of arrival. On a stream each micro-batch writes the
next version of the memory under its batch number, so a batch that is run again writes the same rows again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import leaders, matching

SETS = ("entities", "places", "actions", "core", "numbers", "impact", "storms", "magnitudes", "tokens", "title_tokens")
FACTS = ("impact", "numbers")
TYPES = {"events": "event_id string, " + ", ".join(f"{s} array<string>" for s in SETS), "facts": "event_id string, fact string", "sources": "event_id string, source string"}


@dataclass
class Memory:
    """events: identity sets by event_id. facts and sources: what an event has gathered."""

    events: DataFrame
    facts: DataFrame
    sources: DataFrame

    @staticmethod
    def empty(spark) -> Memory:  # noqa: ANN001
        return Memory(**{name: spark.createDataFrame([], schema) for name, schema in TYPES.items()})

    @staticmethod
    def read(spark, folder: str) -> Memory:  # noqa: ANN001
        return Memory(**{name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in TYPES.items()})

    def write(self, folder: str) -> None:
        for name in TYPES:
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def remember(stories: DataFrame, memory: Memory, **words: list[str]) -> tuple[DataFrame, Memory]:
    """Decisions (id, status, event_id, score, reason) and the memory after them.

    stories: id string, seq long (order of arrival, without ties), source, discovery, dev, reaction and the sets; more columns are
    let be. Null sets count as empty, a null flag as false, a null source as one source; stories without id or seq take no part.
    A founder's id becomes its event's id. words: as in matching.decide.
    """
    stories = stories.where("id is not null and seq is not null").select(
        "id", "seq", F.coalesce("source", F.lit("")).alias("source"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("discovery", "dev", "reaction")),
        *(F.array_distinct(F.coalesce(s, F.array().cast("array<string>"))).alias(s) for s in SETS),
    )
    stories = leaders.cut(stories)
    founding = stories.where(~F.col("discovery") | matching.identified())
    stored = leaders.cut(matching.matches(stories, memory.events, **words).drop("material"))
    earlier = leaders.cut(matching.matches(stories, founding.select(F.col("id").alias("event_id"), "seq", *SETS), order="seq", **words).drop("material"))

    unmet = stories.join(stored.select("id"), "id", "left_anti").select("id")
    links = earlier.select(F.col("event_id").alias("a"), F.col("id").alias("b"))
    links = links.join(unmet.withColumnRenamed("id", "a"), "a", "left_semi").join(unmet.withColumnRenamed("id", "b"), "b", "left_semi")
    free = leaders.cut(leaders.founders(unmet, links))
    new = free.join(founding.select("id"), "id", "left_semi")

    options = stored.unionByName(earlier.join(new.withColumnRenamed("id", "event_id"), "event_id", "left_semi"))
    best = options.groupBy("id").agg(F.min_by(F.struct("event_id", "score", "reason"), F.struct(-F.col("score"), "event_id")).alias("m")).select("id", "m.*")
    own = new.select("id", F.col("id").alias("event_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("reason"))
    placed = leaders.cut(best.unionByName(own).join(stories.select("id", "seq", "source", *FACTS), "id"))

    facts = placed.select("event_id", "id", "seq", F.explode(F.concat(*(F.transform(k, matching.named(k)) for k in FACTS))).alias("fact"))
    before = memory.events.select("event_id", F.explode(F.concat(*(F.transform(F.coalesce(k, F.array().cast("array<string>")), matching.named(k)) for k in FACTS))).alias("fact"))
    before = before.unionByName(memory.facts).distinct()
    brought = leaders.cut(facts.groupBy("event_id", "fact").agg(F.min_by("id", "seq").alias("id")).join(before, ["event_id", "fact"], "left_anti"))
    first = leaders.cut(placed.groupBy("event_id", "source").agg(F.min_by("id", "seq").alias("id")).join(memory.sources, ["event_id", "source"], "left_anti"))

    flag = lambda rows, name: rows.select("id").distinct().withColumn(name, F.lit(True))
    marked = stories.select("id").join(placed.select("id", "event_id", "score", "reason"), "id", "left").join(flag(brought, "material"), "id", "left").join(flag(first, "fresh"), "id", "left").join(flag(new, "founds"), "id", "left")
    status = F.when(F.col("founds"), "NEW").when(F.col("event_id").isNull(), "HELD").when(F.col("material") & F.col("fresh"), "UPDATE").otherwise("DUPLICATE")
    decisions = marked.select("id", status.alias("status"), "event_id", "score", "reason")
    after = Memory(
        memory.events.select("event_id", *SETS).unionByName(stories.join(new, "id", "left_semi").select(F.col("id").alias("event_id"), *SETS)),
        before.unionByName(brought.select("event_id", "fact")),
        memory.sources.select("event_id", "source").distinct().unionByName(first.select("event_id", "source")),
    )
    return decisions, after


def follow(stream: DataFrame, folder: str, checkpoint: str, **words: list[str]) -> StreamingQuery:
    """Stories of a stream, one version of the memory and one table of decisions by micro-batch under folder (shared by all executors). Ends when all at hand is read."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        memory = Memory.read(spark, f"{folder}/memory/{number - 1}") if number else Memory.empty(spark)
        decisions, after = remember(rows, memory, **words)
        after.write(f"{folder}/memory/{number}")
        decisions.write.mode("overwrite").parquet(f"{folder}/decisions/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
