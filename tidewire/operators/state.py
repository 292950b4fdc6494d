"""The state of events beside their identity: best description, development, counters; and an audit of what was merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import matching

#: Fixed value: by how much a story must be stronger than the best one to replace it.
MARGIN = 2


def best_story(stories: DataFrame, key: str = "event_id", margin: int = MARGIN) -> DataFrame:
    """(key, best: id, best_strength) after stories (key, seq, id, strength: a whole number) came in order: the first, until one is stronger by the margin.

    Only the first story of each strength can ever replace another, so a key comes down to as many rows as there are strengths (31).
    """
    first = stories.groupBy(key, "strength").agg(F.min(F.struct("seq", "id")).alias("f")).select(key, "strength", "f.*")
    walk = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "id", "strength"))).alias("s"))
    best = F.aggregate(F.slice("s", 2, F.size("s")), F.get("s", 0), lambda b, x: F.when(x.strength >= b.strength + margin, x).otherwise(b))
    return walk.select(key, best.alias("b")).select(key, F.col("b.id").alias("best"), F.col("b.strength").alias("best_strength"))


def touched(events: DataFrame, hits: DataFrame, key: str = "event_id") -> DataFrame:
    """Events with what hits (key, at, queued, update) bring: last_seen, last_development of updates, queued_count, major. Events without hits stay as they are; null counters count as 0."""
    news = hits.groupBy(key).agg(F.max("at").alias("_seen"), F.max(F.when(F.col("update"), F.col("at"))).alias("_dev"), F.count_if(F.coalesce("queued", F.lit(False))).alias("_q"), F.max(F.coalesce("major", F.lit(False))).alias("_m"))
    out = events.join(news, key, "left")
    return out.select(
        *[c for c in events.columns if c not in ("last_seen", "last_development", "queued_count", "major")], F.greatest("last_seen", "_seen").alias("last_seen"), F.greatest("last_development", "_dev").alias("last_development"),
        (F.coalesce("queued_count", F.lit(0)) + F.coalesce("_q", F.lit(0))).cast("long").alias("queued_count"), (F.coalesce("major", F.lit(False)) | F.coalesce("_m", F.lit(False))).alias("major"),
    )


def development_class(strength_gap: Column, material: Column, fresh_source: Column) -> Column:
    """UPDATE for something material from a new source, ENRICHED for a better description, else DUPLICATE."""
    return F.when(material & fresh_source, "UPDATE").when(strength_gap >= MARGIN, "ENRICHED").otherwise("DUPLICATE")


def audit(stories: DataFrame, events: DataFrame, *, many: int = 6, low: float = 0.10, broad: int = 60, **words: list[str]) -> DataFrame:
    """Events of two stories or more that may have merged too much: (event_id, stories, lowest, flags).

    stories: id, event_id, status and the sets of matching; events: event_id and the sets. Flags: many_stories; location_mismatch (a merged story names places, none of them the
    event's); low_semantic (unless a development or reaction linked it); broad_identity; no_shared_location (no merged story that names places shares one). Counted, not collected.
    """
    met = stories.select("event_id", "status", F.struct(*stories.columns).alias("s")).join(events.select("event_id", F.struct(*events.columns).alias("e")), "event_id")
    met = met.withColumn("sem", matching.semantic()).withColumn("why", matching.reason(F.col("sem"), matching.score(F.col("sem")), *(list(words.get(w, ())) for w in ("weak", "generic", "narrow", "core_words"))))
    later = F.col("status") != "NEW"
    named = (F.size("s.places") > 0) & (F.size("e.places") > 0)
    apart = named & ~F.arrays_overlap("s.places", "e.places")
    weak = (F.col("sem") < low) & ~F.coalesce(F.col("why").isin("dev+link", "reaction"), F.lit(False))
    found = met.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("stories"), F.min(F.when(later, F.round("sem", 3))).alias("lowest"), F.count_if(later & apart).alias("off"), F.count_if(later & weak).alias("thin"),
        F.count_if(later & named).alias("named"), F.max(F.size("e.tokens")).alias("width"),
    ).where("stories >= 2")
    tests = {"many_stories": F.col("stories") > many, "location_mismatch": F.col("off") > 0, "low_semantic": F.col("thin") > 0, "broad_identity": F.col("width") > broad, "no_shared_location": (F.col("named") > 0) & (F.col("named") == F.col("off"))}
    return found.select("event_id", "stories", "lowest", F.array_compact(F.array(*(F.when(holds, F.lit(name)) for name, holds in tests.items()))).alias("flags"))
