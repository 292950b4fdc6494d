"""Scores of stories. The numbers in this module are fixed values: results depend on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import substring_hits


def steps(value: Column, *pairs: tuple[float, float], below: float = 0.0) -> Column:
    """The points of the first bound that the value reaches; bounds fall."""
    out = F.lit(below)
    for bound, points in reversed(pairs):
        out = F.when(value >= bound, F.lit(points)).otherwise(out)
    return out


def reliability_bonus(tier: Column, discovery: Column) -> Column:
    return F.when(discovery, 0).when(tier == 1, 40).when(tier == 2, 25).when(tier == 3, 12).otherwise(0)


def story_score(text: Column, summary: Column, tier: Column, primary: Column, discovery: Column, urgent: list[str]) -> Column:
    hits = F.least(F.lit(25), substring_hits(text, urgent) * 8)
    total = F.lit(35) + hits + reliability_bonus(tier, discovery) + F.when(primary, 10).otherwise(0) + F.when(F.length(summary) >= 180, 5).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def confidence(tier: Column, primary: Column) -> Column:
    return F.when(primary, "high").when(tier <= 2, "medium").otherwise("low")


def priority_score(score: Column, text: Column, primary: Column, strong: Column, immediate: dict[str, int], watch: dict[str, int]) -> tuple[Column, Column]:
    """(priority, points of immediate terms)."""
    points = lambda terms: sum((F.when(F.contains(text, F.lit(t)), w).otherwise(0) for t, w in terms.items()), F.lit(0))
    now = points(immediate)
    total = score + now + points(watch) + F.when(primary, 15).otherwise(0) + F.when(strong >= 2, 15).when(strong >= 1, 8).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), total)), now


def priority_level(priority: Column, immediate: Column, conf: Column, primary: Column, strong: Column) -> Column:
    sure = primary | (strong >= 1)
    return F.when((immediate >= 30) & (conf == "high") & sure, "IMMEDIATE").when((priority >= 75) & conf.isin("high", "medium") & sure, "URGENT").when(priority >= 60, "HIGH").otherwise("NORMAL")


def max_delay(level: Column) -> Column:
    return F.when(level == "IMMEDIATE", 5).when(level == "URGENT", 15).when(level == "HIGH", 30).otherwise(60)


def public_label(status: Column, score: Column, urgent: Column, conf: Column, verified: Column, age_minutes: Column, fresh: int = 15) -> Column:
    return (
        F.when((status == "UPDATE") & (score >= 60), "UPDATE")
        .when(urgent & (conf != "low") & (score >= 80) & verified, "BREAKING")
        .when((age_minutes <= fresh) & (conf != "low") & (score >= 65) & verified, "JUST IN")
        .otherwise("NEWS")
    )


def impact(magnitude: Column, dead: Column, injured: Column, displaced: Column, missing: Column, affected: Column, crisis: Column, incident: Column) -> Column:
    """At most 34: the greater of magnitude and deaths, what else happened, and floors for crises and major incidents."""
    quake = steps(magnitude, (8.0, 30.0), (7.0, 26.0), (6.0, 18.0), (5.0, 12.0), (1e-9, 4.0))
    deaths = steps(dead, (1000, 30.0), (500, 26.0), (100, 22.0), (10, 16.0), (1, 10.0))
    extra = F.greatest(
        steps(injured, (1000, 6.0), (100, 5.0), (10, 3.0), (1, 2.0)), steps(displaced, (100000, 6.0), (10000, 5.0), (1000, 4.0), (100, 3.0)), steps(missing, (1, 2.0)), steps(affected, (1000000, 6.0), (100000, 5.0))
    )
    floors = F.greatest(F.when(crisis, 8.0).otherwise(0.0), F.when(incident, 18.0).otherwise(0.0), F.when((dead >= 1000) | (affected >= 1000000), 32.0).otherwise(0.0))
    return F.round(F.least(F.lit(34.0), F.greatest(F.greatest(quake, deaths) + extra, floors)), 1)


def urgency(text: Column, age_hours: Column) -> Column:
    has = lambda *terms: F.when(substring_hits(text, list(terms)) > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    words = 4.0 + 3 * has("breaking", "developing", "live ") + 2 * has("warns", "warning", "urgent", "emergency", "imminent") + has("rises", "climbs", "reaches", "now", "continues")
    return F.round(F.least(F.lit(10.0), words + F.coalesce(F.when(age_hours < 1, 3).when(age_hours < 6, 2).when(age_hours < 24, 1), F.lit(0))), 1)


def reliability(tier: Column, primary: Column) -> Column:
    base = F.when(tier == 1, 8).when(tier == 2, 6).when(tier == 3, 4).otherwise(2)
    return F.least(F.lit(8), base + F.when(primary, 2).otherwise(0))


def corroboration(strong: Column, count: Column) -> Column:
    return F.when(strong >= 3, 10).when(strong == 2, 8).when(strong == 1, 6).when(count >= 3, 5).when(count >= 1, 3).otherwise(0)


def coverage(count: Column) -> Column:
    return F.when(count <= 0, 0.0).when(count <= 2, 3.0).when(count <= 4, 2.0).when(count <= 6, 1.0).otherwise(0.0)


def significance(dimensions: Column) -> Column:
    """The five highest of an array of points, 40 at most."""
    top = F.slice(F.sort_array(dimensions, asc=False), 1, 5)
    return F.least(F.lit(40.0), F.aggregate(top, F.lit(0.0), lambda a, x: a + x))


def importance_level(score: Column) -> Column:
    return F.when(score >= 85, "CRITICAL").when(score >= 70, "HIGH").when(score >= 50, "MEDIUM").otherwise("LOW")


def retry_delay(attempt: Column, base: float = 5, most: float = 120) -> Column:
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt))
