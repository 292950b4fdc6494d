"""Keyed tables: upserts, retention, duplicates across sources, additive counters, anti-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_wins(stored: DataFrame, incoming: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Insert or replace by key; among several rows of a key the greatest in `order` stays."""
    both = stored.unionByName(incoming, allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def additive_upsert(stored: DataFrame, delta: DataFrame, key: str, counters: list[str], last: dict[str, str]) -> DataFrame:
    """Counters add up; each of `last` keeps its newest value that isn't null, by the column it names."""
    both = stored.unionByName(delta, allowMissingColumns=True)
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in counters]
    return both.groupBy(key).agg(*sums, *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(by))).alias(c) for c, by in last.items()))


def seen_or_newer(incoming: DataFrame, stored: DataFrame, key: str, new_time: str, old_time: str) -> DataFrame:
    """Incoming rows that are unknown, or newer than what is stored."""
    return incoming.join(stored.select(key, F.col(old_time).alias("_old")), key, "left").where(F.col("_old").isNull() | (F.col(new_time) > F.col("_old"))).drop("_old")


def unexpired(rows: DataFrame, time: str, now: Column, hours: Column) -> DataFrame:
    """Rows not older than their hours."""
    return rows.where(F.col(time) >= now - F.make_dt_interval(F.lit(0), hours))


def cross_source_duplicates(rows: DataFrame, key: str, source: str, seq: str) -> DataFrame:
    """Marks duplicate: from the first row of another source on, every row of a key but those before.

    Sources of a key are told by their first rows; every row then looks at one bound, so a key on many rows is sorted nowhere.
    """
    firsts = rows.where(F.col(source).isNotNull()).groupBy(key, source).agg(F.min(seq).alias("_at"))
    one = rows.groupBy(key).agg(F.min_by(source, seq).alias("_first"))
    bound = firsts.join(one, key).where(F.col(source) != F.col("_first")).groupBy(key).agg(F.min("_at").alias("_from"))
    return rows.join(bound, key, "left").withColumn("duplicate", F.coalesce(F.col(seq) >= F.col("_from"), F.lit(False))).select(*rows.columns, "duplicate")


def without(rows: DataFrame, *seen: tuple[DataFrame, str, str]) -> DataFrame:
    """Rows that none of the tables knows: (table, its column, column of rows)."""
    return reduce(lambda d, s: d.join(s[0].select(F.col(s[1]).alias(s[2])).distinct(), s[2], "left_anti"), seen, rows)


def cached(rows: DataFrame, cache: DataFrame, key: str, fetched: str, ttl_hours: str, now: Column) -> DataFrame:
    """Rows with hit: whether the cache has an entry of this key that is still good."""
    good = cache.where(now <= F.col(fetched) + F.make_dt_interval(F.lit(0), F.col(ttl_hours))).select(key).distinct().withColumn("hit", F.lit(True))
    return rows.join(good, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def align(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Additive evolution: missing text columns come as null, missing numbers as 0; nothing is dropped."""
    for name, kind in columns.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind) if kind == "string" else F.lit(0).cast(kind))
    return rows
