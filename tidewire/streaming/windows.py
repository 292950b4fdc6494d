"""Event-time windows, deduplication and rolling counts; the same functions take streams and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def timed(rows: DataFrame, column: str = "ts", delay: str | None = "1 hour") -> DataFrame:
    """A timestamp that windows take; on a stream, with a watermark."""
    rows = rows.withColumn(column, F.col(column).cast("timestamp"))
    return rows.withWatermark(column, delay) if delay and rows.isStreaming else rows


def tumbling(rows: DataFrame, keys: list[str], length: str, slide: str | None = None, column: str = "ts", value: str = "value") -> DataFrame:
    span = F.window(column, length, slide) if slide else F.window(column, length)
    agg = timed(rows, column).groupBy(span.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return agg.select(F.unix_seconds("w.start").alias("start_s"), *keys, "n", "total")


def sessions(rows: DataFrame, key: str, gap: str, column: str = "ts") -> DataFrame:
    agg = timed(rows, column).groupBy(F.session_window(column, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return agg.select(key, F.unix_seconds("w.start").alias("start_s"), F.unix_seconds("w.end").alias("end_s"), "n")


def first_seen(stream: DataFrame, keys: list[str], delay: str, column: str = "ts") -> DataFrame:
    """Each key once within the delay; on a table, once."""
    rows = timed(stream, column, delay)
    return rows.dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def rolling(rows: DataFrame, key: str, channel: str, spans: dict[str, int], column: str = "ts") -> DataFrame:
    """(key, a count for each span): how many rows of the channel lie in the span's seconds up to and with each row. key: unique.

    Time is cut into spans. What a row counts lies in its own span, up to it, and in the one before, from a mark on that is set there for
    it; so a task holds one span of a channel, not the channel, and one pass serves all spans.
    """
    at = F.unix_seconds(F.col(column).cast("timestamp"))
    each = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(n).cast("long").alias("n")) for name, n in spans.items()))
    rows = rows.select(key, channel, at.alias("s"), F.explode(each).alias("span")).select(key, channel, "s", "span.*")
    own = F.struct(F.col("s").alias("s"), F.lit(1).alias("row"))
    mark = F.struct((F.col("s") - F.col("n")).alias("s"), F.lit(0).alias("row"))
    both = rows.select(key, channel, "name", "n", F.explode(F.array(own, mark)).alias("x")).select(key, channel, "name", "n", "x.*")
    both = both.withColumn("slot", F.floor(F.col("s") / F.col("n")))
    slot = Window.partitionBy(channel, "name", "slot")
    order = slot.orderBy("s")
    upto, before = F.sum("row").over(order.rangeBetween(Window.unboundedPreceding, 0)), F.coalesce(F.sum("row").over(order.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = both.withColumn("c", F.when(F.col("row") == 1, upto).otherwise(F.sum("row").over(slot) - before))
    return counted.groupBy(key).agg(*(F.sum(F.when(F.col("name") == name, F.col("c"))).alias(name) for name in spans))
