"""Adapters from stored tables to the engine's model: stories, feeds, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stories: the first line (else the first sentence) is the title, 700 characters of the rest the summary."""
    d = table(spark, sf_dir, "documents")
    line = F.contains("text", F.lit("\n"))
    head = F.when(line, F.substring_index("text", "\n", 1)).otherwise(F.regexp_extract("text", r"^[^.!?]*[.!?]?", 0))
    rest = F.expr("substring(text, length(head) + 1)")
    d = d.withColumn("head", head)
    return d.select(
        F.col("doc_id").alias("id"),
        clean(F.col("head")).alias("title"),
        F.left(clean(rest), F.lit(700)).alias("summary"),
        "source",
        "lang",
        (F.col("doc_id") % 4 + 1).cast("int").alias("tier"),
        (F.col("doc_id") % 4 == 0).alias("primary_source"),
    )


def with_times(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Stories with effective_at: the time of the event of the same number."""
    return rows.join(events.select(F.col("event_id").alias("id"), F.col("ts").alias("effective_at")), "id")


def rss_items(spark: SparkSession, path: str, feed: str, limit: int = 25) -> DataFrame:
    """The first `limit` items of a stored RSS file. For fetched feeds, a job lands the files and this reads them."""
    from pyspark.sql import Window

    schema = "title string, link string, description string, pubDate string"
    rows = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path).withColumn("pos", F.monotonically_increasing_id())
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(F.input_file_name()).orderBy("pos"))).where(F.col("n") <= limit)
    when = F.try_to_timestamp(F.col("pubDate"), F.lit("EEE, d MMM yyyy HH:mm:ss Z"))
    rows = rows.select(F.lit(feed).alias("source"), clean(F.col("title")).alias("title"), F.col("link").alias("url"), F.left(clean(F.col("description")), F.lit(700)).alias("summary"), when.alias("published_at"))
    return rows.where("title <> '' and url <> ''")


def feeds(spark: SparkSession, path: str) -> DataFrame:
    """The feed dimension from a JSON document with a list `feeds`."""
    doc = spark.read.option("multiLine", True).schema("feeds array<struct<name:string,url:string,category:string,tier:int,region:string,type:string,language:string,primary:boolean,news:boolean,discovery:boolean>>").json(path)
    return doc.select(F.inline("feeds"))
