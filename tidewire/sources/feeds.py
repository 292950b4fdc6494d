"""The feed scan: landed feed files in, recent items and each feed's health out; RSS and Atom, as a table or a stream.

A job outside lands each fetch of a feed as a file; fetching itself needs a network and is no part of this. Files are rows (feed, content) of Spark's binary files, so a file is
a row of its own, files are read in parallel, and a stream of a folder keeps track of those it has seen. A file is parsed as it is read, item by item, to the `limit`-th; times are
told in Python there, and all that is judged by them (skew, age) in built-in functions. One scan gives items and health: a row a file holds both.

Defined results: a file that ends or breaks in the middle gives the items before the break, and an error only if there are none; without content it has an error; items without title or link, or
without a time, aren't recent; a time ahead of now by `skew_minutes` at most becomes now; equal items of one file are items each; a feed that the table of feeds doesn't know keeps its items with nulls
and tier 4; an empty folder gives no rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean

ITEM = "struct<title:string, url:string, summary:string, published:timestamp, updated:timestamp>"
#: The elements of RSS, RDF and Atom that hold an item, and what it says, the first that has a text.
ITEMS = ("item", "entry")
FIELDS = {
    "title": ("title",), "summary": ("summary", "description", "content", "encoded"),
    "published": ("pubDate", "published", "issued", "date"), "updated": ("updated", "modified"),
}


def time_of(text: str | None) -> datetime | None:
    """A time by RFC 2822 or ISO 8601, in UTC; without a zone it is UTC. None for anything else."""
    text = (text or "").strip()
    for parse in (datetime.fromisoformat, parsedate_to_datetime):
        try:
            t = parse(text)
            return (t if t.tzinfo else t.replace(tzinfo=UTC)).astimezone(UTC)
        except (ValueError, TypeError, OverflowError):
            continue
    return None


def _item(element: ElementTree.Element) -> dict:
    found: dict[str, list[ElementTree.Element]] = {}
    for child in element:
        found.setdefault(child.tag.rpartition("}")[2], []).append(child)
    said = lambda names: next((t for n in names for e in found.get(n, []) if (t := "".join(e.itertext()).strip())), None)
    links = [e.get("href") or (e.text or "").strip() for e in found.get("link", []) if e.get("rel", "alternate") == "alternate"]
    texts = {name: said(names) for name, names in FIELDS.items()}
    return {"title": texts["title"], "url": next((x for x in links if x), None), "summary": texts["summary"], "published": time_of(texts["published"]), "updated": time_of(texts["updated"])}


def parse(content: bytes | None, limit: int) -> tuple[list[dict], int, str | None]:
    """The first `limit` items of a feed, how many it has in all, and what is wrong with it."""
    if not content:
        return [], 0, "no content"
    items, seen = [], 0
    try:
        for _, element in ElementTree.iterparse(io.BytesIO(content)):
            if element.tag.rpartition("}")[2] in ITEMS:
                seen += 1
                if seen <= limit:
                    items.append(_item(element))
                element.clear()
    except ElementTree.ParseError as e:
        return items, seen, None if items else str(e)
    return items, seen, None


def landed(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """(feed, content) of the files <folder>/<feed>/<fetch>.xml."""
    reader = (spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read).format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", True)
    return reader.load(folder).select(F.url_decode(F.element_at(F.split("path", "/"), -2)).alias("feed"), "content")


def scan(files: DataFrame, now: Column, *, limit: int = 25, max_age_hours: int = 48, skew_minutes: int = 15) -> DataFrame:
    """(feed, entries_seen, error, items): a row for each file, with its recent items (title, url, summary, published, updated, effective)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # a file at a time: batches may be large
                items, seen, error = parse(b.column("content")[k].as_py(), limit)
                times = pa.timestamp("us", tz="UTC")
                kind = pa.list_(pa.struct([("title", pa.string()), ("url", pa.string()), ("summary", pa.string()), ("published", times), ("updated", times)]))
                yield pa.RecordBatch.from_arrays([b.column("feed")[k : k + 1], pa.array([seen], pa.int64()), pa.array([error], pa.string()), pa.array([items], kind)], ["feed", "entries_seen", "error", "items"])

    parsed = files.select("feed", "content").mapInArrow(run, f"feed string, entries_seen long, error string, items array<{ITEM}>")
    skew, age = F.expr(f"INTERVAL {skew_minutes} MINUTES"), F.expr(f"INTERVAL {max_age_hours} HOURS")

    def told(x: Column) -> Column:
        when = F.greatest(x["published"], x["updated"])  # greatest() leaves nulls out
        effective = F.when((when > now) & (when <= now + skew), now).otherwise(when)
        text = lambda c: clean(F.coalesce(c, F.lit("")))
        return F.struct(text(x["title"]).alias("title"), F.coalesce(x["url"], F.lit("")).alias("url"), F.left(text(x["summary"]), F.lit(700)).alias("summary"), x["published"].alias("published"), x["updated"].alias("updated"), effective.alias("effective"))

    recent = lambda x: F.coalesce((x["title"] != "") & (x["url"] != "") & x["effective"].between(now - age, now), F.lit(False))
    return parsed.withColumn("items", F.filter(F.transform("items", told), recent))


def items(scanned: DataFrame, feeds: DataFrame) -> DataFrame:
    """A row for each recent item, with what the table of feeds (name, category, tier, region, primary, discovery) says of its source."""
    known = feeds.select(F.col("name").alias("feed"), F.col("category").alias("source_category"), "tier", "region", F.col("primary").alias("primary_source"), "discovery").dropDuplicates(["feed"])
    rows = scanned.select("feed", F.inline("items")).join(known, "feed", "left")
    return rows.select(F.col("feed").alias("source"), "title", "url", "summary", "published", "updated", "effective", "source_category", F.coalesce("tier", F.lit(4)).alias("tier"), "region", F.coalesce("primary_source", F.lit(False)).alias("primary_source"), F.coalesce("discovery", F.lit(False)).alias("discovery"))


def health(scanned: DataFrame) -> DataFrame:
    """(source, files, entries_seen, recent_entries, failed, error) of each feed; error is that of one of its failed files."""
    return scanned.groupBy(F.col("feed").alias("source")).agg(F.count(F.lit(1)).alias("files"), F.sum("entries_seen").alias("entries_seen"), F.sum(F.size("items")).cast("long").alias("recent_entries"), F.count("error").alias("failed"), F.min("error").alias("error"))


# ---------------------------------------------------------------- feeds out of stories


def _xml(c: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")
    return F.replace(F.replace(F.replace(bare, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def files_of(stories: DataFrame, feed: Column, file: Column, atom: Column) -> DataFrame:
    """(feed, content): stories (title, url, summary, effective_at, order) as feed files, one for each (feed, file), in RSS or Atom."""
    when = F.col("effective_at").cast("timestamp")
    rss = F.concat(F.lit("<item><title>"), _xml(F.col("title")), F.lit("</title><link>"), _xml(F.col("url")), F.lit("</link><description>"), _xml(F.col("summary")), F.lit("</description><pubDate>"), F.date_format(when, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate></item>"))
    entry = F.concat(F.lit("<entry><title>"), _xml(F.col("title")), F.lit('</title><link href="'), _xml(F.col("url")), F.lit('"/><summary>'), _xml(F.col("summary")), F.lit("</summary><updated>"), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z</updated></entry>"))
    rows = stories.select(feed.alias("feed"), file.alias("file"), atom.alias("atom"), F.struct("order", F.when(atom, entry).otherwise(rss).alias("x")).alias("e"))
    made = rows.groupBy("feed", "file", "atom").agg(F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["x"]), "").alias("x"))
    whole = F.when(F.col("atom"), F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), "x", F.lit("</feed>"))).otherwise(F.concat(F.lit('<rss version="2.0"><channel><title>feed</title>'), "x", F.lit("</channel></rss>")))
    return made.select("feed", F.encode(whole, "UTF-8").alias("content"))
