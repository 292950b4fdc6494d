"""The feed scan: RSS, RDF and Atom, odd files, recency, health, and the stream."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewire.plans.news import ORACLE_SQL, QUERIES
from tidewire.sources import feeds

NOW = dt.datetime(2024, 5, 10, 12, 0, tzinfo=dt.UTC)
RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>A feed</title>
<item><title>One &lt;b&gt;bold&lt;/b&gt;</title><link>https://a/1</link><description>Text &amp; more</description><pubDate>Fri, 10 May 2024 09:00:00 +0200</pubDate></item>
<item><title>Ahead by ten minutes</title><link>https://a/2</link><pubDate>Fri, 10 May 2024 12:10:00 GMT</pubDate></item>
<item><title>Ahead by an hour</title><link>https://a/3</link><pubDate>Fri, 10 May 2024 13:00:00 GMT</pubDate></item>
<item><title>Old</title><link>https://a/4</link><pubDate>Tue, 07 May 2024 12:00:00 GMT</pubDate></item>
<item><title>No time</title><link>https://a/5</link></item>
<item><title></title><link>https://a/6</link><dc:date>2024-05-10T10:00:00Z</dc:date></item>
<item><title>By ISO</title><link>https://a/7</link><dc:date>2024-05-10T10:00:00+01:00</dc:date></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">Atom</title><link rel="self" href="https://b/self"/><link rel="alternate" href="https://b/1"/><summary>S</summary>
<published>2024-05-09T10:00:00Z</published><updated>2024-05-10T08:30:00Z</updated></entry></feed>"""


def files(spark):
    rows = [("a", RSS.encode()), ("b", ATOM.encode()), ("c", b""), ("d", b"<rss><item><title>x</title>"), ("e", ATOM.encode().replace(b"</feed>", b"<entry><broken")), ("f", None)]
    return spark.createDataFrame(rows, "feed string, content binary")


def test_scan(spark):
    got = {r.feed: r for r in feeds.scan(files(spark), F.lit(NOW)).collect()}
    said = {k: [(i.title, i.url, i.effective.replace(tzinfo=dt.UTC)) for i in r["items"]] for k, r in got.items()}
    at = lambda *x: dt.datetime(2024, 5, 10, *x, tzinfo=dt.UTC)
    assert said["a"] == [("One bold", "https://a/1", at(7)), ("Ahead by ten minutes", "https://a/2", NOW), ("By ISO", "https://a/7", at(9))]
    assert said["b"] == said["e"] == [("Atom", "https://b/1", at(8, 30))] and said["c"] == said["d"] == said["f"] == []
    assert {k: r.entries_seen for k, r in got.items()} == {"a": 7, "b": 1, "c": 0, "d": 0, "e": 1, "f": 0}
    assert {k for k, r in got.items() if r.error} == {"c", "d", "f"}
    assert [len(r["items"]) for r in feeds.scan(files(spark).where("feed = 'a'"), F.lit(NOW), limit=2).collect()] == [2]


def test_items_and_health(spark):
    known = spark.createDataFrame([("a", "world", 1, "eu", True, None), ("a", "twice", 2, "eu", True, None)], "name string, category string, tier int, region string, primary boolean, discovery boolean")
    scanned = feeds.scan(files(spark), F.lit(NOW))
    rows = {(r.source, r.url): (r.tier, r.primary_source, r.discovery) for r in feeds.items(scanned, known).collect()}
    assert len(rows) == 5 and rows[("b", "https://b/1")] == (4, False, False) and rows[("a", "https://a/1")][1:] == (True, False)
    health = {r.source: (r.files, r.entries_seen, r.recent_entries, r.failed) for r in feeds.health(scanned).collect()}
    assert health == {"a": (1, 7, 3, 0), "b": (1, 1, 1, 0), "c": (1, 0, 0, 1), "d": (1, 0, 0, 1), "e": (1, 1, 1, 0), "f": (1, 0, 0, 1)}


def test_landed_files_as_table_and_stream(spark, tmp_path):
    for name, x in (("a", RSS), ("b%20c", ATOM)):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "1.xml").write_text(x)
        (tmp_path / "in" / name / "notes.txt").write_text("no feed")
    want = sorted((r.feed, len(r["items"])) for r in feeds.scan(feeds.landed(spark, str(tmp_path / "in")), F.lit(NOW)).collect())
    assert want == [("a", 3), ("b c", 1)]
    stream = feeds.scan(feeds.landed(spark, str(tmp_path / "in"), stream=True), F.lit(NOW))

    def run():
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    (tmp_path / "in" / "a" / "2.xml").write_text(RSS)
    run()  # only the new file
    assert sorted((r.feed, len(r["items"])) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 3), ("a", 3), ("b c", 1)]


@pytest.mark.parametrize("name", ["feed_items", "feed_health"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    cur = con.execute(ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(str, cur.fetchall()))
