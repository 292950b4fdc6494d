"""Candidates for posts, shortlists of a run, and the audit's advice: odd rows, and queries against their SQL."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewire.operators import audit, ranking
from tidewire.plans.news import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
NOW = dt.datetime(2024, 5, 10, 12, 0)


def test_postable(spark):
    rows = [(k, s, None if h is None else NOW - dt.timedelta(hours=h)) for k, s, h in [(1, "a", 1), (2, "a", 6), (3, "a", 6.01), (4, "a", -0.1), (5, "press", 1), (6, None, 2), (7, "a", None), (8, "a", 1)]]
    stories = spark.createDataFrame(rows, "id long, source string, effective_at timestamp_ntz")
    not_news = spark.createDataFrame([("press",), (None,), ("press",)], "source string")
    assert [r.id for r in ranking.postable(stories, F.lit(NOW), not_news).collect()] == [1, 8, 6, 2]
    assert [r.id for r in ranking.postable(stories, F.lit(NOW), not_news, most=2).collect()] == [1, 8]
    assert ranking.postable(stories.limit(0), F.lit(NOW), not_news).count() == 0


def test_shortlists(spark):
    rows = spark.createDataFrame([(k, kind, k % 3) for k, kind in enumerate(["a"] * 10 + ["b"] * 2 + [None] * 3 + ["c"] * 2)], "id long, kind string, score long")
    got = sorted((r.kind, r.place, r.id) for r in ranking.shortlists(rows, "kind", {"a": 3, "b": 5}, F.desc("score"), F.asc("id")).collect())
    assert got == [("a", 1, 2), ("a", 2, 5), ("a", 3, 8), ("b", 1, 11), ("b", 2, 10)]


def test_advice(spark):
    rows = [("down", 4, 1, 9, 9, 0), ("young", 2, 0, 9, 9, 0), ("silent", 4, 4, 0, 0, 0), ("unused", 4, 4, 5, 0, 0), ("repeats", 4, 4, 10, 9, 5), ("weak", 4, 4, 10, 1, 0), ("good", 4, 4, 10, 9, 0), ("new", 0, 0, None, 2, None)]
    sources = spark.createDataFrame(rows, "name string, attempts long, successes long, fetched long, useful long, duplicates long")
    got = {r["name"]: (r.advice, r.place) for r in audit.contributions(sources).collect()}
    assert {k: v[0] for k, v in got.items()} == {"down": "unreachable", "young": "keep", "silent": "silent", "unused": "unused", "repeats": "mostly repeats", "weak": "weak", "good": "keep", "new": "keep"}
    assert {k: v[1] for k, v in got.items()} == {"down": 1, "young": 1, "repeats": 1, "good": 1, "new": 5, "weak": 6, "silent": 7, "unused": 7}


@pytest.mark.parametrize("name", ["post_candidates", "run_shortlists", "article_classes", "source_contributions"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(str, cur.fetchall()))
