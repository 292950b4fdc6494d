"""Thin stories and their articles: each outcome, the cache over two runs, and the budget against a walk."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import enrichment

NOW = dt.datetime(2024, 5, 1, 12)
LONG = "The bridge over the river was closed on Monday after the flood."
MORE = "Engineers found cracks in three of its oldest pillars this week."
STORY = "id long, url string, title string, summary string, score int"
PAGE = "page_id long, url string, html string"


def page(*paragraphs):
    return "<!doctype html><html><body>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</body></html>"


def run(spark, stories, pages, cache=None, hours=0, **more):
    cache = spark.createDataFrame([], enrichment.CACHE) if cache is None else cache
    domains = spark.createDataFrame([("News.example",), ("b.example",)], "domain string")
    now = F.lit(NOW + dt.timedelta(hours=hours))
    out, after = enrichment.enriched(spark.createDataFrame(stories, STORY), spark.createDataFrame(pages, PAGE), cache, now, F.desc("score"), domains=domains, important=F.col("score") >= 5, **more)
    return {r.id: r for r in out.collect()}, after


def test_outcomes(spark):
    url = "https://www.news.example/"
    stories = [
        (1, url + "a", "Flood", "Short.", 9), (2, url + "a", "Flood", "Short.", 4), (3, None, "Flood", "Short.", 9), (4, url + "b", "Flood", LONG + " " + MORE, 9), (5, url + "live/x", "Flood", "", 9), (6, "https://other.example/x", "Flood", None, 9),
        (7, url + "wall", "Flood", "", 8), (8, url + "json", "Flood", "", 8), (9, url + "short", "Flood", "", 8), (10, url + "none", "Flood", "", 8), (11, url + "bare", None, None, 8), (12, url + "last", "Flood", "", 5), (13, "http://news.example.evil/x", "Flood", "", 9),
    ]
    pages = [(5, url + "a/?q=1", page(LONG, MORE)), (9, url + "a", "not this"), (1, url + "wall", page("Subscribe to continue reading this article about a bridge.")), (2, url + "json", '{"a": 1}'), (3, url + "short", page(LONG)), (4, url + "bare", page("x")), (6, url + "z", None), (7, None, None)]
    got, after = run(spark, stories, pages, budget=6)
    assert {k: r.outcome for k, r in got.items()} == {
        1: "ok", 2: "unimportant", 3: "no_url", 4: "full", 5: "non_article", 6: "domain_blocked", 7: "paywall", 8: "not_html", 9: "not_expanded", 10: "network_error", 11: "no_text", 12: "budget_exhausted", 13: "domain_blocked",
    }
    assert got[1].summary == LONG + " " + MORE and got[1].article_sentences == [LONG, MORE] and [k for k, r in got.items() if r.expanded] == [1] and got[9].summary == ""
    after = spark.createDataFrame(after.collect(), enrichment.CACHE)
    assert sorted((r.id, r.status, r.ttl_hours) for r in after.collect()) == [(1, "ok", 48), (7, "paywall", 24), (8, "not_html", 24), (9, "ok", 48), (10, "network_error", 24), (11, "no_text", 24)]
    # a day later: what is cached costs nothing, so the last one has its turn; errors are asked for again after their hours
    again, _ = run(spark, stories, [], after, hours=20, budget=1)
    assert again[1].outcome == "cached" and again[1].summary == LONG + " " + MORE and again[7].outcome == "cached_paywall" and again[9].outcome == "cached_ok" and not again[9].expanded and again[12].outcome == "network_error"
    later, _ = run(spark, stories, [], after, hours=25)
    assert later[1].outcome == "cached" and later[7].outcome == "network_error"
    with pytest.raises(ValueError, match="budget"):
        run(spark, stories, pages, budget=10_001)


def test_empty_tables(spark):
    got, after = run(spark, [], [])
    assert got == {} and after.count() == 0


@pytest.mark.parametrize(("budget", "per_host"), [(7, None), (12, 2), (0, 1)])
def test_budget_against_a_walk(spark, budget, per_host):
    rng = random.Random(budget)
    stories = [(k, f"https://{rng.choice('xyz')}.b.example/{k}", "t", "", rng.randint(3, 9)) for k in range(60)]
    got, _ = run(spark, stories, [], budget=budget, per_host=per_host)
    asked, hosts = set(), {}
    for k, url, _, _, score in sorted(stories, key=lambda s: (-s[4], s[0])):
        host = url.split("/")[2]
        if score >= 5 and len(asked) < budget and (per_host is None or hosts.get(host, 0) < per_host):
            asked.add(k)
            hosts[host] = hosts.get(host, 0) + 1
    assert {k for k, r in got.items() if r.outcome == "network_error"} == asked
    assert {k for k, r in got.items() if r.outcome == "budget_exhausted"} == {s[0] for s in stories if s[4] >= 5} - asked
