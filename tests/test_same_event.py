"""One event or not: cases, and groups against a walk over all pairs."""

import random

from pyspark.sql import functions as F

from tidewire.operators import same_event
from tidewire.plans.news import QUERIES

STORY = "id long, title string, effective_at timestamp, strong boolean"
T = 1_700_000_000


def story(k, title, hours=0.0, strong=False):
    import datetime as dt

    return (k, title, None if hours is None else dt.datetime.fromtimestamp(T + int(hours * 3600), dt.UTC), strong)


def linked(spark, *titles):
    rows = [story(k, *(t if isinstance(t, tuple) else (t,))) for k, t in enumerate(titles)]
    return sorted(tuple(r) for r in same_event.links(spark.createDataFrame(rows, STORY)).collect())


def test_cases(spark):
    assert linked(spark, "Wildfire in Canada forces evacuation near Kelowna", "Canada wildfire: Kelowna evacuation grows") == [(0, 1)]
    assert linked(spark, "Wildfire in Canada forces evacuation", "Wildfire in Spain forces evacuation") == []  # other places
    assert linked(spark, "Quake in Chile: 20,000 evacuated in Santiago", "Quake in Chile: 12,000 evacuated in Santiago") == []  # other numbers
    assert linked(spark, ("Strike kills Petro in Colombia", 0), ("Strike kills Petro in Colombia", 73)) == []  # too far apart
    assert linked(spark, ("Strike kills Petro in Colombia", 0), ("Strike kills Petro in Colombia", 71.9)) == [(0, 1)]
    assert linked(spark, ("Strike kills Petro in Colombia", None), ("Strike kills Petro in Colombia", 900)) == [(0, 1)]
    assert linked(spark, "Protest in Ukraine", "Summit in Ukraine") == []  # a name alone
    assert linked(spark, ("Summit on Ukraine", 0, True), ("Leaders in Ukraine at summit", 1, True)) == [(0, 1)]
    assert linked(spark, "", None, "one two", "one two") == []


def test_groups_equal_a_walk(spark):
    rng = random.Random(3)
    places, names, acts = ["Canada", "Spain", "Chile", "Japan"], ["Meta", "Petro", "Yagi", "Smith", "Jones"], ["wildfire", "flood", "strike kills", "summit", "protest", "arrest"]
    rows = []
    for k in range(160):
        title = f"Big {rng.choice(acts)} {rng.choice(['', rng.choice(acts)])} in {rng.choice(places)} with {rng.choice(names)} {rng.choice(['', 'and ' + rng.choice(names)])} {rng.choice(['', '200 people', '300 people', '4,500 jobs'])}"
        rows.append(story(k, title, rng.choice([None, *[rng.uniform(0, 400)] * 6]), rng.random() < 0.2))
    stories = spark.createDataFrame(rows, STORY)
    f = {r.id: r for r in same_event.features(stories).collect()}

    def one(a, b):
        if a.t is not None and b.t is not None and abs(a.t - b.t) > 72 * 3600:
            return False
        if any(u in b.units and b.units[u] != n for u, n in a.units.items()) or (a.places and b.places and not {*a.places} & {*b.places}):
            return False
        n, acts_ = len({*a.names} & {*b.names}), len({*a.actions} & {*b.actions})
        fact = bool({*a.facts} & {*b.facts}) or (a.sure and b.sure)
        alike = len({*a.words} & {*b.words}) / max(1, len({*a.words} | {*b.words})) if a.words and b.words else 0
        if n >= 2 and (acts_ or fact or alike >= 0.3):
            return True
        return n >= 1 and acts_ >= 1 and (acts_ >= 2 or fact or alike >= 0.15)

    want, heads = {}, []
    for k in sorted(f):
        head = next((h for h in heads if one(f[h], f[k])), None)
        if head is None:
            heads.append(k)
        want[k] = k if head is None else head
    got = {r.id: r.leader for r in same_event.groups(stories).collect()}
    assert got == want and 10 < len(heads) < 150


def test_query_reads_all_stories(spark):
    got = QUERIES["same_event_groups"](spark, "/root/testdata/sf0.001")
    assert got.count() == 200 and got.where(F.col("leader") > F.col("id")).isEmpty()
