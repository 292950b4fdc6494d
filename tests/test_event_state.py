"""Wide states of events: every rule against a walk report by report, in one run and in several; the tables' columns."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import event_state as es

SCHEMA = "k long, seq long, word string, n long, flag boolean, tags array<string>, power double, extra string"
RULES = {
    "first": es.Keep("word"), "last": es.Newest("word"), "flagged": es.Newest("word", when="flag"), "long": es.Longest("word"), "most": es.Greatest("n"), "sum": es.Total("n"), "tags": es.Union("tags"), "words": es.Gather("word"),
    "late": es.Recent("word", 3), "best": es.Stronger(("word", "n"), "power", 2),
}


def some_reports(n, seed, keys=(1, 2, 3, None)):
    rng = random.Random(seed)
    words = ["a", "bb", "ccc", "ddd", "eeeee", "", None]
    tags = lambda: rng.choice([None, [], [rng.choice("xyz"), rng.choice(["x", None, ""])], ["w"]])
    return [(rng.choice(keys), k, rng.choice(words), rng.choice([None, 1, 5, 7]), rng.choice([True, False, None]), tags(), rng.choice([None, rng.random() * 30, float(rng.randint(0, 30))]), "e") for k in range(n)]


def walk(reports):
    out = {}
    for k, _, word, n, flag, tags, power, _ in sorted((r for r in reports if r[0] is not None), key=lambda r: r[1]):
        power = power or 0.0
        new = k not in out
        s = out.setdefault(k, {"first": word, "last": None, "flagged": None, "long": None, "most": None, "sum": 0, "tags": set(), "words": [], "late": [], "best": (word, n, power)})
        if word:
            s["last"] = word
            s["flagged"] = word if flag else s["flagged"]
            s["long"] = word if len(word) > len(s["long"] or "") else s["long"]
            s["words"] += [] if word in s["words"] else [word]
            s["late"] = [word, *s["late"]][:3]
        if n is not None:
            s["most"] = n if s["most"] is None else max(n, s["most"])
            s["sum"] += n
        s["tags"] |= {t for t in tags or () if t}
        if not new and power >= s["best"][2] + 2:
            s["best"] = (word, n, power)
    return {k: {**s, "tags": sorted(s["tags"])} for k, s in out.items()}


def seen(df):
    return {r.k: {**{f: r[f] for f in RULES}, "best": None if r.best is None else tuple(r.best)} for r in df.collect()}


@pytest.mark.parametrize("cuts", [(), (60,), (20, 21, 90)])
def test_rules_against_a_walk(spark, cuts):
    reports, stored, lo = some_reports(150, 5), None, 0
    for hi in (*cuts, 150):
        now = spark.createDataFrame(reports[lo:hi], SCHEMA)
        stored = es.accumulated(now, "k", "seq", RULES, stored)
        stored = spark.createDataFrame(stored.collect(), stored.schema)
        lo = hi
    assert seen(stored) == walk(reports)


def test_odd_reports(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert es.accumulated(none, "k", "seq", RULES).count() == 0
    stored = es.accumulated(spark.createDataFrame(some_reports(20, 1), SCHEMA), "k", "seq", RULES)
    assert seen(es.accumulated(none, "k", "seq", RULES, stored)) == seen(stored)
    # a column that came later, a report without anything, a very long text
    now = spark.createDataFrame([(7, None, None, None, None, None, None, None), (1, 99, "z" * 1_000_000, 1, True, ["q"], 99.0, "e")], SCHEMA)
    got = seen(es.accumulated(now, "k", "seq", RULES, stored.drop("late", "best", "sum")))
    assert got[7] == {"first": None, "last": None, "flagged": None, "long": None, "most": None, "sum": 0, "tags": [], "words": [], "late": [], "best": (None, None, 0.0)}
    assert len(got[1]["long"]) == 1_000_000 and got[1]["sum"] == 1 and got[1]["late"] == ["z" * 1_000_000] and got[1]["best"][2] == 99.0


def test_event_rows(spark):
    assert [len(c) for c in (es.STORY_COLUMNS, es.EVENT_COLUMNS, es.HEALTH_COLUMNS)] == [22, 19, 21]
    base = {**{c: "" for c in ("category", "sector", "subsector", "region", "subregion", "country", "event_time", "verification", "status")}, "queued": 1}
    first = {**base, "event_id": "e", "seq": 1, "at": "2024-01-01T00:00:00", "title": "Quake", "summary": "A quake.", "source": "A", "strength": 4.0, "major": 0, "development": True, "entities": ["lyon"]}
    later = {**first, "seq": 2, "at": "2024-01-02T00:00:00", "title": "Quake kills two", "summary": "Two died.", "source": "B", "strength": 9.0, "major": 1, "development": False, "entities": ["nice"], "sector": "climate"}
    rows = spark.createDataFrame([first, later]).withColumn("identity", F.struct("title", "entities")).withColumns({g: F.array().cast("array<string>") for g in es.GATHERED if g != "entities"})
    got = es.event_rows(es.event_state(rows)).first()
    assert list(got.asDict()) == list(es.EVENT_COLUMNS)
    assert (got.canonical_title, got.sector, got.major, got.queued_count, got.first_seen[:10], got.last_seen[:10], got.last_development[:10]) == ("Quake kills two", "climate", 1, 2, "2024-01-01", "2024-01-02", "2024-01-01")
    kept = json.loads(got.canonical_state)
    assert kept["identity"]["title"] == "Quake" and kept["identity"]["entities"] == ["lyon"] and json.loads(got.entities) == ["lyon", "nice"] and json.loads(got.related_sources) == ["A", "B"] and kept["titles"] == ["Quake kills two", "Quake"]


def test_columns_that_came_later(spark):
    old = spark.createDataFrame([("s", "Name", "mine")], "source_id string, source_name string, own string")
    got = es.aligned(old, es.HEALTH_COLUMNS)
    assert got.columns == [*es.HEALTH_COLUMNS, "own"] and got.first().attempt_count == 0 and got.first().last_error is None and got.first().own == "mine"
