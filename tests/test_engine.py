"""The engine's operators on small tables of our own."""

from collections import deque
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewire.functions import score as sc
from tidewire.functions import text as tx
from tidewire.operators import audit, matching, similarity, tables
from tidewire.plans.queries import ORACLE_SQL, QUERIES
from tidewire.streaming import emission, windows

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text(spark):
    assert one(spark, tx.clean(F.lit(" <b>a</b>\n  c "))) == "a c"
    assert one(spark, tx.sentences(F.lit("Dr. Roe spoke. It rained! Why?  Yes"))) == ["Dr. Roe spoke.", "It rained!", "Why?", "Yes"]
    assert one(spark, tx.numbers(F.lit("1,200 of 3.5. and 3.5"))) == ["1200", "3.5"]
    assert one(spark, tx.escape_attribute(F.lit('a<"&'))) == "a&lt;&quot;&amp;"
    assert one(spark, tx.visible_length(F.lit("a&amp;日"))) == 4
    assert one(spark, tx.clean_headline(F.lit("LIVE: flood in town - The Guardian"))) == "Flood in town"
    assert one(spark, tx.near_number(F.array(*map(F.lit, "flood kills 12 and 9 others".split())), ["kills"])) == 12
    assert one(spark, tx.registrable(F.lit("news.example.org"))) == "example.org"


def test_scores(spark):
    text = F.lit("explosion and attack")
    assert one(spark, sc.story_score(text, F.lit("s" * 180), F.lit(1), F.lit(True), F.lit(False), ["attack", "explosion"])) == 100
    assert one(spark, sc.story_score(text, F.lit(""), F.lit(1), F.lit(False), F.lit(True), ["attack"])) == 43
    none = F.lit(0)
    assert one(spark, sc.impact(F.lit(7.4), F.lit(281), none, none, none, none, F.lit(False), F.lit(False))) == 26.0
    assert one(spark, sc.impact(F.lit(0.0), none, none, none, none, none, F.lit(False), F.lit(True))) == 18.0


def test_similar_pairs_is_exact(spark):
    import random

    random.seed(3)
    sets = {k: sorted({random.choice("abcdefghij") for _ in range(random.randint(1, 7))}) for k in range(60)}
    rows = spark.createDataFrame([*sets.items(), (99, [])], "id long, tokens array<string>")
    for t in (0.38, 0.8, 1.0):
        got = {(r.a, r.b) for r in similarity.similar_pairs(rows, t).collect()}
        assert got == {(a, b) for a, b in combinations(sets, 2) if len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) >= t}


def test_tables(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, t int")
    assert sorted(map(tuple, tables.latest_wins(old, new, "k", [F.desc("t")]).collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", 2)]
    dup = spark.createDataFrame([("x", "s1", 1), ("x", "s1", 2), ("x", "s2", 3), ("x", "s1", 4)], "key string, src string, seq int")
    assert [r.duplicate for r in tables.cross_source_duplicates(dup, "key", "src", "seq").orderBy("seq").collect()] == [False, False, True, True]
    assert tables.align(old, {"note": "string", "n": "int"}).first()[3:] == (None, 0)
    empty = spark.createDataFrame([], "name string, v long")
    assert audit.concentration(empty, "name", "v").first().hhi is None


SIDE = "id string, event_id string, source string, discovery boolean, dev boolean, reaction boolean, " + ", ".join(f"{c} array<string>" for c in ("entities", "places", "actions", "core", "numbers", "impact", "storms", "magnitudes", "tokens", "title_tokens"))


def side(key, source="A", discovery=False, dev=False, **sets):
    names = ("entities", "places", "actions", "core", "numbers", "impact", "storms", "magnitudes", "tokens", "title_tokens")
    return (key, key, source, discovery, dev, False, *(sets.get(n, []) for n in names))


def test_decide(spark):
    quake = side("e1", places=["chile"], core=["earthquake"], impact=["100:killed"], tokens=["quake", "kills", "chile"])
    other = side("e2", places=["japan"], core=["flood"], tokens=["flood", "japan"])
    events = spark.createDataFrame([quake, other], SIDE).drop("id")
    stories = spark.createDataFrame(
        [
            side("same", "A", places=["chile"], core=["earthquake"], impact=["100:killed"], tokens=["chile"]),
            side("more", "B", places=["chile"], core=["earthquake"], impact=["100:killed", "7:missing"], tokens=["chile"]),
            side("again", "B", places=["chile"], core=["earthquake"], impact=["100:killed"], tokens=["chile"]),
            side("veto", "B", places=["peru"], core=["earthquake"], impact=["100:killed"], tokens=["peru"]),
            side("thin", "B", discovery=True, tokens=["x"]),
        ],
        SIDE,
    ).drop("event_id")
    got = {r.id: (r.status, r.event_id) for r in matching.decide(stories, events, spark.createDataFrame([("e1", "A")], "event_id string, source string")).collect()}
    assert got == {"same": ("DUPLICATE", "e1"), "more": ("UPDATE", "e1"), "again": ("DUPLICATE", "e1"), "veto": ("NEW", None), "thin": ("HELD", None)}


def test_emission_limits():
    assert emission.allowed([0, 30, 60, 119, 120], deque(), 60, 20, 150) == [True, False, True, False, True]
    assert sum(emission.allowed([60.0 * k for k in range(60)], deque(), 60, 20, 150)) == 20


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    want = {tuple(r) for r in windows.tumbling(events, ["event_type"], "6 hours").drop("total").collect()}
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windows.tumbling(stream, ["event_type"], "6 hours").drop("total").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("w").collect()} == want


def test_titles_are_duplicates_as_a_whole(spark, tmp_path):
    rows = [(1, "Storm hits coast.", "a"), (2, "Storm hits inland.", "b"), (3, "STORM -- hits coast!", "b"), (4, "Storm hits inland.", "b"), (5, "Storm hits coast.", "a")]
    spark.createDataFrame([(*r, "en", len(r[1])) for r in rows], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["cross_source_title_dedup"](spark, str(tmp_path)).collect())
    assert got == [(1, False), (2, False), (3, True), (4, False), (5, True)]


@pytest.mark.parametrize("name", ["corroboration_selfjoin", "topic_argmax", "importance_rank", "source_concentration", "cross_source_title_dedup", "session_windows", "coverage_grouping_sets"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    want = sorted(map(str, (tuple(dict(zip(cols, r))[c] for c in sorted(cols)) for r in cur.fetchall())))
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(str(tuple(r[c] for c in sorted(cols))) for r in df.collect()) == want
