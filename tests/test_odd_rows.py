"""Queries on odd rows of small tables, held against their SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewire.operators import similarity
from tidewire.plans.news import ORACLE_SQL, QUERIES


@pytest.fixture
def held(spark, tmp_path):
    """Runs a query on rows of a table and compares it with its SQL."""

    def run(name: str, table: str, columns: str, rows: list[tuple]) -> list[tuple]:
        spark.createDataFrame(rows, columns).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        con = duckdb.connect()
        con.execute(f"create or replace view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
        cur = con.execute(ORACLE_SQL[name])
        cols = [c[0] for c in cur.description]
        want = sorted(cur.fetchall(), key=repr)
        got = sorted((tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*cols).collect()), key=repr)
        assert got == want
        return got

    return run


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
HEADS = ["ßheit kommt", "ﬁne weather", "ŉ dag", "ᾳ and more", "ǆ first", "élan vital", "", "ä", " 7 days", "live: ßa | b"]
HEADED = [(k, f"{h}\nRest of it.", "de", "a", 9) for k, h in enumerate(HEADS)] + [(99, None, "de", "a", 0)]


def test_clean_headlines_of_letters_whose_capital_takes_several(held):
    got = dict(held("clean_headlines", "documents", DOCS, HEADED))
    assert (got[0], got[1], got[9]) == ("ẞheit kommt", "ﬁne weather", "ẞa | b")


def test_headline_html_of_letters_whose_capital_takes_several(held):
    got = {i: headline for i, _, headline in held("headline_html", "documents", DOCS, HEADED)}
    assert (got[0], got[2], got[3]) == ("ẞheit kommt", "ŉ dag", "ᾼ and more")


def test_meaningful_sentences_around_abbreviations(held):
    texts = ["We met Dr. Smith of the town. He left at 5 p.m. on Jan. 5 of that year!", "One two three four.\x0bFive six seven eight. Nine ten eleven twelve", "U.S. troops came to town. U.S. troops came to town.", "No. Not so", ""]
    rows = [(k, turn, "user", t) for k, t in enumerate(texts) for turn in (0, 1)] + [(9, 0, "user", None)]
    assert dict(held("meaningful_sentence_count", "conversations", "conv_id long, turn long, role string, text string", rows))[0] == 3


TITLES = ["red cat sat on mats", "sat on mats red cat", "red cat sat on big mats", "blue dog ran far", "red cat sat on mats", "one two", "one two", "", "Red cat, sat: on mats", "blue dog ran far off now", "red cat sat on big mats once"]
TITLED = [(k, f"{t}\nRest of it.", "de", "abc"[k % 3] if k != 4 else None, 9) for k, t in enumerate(TITLES)]


def test_corroboration_of_copies(held, spark):
    held("corroboration_selfjoin", "documents", DOCS, TITLED)
    # 30,000 copies are 900 million pairs, and one set
    many = spark.range(30_000).select("id", F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("source"), F.lit(1).alias("tier"), F.array(*map(F.lit, "wxyz")).alias("tokens"))
    got = similarity.corroborate(many).groupBy("corroborating", "strong", "matches").count().collect()
    assert sorted(map(tuple, got)) == [(1, 1, 10_000, 20_000), (1, 1, 20_000, 10_000)]


def test_near_duplicate_titles_with_copies(held):
    got = held("near_duplicate_titles", "documents", DOCS, TITLED)
    assert {(a, b) for a, b, _ in got} == {(0, 1), (0, 4), (0, 8), (0, 2), (2, 10)}


def test_leader_groups_with_copies(held, spark, tmp_path):
    got = dict(held("leader_groups", "documents", DOCS, TITLED))
    assert (got[8], got[9], got[10]) == (0, 9, 10)
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("Rain falls on towns.\nMore.").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(9).alias("n_chars"))
    rows.write.parquet(f"{tmp_path}/many/documents.parquet")
    assert [tuple(r) for r in QUERIES["leader_groups"](spark, f"{tmp_path}/many").groupBy("leader").count().collect()] == [(0, 30_000)]


def test_first_place_makes_its_words_once(spark):
    found = QUERIES["first_place_mention"](spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1


def test_hygienic_sentences_are_cleaned_once(spark):
    found = QUERIES["hygienic_sentences"](spark, "/root/testdata/sf0.001")
    node = found._jdf.queryExecution().optimizedPlan()
    assert found.columns == ["page_id", "pos", "sentence", "filler"]
    assert not [n for n in node.toString().split("\n") if n.strip(" :+-").startswith("Filter") and n.count("regexp_replace(") > 2]


def test_alike_pairs_are_told_where_they_meet(spark, monkeypatch):
    rng = random.Random(4)
    sets = [(k, sorted(rng.sample("abcdefghijkl", rng.randint(1, 7))), k % 3) for k in range(70)]
    monkeypatch.setattr(similarity, "_DEALT", 5, raising=False)
    found = similarity.similar_pairs(spark.createDataFrame(sets, "id long, tokens array<string>, x int"), 0.38, extra=("x",))
    jac = lambda x, y: len({*x} & {*y}) / len({*x} | {*y})
    want = sorted((a, b, jac(s, t), x, y) for a, s, x in sets for b, t, y in sets if a < b and jac(s, t) >= 0.38)
    assert sorted((r.a, r.b, r.similarity, r.a_x, r.b_x) for r in found.collect()) == want and len(want) > 100
    # the last join is the one by token: pairs are shuffled to no further one
    plan = found._jdf.queryExecution().sparkPlan().toString().split("\n")
    assert "token" in next(line for line in plan if "Join" in line)
