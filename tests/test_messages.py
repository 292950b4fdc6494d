"""Messages, media and sentence checks on small cases."""

import pytest
from pyspark.sql import functions as F

from tidewire.functions import pages, render, summary
from tidewire.functions import text as tx
from tidewire.operators import ranking
from tidewire.plans.queries import QUERIES


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def texts(*parts):
    return F.array(*map(F.lit, parts))


def test_message(spark):
    args = F.lit("NEWS"), F.lit("Flood & fire")
    rest = F.lit("Wire"), F.lit('https://e.org/?a="1"')
    long = texts("One is here.", "Two is here.", "Three is here.")
    full = one(spark, render.message(*args, long, *rest, 500))
    assert full == 'NEWS\n\n<b>Flood &amp; fire</b>\n\nOne is here. Two is here. Three is here.\n\nSource: Wire\n\n<a href="https://e.org/?a=&quot;1&quot;">Read more</a>'
    assert "Three" not in one(spark, render.message(*args, long, *rest, 80)) and "Two" in one(spark, render.message(*args, long, *rest, 80))
    assert one(spark, render.message(*args, texts("One."), *rest, 500)) is None
    none = F.lit(None).cast("string")
    assert one(spark, render.message(none, F.lit("H"), texts("A.", "B."), none, F.lit(""), 99)) == "<b>H</b>\n\nA. B."


def test_messages_take_whole_texts_of_all_turns(spark, tmp_path):
    long = "This first sentence is longer than sixty characters, so that a cut would show at once. Second <one>. Third."
    rows = [(1, 1, long), (1, 2, "Fourth."), (2, 5, "Late one. Late two."), (3, 1, "Only one."), (4, 6, "B & b."), (4, 2, "A."), (4, 7, "word " * 60 + "end. More."), (5, 1, None)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in QUERIES["messages_under_budget"](spark, str(tmp_path)).collect()}
    body = lambda k: got[k].message.split("\n\n")[2]
    assert set(got) == {1, 2, 4} and body(1) == long.replace("<one>", "&lt;one&gt;") + " Fourth." and body(2) == "Late one. Late two." and body(4) == "A. B &amp; b."


@pytest.mark.parametrize("budget", range(20, 90, 7))
def test_message_takes_the_most_that_fits(spark, budget):
    parts = ["A & b.", "日本 x.", "<i>.", "Four five six.", "&amp;.", "Seven."]
    whole = lambda k: render.message(F.lit("NEWS"), F.lit("H"), texts(*parts[:k]), F.lit("Wire"), F.lit(None).cast("string"), 999)
    fit = [k for k in range(2, 7) if one(spark, tx.visible_length(whole(k))) <= budget]
    if fit:
        assert one(spark, render.message(F.lit("NEWS"), F.lit("H"), texts(*parts), F.lit("Wire"), F.lit(None).cast("string"), budget)) == one(spark, whole(fit[-1]))


@pytest.mark.parametrize(("text", "limit", "want"), [("Ab cd. Ef gh. Ij", 14, "Ab cd. Ef gh"), ("short", 9, "short"), ("many words in here", 12, "many words…"), ("", 5, "")])
def test_cut_text(spark, text, limit, want):
    assert one(spark, render.cut_text(F.lit(text), limit)) == want


def test_paragraphs(spark):
    html = """<style>p{margin:0}</style><pre>no</pre><article><p>one <b>two</b> three</p><P class="x"><b>four
    five<br><p>six</p><p>seven <i>eight</i></article><footer>no</footer>"""
    assert one(spark, pages.paragraphs(F.lit(html))) == ["one two three", "four five", "six", "seven eight"]
    assert one(spark, pages.paragraphs(F.lit("<p>open <b>end"))) == ["open end"]


def test_article_paragraphs_counts_whole_texts(spark, tmp_path):
    rows = [(1, "<p><b>a paragraph that starts with a tag and goes on</b> after it</p>"), (2, "<p>short <b>but</b> long enough with all that stands behind it</p>"), (3, "<p>short</p>")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in QUERIES["article_paragraphs"](spark, str(tmp_path)).collect())
    assert got == [(1, 1, 55), (2, 1, 52)]


def test_media(spark):
    html = """<meta property="og:image" content="/logo.png"><IMG src="a.jpg" width="400" height="300"><img src='//c.org/b.jpg' width="800" height="600">
    <img src="small.jpg" width="10" height="10"><img src="data:x"><video src="v.mp4"></video>"""
    found = pages.media(F.lit(html), F.lit("https://e.org/x/y.html"))
    assert [(c.kind, c.url, c.width) for c in one(spark, found)] == [
        ("image", "https://e.org/logo.png", None), ("image", "https://e.org/x/a.jpg", 400), ("image", "https://c.org/b.jpg", 800), ("image", "https://e.org/x/small.jpg", 10), ("video", "https://e.org/x/v.mp4", None),
    ]
    assert one(spark, pages.best_media(found)) == "https://c.org/b.jpg"
    assert one(spark, pages.best_media(pages.media(F.lit(""), F.lit("https://e.org")))) is None
    assert one(spark, pages.resolve(F.lit("a"), F.lit("https://e.org"))) == "https://e.org/a"
    assert one(spark, pages.resolve(F.lit("a"), F.lit("nowhere"))) is None


def test_sentences(spark):
    assert one(spark, summary.front_attribution(F.lit("The river rose fast, police said."))) == "Police said the river rose fast."
    assert one(spark, summary.front_attribution(F.lit("Nothing here."))) == "Nothing here."
    assert one(spark, summary.repair_boundaries(F.lit("The river rose over night However the town slept near The Hague"))) == "The river rose over night. However the town slept near The Hague"
    assert one(spark, summary.repair_boundaries(F.lit("Three words only The end and more of The rest"))) == "Three words only The end and more of The rest"
    assert one(spark, summary.problems(F.lit("Police closed two roads on Monday."), F.lit("Storm"))) == []
    assert one(spark, summary.problems(F.lit('he said "no to the'), F.lit(None).cast("string"))) == ["open_end", "quotes", "dangling", "lower_start"]
    assert one(spark, summary.problems(F.lit(None).cast("string"), F.lit("x"))) == ["empty"]
    assert one(spark, summary.paraphrases(F.lit("Floods hit the northern town."), F.lit("Flood hits northern town")))
    assert not one(spark, summary.paraphrases(F.lit("Floods hit 12 northern towns."), F.lit("Flood hits northern town")))
    assert one(spark, summary.verified(F.lit("12 died."), F.lit("Officials: 12 died. Rain fell.")))
    assert not one(spark, summary.verified(F.lit("13 died."), F.lit("Officials: 12 died.")))


def test_top_sentences(spark):
    rows = spark.createDataFrame(
        [(1, 0, "Rain fell."), (1, 1, "It killed 12 in Chile."), (1, 2, "rain fell"), (1, 3, "About 7 of 90 left."), (1, 4, "!!"), (2, 0, "Only one."), (3, 0, None)],
        "id long, pos int, sentence string",
    )
    got = [(r.id, r.rank, r.pos) for r in ranking.top_sentences(rows, "id", 2).orderBy("id", "rank").collect()]
    assert got == [(1, 1, 3), (1, 2, 1), (2, 1, 0)]
