"""What stories say: signals, severity, classes, clean sentences, accounts of events and their state."""

import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewire import lexicons as lex
from tidewire.functions import classify as cl
from tidewire.functions import facts
from tidewire.functions import hygiene as hy
from tidewire.functions import signals as sg
from tidewire.functions import text as tx
from tidewire.operators import narrative, state, tables
from tidewire.plans.news import ORACLE_SQL, QUERIES
from tidewire.streaming import windows

SF = "/root/testdata/sf0.001"
L = F.lit


@pytest.fixture(scope="module")
def one(spark):
    """Values of several columns at once."""
    return lambda *columns: list(spark.range(1).select(*(c.alias(f"x{k}") for k, c in enumerate(columns))).first())


def test_sentences(one):
    text = "The U.S. midterms came. Dr. Smith, e.g. on Jan. 5, left! No. Yes."
    assert one(tx.sentences(L(text))) == [["The U.S. midterms came.", "Dr. Smith, e.g. on Jan. 5, left!", "No.", "Yes."]]
    assert one(tx.clean_headline(L("Live: flood in town  - BBC World")), tx.clean_headline(L("storm")), tx.clean_headline(L(None).cast("string"))) == ["Flood in town", "Storm", None]
    assert one(*(tx.error_class(L(t)) for t in ("Forbidden", "page not found", "bozo", "nodename nor servname", "resolve", "")), tx.error_class(L(None).cast("string"))) == ["HTTP_403", "HTTP_404", "PARSE_ERROR", "DNS_ERROR", "OTHER", None, None]


def test_hygiene(one):
    texts = {
        "NEW DELHI - The the minister said &amp;quot;no&amp;quot; . Continue reading...": 'The minister said "no".', "LONDON, Aug 14 (Reuters) -- Prices rose.": "Prices rose.", "US - China trade talks": "US - China trade talks",
        "Total solar eclipse (2/4) A total eclipse will come.": "A total eclipse will come.", "Con": "", "- list 3 of 3Why it matters": "Why it matters", "Words": "Words", "": "",
    }
    assert one(*(hy.clean_sentence_text(L(t)) for t in texts)) == list(texts.values())
    assert one(hy.unescape(L("&#x27;a&#8217; &amp;lt; &unknown; &eacute;"))) == ["'a’ &lt; &unknown; é"]
    assert one(hy.clean_sentence(L("a plane t")), hy.clean_sentence(L('He said "burn."')), hy.filler(L("Stay tuned!")), hy.filler(L("It rained."))) == ["a plane.", 'He said "burn."', True, False]


def test_signals(one):
    title, summary = "Powerful quake of 6.4 kills seven workers in Chile", "Officials in Santiago said 20,000 evacuated after Typhoon Yagi. The A380 and 5G in 2026. Moscow expels 12 diplomats."
    s = one(sg.signals(L(title), L(summary)))[0]
    assert {*s.entities} == {"chile", "santiago", "typhoon", "yagi", "a380", "russia"} and {*s.places} == {"chile", "russia"}
    assert {*s.core} == {"typhoon", "earthquake"} and {*s.actions} == {"kill", "evacuat", "earthquake", "typhoon", "diplomatic-rupture"}
    assert (s.storms, s.magnitudes, s.numbers) == (["yagi"], ["6.4"], ["6.4", "20000", "12"])
    assert {*s.impact} == {"20000:evacuated", "7:workers"} and {*s.consequences} == {"killed", "evacuated"}
    assert (s.dev, s.dev_facts, s.reaction, s.political_landslide) == (True, ["evacuation"], True, False)
    won, slid, none = one(*(sg.signals(L(t), L(None).cast("string")) for t in ("Party won by a landslide", "A landslide blocked the road", "")))
    assert won.political_landslide and "landslide" not in won.actions + won.core and slid.core == ["landslide"] and none.entities == none.tokens == []
    a, b, c = one(*(sg.impact(L(t)) for t in ("100 dead", "100 people killed and 7 killed", "seven killed")))
    assert a == ["100:killed"] and {*b} == {"100:people", "7:killed"} and c == ["7:killed"]
    assert one(sg.number_units(L("about 20,000 people and 30,000 People, 5 km"))) == [{"people": "30000", "km": "5"}]
    assert one(sg.places(L("south korea and niger, japan"))) == [["japan", "south_korea"]]


def test_strength_and_change(one):
    s = sg.signals(L("Quake kills 100 in Chile"), L("word " * 45))
    none = L(None).cast("int")
    got = one(sg.strength(s, L("word " * 45), L(1), L(True), L(2), none, L(1), L(False)))[0]
    assert (got.summary_quality, got.reliability, got.corroboration, got.extraction) == (5, 5, 3, 2) and got.total == sum(got[:6])
    known = sg.signals(L("Quake kills 100 in Chile"), L(""))
    new = {"Quake kills 100 in Chile": False, "Quake kills 180 in Chile": True, "Quake toll rises in Chile": True, "Chile quake, 3 minutes long": False, "Chile quake, 3 homes lost": True, "Quake in Chile: protest": True}
    assert one(*(sg.material_change(sg.signals(L(t), L("")), known) for t in new)) == list(new.values())
    assert one(sg.identified(sg.signals(L("Something happens in Chile"), L(""))), sg.identified(sg.signals(L("Flood in Chile"), L("")))) == [False, True]
    assert one(sg.major(none, L(85)), sg.major(L(80), L(99)), sg.status(known)) == [True, False, "ongoing"]


def test_severity(one):
    text = "A 7.4 magnitude quake killed 281 people; far from there and much later on that same long day some thousands displaced; state of emergency; airliner"
    s, quiet, none = one(facts.severity(L(text)), facts.severity(L("A quiet day with 12 cats")), facts.severity(L(None).cast("string")))
    assert (s.magnitude, s.dead, s.displaced, s.injured, s.incident, s.crisis) == (7.4, 281, 3000, 0, True, True)
    assert quiet[:6] == none[:6] == (0.0, 0, 0, 0, 0, 0)
    major, routine = one(*(facts.severity(L(t)) for t in ("Earthquake kills 1,200 and injures dozens", "Council debates parking")))
    assert major.dead > routine.dead
    cases = {"no fatalities were reported": False, "one dead": False, "1 killed": False, "2 killed": True, "two people killed": True, "bodies were found": True, "dozens killed": True, "a mass grave": True, "a death in the family": False}
    assert one(*(facts.mass_casualty(L(t)) for t in cases)) == list(cases.values())


def test_headline_against_text(one):
    cases = [("Team wins 3-1, five killed", "The team lost. Five were injured.", ["score", "win", "deaths"]), ("Team wins 3-1", "They won 3 – 1.", []), ("Plan announced", "The city is considering a plan.", ["announced"]), ("", "x", [])]
    assert one(*(facts.contradictions(L(h), L(t)) for h, t, _ in cases)) == [w for *_, w in cases]
    assert one(facts.linked(L("Wildfire in Canada spreads"), L("The wildfire grew")), facts.linked(L("Mayor Jones resigns"), L("Prices of tea rose"))) == [True, False]
    assert one(*(facts.question(L(t)) for t in ("Why is it hot?", "How to cook rice", "Is it true that this ends", "It is true."))) == [True, False, True, False]


def test_classes(one):
    regions = {"North America": {"United States": ["american"], "Canada": ["canada"]}, "Europe": {"Europe": ["paris"]}}
    r = lambda t: cl.region(L(t), L(None).cast("string"), regions, cl.US_MARK)
    assert [tuple(x) for x in one(r("Canada pushes back on US tariffs"), r("US meets Canada"), r("tell us about Paris"), r("nowhere"))] == [("North America", "Canada"), ("North America", "United States"), ("Europe", "Europe"), (None, None)]
    sectors, top = {"storms": ["storm"], "floods": ["flood", "flooding"]}, {"floods": "climate", "storms": "climate"}
    s = lambda t, label: cl.sector(L(t), L(""), L(label), sectors, top, ("world",))
    assert [tuple(x) for x in one(s("Floods and storms", "floods"), s("Floods and storms", "x"), s("Nothing", "floods"), s("Nothing", "world"))] == [("climate", "floods"), ("climate", "storms"), ("climate", "floods"), ("other", "general")]
    t = lambda text, label: cl.topic(L(text), L(""), L(label), {"sports": ["football"], "conflict": ["war"]}, ("africa",))
    assert one(t("War and war", "sports"), t("war", "sports"), t("war", "africa"), t("war war", "africa")) == ["conflict", "sports", "world", "conflict"]
    why = {("Review: the new phone", ""): "review", ("Court to review ruling", ""): None, ("How to watch the solar eclipse", ""): None, ("How to cook", ""): "howto", ("A year after the quake", ""): "anniversary", ("One year after the quake, agency releases findings", ""): None, ("", "x"): None}
    assert one(*(cl.rejection(L(a), L(b)) for a, b in why)) == list(why.values())
    none = L(None).cast("int")
    assert one(cl.tier(none, L("https://www.nasa.gov/x")), cl.tier(L(3), L("https://www.nasa.gov/x")), cl.tier(L(9), L(None).cast("string")), cl.discovery(none.cast("boolean"), L("https://news.google.com/a"))) == [1, 3, 4, True]
    assert one(cl.norm_url(L("https://Ex.org/a//?q")), cl.looks_like_html(L(" <HTML>")), cl.looks_like_html(L('{"a": "<b>"}')), cl.first_present(L(""), L(None).cast("string"), L("x"))) == ["ex.org/a", True, False, "x"]
    assert one(*(cl.maybe_important(L(a), L(b), 15, True) for a, b in (("IMMEDIATE", 99), ("HIGH", 99), ("URGENT", 99), ("URGENT", 5)))) == [True, True, False, True]


def test_selected_sentences_against_a_walk(spark):
    rng = random.Random(4)
    pool = ["Five people were killed in Paris on Monday.", "At least 5 people killed, 5 in hospital.", "Police arrested 20 workers.", "It was dark.", "The river rose 3 metres in Lyon.", "Nothing is known.", "About 5 people killed near Nice.", "It was dark."]
    rows = [(k, p, rng.choice(pool), rng.random() < 0.3) for k in range(25) for p in range(rng.randint(1, 8))]
    df = spark.createDataFrame(rows, "id long, pos long, sentence string, article boolean")
    got = defaultdict(list)
    for r in narrative.select_rows(df, "id", 3).orderBy("id", "turn").collect():
        got[r.id].append(r.sentence)
    told = {r.sentence: r for r in narrative.informed(df.select("sentence").distinct()).collect()}

    def covered(a, b):
        return {*a.facts.numbers} & {*b.facts.numbers} and {*map(tuple, a.facts.impact)} & {*map(tuple, b.facts.impact)}

    for k in {r[0] for r in rows}:
        own, want = {}, []
        for _, p, s, a in sorted((r for r in rows if r[0] == k), key=lambda r: (not r[3], r[1])):
            own.setdefault(s, (not a, p))
        order = sorted(own, key=lambda s: (own[s][0], not told[s].informative, -told[s].worth if told[s].informative else 0, own[s][1]))
        for s in order:
            if len(want) < 3 and not any(covered(told[s], told[w]) for w in want):
                want.append(s)
        assert got[k] == want
    placed = narrative.in_order(narrative.select_rows(df, "id", 3), "id").orderBy("id", "place").collect()
    assert len(placed) == sum(map(len, got.values())) and all(r.place == sum(q.id == r.id for q in placed[:i]) for i, r in enumerate(placed))


def test_aggregated_sentences(spark):
    items = [
        (1, 0, "A", "The fire has spread over more than 36 sq miles near town. Some 20,000 people fled quickly.", True, "Fire near town"), (1, 1, "B", "The fire has spread to more than 36 sq miles near town. Some 30,000 people fled quickly. Stay tuned.", False, "Fire near town"),
        (2, 0, "B", "Some 30,000 people fled quickly. Why did they leave?", False, "x"), (3, 0, "C", None, False, None),
    ]
    df = spark.createDataFrame(items, "id long, rank long, source string, summary string, article boolean, headline string")
    got = {(r.id, r.source, r.sentence) for r in narrative.aggregated(df, "id", F.col("headline")).collect()}
    assert got == {(1, "A", "The fire has spread over more than 36 sq miles near town."), (1, "A", "Some 20,000 people fled quickly."), (2, "B", "Some 30,000 people fled quickly."), (2, "B", "Why did they leave?")}
    brief = {r.id: r for r in narrative.briefing(df, "id", F.col("headline")).collect()}
    assert set(brief) == {1, 2} and len(brief[1].opening) == 2 and brief[1].body == [] and brief[1].bullets["Impact"] == "20,000 people" and brief[1].sources == ["A", "B"]
    rows = narrative.in_order(narrative.select_rows(df.select("id", F.col("rank").alias("pos"), F.col("summary").alias("sentence"), "article"), "id"), "id")
    told = {r.id: (r.ok, r.reason) for r in narrative.verdict(rows, "id", df.select("id", "headline").distinct()).collect()}
    assert told[1] == (True, None) and told[3] == (False, "no_news_content")


def test_best_story_and_touches(spark):
    rng = random.Random(1)
    rows = [(k, s, 100 * k + s, rng.randint(0, 30)) for k in range(20) for s in range(rng.randint(1, 30))]
    got = {r.event_id: r.best for r in state.best_story(spark.createDataFrame(rows, "event_id long, seq long, id long, strength long")).collect()}
    for k in range(20):
        best = None
        for r in sorted(r for r in rows if r[0] == k):
            best = r if best is None or r[3] >= best[3] + 2 else best
        assert got[k] == best[2]
    events = spark.createDataFrame([("e", 1, None, None, None), ("f", 5, 2, 1, True)], "event_id string, last_seen int, last_development int, queued_count int, major boolean")
    hits = spark.createDataFrame([("e", 4, True, True, True), ("e", 3, None, None, None)], "event_id string, at int, queued boolean, update boolean, major boolean")
    assert sorted(map(tuple, state.touched(events, hits).collect())) == [("e", 4, 4, 1, True), ("f", 5, 2, 1, True)]


def test_memory_audit(spark):
    sets = "entities places actions core numbers impact storms magnitudes tokens".split()
    side = lambda **s: tuple(s.get(n, []) for n in sets)
    ddl = ", ".join(f"{n} array<string>" for n in sets)
    events = spark.createDataFrame([("e", [], *side(places=["chile"], tokens=["quake", "chile"])), ("f", [], *side(tokens=list("abc")))], f"event_id string, title_tokens array<string>, {ddl}")
    stories = [("e", "NEW", *side(places=["chile"], tokens=["quake", "chile"])), ("e", "DUPLICATE", *side(places=["peru"], tokens=["x"])), ("f", "NEW", *side(tokens=list("abc")))] + [("f", "UPDATE", *side(tokens=list("abc")))] * 6
    df = spark.createDataFrame([(str(k), *s, False, False) for k, s in enumerate(stories)], f"id string, event_id string, status string, {ddl}, dev boolean, reaction boolean")
    got = {r.event_id: (r.stories, r.flags) for r in state.audit(df, events.withColumn("dev", L(False))).collect()}
    assert got == {"e": (2, ["location_mismatch", "low_semantic", "no_shared_location"]), "f": (7, ["many_stories"])}


def test_rolling_counts_and_duplicates(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice("ab"), rng.randint(-50, 400)) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, c string, s long").select("id", "c", F.timestamp_seconds("s").alias("ts"))
    got = {r.id: (r.near, r.far) for r in windows.rolling(df, "id", "c", {"near": 7, "far": 100}).collect()}
    assert got == {i: tuple(sum(d == c and s - n <= t <= s for _, d, t in rows) for n in (7, 100)) for i, c, s in rows}
    dup = [(k, rng.choice("xyz"), rng.choice(["s", "t", None])) for k in range(60)]
    marked = {r.seq: r.duplicate for r in tables.cross_source_duplicates(spark.createDataFrame(dup, "seq long, key string, src string"), "key", "src", "seq").collect()}
    for k, key, _ in dup:
        before = [s for j, q, s in dup if q == key and j <= k]
        assert marked[k] == any(s is not None and s != before[0] for s in before if before[0] is not None)


@pytest.mark.parametrize("name", ["closed_sentences", "story_signals", "story_sectors", "story_regions", "editorial_reasons", "headline_contradictions", "source_dimension", "best_descriptions", "touched_events", "sentence_topk"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in "customer orders documents pages conversations events".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    want = sorted(str([dict(zip(cols, r))[c] for c in sorted(cols)]) for r in cur.fetchall())
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(str([r[c] for c in sorted(cols)]) for r in df.collect()) == want


def test_lexicons_hold_no_word_twice():
    for words in (lex.ACTIONS, lex.PLACES, lex.CORE_EVENTS, lex.NAME_STOPWORDS):
        assert len(words) - len({*words}) <= 1


def test_strengths_ask_for_no_more_than_they_need(spark, one, tmp_path):
    from tidewire.plans import news

    text = "A380 flood kills 1,200 people in New Zealand. Troops withdraw from Chile!  Mr. Lee of the U.S. said 3a4 and 12, 5.6-magnitude quake; Storm Ana rescued\n50 homes, truce"
    whole, some = one(sg.signals(L(text), L("Two dead")), sg.signals(L(text), L("Two dead"), fields=sg.WORTH))
    assert {f: whole[f] for f in sg.WORTH} == some.asDict() and whole.numbers == ["1200", "12", "5.6", "50"]
    spark.createDataFrame([(1, text, "x", "en")], "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = news.story_strengths(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "title_tokens" not in plan


def test_sentences_with_marks_at_their_edges(one):
    texts = ["Mr. Lee met Dr.Who. He said e.g. no!  Yes?\t\nIn the U.S. it is 3.5. etc. vs. a.b.c. End", "Sept. 4. x", ". . a.  b", " \x0b A.\x0bB ", "Amr. Mr.", ""]
    want = [["Mr. Lee met Dr.Who.", "He said e.g. no!", "Yes?", "In the U.S. it is 3.5.", "etc. vs. a.b.c. End"], ["Sept. 4. x"], [".", ".", "a.", "b"], ["A.", "B"], ["Amr.", "Mr."], []]
    assert one(*(tx.sentences(L(t)) for t in texts)) == want


def test_a_filter_on_sentences_does_not_clean_them_again(spark):
    items = spark.createDataFrame([("e", "It rained. Three people were hurt.")], "g string, summary string")
    rows = items.select(F.explode(narrative._cleaned(F.col("summary"))).alias("sentence")).where(F.col("sentence") != "")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "regexp" in line for line in plan.splitlines())
    assert sorted(r.sentence for r in rows.collect()) == ["It rained.", "Three people were hurt."]
