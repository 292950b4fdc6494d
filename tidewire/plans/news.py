"""Queries on what stories say: signals, classes, severity, accounts of events, their state. They join those of `queries`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicons as lex
from ..functions import classify as cl
from ..functions import facts, images
from ..functions import hygiene as hy
from ..functions import signals as sg
from ..functions import text as tx
from ..operators import audit, enrichment, event_state, leaders, narrative, ranking, repair, same_event, state
from ..sources import feeds
from ..sources.tables import stories, table, with_times
from ..streaming import event_memory, publisher
from .queries import _HOST, _SCORE, ORACLE_SQL, QUERIES, S, _scored, query

__all__ = ["ORACLE_SQL", "QUERIES"]

#: Small lexicons that fit the invented prose of the stored tables, in place of a deployment's own.
SECTORS = {"conflict": ["war", "ation"], "markets": ["stock", "of", "the"], "health": ["der", "und"], "storms": ["la", "que"], "rail": ["el", "los"]}
TOP_OF = {"conflict": "geopolitics", "markets": "economy", "health": "health", "storms": "climate", "rail": "transport"}
REGIONS = {"Africa": {"North": ["and", "por"], "West": ["les"]}, "Europe": {"Europe": ["und", "der", "la"]}, "North America": {"United States": ["to", "con"]}}
EDITORIAL = (("review", r"(?i)\btion\b|view"), ("opinion", r"(?i)^the\b"), ("howto", r"(?i)\band\b.*\bto\b"), ("sponsored", r"!!"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _re(pattern: str) -> str:
    r"""A pattern for RE2: quoted runs without \Q and \E."""
    return _sql(pattern)


def _any(words) -> str:  # noqa: ANN001
    return "|".join(words)


# ---------------------------------------------------------------- sentences and headlines


@query(r"""WITH t AS (SELECT conv_id, turn, regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '\s+[a-z][.]?$', '') AS t FROM conversations)
 SELECT conv_id, turn, CASE WHEN t = '' THEN '' WHEN regexp_matches(t, '[.!?][''"‘’“”)\]}]*$') THEN t ELSE t || '.' END AS sentence FROM t""")
def closed_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", hy.clean_sentence(F.col("text")).alias("sentence"))


@query(S + rf""", h AS (SELECT id, regexp_replace(trim(regexp_replace(title, '\s+', ' ', 'g')), {_re(rf"(?i)\s*(?:-\s*|[–—]\s*|\|\s*)(?:{lex.PUBLISHERS})$")}, '') AS h FROM stories),
 p AS (SELECT id, trim(regexp_replace(h, '(?i)^(?:Live|Watch|Video|Update|Breaking|Flash)[:\s-]+\s*', '')) AS h FROM h) SELECT id, upper(left(h, 1)) || substr(h, 2) AS headline FROM p""")
def clean_headlines(spark: SparkSession, d: str) -> DataFrame:
    return stories(spark, d).select("id", tx.clean_headline(F.col("title")).alias("headline"))


@query(None)
def hygienic_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of pages without what the page put around them, and whether they say anything; the tests hold single sentences against their clean forms."""
    rows = table(spark, d, "pages").select("page_id", F.posexplode(tx.sentences(F.regexp_replace("html", "<[^>]+>", " "))).alias("pos", "s"))
    # a row of none or one: a filter on it would go before the sentences are cleaned, and clean them again
    made = sg.bind(hy.clean_sentence_text(F.col("s")), lambda s: F.struct(s.alias("sentence"), hy.filler(s).alias("filler")))
    return rows.select("page_id", "pos", F.inline(F.filter(F.array(made), lambda x: x["sentence"] != "")))


_CLAIMS = ", ".join(
    f"CASE WHEN regexp_matches(title, '(?i)\\b(?:{claim})\\b') AND NOT regexp_matches(summary, '(?i)\\b(?:{claim})\\b') AND regexp_matches(summary, '(?i)\\b(?:{other})\\b') THEN '{name}' END"
    for name, claim, other in facts.CLAIMS
)


@query(S + rf"""SELECT id, array_to_string(list_filter([CASE WHEN len(list_filter(regexp_extract_all(title, '\b[0-9]{{1,2}}\s*[-–—]\s*[0-9]{{1,2}}\b'), lambda x: NOT contains(regexp_replace(regexp_replace(summary, '\s+', '', 'g'), '[–—]', '-', 'g'),
   regexp_replace(regexp_replace(x, '\s+', '', 'g'), '[–—]', '-', 'g')))) > 0 THEN 'score' END, {_CLAIMS}], lambda x: x IS NOT NULL), ',') AS problems FROM stories""")
def headline_contradictions(spark: SparkSession, d: str) -> DataFrame:
    return stories(spark, d).select("id", F.array_join(facts.contradictions(F.col("title"), F.col("summary")), ",").alias("problems"))


# ---------------------------------------------------------------- classes


@query(r"""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www[.]', '') AS site, url FROM pages)
 SELECT page_id, site, CAST(CASE WHEN page_id % 5 BETWEEN 1 AND 4 THEN page_id % 5 ELSE 4 END AS INTEGER) AS tier, CASE WHEN page_id % 7 = 0 THEN 'discovery_aggregator' WHEN regexp_matches(site, '[.]gov$|[.]gov[.]|[.]int$|[.]mil$') THEN 'primary_source'
 WHEN regexp_matches(site, 'reuters|apnews|afp|xinhua|tass|yonhap') THEN 'news_agency' ELSE 'publisher' END AS kind,
 lower(regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^?#]*)', 1), '/+$', '')) AS key FROM h""")
def source_dimension(spark: SparkSession, d: str) -> DataFrame:
    url, flag = F.col("url"), F.col("page_id") % 7 == 0
    kind = cl.source_type(flag, F.lit(None).cast("string"), F.lit(False), url)
    return table(spark, d, "pages").select("page_id", cl.site(url).alias("site"), cl.tier((F.col("page_id") % 5).cast("int"), url).alias("tier"), kind.alias("kind"), cl.norm_url(url).alias("key"))


@query("WITH n AS (SELECT max(ts) - INTERVAL 2 HOUR AS now FROM events) SELECT event_id, floor(epoch(now))::BIGINT - floor(epoch(ts))::BIGINT BETWEEN -900 AND 172800 AS recent FROM events, n")
def recent_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    now = e.agg((F.max("ts") - F.expr("INTERVAL 2 HOUR")).alias("now"))
    return e.join(F.broadcast(now), F.lit(True)).select("event_id", cl.recent(F.col("ts"), F.col("now")).alias("recent"))


_COUNTS = ", ".join("{'n': " + " + ".join(f"len(regexp_extract_all(low, '\\b{t}(?:s|es)?\\b'))" for t in ts) + f", 'own': 0, 'ord': {-k}, 'name': '{n}'}}" for k, (n, ts) in enumerate(SECTORS.items()))
_TOPS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TOP_OF.items())


@query(S + f""", c AS (SELECT id, regexp_replace(lower(title || ' ' || summary), '[À-ɏ]', 'x', 'g') AS low FROM stories), b AS (SELECT id, list_max([{_COUNTS}]) AS b FROM c)
 SELECT id, CASE WHEN b.n > 0 THEN CASE b.name {_TOPS} END ELSE 'other' END AS top, CASE WHEN b.n > 0 THEN b.name ELSE 'general' END AS sub FROM b""")
def story_sectors(spark: SparkSession, d: str) -> DataFrame:
    found = cl.sector(F.col("title"), F.col("summary"), F.lit("world"), SECTORS, TOP_OF, ("world",))
    return stories(spark, d).select("id", found.alias("s")).select("id", "s.top", "s.sub")


_PLACES = [(t, s, rf"(?is)^(.*?)\b(?:{_any(terms)})\b") for t, subs in REGIONS.items() for s, terms in subs.items()]
_AT = ", ".join(f"CASE WHEN regexp_matches(t, {_re(p)}) THEN {{'at': length(regexp_extract(t, {_re(p)}, 1)), 'k': {k}, 'top': '{top}', 'sub': '{sub}'}} END" for k, (top, sub, p) in enumerate(_PLACES))


@query(S + f""", f AS (SELECT id, list_min(list_filter([{_AT}], lambda x: x IS NOT NULL)) AS f FROM (SELECT id, regexp_replace(title || ' ' || summary, '[À-ɏ]', 'x', 'g') AS t FROM stories)) SELECT id, f.top AS top, f.sub AS sub FROM f""")
def story_regions(spark: SparkSession, d: str) -> DataFrame:
    found = cl.region(F.col("title"), F.col("summary"), REGIONS)
    return stories(spark, d).select("id", found.alias("r")).select("id", "r.top", "r.sub")


def _hit(pattern: str) -> str:
    return f"(regexp_matches(t, {_re(pattern)}) OR regexp_matches(b, {_re(pattern)}))"


_RULES = " ".join(
    "WHEN " + _hit(p) + (f" AND (regexp_matches(b, {_re(cl.STRONG_REVIEW)}) OR regexp_matches(b, {_re(cl.PRODUCTS)}))" if n == "review" else "") + (f" AND NOT regexp_matches(b, {_re(cl.ASTRONOMY)})" if n in ("howto", "lifestyle") else "") + f" THEN '{n}'"
    for n, p in EDITORIAL
)


@query(S + f""", r AS (SELECT id, trim(title) AS t, trim(title) || ' ' || summary AS b FROM stories)
 SELECT id, CASE WHEN t = '' THEN NULL {_RULES} WHEN regexp_matches(lower(t), {_re(cl.WEATHER)}) AND NOT regexp_matches(b, {_re(cl.EXTREME)}) AND NOT regexp_matches(b, {_re(cl.ASTRONOMY)}) THEN 'routine_weather'
 WHEN regexp_matches(t, {_re(cl.FEATURE)}) THEN 'feature' WHEN regexp_matches(t, {_re(cl.ANNIVERSARY)}) AND NOT regexp_matches(b, {_re(cl.CURRENT)}) THEN 'anniversary' END AS reason FROM r""")
def editorial_reasons(spark: SparkSession, d: str) -> DataFrame:
    return stories(spark, d).select("id", cl.rejection(F.col("title"), F.col("summary"), EDITORIAL).alias("reason"))


# ---------------------------------------------------------------- signals, severity, strength


_LIST = "array_to_string(list_sort(list_distinct({})), ',')"


@query(S + rf""", t AS (SELECT id, replace(title || ' ' || summary, '’', '''') AS t FROM stories)
 SELECT id, {_LIST.format("list_filter(list_transform(list_filter(regexp_extract_all(regexp_replace(t, '([a-zA-Z])', '\\1\\1', 'g'), '[a-zA-Z]?[0-9][0-9,.]*[a-zA-Z]?'), lambda x: NOT regexp_matches(x, '[a-zA-Z]')), lambda x: regexp_replace(x, '[^0-9.]', '', 'g')), lambda x: TRY_CAST(x AS DOUBLE) IS NOT NULL AND NOT TRY_CAST(x AS DOUBLE) BETWEEN 1900 AND 2100)")} AS numbers,
 {_LIST.format("list_transform(regexp_extract_all(t, '(?i)\\b(?:storm|typhoon|hurricane|cyclone)\\s+([a-z][a-z''-]+)\\b', 1), lambda x: lower(x))")} AS storms, {_LIST.format("list_transform(regexp_extract_all(t, " + _re(lex.TEMPORAL) + "), lambda x: lower(regexp_replace(x, '\\s+', ' ', 'g')))")} AS temporal,
 regexp_matches(t, {_re(rf"(?i)\b(?:{_any(lex.REACTIONS)})\b")}) AS reaction, array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN regexp_matches(t, {_re(p)}) THEN '{n}' END" for n, p in sg.development_patterns().items())}], lambda x: x IS NOT NULL)), ',') AS developments FROM t""")
def story_signals(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat("title", F.lit(" "), "summary")
    flat = lambda x: F.array_join(F.array_sort(x), ",")
    return stories(spark, d).select("id", flat(sg.event_numbers(t)).alias("numbers"), flat(sg.storms(t)).alias("storms"), flat(sg.temporal(t)).alias("temporal"), sg.reaction(t).alias("reaction"), flat(sg.developments(t)).alias("developments"))


_NEAR = ", ".join(f"max(CASE WHEN k.{n} AND v.v IS NOT NULL THEN v.v ELSE 0 END) AS {n}" for n in lex.CASUALTY_WORDS)
_SAID = ", ".join(f"regexp_matches(w, {_re('(?:' + p + ')')}) AS {n}" for n, p in lex.CASUALTY_WORDS.items())
_NAMED = ", ".join(f"CASE WHEN regexp_matches(w, '\\b{n}\\b') THEN {v} END" for n, v in lex.WORD_MAGNITUDES.items())
#: Prose with numbers and words of severity, made of the ids of events.
_TEXT_PARTS = (("", "Quake of magnitude ", "Flood leaves "), ("7.4 kills ", "12 dead and ", "thousands displaced, "), ("281 people", "1,200 injured", "dozens missing"))


def _event_text(sql: bool):  # noqa: ANN202
    if sql:
        return " || ".join(f"([{', '.join(map(_sql, part))}])[event_id // {3**k} % 3 + 1]" for k, part in enumerate(_TEXT_PARTS)) + " || ' as state of emergency number ' || event_id"
    parts = [F.get(F.array(*map(F.lit, part)), (F.floor(F.col("event_id") / 3**k) % 3).cast("int")) for k, part in enumerate(_TEXT_PARTS)]
    return F.concat(*parts, F.lit(" as state of emergency number "), F.col("event_id").cast("string"))


@query(rf"""WITH t AS (SELECT event_id, lower({_event_text(True)}) AS t FROM events), s AS (SELECT event_id, string_split_regex(t, '\s+') AS a FROM t), w AS (SELECT event_id, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM s),
 v AS (SELECT event_id, i, greatest(TRY_CAST(CASE WHEN contains(n, '.') THEN NULL ELSE nullif(n, '') END AS BIGINT), {_NAMED}) AS v FROM (SELECT event_id, i, w, replace(regexp_extract(w, '([0-9][0-9,]*(?:[.][0-9]+)?)', 1), ',', '') AS n FROM w)),
 k AS (SELECT event_id, i, {_SAID} FROM w), m AS (SELECT k.event_id, {_NEAR} FROM k JOIN v ON k.event_id = v.event_id AND v.i >= k.i - 8 AND v.i < k.i + 8 GROUP BY 1)
 SELECT t.event_id, CASE WHEN contains(t, 'magnitude 7.4') THEN 7.4::DOUBLE ELSE coalesce(TRY_CAST(regexp_extract(t, '\b(?:magnitude|m|mw)\s*[-\s]?\s*([0-9]+(?:[.][0-9]+)?)\b', 1) AS DOUBLE), 0.0::DOUBLE) END AS magnitude,
 {', '.join(f'CAST(coalesce(m.{n}, 0) AS BIGINT) AS {n}' for n in lex.CASUALTY_WORDS)}, contains(t, 'state of emergency') AS crisis FROM t LEFT JOIN m USING (event_id)""")
def event_severity(spark: SparkSession, d: str) -> DataFrame:
    s = facts.severity(_event_text(False))
    return table(spark, d, "events").select("event_id", s.alias("s")).select("event_id", "s.magnitude", *(f"s.{n}" for n in lex.CASUALTY_WORDS), "s.crisis")


def _signalled(spark: SparkSession, d: str, fields: tuple[str, ...] | None = None) -> DataFrame:
    return stories(spark, d).withColumn("s", sg.signals(F.col("title"), F.col("summary"), fields=fields))


@query(None)
def story_strengths(spark: SparkSession, d: str) -> DataFrame:
    """How good a description of its event each story is, with the parts; the tests hold single stories against counted parts."""
    nothing = F.lit(None).cast("int")
    total = sg.strength(F.col("s"), F.col("summary"), F.col("tier"), F.col("primary_source"), nothing, nothing, nothing, F.lit(False))
    return _signalled(spark, d, sg.WORTH).select("id", sg.status(F.col("s")).alias("status"), sg.identified(F.col("s")).alias("identified"), total.alias("x")).select("id", "status", "identified", "x.*")


@query("""WITH s AS (SELECT o_custkey, list({'seq': o_orderkey, 'strength': CAST(floor(o_totalprice / 10000) AS BIGINT)} ORDER BY o_orderkey) AS a FROM orders GROUP BY 1),
 b AS (SELECT o_custkey, list_reduce(a, lambda b, x: CASE WHEN x.strength >= b.strength + 2 THEN x ELSE b END) AS b FROM s) SELECT o_custkey, b.seq AS best, b.strength AS best_strength FROM b""")
def best_descriptions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") / 10000).alias("strength"))
    return state.best_story(o, "o_custkey")


@query("""WITH e AS (SELECT c_custkey AS event_id, TIMESTAMP '1995-01-01' AS last_seen, c_custkey % 3 AS queued_count, c_acctbal > 9000 AS major FROM customer),
 h AS (SELECT o_custkey AS event_id, max(o_orderdate) AS seen, max(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS dev, count(*) FILTER (WHERE o_orderstatus = 'O') AS q, bool_or(o_totalprice > 400000) AS m FROM orders GROUP BY 1)
 SELECT event_id, greatest(last_seen, seen) AS last_seen, dev AS last_development, CAST(queued_count + coalesce(q, 0) AS BIGINT) AS queued_count, major OR coalesce(m, false) AS major FROM e LEFT JOIN h USING (event_id)""")
def touched_events(spark: SparkSession, d: str) -> DataFrame:
    at = F.lit("1995-01-01").cast("timestamp_ntz")
    events = table(spark, d, "customer").select(F.col("c_custkey").alias("event_id"), at.alias("last_seen"), F.lit(None).cast("timestamp_ntz").alias("last_development"), (F.col("c_custkey") % 3).alias("queued_count"), (F.col("c_acctbal") > 9000).alias("major"))
    hits = table(spark, d, "orders").select(F.col("o_custkey").alias("event_id"), F.col("o_orderdate").alias("at"), (F.col("o_orderstatus") == "O").alias("queued"), (F.col("o_orderstatus") == "F").alias("update"), (F.col("o_totalprice") > 400000).alias("major"))
    return state.touched(events, hits)


# ---------------------------------------------------------------- accounts of events


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as events: each turn is a report, the first one's first sentence the headline."""
    turns = table(spark, d, "conversations").where("text is not null")
    head = turns.groupBy("conv_id").agg(F.get(tx.sentences(F.min_by("text", "turn")), 0).alias("headline"))
    return turns.join(head, "conv_id").select("conv_id", F.col("turn").alias("rank"), F.col("role").alias("source"), F.col("text").alias("summary"), (F.col("role") == "assistant").alias("article"), "headline")


@query(None)
def aggregated_sentences(spark: SparkSession, d: str) -> DataFrame:
    """What all reports of an event say, once each; the tests hold it against a walk in order."""
    return narrative.aggregated(_items(spark, d), "conv_id", F.col("headline")).select("conv_id", "seq.rank", "seq.pos", "source", "sentence")


@query(None)
def event_briefings(spark: SparkSession, d: str) -> DataFrame:
    """Each event's account of four sentences at most; the tests hold choice and order against a walk."""
    found = narrative.briefing(_items(spark, d), "conv_id", F.col("headline"))
    return found.select("conv_id", F.array_join("opening", " ").alias("opening"), F.array_join("body", " ").alias("body"), F.to_json("bullets").alias("bullets"), F.array_join("sources", ",").alias("sources"))


@query(None)
def event_memory_run(spark: SparkSession, d: str) -> DataFrame:
    """All stories through an empty event memory in order of their number, by the signals of title and summary; the tests hold the operator against a walk in order."""
    found = event_memory.remember(_memory_rows(spark, d), event_memory.Memory.empty(spark), weak=lex.WEAK_ENTITIES, generic=lex.GENERIC_ACTIONS, narrow=lex.NARROW_ACTIONS, core_words=lex.CORE_EVENTS)[0]
    return found.select("id", "status", "event_id", F.round("score", 6).alias("score"), "reason")


@query(None)
def memory_audit(spark: SparkSession, d: str) -> DataFrame:
    """Events of the memory after a run over all stories by their signals, and what makes a merge doubtful; the tests hold both against walks."""
    told = leaders.cut(_memory_rows(spark, d))
    decisions, after = event_memory.remember(told, event_memory.Memory.empty(spark))
    placed = decisions.where("event_id is not null").select("id", "status", "event_id").join(told, "id")
    founded = after.events.withColumn("dev", F.lit(False)).withColumn("reaction", F.lit(False))
    found = state.audit(placed, founded, weak=lex.WEAK_ENTITIES, generic=lex.GENERIC_ACTIONS, narrow=lex.NARROW_ACTIONS, core_words=lex.CORE_EVENTS)
    return found.select("event_id", "stories", "lowest", F.array_join("flags", ",").alias("flags"))


def _memory_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _signalled(spark, d).select(F.col("id").cast("string").alias("id"), F.col("id").cast("long").alias("seq"), "source", F.lit(False).alias("discovery"), "s.dev", "s.reaction", *(f"s.{c}" for c in event_memory.SETS))
    return rows


# ---------------------------------------------------------------- publishing


@query(None)
def published_events(spark: SparkSession, d: str) -> DataFrame:
    """All events as the queue of one channel: fresh for two hours and as many minutes as their value says, some failing (by their props). The tests hold the operator against a walk round by round."""
    e = table(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    k = F.get_json_object("props", "$.k").cast("int")
    fails = F.when(k < 5, 5).when(k < 20, 1).otherwise(0)
    queue = e.select(F.lit("news").alias("channel"), F.lpad(F.col("event_id").cast("string"), 20, "0").alias("key"), at.alias("scheduled"), (at + 7200 + 60 * F.col("value")).alias("until"), fails.alias("fails"))
    done = publisher.publish(queue, publisher.Limits(gap=600, per_hour=4, per_day=40))
    return done.select(F.col("key").cast("long").alias("event_id"), "outcome", F.col("posted").cast("long").alias("posted_s"), "attempts")


# ---------------------------------------------------------------- feeds

_NOW = "2024-01-20 00:00:00"
_FED = S + rf""", t AS (SELECT id, title, summary, coalesce(source, 'none') || '-' || CAST(id // 32 % 4 AS VARCHAR) AS feed, id // 32 AS file, date_trunc('second', ts) AS moment FROM stories JOIN events ON id = event_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY feed, file ORDER BY id) AS n FROM t),
 f AS (SELECT *, CASE WHEN moment > TIMESTAMP '{_NOW}' AND moment <= TIMESTAMP '{_NOW}' + INTERVAL 15 MINUTE THEN TIMESTAMP '{_NOW}' ELSE moment END AS eff FROM r),
 i AS (SELECT *, n <= 25 AND title <> '' AND eff BETWEEN TIMESTAMP '{_NOW}' - INTERVAL 480 HOUR AND TIMESTAMP '{_NOW}' AS recent FROM f)
"""


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    """Stories as files of feeds (four a source, RSS or Atom, each file of up to 32 stories), scanned."""
    rows = with_times(stories(spark, d), table(spark, d, "events"))
    rows = rows.withColumn("url", F.concat(F.lit("https://news.example/?a=1&id="), F.col("id"))).withColumn("order", F.col("id"))
    file = F.floor(F.col("id") / 32)
    feed = F.concat(F.coalesce("source", F.lit("none")), F.lit("-"), (file % 4).cast("string"))
    files = feeds.files_of(rows, feed, file, file % 2 == 1)
    return feeds.scan(files, F.lit(_NOW).cast("timestamp"), max_age_hours=480)


@query(_FED + " SELECT feed AS source, 'https://news.example/?a=1&id=' || CAST(id AS VARCHAR) AS url, title, trim(summary) AS summary, CAST(epoch(eff) AS BIGINT) AS effective_s FROM i WHERE recent")
def feed_items(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(spark, d).select("feed", F.inline("items")).select(F.col("feed").alias("source"), "url", "title", "summary", F.unix_seconds("effective").alias("effective_s"))


@query(_FED + " SELECT feed AS source, count(DISTINCT file) AS files, count(*) AS entries_seen, count(*) FILTER (recent) AS recent_entries, CAST(0 AS BIGINT) AS failed FROM i GROUP BY feed")
def feed_health(spark: SparkSession, d: str) -> DataFrame:
    return feeds.health(_scanned(spark, d)).drop("error")


@query(None)
def same_event_groups(spark: SparkSession, d: str) -> DataFrame:
    """All stories with times, grouped by events; the tests hold the operator against a walk."""
    return same_event.groups(with_times(stories(spark, d), table(spark, d, "events")))


# ---------------------------------------------------------------- choice and audit

_QUALITY = """q AS (SELECT source, avg(quality) AS share FROM documents JOIN labels USING (doc_id) GROUP BY source), bad AS (SELECT source FROM q WHERE share < 0.5)"""


def _not_news(spark: SparkSession, d: str) -> DataFrame:
    """Sources of whose labelled documents less than half are good."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.avg("quality").alias("share"))
    return rows.where("share < 0.5").select("source")


@query(S + f""", {_QUALITY}, t AS (SELECT id, source, ts FROM stories JOIN events ON id = event_id), n AS (SELECT max(ts) - INTERVAL 1 HOUR AS now FROM t)
 SELECT id, source FROM t, n WHERE ts BETWEEN now - INTERVAL 6 HOUR AND now AND (source IS NULL OR source NOT IN (SELECT source FROM bad WHERE source IS NOT NULL)) ORDER BY ts DESC, id LIMIT 50""")
def post_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Stories of the six hours before an hour ago, of sources that bring news."""
    rows = with_times(stories(spark, d), table(spark, d, "events"))
    now = F.lit(rows.agg(F.max("effective_at")).first()[0]) - F.expr("INTERVAL 1 HOUR")
    return ranking.postable(rows, now, _not_news(spark, d)).select("id", "source")


@query("""WITH t AS (SELECT doc_id AS id, CASE WHEN l.quality = 1 AND toxic = 0 THEN 'queued' WHEN l.doc_id IS NULL THEN 'held' ELSE 'rejected' END AS kind, coalesce(n_chars, 0) AS n FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id)),
 r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, id) AS place FROM t) SELECT kind, CAST(place AS INTEGER) AS place, id FROM r WHERE place <= CASE kind WHEN 'queued' THEN 5 ELSE 30 END""")
def run_shortlists(spark: SparkSession, d: str) -> DataFrame:
    """Of a run: five queued stories, thirty held and thirty rejected ones, the longest first."""
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"), F.lit(True).alias("known"))
    kind = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "queued").when(F.col("known").isNull(), "held").otherwise("rejected")
    rows = table(spark, d, "documents").join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), kind.alias("kind"), F.coalesce("n_chars", F.lit(0)).alias("n"))
    return ranking.shortlists(rows, "kind", {"queued": 5, "held": 30, "rejected": 30}, F.desc("n"), F.asc("id")).select("kind", "place", "id")


@query(f"""WITH s AS ({ORACLE_SQL['story_sectors']}), r AS ({ORACLE_SQL['story_regions']}), e AS ({ORACLE_SQL['editorial_reasons']}), c AS ({S} SELECT id, CAST({_SCORE} AS INTEGER) AS score, tier = 4 AS discovery FROM toks)
 SELECT id, s.top AS sector, s.sub AS sub_sector, r.top AS region, r.sub AS sub_region, score, reason IS NULL AS editorial_pass, discovery, score < CASE WHEN discovery THEN 70 ELSE 55 END AS below_score FROM s JOIN r USING (id) JOIN e USING (id) JOIN c USING (id)""")
def article_classes(spark: SparkSession, d: str) -> DataFrame:
    """What the audit says of each article: sector, region, score, whether it passes, and whether its score is below the bound (70 for the last tier, else 55)."""
    rows = _scored(spark, d)
    found = rows.select(
        "id", cl.sector(F.col("title"), F.col("summary"), F.lit("world"), SECTORS, TOP_OF, ("world",)).alias("s"), cl.region(F.col("title"), F.col("summary"), REGIONS).alias("r"),
        cl.rejection(F.col("title"), F.col("summary"), EDITORIAL).isNull().alias("editorial_pass"), F.col("score").cast("int").alias("score"), (F.col("tier") == 4).alias("discovery"),
    )
    below = F.col("score") < F.when(F.col("discovery"), 70).otherwise(55)
    return found.select("id", F.col("s.top").alias("sector"), F.col("s.sub").alias("sub_sector"), F.col("r.top").alias("region"), F.col("r.sub").alias("sub_region"), "score", "editorial_pass", "discovery", below.alias("below_score"))


@query("""WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1), t AS (SELECT coalesce(source, 'none') || '/' || coalesce(lang, 'none') AS name, d.doc_id, l.quality, l.toxic, d.text IS NOT NULL AS ok, row_number() OVER (PARTITION BY text ORDER BY d.doc_id) > 1 AS again FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id),
 s AS (SELECT name, count(*) AS attempts, count(*) FILTER (ok) AS successes, count(*) FILTER (quality IS NOT NULL) AS fetched, count(*) FILTER (quality = 1 AND toxic = 0) AS useful, count(*) FILTER (again AND quality IS NOT NULL) AS duplicates FROM t GROUP BY name),
 r AS (SELECT *, successes / attempts AS sr, CASE WHEN fetched > 0 THEN useful / fetched END AS ur, CASE WHEN fetched > 0 THEN duplicates / fetched END AS dr FROM s)
 SELECT name, useful, round(ur, 6) AS useful_rate, round(dr, 6) AS duplicate_rate, CASE WHEN sr < 0.5 AND attempts >= 3 THEN 'unreachable' WHEN fetched < 1 THEN 'silent' WHEN fetched >= 5 AND useful < 1 THEN 'unused' WHEN fetched >= 5 AND dr >= 0.5 THEN 'mostly repeats' WHEN fetched >= 5 AND ur < 0.2 THEN 'weak' ELSE 'keep' END AS advice,
 rank() OVER (ORDER BY useful DESC) AS place FROM r""")
def source_contributions(spark: SparkSession, d: str) -> DataFrame:
    """Sources by language: labelled documents are fetched ones, good ones useful, later ones of one text duplicates."""
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = table(spark, d, "documents").withColumn("digest", F.sha2(F.col("text"), 256))
    first = docs.groupBy("digest").agg(F.min("doc_id").alias("first"))
    rows = docs.join(first, docs["digest"].eqNullSafe(first["digest"])).drop(first["digest"]).join(labels, "doc_id", "left")
    name = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")))
    known = F.col("quality").isNotNull()
    sources = rows.groupBy(name.alias("name")).agg(
        F.count(F.lit(1)).alias("attempts"), F.count("text").alias("successes"), F.count_if(known).alias("fetched"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("useful"),
        F.count_if(known & (F.col("doc_id") > F.col("first"))).alias("duplicates"),
    )
    out = audit.contributions(sources)
    return out.select("name", "useful", F.round("useful_rate", 6).alias("useful_rate"), F.round("duplicate_rate", 6).alias("duplicate_rate"), "advice", "place")


# ---------------------------------------------------------------- damaged rows

#: Words that fit the invented prose: what comes second in a sentence, and what stands before a name.
SEAM_WORDS = repair.Seams(follow=["der", "die", "und", "la", "le", "de", "el", "en", "of", "the", "is"], barred=["that", "with", "que", "mit", "dans", "con"])


def _damaged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Turns whose line breaks have swallowed the stop before them, as rows; and the first sentence of each conversation as its headline."""
    turns = table(spark, d, "conversations").where("text is not null").withColumn("text", F.regexp_replace("text", r"[.!?]\s*\n", " "))
    each = F.transform(tx.sentences(sg.whole(F.col("text"))), lambda s: F.struct(s.alias("s"), hy.clean_sentence_text(s).alias("sentence")))
    # rows, evidence and headlines read them: they are cut and cleaned once
    rows = leaders.cut(turns.select("conv_id", "role", F.struct("turn", F.xxhash64("text").alias("h")).alias("at"), F.posexplode(each).alias("n", "r")))
    heads = leaders.cut(rows.groupBy("conv_id").agg(F.min_by("r.s", F.struct("at", "n")).alias("headline")))
    return rows.select("conv_id", F.col("at.turn").alias("turn"), "n", "role", "r.sentence"), heads


@query(None)
def repaired_rows(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of all conversations, mended where two have run together, without what has nothing to do with the first; the tests hold the operator against a walk row by row."""
    rows, heads = _damaged(spark, d)
    whole = repair.repaired(rows, "conv_id", heads, rows.select("conv_id", "sentence"), SEAM_WORDS)
    return repair.related(whole, "conv_id", heads).select("conv_id", "turn", "n", "piece", "role", "sentence")


# ---------------------------------------------------------------- the stored table of events


@query(r"""WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS event_id, turn AS seq, lpad(CAST(turn AS VARCHAR), 6, '0') AS moment, left(text, 40) AS title, text AS summary, role AS source, CASE turn % 3 WHEN 1 THEN 'world' WHEN 2 THEN 'local' END AS category,
  CAST(coalesce(length(text), 0) // 40 % 31 AS DOUBLE) AS strength, turn % 4 = 0 AS dev, CASE WHEN turn % 5 = 3 THEN 1 ELSE 0 END AS major, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS queued FROM conversations),
 b AS (SELECT event_id, list_reduce(list({'title': title, 'summary': summary, 'strength': strength} ORDER BY seq), lambda b, x: CASE WHEN x.strength >= b.strength + 2 THEN x ELSE b END) AS b FROM t GROUP BY 1),
 e AS (SELECT event_id, list_sort(list_distinct(flatten(list(regexp_extract_all(coalesce(summary, ''), '[A-Z][a-z]{4,}'))))) AS e FROM t GROUP BY 1),
 s AS (SELECT event_id, list(source ORDER BY seq) AS s FROM (SELECT event_id, source, min(seq) AS seq FROM t WHERE source <> '' GROUP BY 1, 2) GROUP BY 1)
 SELECT event_id, b.title AS canonical_title, coalesce(b.summary, '') AS canonical_summary, max_by(category, seq) FILTER (category IS NOT NULL) AS category, min_by(moment, seq) AS first_seen, max(moment) AS last_seen, CAST(max(major) AS BIGINT) AS major, CAST(sum(queued) AS BIGINT) AS queued_count,
  max_by(moment, seq) FILTER (dev) AS last_development, CAST(to_json(any_value(e)) AS VARCHAR) AS entities, coalesce(CAST(to_json(any_value(s)) AS VARCHAR), '[]') AS related_sources FROM t JOIN b USING (event_id) JOIN e USING (event_id) LEFT JOIN s USING (event_id) GROUP BY event_id, b""")
def event_table(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as events, turns as their reports: rows of the stored table, by the rules of all its fields; its state is JSON of the same and left out here."""
    text, turn = F.col("text"), F.col("turn")
    none = F.array().cast("array<string>")
    reports = table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("event_id"), turn.alias("seq"), F.lpad(turn.cast("string"), 6, "0").alias("at"), F.left(text, F.lit(40)).alias("title"), text.alias("summary"), F.col("role").alias("source"),
        F.when(turn % 3 == 1, "world").when(turn % 3 == 2, "local").alias("category"), (F.floor(F.coalesce(F.length(text), F.lit(0)) / 40) % 31).cast("double").alias("strength"), (turn % 4 == 0).alias("development"),
        F.when(turn % 5 == 3, 1).otherwise(0).alias("major"), F.when(F.col("role") == "user", 1).otherwise(0).alias("queued"), F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Z][a-z]{4,})"), F.lit(1)).alias("entities"),
        *(F.lit(None).cast("string").alias(c) for c in ("sector", "subsector", "region", "subregion", "country", "event_time", "verification", "status")), *(none.alias(g) for g in event_state.GATHERED if g != "entities"),
    ).withColumn("identity", F.struct("title", "entities"))
    rows = event_state.event_rows(event_state.event_state(reports))
    return rows.select("event_id", "canonical_title", "canonical_summary", "category", "first_seen", "last_seen", "major", "queued_count", "last_development", "entities", "related_sources")


# ---------------------------------------------------------------- thin stories and their articles

_MARKED = " OR ".join(f"contains(lower(html), {_sql(m)})" for m in enrichment.PAYWALL_MARKERS)


@query(rf"""WITH s AS (SELECT page_id AS id, url, substr(text, 61, 140) AS summary, length(text) % 100 AS score, {_HOST} AS host, string_split(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)), '/') AS path,
  lower(regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^?#]*)', 1), '/+$', '')) AS key FROM pages JOIN documents ON doc_id = page_id),
 j AS (SELECT *, CASE WHEN score IS NULL OR score < 40 THEN 'unimportant' WHEN url IS NULL OR trim(url) = '' THEN 'no_url' WHEN len(regexp_extract_all(coalesce(summary, ''), '[.!?]')) >= 3 THEN 'full' WHEN list_has_any(path, [{', '.join(map(_sql, enrichment.NO_ARTICLE))}]) THEN 'non_article'
  WHEN NOT coalesce(host = 'example.com' OR host LIKE '%.example.com' OR host = 'example.org' OR host LIKE '%.example.org', false) THEN 'domain_blocked' END AS known FROM s),
 a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS n FROM j WHERE known IS NULL),
 g AS (SELECT lower(regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^?#]*)', 1), '/+$', '')) AS key, min_by(html, page_id) AS html FROM pages WHERE url IS NOT NULL GROUP BY 1),
 p AS (SELECT key, html, list_filter(list_transform(string_split_regex(html, '(?i)<p(?:\s[^>]*)?>')[2:], lambda p: trim(regexp_replace(regexp_replace(regexp_replace(p, '(?is)(?:</p\s*>|</article\s*>|</body\s*>).*$', ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))), lambda p: length(p) >= 40)[:12] AS said FROM g),
 o AS (SELECT j.id, CASE WHEN known IS NOT NULL THEN known WHEN n > 15 THEN 'budget_exhausted' WHEN NOT contains(html, '<') THEN 'not_html' WHEN {_MARKED} THEN 'paywall' WHEN len(said) = 0 THEN 'no_text' WHEN len(said) < 2 THEN 'not_expanded' ELSE 'ok' END AS outcome, said FROM j LEFT JOIN a ON j.id = a.id LEFT JOIN p ON j.key = p.key)
 SELECT id, outcome, outcome = 'ok' AS expanded, CASE WHEN outcome = 'ok' THEN array_to_string(said, ' ') END AS told FROM o""")
def enriched_stories(spark: SparkSession, d: str) -> DataFrame:
    """Pages as stories whose summaries are a few words of a document: the fifteen first thin ones of two sites get the paragraphs of their pages."""
    landed = table(spark, d, "pages")
    text = F.col("text")
    rows = landed.select(F.col("page_id").alias("id"), "url").join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    rows = rows.select("id", "url", F.left(text, F.lit(60)).alias("title"), F.substring("text", 61, 140).alias("summary"), (F.length(text) % 100).alias("score"))
    domains = spark.createDataFrame([("example.com",), ("example.org",)], "domain string")
    few = F.regexp_count(F.coalesce("summary", F.lit("")), F.lit("[.!?]")) < 3
    cache = spark.createDataFrame([], enrichment.CACHE)
    out, _ = enrichment.enriched(rows, landed, cache, F.lit("2024-01-01 00:00:00"), F.desc("score"), domains=domains, important=F.col("score") >= 40, thin=few, told=enrichment.article)
    return out.select("id", "outcome", "expanded", F.array_join("article_sentences", " ").alias("told"))


# ---------------------------------------------------------------- pictures

_CUT = "page_id % 7 = 3"


@query(f"""SELECT page_id, (['png', 'gif', 'jpeg', 'webp'])[page_id % 4 + 1] AS kind, CASE WHEN NOT {_CUT} THEN CAST(page_id * 7 % 5000 + 1 AS BIGINT) END AS width, CASE WHEN NOT {_CUT} THEN CAST(coalesce(length(url), 0) + 1 AS BIGINT) END AS height FROM pages""")
def image_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Each page as a picture's file in one of four formats, a JPEG with its page in comment segments before its frame, some cut off within their sizes: what the files say."""
    p = table(spark, d, "pages")
    k, w, h = F.col("page_id"), F.col("page_id") * 7 % 5000 + 1, F.coalesce(F.length("url"), F.lit(0)) + 1
    digits = lambda v, n: F.lpad(F.hex(v.cast("long")), 2 * n, "0")
    swapped = lambda v, n: F.concat(*(F.substring(digits(v, n), 2 * i + 1, 2) for i in reversed(range(n))))
    page = F.hex(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.length(page) / 100_000).cast("int")), lambda i: F.substring(page, i * 100_000 + 1, F.lit(100_000)))
    comments = F.array_join(F.transform(parts, lambda x: F.concat(F.lit("FFFE"), digits(F.length(x) / 2 + 2, 2), x)), "")
    files = [
        F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), digits(w, 4), digits(h, 4)), F.concat(F.lit("474946383961"), swapped(w, 2), swapped(h, 2), F.lit("000000")),
        F.concat(F.lit("FFD8"), comments, F.lit("FFC0001108"), digits(h, 2), digits(w, 2), F.lit("0300")), F.concat(F.lit("524946460000000057454250565038580A00000010000000"), swapped(w - 1, 3), swapped(h - 1, 3)),
    ]
    whole = F.unhex(F.element_at(F.array(*files), (k % 4 + 1).cast("int")))
    file = F.when(k % 7 == 3, F.expr("substring(_f, 1, octet_length(_f) - 6)")).otherwise(F.col("_f"))
    made = p.select("page_id", whole.alias("_f")).select("page_id", file.alias("f"))
    found = made.select("page_id", images.kind(F.col("f")).alias("kind"), images.dimensions(F.col("f")).alias("size"))
    return found.select("page_id", "kind", "size.width", "size.height")
