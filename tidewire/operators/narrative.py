"""From the sentences of an event's stories to a short account of it. Groups are never collected: every step keeps one row a group and round, or meets by keys."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import facts, hygiene, summary
from ..functions import signals as sg
from ..functions.text import sentences
from . import leaders, repair, similarity


def informed(rows: DataFrame, sentence: str = "sentence") -> DataFrame:
    """Adds facts, worth and informative."""
    rows = rows.withColumn("facts", facts.of_sentence(F.col(sentence)))
    return rows.withColumn("worth", facts.worth(F.col("facts"))).withColumn("informative", facts.informative(F.col("facts")))


def select_rows(rows: DataFrame, key: str, most: int = 4) -> DataFrame:
    """Of (key, pos, sentence, article), the up to `most` sentences of a key that say most: (key, turn, pos, sentence, article, facts, worth).

    Sentences of articles come before others, those with facts before those without, by worth, then in order. One that tells what a chosen one told already
    (a number and its consequence) is passed over; equal sentences count once. Each round takes one sentence of every key, so a key of any size costs no task more than its rows.
    """
    norm = hygiene.normalised(F.col("sentence"))
    once = rows.where(F.coalesce(F.trim("sentence"), F.lit("")) != "").withColumn("norm", norm).groupBy(key, "norm")
    once = once.agg(F.min(F.struct((~F.coalesce("article", F.lit(False))).alias("late"), "pos", "sentence")).alias("r")).select(key, "r.*")
    ranked = informed(once).withColumn("rank", F.struct("late", (~F.col("informative")).alias("bare"), F.when(F.col("informative"), -F.col("worth")).otherwise(0.0).alias("less"), "pos", "sentence"))
    left = leaders.cut(ranked.select(key, "rank", F.struct("pos", "sentence", (~F.col("late")).alias("article"), "facts", "worth").alias("r")))
    chosen = None
    for turn in range(most):
        best = leaders.cut(left.groupBy(key).agg(F.min_by(F.struct("rank", "r"), "rank").alias("b")))
        now = best.select(key, F.lit(turn).alias("turn"), "b.r.*")
        chosen = now if chosen is None else chosen.unionByName(now)
        if turn + 1 < most:
            left = leaders.cut(left.join(best, key).where((F.col("rank") > F.col("b.rank")) & ~facts.covers(F.col("r.facts"), F.col("b.r.facts"))).drop("b"))
    return chosen


def in_order(chosen: DataFrame, key: str) -> DataFrame:
    """Adds place (from 0) to chosen sentences: what leads, by worth; then details and consequences in order. Without a lead the worthiest detail leads. A key has few of them."""
    group = Window.partitionBy(key)
    rows = chosen.withColumn("_b", facts.bucket(F.col("facts")))
    rows = rows.withColumn("_none", F.min("_b").over(group) > 0).withColumn("_first", F.min(F.when(F.col("_b") == 1, F.struct((-F.col("worth")).alias("w"), "turn"))).over(group))
    rows = rows.withColumn("_b", F.when(F.col("_none") & (F.col("turn") == F.col("_first.turn")) & (F.col("_b") == 1), 0).otherwise(F.col("_b")))
    order = group.orderBy("_b", F.when(F.col("_b") == 0, -F.col("worth")).otherwise(0.0), "turn")
    return rows.withColumn("place", F.row_number().over(order) - 1).drop("_b", "_none", "_first")


def _cleaned(text: Column) -> Column:
    """A text's sentences, each cleaned; filters on rows made of them don't clean them again."""
    return F.transform(sentences(sg.whole(text)), hygiene.clean_sentence_text)


def aggregated(items: DataFrame, group: str, headline: Column) -> DataFrame:
    """The sentences of a group's items, (group, seq, source, sentence), without what an earlier one says, nearly says or contradicts.

    items: group, rank (order within the group, no ties), source, summary. Cleaned sentences; fillers and paraphrases of the headline go. A sentence stays if no earlier one
    that stays has the same tokens by 0.8, or another number for one of its units while sharing two words.
    """
    rows = items.withColumn("_h", headline).select(group, "rank", "source", "_h", F.posexplode(_cleaned(F.col("summary"))).alias("pos", "sentence")).where(F.col("sentence") != "")
    rows = rows.where(~hygiene.filler(F.col("sentence")) & ~F.coalesce(summary.paraphrases(F.col("sentence"), F.col("_h")), F.lit(False)))
    rows = rows.groupBy(group, hygiene.normalised(F.col("sentence")).alias("norm")).agg(F.min(F.struct("rank", "pos", "source", "sentence")).alias("r")).select(group, "r.*")
    rows = leaders.cut(rows.withColumn("_sid", F.xxhash64(group, "rank", "pos")))
    tokens = F.array_distinct(F.filter(sg.words(F.lower("sentence")), lambda w: (F.length(w) >= 4) & ~w.isin(sg.lex.NAME_STOPWORDS)))
    told = leaders.cut(rows.select(group, "_sid", F.struct("rank", "pos").alias("at"), tokens.alias("words"), sg.number_units(F.col("sentence")).alias("units")))
    # alike: tokens carry their group, so only sentences of one group can share them
    own = F.transform("words", lambda w: F.concat_ws("\u0001", F.col(group).cast("string"), w))
    alike = similarity.similar_pairs(told.withColumn("tokens", own).select(F.col("_sid").alias("id"), "tokens").where(F.size("tokens") >= 3), 0.8).select("a", "b")
    # at odds: they meet on a unit and two words
    keyed = told.select(group, "_sid", F.explode("units").alias("unit", "n"), "words").withColumn("words", F.array_sort("words"))
    pairs = F.flatten(F.transform("words", lambda x, i: F.transform(F.slice("words", i + 2, F.size("words")), lambda y: F.concat_ws(" ", x, y))))
    keyed = keyed.select(group, "_sid", "unit", "n", F.explode(pairs).alias("pair"))
    odd = keyed.alias("x").join(keyed.alias("y"), [group, "unit", "pair"]).where("x._sid < y._sid and x.n <> y.n").select(F.col("x._sid").alias("a"), F.col("y._sid").alias("b"))
    at = told.select("_sid", "at")
    links = alike.unionByName(odd).distinct().join(at.toDF("a", "at_a"), "a").join(at.toDF("b", "at_b"), "b")
    first = F.col("at_a") < F.col("at_b")
    links = links.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"))
    kept = leaders.founders(told.select(F.col("_sid").alias("id")), leaders.cut(links)).toDF("_sid")
    return rows.join(kept, "_sid", "left_semi").select(group, F.struct("rank", "pos").alias("seq"), "source", "sentence")


#: Phrases that tell a state, in order.
STATES = ("under control", "contained", "ongoing", "still burning", "spreading", "out of control", "evacuation order", "state of emergency", "under investigation", "no injuries", "ceasefire")
NEXT = r"(?i)\b(?:will (?:meet|vote|hold|begin|start|resume|return|appear|continue)|is (?:due|set|scheduled|expected) to|are (?:due|set|scheduled|expected) to)\b"


def bullets(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """For each key: the first place, state, impact and next step that its sentences tell, as a map; a kind that none tells isn't there."""
    s = F.col("sentence")
    low = F.lower(s)
    places_, strikes = facts.locations(s), facts.impacts(s)
    place = F.get(F.filter(places_, lambda p: ~F.startswith(p, F.lit("the "))), 0)
    state = F.array_min(F.array_compact(F.array(*(F.when(F.contains(low, F.lit(p)), F.struct(F.lit(k).alias("k"), F.lit(p).alias("p"))) for k, p in enumerate(STATES)))))
    at = F.struct(*order)
    first = lambda value, by=at: F.min_by(value, F.when(value.isNotNull(), by))
    found = rows.groupBy(key).agg(
        first(place).alias("location"), F.min(state).alias("status"), first(F.get(strikes, 0).phrase).alias("impact"), first(F.when(s.rlike(NEXT), s)).alias("next")
    )
    kinds = {"Location": F.col("location"), "Status": F.col("status.p"), "Impact": F.col("impact"), "Next": F.col("next")}
    pairs = F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in kinds.items())))
    return found.select(key, F.map_from_entries(pairs).alias("bullets"))


def verdict(chosen: DataFrame, key: str, headline: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """(key, ok, reason): why an account can't stand: no_news_content, question_only, headline (it contradicts source), off_topic; null if it can.

    headline: (key, headline); source: (key, text) the whole that it was taken from.
    """
    ask, some = facts.question(F.col("sentence")), facts.informative(F.col("facts"))
    body = chosen.groupBy(key).agg(F.every(ask).alias("asks"), F.some(some).alias("tells"), F.array_sort(F.collect_list(F.struct("place", "sentence"))).alias("s"))  # a few sentences
    body = headline.join(body, key, "left").withColumn("text", F.array_join(F.transform("s", lambda x: x.sentence), " "))
    h = F.coalesce("headline", F.lit(""))
    against = F.lit(False)
    if source is not None:
        body = body.join(source.select(key, F.col("text").alias("source_text")), key, "left")
        against = F.size(facts.contradictions(h, F.col("source_text"))) > 0
    reason = F.when(F.col("s").isNull() | (~F.col("tells") & ~F.col("asks")), "no_news_content").when(F.col("asks"), "question_only").when(against, "headline").when((F.trim(h) != "") & ~facts.linked(h, F.col("text")), "off_topic")
    return body.select(key, reason.isNull().alias("ok"), reason.alias("reason"))


def mended(items: DataFrame, rows: DataFrame, group: str, headline: Column) -> DataFrame:
    """Rows (group, pos, sentence, ...) of items without damage and without what is of another story; pos is a struct then, with the piece of the row. All items' sentences are evidence."""
    said = items.select(group, F.explode(_cleaned(F.col("summary"))).alias("sentence"))
    heads = leaders.cut(items.groupBy(group).agg(F.min_by(headline, "rank").alias("headline")))
    whole = repair.repaired(leaders.cut(rows), group, heads, said)
    return leaders.cut(repair.related(whole, group, heads).withColumn("pos", F.struct("pos", "piece")).drop("piece"))


def briefing(items: DataFrame, group: str, headline: Column, most: int = 4) -> DataFrame:
    """A group's account: (group, opening: two sentences, body: the rest, bullets, sources). items as for aggregated(), with article (the summary is an article's own)."""
    items = leaders.cut(items)  # six steps read them
    rows = aggregated(items, group, headline)
    marked = rows.join(items.select(group, "rank", "article"), (rows[group] == items[group]) & (rows["seq.rank"] == items["rank"])).select(rows[group], F.col("seq").alias("pos"), "sentence", "article", "source")
    marked = mended(items, marked, group, headline)
    placed = leaders.cut(in_order(select_rows(marked, group, most), group))
    account = placed.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("place", "sentence"))).alias("s"))  # at most `most` sentences
    text = F.transform("s", lambda x: x.sentence)
    account = account.select(group, F.slice(text, 1, 2).alias("opening"), F.slice(text, 3, most).alias("body"))
    told = bullets(placed, group, "place")
    # sources are the few feeds of a configuration
    named = items.where("source is not null").groupBy(group).agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return account.join(told, group).join(named, group, "left")
