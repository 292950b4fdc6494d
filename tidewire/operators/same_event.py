"""Whether stories report one event, by several kinds of evidence and with vetoes, and groups of such stories around their earliest.

Two stories are one event if their titles share two names and an action, a fact or much of their words; or one name and an action and either another action, a fact, or some of their words. A fact is a number with its unit, or
a number of four digits or more, or that both are strongly corroborated. Never: more than `hours` apart, the same unit with different numbers, or places named on both sides of which none is shared.

Every such pair shares two names, or a name and an action. So candidates meet by these compound keys within windows of time, which are far rarer than a name alone; vetoes and evidence are then told from both
sides' features, before anyone founds a group. A name and an action that a third of all stories share meets only within `hours`.

Defined results: a story without a time is compared with stories of any time; one without names, or with a null title, is linked with nothing; stories of one id are one row (the first title by order); null ids give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as lex
from ..functions import signals as sg
from . import leaders

HOURS = 72
#: Evidence that makes one event: each row is enough. Numbers are the least that each kind must come to.
EVIDENCE = [
    {"names": 2, "actions": 1}, {"names": 2, "facts": 1}, {"names": 2, "alike": 0.30},
    {"names": 1, "actions": 2}, {"names": 1, "actions": 1, "facts": 1}, {"names": 1, "actions": 1, "alike": 0.15},
]


def features(stories: DataFrame) -> DataFrame:
    """(id, t, names, places, actions, units, facts, words, sure) of stories (id, title, effective_at, strong: optional)."""
    title = F.col("title")
    strong = F.coalesce(F.col("strong"), F.lit(False)) if "strong" in stories.columns else F.lit(False)
    told = stories.where("id is not null").groupBy("id").agg(F.min(F.struct(F.coalesce("title", F.lit("")).alias("title"), F.col("effective_at").cast("timestamp").alias("at"), strong.alias("sure"))).alias("s")).select("id", "s.*")
    large = F.filter(F.transform(F.regexp_extract_all(title, F.lit(r"(\d[\d,.]*)"), F.lit(1)), lambda n: F.replace(n, F.lit(","), F.lit(""))), lambda n: F.length(n) >= 4)
    words = F.filter(F.array_distinct(sg.runs(title, "[a-z0-9]+")), lambda w: (F.length(w) >= 4) & ~w.isin(lex.TOKEN_STOPWORDS))
    made = told.select("id", F.unix_seconds("at").alias("t"), sg.names(title).alias("names"), sg.actions(title).alias("actions"), sg.number_units(title).alias("units"), large.alias("large"), words.alias("words"), "sure")
    facts = F.array_distinct(F.concat(F.transform(F.map_entries("units"), lambda e: F.concat(F.lower(e["key"]), F.lit("="), e["value"])), "large"))
    return made.select("id", "t", F.array_distinct("names").alias("names"), F.array_intersect("names", sg.strings(lex.PLACES)).alias("places"), "actions", "units", facts.alias("facts"), "words", "sure")


def _keys() -> Column:
    """Pairs of a name and an action, and of two names in order."""
    acted = F.flatten(F.transform("names", lambda n: F.transform("actions", lambda a: F.concat(F.lit("a:"), n, F.lit("|"), a))))
    both = F.flatten(F.transform("names", lambda n: F.transform(F.filter("names", lambda m: m > n), lambda m: F.concat(F.lit("n:"), n, F.lit("|"), m))))
    return F.array_union(acted, both)


def candidates(rows: DataFrame, hours: int = HOURS) -> DataFrame:
    """(a, b), a < b, of features that share a compound key and aren't certainly too far apart."""
    keyed = rows.select("id", F.floor(F.col("t") / (hours * 3600)).alias("slot"), F.explode(_keys()).alias("key"))
    timed, free = keyed.where("slot is not null"), keyed.where("slot is null").select("id", "key")
    near = timed.select(F.col("id").alias("a"), "key", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)).alias("slot")).join(timed.withColumnRenamed("id", "b"), ["key", "slot"])
    any_time = free.select(F.col("id").alias("a"), "key").join(keyed.select(F.col("id").alias("b"), "key"), "key")
    ordered = any_time.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return near.select("a", "b").unionByName(ordered).where("a < b").distinct()


def vetoed(hours: int = HOURS) -> Column:
    """Of features x and y: too far apart, another number for a unit, or other places."""
    far = F.coalesce(F.abs(F.col("x.t") - F.col("y.t")) > hours * 3600, F.lit(False))
    other_number = F.exists(F.map_keys("x.units"), lambda u: F.coalesce(F.try_element_at(F.col("y.units"), u) != F.try_element_at(F.col("x.units"), u), F.lit(False)))
    other_place = (F.size("x.places") > 0) & (F.size("y.places") > 0) & ~F.arrays_overlap("x.places", "y.places")
    return far | other_number | other_place


def evident() -> Column:
    shared = {n: F.size(F.array_intersect(f"x.{n}", f"y.{n}")) for n in ("names", "actions", "facts", "words")}
    all_words = F.size(F.array_union("x.words", "y.words"))
    found = {
        "names": shared["names"], "actions": shared["actions"], "facts": shared["facts"] + (F.col("x.sure") & F.col("y.sure")).cast("int"),
        "alike": F.when((F.size("x.words") > 0) & (F.size("y.words") > 0), shared["words"] / F.greatest(all_words, F.lit(1))).otherwise(0.0),
    }
    out = F.lit(False)
    for row in EVIDENCE:
        met = F.lit(True)
        for kind, least in row.items():
            met = met & (found[kind] >= least)
        out = out | met
    return out


def links(stories: DataFrame, hours: int = HOURS) -> DataFrame:
    """(a, b), a < b: stories that are one event."""
    rows = leaders.cut(features(stories))
    side = lambda name, end: rows.select(F.col("id").alias(end), F.struct(*(c for c in rows.columns if c != "id")).alias(name))
    return candidates(rows, hours).join(side("x", "a"), "a").join(side("y", "b"), "b").where(evident() & ~vetoed(hours)).select("a", "b")


def groups(stories: DataFrame, hours: int = HOURS) -> DataFrame:
    """(id, leader): each story with the first founder (in order of ids) that reports its event; founders are stories that no earlier founder does. No chains: members meet founders only."""
    return leaders.groups(stories.select("id"), leaders.cut(links(stories, hours)))
