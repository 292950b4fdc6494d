"""The state of events as wide rows: each field says how reports accumulate in it, and all of them are brought together by key.

A rule a field: Keep (the first report's, whatever it is), Newest, Longest, Greatest, Total, Union (values of arrays, sorted), Gather (values in order of their first report), Recent (the last few, newest first),
Stronger (a description that gives way only to one stronger by a margin). Single values are one aggregation with partial sums. Values of lists are told apart by (key, field, value) first, so an event that a third
of all reports belong to sends each of its values once from each task; its row then holds its distinct values, which are the result. Recent ones are cut to their number before the shuffle. Descriptions need a round for
each replacement, and each raises the strength by the margin; a round keeps one row a key.

A stored state takes part as what came before all reports, so run after run gives what one run over everything gives, and an identity that is kept never changes.

Defined results: reports without a key are left out; one without seq comes first; reports of a key have different seqs, else which of equal ones comes first is open; null and empty values tell Newest, Longest, Union, Gather and
Recent nothing; a null strength counts as 0; stored rows without reports stay as they are; fields that a stored table doesn't have yet start from nothing; an empty table gives the stored rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import leaders, state, tables


@dataclass(frozen=True)
class Rule:
    column: str


class Keep(Rule):
    """The value of the first report."""


@dataclass(frozen=True)
class Newest(Rule):
    """The last value; when: a column of truth values, only reports where it holds count."""

    when: str | None = None


class Longest(Rule):
    """The longest text, the first of several."""


class Greatest(Rule):
    pass


class Total(Rule):
    pass


class Union(Rule):
    """The column holds arrays of strings."""


class Gather(Rule):
    pass


@dataclass(frozen=True)
class Recent(Rule):
    most: int = 8


@dataclass(frozen=True)
class Stronger:
    """A struct of the columns and strength; by: the column of strengths."""

    columns: tuple[str, ...]
    by: str
    margin: float = state.MARGIN


def _some(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("")) != ""


def _of(rules: dict, *kinds: type) -> dict:
    return {f: r for f, r in rules.items() if type(r) in kinds}


def _single(reports: DataFrame, stored: DataFrame | None, key: str, seq: str, rules: dict) -> DataFrame:
    came = reports.select(key, F.struct(F.lit(1).alias("run"), F.col(seq).alias("seq")).alias("_at"), *(F.when(F.col(r.when), F.col(r.column)).alias(f) if isinstance(r, Newest) and r.when else F.col(r.column).alias(f) for f, r in rules.items()))
    if stored is not None:
        old = stored.select(key, F.struct(F.lit(0).alias("run"), F.lit(None).cast(came.schema["_at"].dataType["seq"].dataType).alias("seq")).alias("_at"), *(f for f in rules if f in stored.columns))
        came = came.unionByName(old, allowMissingColumns=True)
    at = F.col("_at")

    def told(f: str, r: Rule) -> Column:
        v = F.col(f)
        if isinstance(r, Keep):
            return F.min_by(F.struct(v.alias("v")), at)["v"]
        if isinstance(r, Newest):
            return F.max_by(v, F.when(_some(v), at))
        if isinstance(r, Longest):
            return F.min_by(v, F.when(_some(v), F.struct(-F.length(v), at)))
        return F.max(v) if isinstance(r, Greatest) else F.sum(F.coalesce(v, F.lit(0)))

    return came.groupBy(key).agg(*(told(f, r).alias(f) for f, r in rules.items()))


def _lists(reports: DataFrame, stored: DataFrame | None, key: str, seq: str, rules: dict) -> DataFrame:
    """(key, field, value, run, seq, pos): a row for each value; of a stored list, pos is the place in it."""
    each = lambda rows, run, at, lists: rows.select(key, F.lit(run).alias("run"), at.alias("seq"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), v.cast("array<string>").alias("values")) for f, v in lists.items()))).alias("l")).select(
        key, "run", "seq", "l.field", F.posexplode("l.values").alias("pos", "value")
    )
    out = each(reports, 1, F.col(seq), {f: F.col(r.column) if isinstance(r, Union) else F.array(F.col(r.column)) for f, r in rules.items()})
    known = {f: F.col(f) for f in rules if stored is not None and f in stored.columns}
    if known:
        out = out.unionByName(each(stored, 0, F.lit(None).cast(reports.schema[seq].dataType), known))
    return out.where(F.coalesce("value", F.lit("")) != "")


def _gathered(values: DataFrame, key: str, rules: dict) -> DataFrame:
    once = values.groupBy(key, "field", "value").agg(F.min(F.struct("run", "seq", "pos")).alias("at"))

    def told(f: str, r: Rule) -> Column:
        own = F.collect_list(F.when(F.col("field") == f, F.struct("at", "value")))
        return F.array_sort(F.transform(own, lambda x: x.value)) if isinstance(r, Union) else F.transform(F.array_sort(own), lambda x: x.value)

    return once.groupBy(key).agg(*(told(f, r).alias(f) for f, r in rules.items()))


def _recent(values: DataFrame, key: str, rules: dict) -> DataFrame:
    # within a run newer is greater; of a stored list the first is the newest
    place = F.row_number().over(Window.partitionBy(key, "field").orderBy(F.desc("run"), F.desc("seq"), F.asc("pos")))
    most = reduce(lambda c, f: F.when(F.col("field") == f, rules[f].most).otherwise(c), rules, F.lit(0))
    last = values.withColumn("_n", place).where(F.col("_n") <= max(r.most for r in rules.values())).where(F.col("_n") <= most)
    own = lambda f: F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("_n", "value"))))
    return last.groupBy(key).agg(*(F.transform(own(f), lambda x: x.value).alias(f) for f in rules))


def strongest(reports: DataFrame, stored: DataFrame | None, key: str, seq: str, field: str, rule: Stronger) -> DataFrame:
    """(key, field): the stored description or the first one, until a later one is stronger by the margin, and so on."""
    power = F.coalesce(F.col(rule.by), F.lit(0)).cast("double")
    said = reports.select(key, power.alias("s"), F.struct(F.col(seq).isNotNull().alias("timed"), F.col(seq).alias("seq")).alias("at"), F.struct(*rule.columns, power.alias("strength")).alias("d"))
    # only the first of equally strong ones can ever take over
    left = leaders.cut(said.groupBy(key, "s").agg(F.min_by(F.struct("at", "d"), "at").alias("r")).select(key, "s", "r.*"))
    best = left.groupBy(key).agg(F.min_by(F.struct("s", "at", "d"), "at").alias("b"))
    if stored is not None and field in stored.columns:
        known = stored.where(F.col(field).isNotNull()).select(key, F.struct(F.coalesce(F.col(field).strength, F.lit(0.0)).alias("s"), F.lit(None).cast(left.schema["at"].dataType).alias("at"), F.col(field).cast(left.schema["d"].dataType).alias("d")).alias("b"))
        best = known.unionByName(best.join(known.select(key), key, "left_anti"))
    best = leaders.cut(best)
    while True:
        left = leaders.cut(left.join(best, key).where((F.col("s") >= F.col("b.s") + rule.margin) & F.coalesce(F.col("at") > F.col("b.at"), F.lit(True))).select(left["*"]))
        if left.isEmpty():
            return best.select(key, F.col("b.d").alias(field))
        after = left.groupBy(key).agg(F.min_by(F.struct("s", "at", "d"), "at").alias("n"))
        best = leaders.cut(best.join(after, key, "left").select(key, F.coalesce("n", "b").alias("b")))


def accumulated(reports: DataFrame, key: str, seq: str, rules: dict[str, Rule | Stronger], stored: DataFrame | None = None) -> DataFrame:
    """(key, the fields in order of the rules) of all events, stored ones and those of the reports."""
    reports = reports.where(F.col(key).isNotNull())
    single, lists, recent = _of(rules, Keep, Newest, Longest, Greatest, Total), _of(rules, Union, Gather), _of(rules, Recent)
    keys = reports.select(key) if stored is None else reports.select(key).unionByName(stored.select(key))
    out = _single(reports, stored, key, seq, single) if single else keys.distinct()
    if lists:
        out = out.join(_gathered(_lists(reports, stored, key, seq, lists), key, lists), key, "left")
    if recent:
        out = out.join(_recent(_lists(reports, stored, key, seq, recent), key, recent), key, "left")
    for f, r in _of(rules, Stronger).items():
        out = out.join(strongest(reports, stored, key, seq, f, r), key, "left")
    empty = F.array().cast("array<string>")
    return out.select(key, *(F.coalesce(F.col(f), empty).alias(f) if f in lists or f in recent else F.col(f) for f in rules))


# ---------------------------------------------------------------- the tables as they are stored

#: The columns of the three tables.
STORY_COLUMNS = {
    "id": "string", "title": "string", "url": "string", "source": "string", "category": "string", "summary": "string", "score": "long", "confidence": "string", "event_id": "string", "event_status": "string", "first_seen": "string",
    "sector": "string", "subsector": "string", "region": "string", "subregion": "string", "country": "string", "entities": "string", "published_at": "string", "updated_at": "string", "event_time": "string", "last_seen": "string",
    "verification": "string",
}
EVENT_COLUMNS = {
    "event_id": "string", "canonical_title": "string", "category": "string", "first_seen": "string", "last_seen": "string", "major": "long", "queued_count": "long", "canonical_summary": "string", "canonical_state": "string",
    "sector": "string", "subsector": "string", "region": "string", "subregion": "string", "country": "string", "entities": "string", "event_time": "string", "last_development": "string", "related_sources": "string",
    "verification": "string",
}
HEALTH_COLUMNS = {
    "source_id": "string", "source_name": "string", "source_type": "string", "tier": "long", "region": "string", "sector": "string", "attempt_count": "long", "success_count": "long", "failure_count": "long",
    "articles_fetched": "long", "articles_accepted": "long", "articles_rejected": "long", "duplicates_generated": "long", "editorial_rejected_count": "long", "summarized_count": "long", "published_count": "long",
    "last_success": "string", "last_failure": "string", "last_article_at": "string", "last_seen": "string", "last_error": "string",
}

#: Sets of signals that an event gathers, and those that are its identity.
GATHERED = ("entities", "places", "actions", "core", "storms", "numbers", "consequences", "impact", "magnitudes", "dev_facts")
IDENTITY = ("entities", "places", "actions", "core", "storms", "numbers", "impact", "magnitudes", "title_tokens", "tokens")
_ABOUT = ("title", "summary", "source", "sector", "subsector", "region", "subregion", "country")

EVENT_RULES: dict[str, Rule | Stronger] = {
    "identity": Keep("identity"), "first_seen": Keep("at"), "last_seen": Greatest("at"), "event_time": Keep("event_time"), "category": Newest("category"), "major": Greatest("major"), "queued_count": Total("queued"),
    "last_development": Newest("at", when="development"), "verification": Newest("verification"), "summary": Longest("summary"), "status": Keep("status"), **{g: Union(g) for g in GATHERED},
    "titles": Recent("title", 8), "sources": Gather("source"), "best_story": Stronger(_ABOUT, "strength"),
}


def event_state(reports: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """What each event has gathered. reports: event_id, seq, at (text, sortable), title, summary, source, category, sector, subsector, region, subregion, country, event_time, verification (text), status, strength, major (0 or 1), queued (0 or 1),
    development (it founds the event or is an update), identity (a struct of the title, the summary and sets) and the sets GATHERED."""
    return accumulated(reports, "event_id", "seq", EVENT_RULES, stored)


def event_rows(states: DataFrame) -> DataFrame:
    """States as rows of the stored table: the best description leads, sets and state as JSON. A kept identity stands in the state, and matching reads nothing else."""
    rest = F.struct("identity", *GATHERED, "titles", "summary", "status", "sources", "category", "best_story")
    best = F.col("best_story")
    given = {
        "canonical_title": best.title, "canonical_summary": F.coalesce(best.summary, F.lit("")), "canonical_state": F.to_json(rest), "entities": F.to_json("entities"), "related_sources": F.to_json("sources"),
        "major": F.coalesce("major", F.lit(0)), **{c: best[c] for c in _ABOUT[3:]},
    }
    return states.select(*(given.get(c, F.col(c) if c in states.columns else F.lit(None)).cast(kind).alias(c) for c, kind in EVENT_COLUMNS.items()))


def aligned(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows of an older table with the columns that came later (null texts, numbers 0), in order; columns beyond those come last."""
    found = tables.align(rows, columns)
    return found.select(*columns, *(c for c in found.columns if c not in columns))
