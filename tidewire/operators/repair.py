"""Rows of an account that extraction has damaged: two sentences in one row, and rows that belong to another story.

A row's text is a sentence of one of its key's sources. Where the boundary between two sentences was lost, a word with a capital letter follows one without ('... centre Orangutans rescued ...'):
a seam. It may also be a name, so a seam needs evidence: the word stands in the key's headline or in another sentence of its sources. Evidence is looked up in an index of the words of those keys
that have a seam at all; of each word the index keeps only the least and the greatest sentence it stands in, which is enough to tell whether another sentence than the row's own has it. So neither a
key's texts nor its rows are gathered anywhere, and a word that a third of all sentences have is one row of the index after the map-side sums.

Defined results: a null or blank sentence is no row; equal rows of a key are repaired alike, each by itself; a null headline or one of no row tells nothing; rows with a null key find no headline and no evidence;
an empty table gives no rows. Columns other than those named are passed on. Sentences may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as lex
from ..functions import facts, summary
from ..functions import signals as sg
from . import leaders

_TITLE = r"[A-Z][a-z]+(?:-[A-Za-z]+)*"
_LOWER = r"\b[a-z][a-z’'-]*+"


def _some(words) -> str:  # noqa: ANN001
    return "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"


class Seams:
    """Where a sentence may hide a boundary. follow: words that can come second in a sentence; barred: words before a name, none of which is among the two before a seam; known: names in lower case, and other words that have a capital anywhere.

    Kinds, the first that is there counts, and its first place:
    a plain word, the capital one, a word of `follow`; a closing quote behind a plain word, the capital one, any word; a number of two to four digits, the capital one, and it ends in -ing or a word of
    `follow` comes next; an ellipsis behind a plain word, the capital one. Quotes and ellipses are boundaries by themselves, the others need evidence.
    """

    def __init__(self, follow=lex.SECOND_WORDS, barred=lex.BEFORE_NAMES, known=(*lex.DATE_WORDS, *lex.KNOWN_NAMES, *lex.PLACES, *lex.ALIASES), reporting=lex.REPORTING, prepositions=lex.AFTER_REPORT):  # noqa: ANN001
        word = r"[A-Za-z’'-]"
        unknown = rf"(?!(?i:{_some(known)})(?![A-Za-z-]))"
        free = rf"(?<!(?<!{word})(?i:{_some(barred)})[^A-Za-z’'-]{{1,12}})(?<!(?<!{word})(?i:{_some(barred)})[^A-Za-z’'-]{{1,12}}{word}{{1,40}}[^A-Za-z’'-]{{1,12}})"
        second = rf"\s+{_some(follow)}(?![A-Za-z’'-])"
        head = r"(?s)^(.*?"
        self.kinds = [
            (rf"{head}{_LOWER}(?<!['’-])\s+){free}(?={unknown}{_TITLE}{second})", False),
            (rf"{head}\b[a-z][a-z’'-]*['\"’”]\s+)(?={unknown}{_TITLE}\s+[A-Za-z])", True),
            (rf"{head}\b\d{{2,4}}\s+){free}(?={unknown}(?:{_TITLE}{second}|[A-Z][a-z]*+(?<=ing)\s+[a-z]))", False),
            (rf"{head}{_LOWER}[?!]?\s*(?:…|\.\.\.)\s*)(?={unknown}{_TITLE})", True),
        ]
        self.reported = rf"{head}\b(?i:{_some(reporting)})\s+)(?={unknown}{_TITLE}\s+{_some(prepositions)}\b)"

    def find(self, sentence: Column) -> Column:
        """(head: all before the seam, title: the word behind it, sure: it needs no evidence, reported: the word follows a verb of saying and has its capital by mistake); null without a seam."""
        heads = [(F.regexp_extract(sentence, pattern, 1), sure, False) for pattern, sure in self.kinds] + [(F.regexp_extract(sentence, self.reported, 1), False, True)]
        title = lambda h: F.regexp_extract(F.substring(sentence, F.length(h) + 1, F.length(sentence)), f"^({_TITLE})", 1)
        found = F.coalesce(*(F.when(h != "", F.struct(h.alias("head"), F.lit(sure).alias("sure"), F.lit(said).alias("reported"))) for h, sure, said in heads))
        whole = sg.bind(found, lambda x: F.when(x["head"].isNotNull(), F.struct(x["head"].alias("head"), title(x["head"]).alias("title"), x["sure"].alias("sure"), x["reported"].alias("reported"))))
        # an untroubled sentence meets no pattern: a capital behind a plain word, a digit, a quote or an ellipsis is what all have in common
        return F.when(sentence.rlike(r"[a-z0-9’'\"”…?!.-]\s*(?<=[\s….])[A-Z][a-z]"), whole)

    def fused(self, sentence: Column) -> Column:
        """The sentence has a seam of the four kinds."""
        return F.coalesce(~self.find(sentence).reported, F.lit(False))


def quote_parts(sentence: Column) -> Column:
    """A sentence cut where a closing quote stands behind its full stop: ['...food."', 'The fund said so.']."""
    return F.filter(F.split(sentence, r"(?<=[.!?]['\"‘’“”])\s+"), lambda p: F.trim(p) != "")


def _plain(word: Column) -> Column:
    """A word as evidence knows it: in lower case, without hyphens and the s of a plural."""
    return F.regexp_replace(F.replace(F.lower(word), F.lit("-"), F.lit("")), "(?<!s)s$", "")


def _evidence(text: Column) -> Column:
    """Words of a text, and each two that stand together as one: 'cross benchers' bears out 'Cross-benchers'."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]+(?:-[a-z]+)*)"), F.lit(1)), _plain)
    return sg.bind(words, lambda w: F.array_distinct(F.concat(w, F.transform(F.slice(w, F.lit(2), F.size(w)), lambda x, k: F.concat(F.get(w, k), x)))))


def repaired(rows: DataFrame, key: str, headlines: DataFrame, said: DataFrame, seams: Seams | None = None, sentence: str = "sentence") -> DataFrame:
    """Rows with their damage mended, and piece: the place of a part within its row, from 0.

    A row is cut behind closing quotes; a part that only repeats the headline goes, if there was a cut. What has a seam with evidence becomes two rows, the first closed by a full stop; without evidence it goes, as the words
    may be a name's. Behind a verb of saying the word loses its capital letter if there is evidence, and stays as it is without. A part that has a further seam goes, too.

    rows: key, sentence and more; headlines: (key, headline), one a key; said: (key, sentence) all sentences of the sources, cut and cleaned as the rows are.
    """
    seams = seams or Seams()
    head = headlines.select(key, F.col("headline").alias("_h"))
    own = [c for c in rows.columns if c != "piece"]
    cut = rows.select(*own).where(F.coalesce(F.trim(sentence), F.lit("")) != "").join(head, key, "left")
    parts = cut.withColumn("_parts", quote_parts(F.col(sentence)))
    parts = parts.select(*(c for c in own if c != sentence), "_h", (F.size("_parts") > 1).alias("_cut"), F.posexplode("_parts").alias("_part", sentence))
    parts = parts.where(~F.col("_cut") | ~summary.paraphrases(F.col(sentence), F.col("_h"))).withColumn("_seam", seams.find(F.col(sentence)))
    parts = leaders.cut(parts.withColumn("_word", _plain(F.col("_seam.title"))).withColumn("_own", F.xxhash64(F.trim(sentence))))

    asked = parts.where("_seam is not null and not _seam.sure").select(key, "_word").distinct()
    source = said.where(F.col("sentence").isNotNull()).join(asked.select(key).distinct(), key, "left_semi")
    each = source.select(key, F.explode(quote_parts(F.col("sentence"))).alias("s")).select(key, F.xxhash64(F.trim("s")).alias("at"), F.explode(_evidence(F.col("s"))).alias("_word"))
    titles = head.where("_h is not null").join(asked.select(key).distinct(), key, "left_semi").select(key, F.lit(None).cast("long").alias("at"), F.explode(_evidence(F.col("_h"))).alias("_word"))
    index = each.unionByName(titles).join(asked, [key, "_word"], "left_semi").groupBy(key, "_word").agg(F.min("at").alias("_least"), F.max("at").alias("_most"), F.some(F.col("at").isNull()).alias("_titled"))

    met = parts.join(index, [key, "_word"], "left")
    shown = F.coalesce(F.col("_titled") | (F.col("_least") != F.col("_own")) | (F.col("_most") != F.col("_own")), F.lit(False))
    s, x = F.col(sentence), F.col("_seam")
    before, rest = F.rtrim(x["head"]), F.substring(s, F.length(x["head"]) + 1, F.length(s))
    closed = F.when(before.rlike("[.!?]$"), before).otherwise(F.concat(before, F.lit(".")))
    small = F.concat(x["head"], F.lower(x.title), F.substring(rest, F.length(x.title) + 1, F.length(rest)))
    pieces = (
        F.when(x.isNull() | (x.reported & ~shown), F.array(s)).when(x.reported, F.array(small)).when(x.sure | shown, F.array(closed, F.trim(rest))).otherwise(F.array().cast("array<string>"))
    )
    out = met.select(*(c for c in own if c != sentence), "_part", F.posexplode(pieces).alias("_half", sentence))
    return out.where(~seams.fused(F.col(sentence))).select(*own, (F.col("_part") * 2 + F.col("_half")).alias("piece"))


def _off_topic(sentence: Column, headline: Column) -> Column:
    """A sentence names someone that the headline doesn't: a run of two or more words with capitals that is no known name and holds no place and no name of the headline."""
    flat = F.array_join(sg.words(sentence), " ")
    runs = F.transform(F.regexp_extract_all(flat, F.lit(r"(?<!\S)([A-Z]\S*(?: [A-Z]\S*)+)"), F.lit(1)), F.lower)
    there, low = sg.names(headline), F.lower(headline)
    known, places = sg.strings([*lex.KNOWN_NAMES, *lex.ALIASES]), sg.strings([*lex.PLACES, *(a for a, name in lex.ALIASES.items() if name in lex.PLACES)])
    close = lambda r: F.contains(low, r) | F.array_contains(known, r) | F.arrays_overlap(F.split(r, " "), places) | F.arrays_overlap(F.transform(F.split(r, " "), lambda w: sg.mapped(w, lex.ALIASES)), there) | F.arrays_overlap(F.split(r, " "), there)
    return F.exists(runs, lambda r: ~F.coalesce(close(r), F.lit(False)))


def _touches(sentence: Column, headline: Column) -> Column:
    """A sentence shares a name, an event word or a stem with the headline (also one inside the other, from four letters on), or tells who was struck."""
    stems = lambda t: F.filter(sg.content_tokens(t), lambda w: F.length(w) >= 4)
    inside = sg.bind(stems(headline), lambda hs: F.exists(stems(sentence), lambda a: F.exists(hs, lambda b: F.contains(a, b) | F.contains(b, a))))
    shared = F.lit(False)
    for told in (sg.names, sg.actions, sg.content_tokens):
        shared = shared | F.arrays_overlap(told(sentence), told(headline))
    return shared | inside | (F.size(facts.impacts(sentence)) > 0)


def unrelated(sentence: Column, headline: Column) -> Column:
    """A sentence is of another story: it turns to something else ('Meanwhile ...', or begins with a mark) or names someone off topic, and has nothing in common with the headline. False for a null or blank one of either."""
    s, h = F.coalesce(sentence, F.lit("")), F.coalesce(headline, F.lit(""))
    turns = s.rlike(rf"(?i)^\s*[\"“]*{_some(lex.TOPIC_TURNS)}\b|^[^\w]")
    return F.when((F.trim(s) != "") & (F.trim(h) != ""), (turns | _off_topic(s, h)) & ~_touches(s, h)).otherwise(False)


def related(rows: DataFrame, key: str, headlines: DataFrame, sentence: str = "sentence") -> DataFrame:
    """Rows without those of other stories. headlines: (key, headline), one a key."""
    met = rows.join(headlines.select(key, F.col("headline").alias("_h")), key, "left")
    return met.where(~unrelated(F.col(sentence), F.col("_h"))).select(*rows.columns)
