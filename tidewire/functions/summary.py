"""Checks and repairs of summary sentences; built-in functions only. Null sentences give null, but for problems(): ['empty']."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .signals import bind
from .text import numbers, stem, tokens

STOPWORDS = ("a", "an", "the", "of", "in", "on", "at", "to", "for", "and", "or", "is", "are", "was", "were", "by", "with", "as", "that")
DANGLING = ("a", "an", "the", "of", "in", "on", "at", "to", "for", "and", "or", "but", "by", "with", "near", "from", "into")
STARTERS = ("However", "Meanwhile", "The", "This", "These", "There", "They", "It", "He", "She", "We", "But", "In", "After", "Officials")


def content_stems(text: Column) -> Column:
    """Distinct stems of the words that aren't stopwords."""
    words = F.filter(tokens(text), lambda w: ~w.isin(*STOPWORDS))
    return F.array_distinct(F.transform(words, stem))


def paraphrases(sentence: Column, headline: Column) -> Column:
    """The sentence says what the headline says: half of its three stems or more are there, and it has no number of its own."""
    there = content_stems(F.coalesce(headline, F.lit("")))
    same = F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " ")) == F.trim(F.regexp_replace(F.lower(headline), "[^a-z0-9]+", " "))
    fresh = F.size(F.array_except(numbers(sentence), numbers(F.coalesce(headline, F.lit(""))))) > 0
    near = bind(content_stems(sentence), lambda own: (F.size(own) >= 3) & (2 * F.size(F.array_intersect(own, there)) >= F.size(own)))
    return F.coalesce(same, F.lit(False)) | (near & ~fresh)


def verified(sentence: Column, source: Column) -> Column:
    """Every number of the sentence is in the source, and its last 40 characters stand there as they are, whatever the case."""
    return (F.size(F.array_except(numbers(sentence), numbers(source))) == 0) & F.contains(F.lower(source), F.lower(F.right(sentence, F.lit(40))))


def problems(sentence: Column, headline: Column, least: int = 4) -> Column:
    """Names of what is wrong with a sentence, none for a sound one."""
    s = F.trim(F.coalesce(sentence, F.lit("")))
    last = F.lower(F.regexp_extract(s, r"([A-Za-z]+)[^A-Za-z]*$", 1))
    tests = {
        "empty": s == "", "short": (s != "") & (F.size(tokens(s)) < least), "open_end": (s != "") & ~s.rlike(r"""[.!?…]["'”’)]*$"""), "quotes": (F.regexp_count(s, F.lit('"')) % 2 == 1) | (F.regexp_count(s, F.lit("“")) != F.regexp_count(s, F.lit("”"))),
        "dangling": last.isin(*DANGLING), "lower_start": s.rlike("^[a-z]"), "shouting": s.rlike("[A-Z]{2}") & (s == F.upper(s)), "link": s.rlike(r"(?i)\b(https?://|www\.)"), "headline": (s != "") & paraphrases(s, headline),
    }
    return F.array_compact(F.array(*(F.when(holds, F.lit(name)) for name, holds in tests.items())))


def front_attribution(sentence: Column) -> Column:
    """'It rained, police said.' becomes 'Police said it rained.'; sentences with quotes or another shape stay."""
    shape = r"^([^\"“”]{10,}), ([A-Za-z][A-Za-z ]{1,40}?) (said|says|reported|announced)\.$"
    body, who, verb = (F.regexp_extract(sentence, shape, k) for k in (1, 2, 3))
    lower = F.when(body.rlike(r"^(The|A|An|It|He|She|They|There|This|These|In|At|On)\b"), F.concat(F.lower(F.left(body, F.lit(1))), F.substring(body, F.lit(2), F.length(body)))).otherwise(body)
    return F.when(body == "", sentence).otherwise(F.concat(F.upper(F.left(who, F.lit(1))), F.substring(who, F.lit(2), F.length(who)), F.lit(" "), verb, F.lit(" "), lower, F.lit(".")))


def repair_boundaries(text: Column, starters: tuple[str, ...] = STARTERS) -> Column:
    """Puts a full stop before a capital starter that follows four words or more without one; not after a word that ends no sentence, and four words clear of any quote mark.

    The count in the pattern only bounds one attempt; a longer run is matched from a later word.
    """
    barred = "|".join(DANGLING)
    return F.regexp_replace(text, rf'((?:[^\s.!?"“”]+\s+){{3,40}}?[^\s.!?"“”]*[a-z0-9])(?<!\b(?:{barred}))\s+(?=(?:{"|".join(starters)})\s)', "$1. ")
