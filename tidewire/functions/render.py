"""Messages in a small HTML subset under a budget of visible characters; built-in functions only. A null text counts as none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import escape_attribute, escape_html, visible_length

LEAST = 2


def _largest(low: Column, high: Column, fits) -> Column:  # noqa: ANN001
    """The largest k of low..high that fits; null if none does."""
    return F.when(low <= high, F.array_max(F.filter(F.sequence(low, F.greatest(low, high)), fits)))


def cut_text(text: Column, limit: int) -> Column:
    """At the last end of a sentence within the limit; a first sentence beyond it is cut between words and gets an ellipsis."""
    parts = F.split(text, r"\. ")
    lead = lambda k: F.array_join(F.slice(parts, 1, k), ". ")
    whole = _largest(F.lit(1), F.size(parts), lambda k: visible_length(lead(k)) <= limit)
    chars = _largest(F.lit(1), F.least(F.lit(limit), F.length(text)), lambda n: visible_length(F.left(text, n)) <= limit - 1)
    by_word = F.concat(F.regexp_replace(F.left(text, F.coalesce(chars, F.lit(0))), r"\s+\S*$", ""), F.lit("…"))
    return F.when(visible_length(text) <= limit, text).when(whole.isNotNull(), lead(whole)).otherwise(by_word)


def message(label: Column, headline: Column, sentences: Column, source: Column, url: Column, budget: int) -> Column:
    """Label, bold headline, two sentences or more, source and link, parts apart by an empty line.

    Sentences go from the end while the message is over the budget, down to two; then the paragraph is cut. Label, headline,
    source and link always stay. Null for fewer than two sentences.
    """
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    link = F.concat(F.lit('<a href="'), escape_attribute(some(url)), F.lit('">Read more</a>'))

    def whole(paragraph: Column) -> Column:
        return F.concat_ws("\n\n", escape_html(some(label)), F.concat(F.lit("<b>"), escape_html(some(headline)), F.lit("</b>")), escape_html(paragraph), F.concat(F.lit("Source: "), escape_html(some(source))), link)

    lead = lambda k: F.array_join(F.slice(sentences, 1, k), " ")
    # what is shown adds up: the rest of the message, the sentences, and a blank between two of them
    room = F.lit(budget) - visible_length(whole(F.lit("")))
    shown = F.transform(sentences, lambda s: F.coalesce(visible_length(escape_html(s)), F.lit(-1)))  # a null sentence has no blank either
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("chars"))
    most = F.aggregate(shown, start, lambda a, c: F.struct((a.n + (a.chars + c + 1 <= room).cast("int")).alias("n"), (a.chars + c + 1).alias("chars"))).n
    return F.when(F.size(sentences) >= LEAST, F.when(most >= LEAST, whole(lead(most))).otherwise(whole(cut_text(lead(F.lit(LEAST)), budget))))
