"""Text expressions: Column in, Column out, all of them built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as lex


def clean(text: Column) -> Column:
    """Without tags, white space as single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def norm_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def story_id(url: Column, title: Column) -> Column:
    return F.sha2(F.concat(F.substring_index(url, "?", 1), F.lit("|"), F.lower(title)), 256)


def event_id(title: Column, source: Column) -> Column:
    return F.substring(F.sha2(F.lower(F.trim(F.concat(title, F.lit("|"), source))), 256), 1, 24)


#: Words whose full stop ends no sentence.
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "St", "Sr", "Jr", "vs", "etc", "approx", "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def sentences(text: Column) -> Column:
    """Array of sentences; a full stop within or after initials (U.S., e.g.) or after a known abbreviation ends none."""
    # each pattern begins with the mark itself, and looks back from behind it: elsewhere one comparison tells that it can't fit
    kept = F.regexp_replace(text, rf"\.(?<=\b(?:{'|'.join(ABBREVIATIONS)})\.)(?![A-Za-z0-9])", "\u0000")
    kept = F.regexp_replace(kept, r"\.(?<=\b[A-Za-z]\.)(?=[A-Za-z]\.)", "\u0000")
    kept = F.regexp_replace(kept, r"\.(?<=\x00[A-Za-z]\.)(?![A-Za-z0-9])", "\u0000")
    parts = F.transform(F.split(kept, r"\s(?<=[.!?]\s)\s*"), lambda s: F.trim(F.regexp_replace(F.replace(s, F.lit("\u0000"), F.lit(".")), r" \s+|[\t\n\x0B\f\r]\s*", " ")))
    return F.filter(parts, lambda s: s != "")


def closed_runs(text: Column) -> Column:
    """Array of what stands between closing marks with white space behind them; abbreviations aren't known here, as in `sentences`."""
    return F.split(text, r"(?<=[.!?])[\t\n\f\r ]+")


def capital(letter: Column) -> Column:
    """A letter's capital, which is one letter too: that of ß is ẞ; a letter whose capital takes several (a ligature) stays as it is."""
    upper, title = F.upper(letter), F.initcap(letter)
    return F.when(letter == "ß", "ẞ").when(F.length(upper) <= 1, upper).when(F.length(title) == 1, title).otherwise(letter)


def capitalized(text: Column) -> Column:
    return F.concat(capital(F.left(text, F.lit(1))), F.substring(text, F.lit(2), F.length(text)))


def numbers(text: Column) -> Column:
    """Distinct numbers as written, without separators of thousands."""
    found = F.regexp_extract_all(text, F.lit(r"(\d[\d,.]*)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, "[^0-9.]", ""), r"\.+$", "")))


def stem(word: Column) -> Column:
    """A light stemmer: the first of a few endings goes, if four letters stay."""
    out = word
    for end, to in reversed((("ies", "y"), ("ing", ""), ("edly", ""), ("ed", ""), ("es", ""), ("s", ""), ("ly", ""))):
        out = F.when(F.endswith(word, F.lit(end)) & (F.length(word) >= len(end) + 4), F.concat(F.substring(word, F.lit(1), F.length(word) - len(end)), F.lit(to))).otherwise(out)
    return out


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def count_terms(words: Column, terms: list[str]) -> Column:
    """How many of the words (with repeats) are terms."""
    return F.size(F.filter(words, lambda w: w.isin(terms)))


def substring_hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms stand anywhere in the text."""
    return sum((F.contains(text, F.lit(t)).cast("int") for t in terms), F.lit(0))


def english_score(text: Column, common: list[str]) -> Column:
    """0.75 * common words / min(words, 30) + 0.25 * share of ASCII; 0 without words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))
    n = F.size(words)
    ascii_part = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")) / F.length(text)
    return F.when(n > 0, F.lit(0.75) * count_terms(words, common) / F.least(n, F.lit(30)) + F.lit(0.25) * ascii_part).otherwise(F.lit(0.0))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_attribute(text: Column) -> Column:
    return F.replace(escape_html(text), F.lit('"'), F.lit("&quot;"))


def visible_length(text: Column) -> Column:
    """Characters as shown: an entity is one, a wide character (CJK, emoji) two."""
    plain = F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", ""), r"&(amp|lt|gt|quot|#\d+);", "x")
    wide = F.regexp_count(plain, F.lit(r"[\x{1100}-\x{115F}\x{2E80}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FF00}-\x{FF60}\x{1F300}-\x{1FAFF}]"))
    return F.length(plain) + wide


def clean_headline(title: Column) -> Column:
    """Without a publisher behind and a label in front, white space as single blanks, first letter capital. A null title gives null."""
    h = F.trim(F.regexp_replace(title, r"\s+", " "))
    h = F.regexp_replace(h, rf"(?i)\s*(?:-\s*|[–—]\s*|\|\s*)(?:{lex.PUBLISHERS})$", "")
    h = F.trim(F.regexp_replace(h, r"(?i)^(?:Live|Watch|Video|Update|Breaking|Flash)[:\s-]+\s*", ""))
    return capitalized(h)


def near_number(words: Column, keywords: list[str], window: int = 8) -> Column:
    """The largest number within `window` words before or fewer than that after a keyword (an array of words)."""
    at = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.element_at(words, i).isin(keywords))
    chunk = lambda i: F.slice(words, F.greatest(F.lit(1), i - window), F.least(F.size(words), i + (window - 1)) - F.greatest(F.lit(1), i - window) + 1)
    near = F.flatten(F.transform(at, chunk))
    values = F.transform(F.filter(near, lambda w: w.rlike("^[0-9]{1,9}$")), lambda w: w.cast("long"))
    return F.when(F.size(words) > 0, F.coalesce(F.array_max(values), F.lit(0))).otherwise(F.lit(0)).cast("long")


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def registrable(host_name: Column) -> Column:
    parts = F.split(host_name, r"\.")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), F.lit(2)), ".")


def error_class(text: Column, classes: dict[str, list[str]] = lex.ERROR_CLASSES) -> Column:
    """The first class of which a term stands in the message, OTHER if none does; null for a null or empty one."""
    low, out = F.lower(text), F.lit("OTHER")
    for name, terms in reversed(classes.items()):
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.contains(low, F.lit(t))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return F.when(F.coalesce(text, F.lit("")) != "", out)
