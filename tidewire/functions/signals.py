"""What a story says, as sets: names, places, actions, numbers with units, developments. Column in, Column out; built-in functions only.

Every set is an array without repeats; a null text gives empty sets. Word lists are parameters with the fixed values of
lexicons as defaults, so other languages or beats bring their own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as lex
from .text import sentences


def strings(values: list[str] | tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def bind(value: Column, use) -> Column:  # noqa: ANN001
    """use(value) with the value told once, however often it is used, also within lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def mapped(word: Column, table: dict[str, str]) -> Column:
    """What the table has for the word, or the word."""
    if not table:
        return word
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, word), word)


def whole(text: Column) -> Column:
    """A text without nulls and with plain apostrophes."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("’"), F.lit("'"))


def among(found: Column, lexicon: list[str] | tuple[str, ...]) -> Column:
    """The words that a list has, each once, in their order: an array_intersect whose list isn't hashed again for each row."""
    return F.array_distinct(F.filter(found, lambda w: w.isin(list(lexicon))))


def holds(low: Column, parts: list[str] | tuple[str, ...]) -> Column:
    """One of the parts stands anywhere in a text of lower case: a cheap look before a pattern that can't fit else."""
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(low, F.lit(p))
    return out


def _where(condition: Column, found: Column) -> Column:
    return F.when(condition, found).otherwise(F.array().cast("array<string>"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(whole(text), F.lit(r"([A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*)"), F.lit(1))


def runs(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(whole(text)), F.lit(f"({pattern})"), F.lit(1))


# ---------------------------------------------------------------- names, places, actions


def names(text: Column, known: list[str] | None = None, aliases: dict[str, str] = lex.ALIASES, stopwords: list[str] = lex.NAME_STOPWORDS) -> Column:
    """Capitalised words in lower case, without possessives: those inside a sentence, in a run of several, or known ones that begin it. An alias stands beside its name."""
    known = (known if known is not None else [*lex.KNOWN_NAMES, *lex.PLACES]) + list(aliases)
    bare = lambda w: F.lower(F.regexp_replace(w, r"'\w*$", ""))
    capital = lambda w: F.coalesce(w.rlike("^[A-Z]"), F.lit(False))

    def of_sentence(s: Column) -> Column:
        found = bind(words(s), lambda ws: F.filter(ws, lambda w, i: capital(w) & ((i > 0) | capital(F.get(ws, i + 1)) | bare(w).isin(known))))
        found = F.filter(F.transform(found, bare), lambda w: (w != "") & ~w.isin(stopwords))
        return F.flatten(F.transform(found, lambda w: F.array(mapped(w, aliases), w)))

    # a word with an alias counts as both, any other as itself
    return F.array_distinct(F.flatten(F.transform(sentences(whole(text)), of_sentence)))


def places(text: Column, single: list[str] = lex.PLACES, phrases: dict[str, str] = lex.PLACES_OF_TWO) -> Column:
    """Known places anywhere in the text; a phrase counts as one place, and its words as none."""
    return bind(F.lower(whole(text)), lambda low: _with_phrases(among(F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), F.lit(1)), single), low, phrases))


def _with_phrases(found: Column, low: Column, phrases: dict[str, str]) -> Column:
    """low is a bound value: each phrase looks at it."""
    hit = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(p)), F.struct(F.lit(c).alias("name"), strings(p.split()).alias("parts"))) for p, c in phrases.items())))
    return bind(hit, lambda hs: F.array_union(F.array_except(found, F.flatten(F.transform(hs, lambda h: h.parts))), F.transform(hs, lambda h: h["name"])))


def action_stems(text: Column) -> Column:
    """Words in lower case, each also without s, es, ed, d and ing where three letters or more stay."""
    return _stems(words(F.lower(text)))


def _stems(found: Column) -> Column:
    each = lambda w: F.array_compact(F.array(w, *(F.when(F.endswith(w, F.lit(e)) & (F.length(w) > len(e) + 2), F.left(w, F.length(w) - len(e))) for e in ("s", "es", "ed", "d", "ing"))))
    return F.array_distinct(F.flatten(F.transform(found, each)))


def actions(text: Column, lexicon: list[str] = lex.ACTIONS, groups: dict[str, str] = lex.ACTION_GROUPS) -> Column:
    """Strong event words, and for each group of which a word is there, the group's name."""

    def found(stems: Column) -> Column:
        named = F.array_compact(F.array(*(F.when(F.arrays_overlap(stems, strings(v.split())), F.lit(name)) for name, v in groups.items())))
        return F.array_union(named, F.array_intersect(stems, strings(lexicon)))

    # only words with a stem in a list are stemmed
    stems = {*lexicon, *(w for v in groups.values() for w in v.split())}
    return bind(_stems(among(words(F.lower(text)), sorted({w + e for w in stems for e in ("", "s", "es", "ed", "d", "ing")}))), found)


def core(found: Column, events: list[str] = lex.CORE_EVENTS, forms: dict[str, str] = lex.CORE_FORMS) -> Column:
    # a word that is no event and has no other form is never looked up
    return among(F.transform(among(found, [*events, *forms]), lambda w: mapped(w, forms)), events)


def political_landslide(text: Column) -> Column:
    """'landslide' within 120 characters of a word of elections."""
    about = "|".join(lex.LANDSLIDE_POLITICS)
    near = rf"(?s)\blandslides?\b.{{0,119}}\b(?:{about})\b|\b(?:{about})\b.{{0,119}}\blandslides?\b"
    return bind(F.lower(whole(text)), lambda low: F.contains(low, F.lit("landslide")) & low.rlike(near))


# ---------------------------------------------------------------- numbers


def _digits(number: Column) -> Column:
    return F.regexp_replace(number, "[^0-9.]", "")


def _year(number: Column) -> Column:
    return F.coalesce(number.try_cast("double").between(1900, 2100), F.lit(False))


def event_numbers(text: Column) -> Column:
    """Numbers as written, without separators; not years, and not digits within a name such as A380."""
    # a letter right after is looked at, not taken: it may stand before the next number; one before is taken, and tells that the number goes
    found = F.regexp_extract_all(whole(text), F.lit(r"([a-zA-Z]?\d[\d,.]*+(?![a-zA-Z]))"), F.lit(1))
    alone = F.filter(found, lambda n: F.left(n, F.lit(1)).between("0", "9"))
    return F.array_distinct(F.filter(F.transform(alone, _digits), lambda n: n.try_cast("double").isNotNull() & ~_year(n)))


def _bound(text: Column, pattern: str) -> Column:
    """(number, unit) pairs, units in lower case."""
    number, unit = (F.regexp_extract_all(whole(text), F.lit(pattern), F.lit(k)) for k in (1, 2))
    return F.transform(F.arrays_zip(number.alias("n"), unit.alias("u")), lambda z: F.struct(z.n.alias("n"), F.lower(z.u).alias("u")))


def impact(text: Column) -> Column:
    """'100:killed' for each number with a unit; words for consequences and for small numbers in one form."""
    forms = {w: name for name, ws in lex.CONSEQUENCES.items() for w in ws.split()}
    counts = {w: str(k + 1) for k, w in enumerate(lex.SMALL_NUMBERS)} | {w: str(10 * (k + 3)) for k, w in enumerate(lex.TENS)}
    units = "|".join([*lex.COUNTED, *lex.MEASURES, "toll"])
    spelt = "|".join(sorted(counts, key=len, reverse=True))
    digits = F.transform(_bound(text, rf"(?i)\b(\d[\d,.]*)\s*({units})\b"), lambda z: F.concat(_digits(z.n), F.lit(":"), mapped(z.u, forms)))
    pairs = lambda low: F.when(holds(low, [*lex.COUNTED, "toll"]), _bound(text, rf"(?i)\b({spelt})\s*({'|'.join([*lex.COUNTED, 'toll'])})\b")).otherwise(F.array().cast("array<struct<n:string,u:string>>"))
    named = F.transform(bind(F.lower(whole(text)), pairs), lambda z: F.concat(mapped(F.lower(z.n), counts), F.lit(":"), mapped(z.u, forms)))
    return F.array_distinct(F.concat(F.filter(digits, lambda p: ~F.startswith(p, F.lit(":"))), named))


def consequences(text: Column) -> Column:
    forms = {w: name for name, ws in lex.CONSEQUENCES.items() for w in ws.split()}
    return F.array_distinct(F.transform(among(runs(text, "[a-z0-9]+"), list(forms)), lambda w: mapped(w, forms)))


def magnitudes(text: Column) -> Column:
    """Strengths of earthquakes, as numbers written as text."""
    quake = "(?:earthquake|quake|tremor|temblor|aftershock)"
    number = r"(\d+(?:\.\d+)?)"
    forms = (rf"(?i)\bmagnitude\s+{number}", rf"(?i)\b{number}\s*-\s*magnitude", rf"(?i)\b{number}\s+{quake}", rf"(?i)\b{quake}\s+of\s+{number}")
    found = F.flatten(F.array(*(F.regexp_extract_all(whole(text), F.lit(f), F.lit(1)) for f in forms)))
    told = F.array_distinct(F.transform(found, lambda x: x.cast("double").cast("string")))
    return bind(F.lower(whole(text)), lambda low: _where(holds(low, ("magnitude", "quake", "tremor", "temblor", "aftershock")), told))


def storms(text: Column) -> Column:
    named = F.regexp_extract_all(whole(text), F.lit(r"(?i)\b(?:storm|typhoon|hurricane|cyclone)\s+([a-z][a-z'-]+)\b"), F.lit(1))
    return bind(F.lower(whole(text)), lambda low: _where(holds(low, ("storm", "typhoon", "hurricane", "cyclone")), F.array_distinct(F.transform(named, F.lower))))


def number_units(text: Column) -> Column:
    """Map of unit to its last number."""
    units = "million|billion|thousand|percent|%|people|residents|homes|families|troops|soldiers|killed|injured|dead|displaced|evacuated|evacuees|jobs|sq miles|sq km|sq m|miles|km|hectares|acres|fires|officers|hostages"
    pairs = F.transform(_bound(text, rf"(?i)(\d[\d,.]*)\s*({units})"), lambda z: F.struct(z.u.alias("u"), F.regexp_replace(z.n, "[.,]", "").alias("n")))
    last = bind(pairs, lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q.u == p.u)))
    return F.map_from_entries(last)


def temporal(text: Column) -> Column:
    found = F.regexp_extract_all(whole(text), F.lit(lex.TEMPORAL), F.lit(1))
    return F.array_distinct(F.transform(found, lambda t: F.lower(F.regexp_replace(t, r"\s+", " "))))


# ---------------------------------------------------------------- what kind of news


def development_patterns(kinds: dict[str, list[tuple[list[str], list[str]]]] = lex.DEVELOPMENTS) -> dict[str, str]:
    """A pattern for each development: a word of a pair's first list, and within three words one of its second. 'rises to' asks for a number."""
    word = lambda w: w[:-1] + r"\w*" if w.endswith("-") else w
    some = lambda ws: "(?:" + "|".join(map(word, ws)) + ")"
    pair = lambda a, b: rf"\b{some(a)}\b" + (r"\s+to\s+\d" if b == ["to"] else rf"(?:\s+\w+){{0,2}}?\s+{some(b)}\b" if b else "")
    return {name: "(?i)" + "|".join(pair(a, b) for a, b in pairs) for name, pairs in kinds.items()}


def developments(text: Column, kinds: dict[str, list[tuple[list[str], list[str]]]] = lex.DEVELOPMENTS) -> Column:
    """Names of the developments that the text reports."""
    begins = {name: [w.rstrip("-") for ws, _ in pairs for w in ws] for name, pairs in kinds.items()}

    def told(plain: Column) -> Column:
        return bind(F.lower(plain), lambda low: F.array_compact(F.array(*(F.when(holds(low, begins[name]) & plain.rlike(p), F.lit(name)) for name, p in development_patterns(kinds).items()))))

    return bind(whole(text), told)


def reaction(text: Column) -> Column:
    return whole(text).rlike(rf"(?i)\b(?:{'|'.join(lex.REACTIONS)})\b")


def stem_lite(word: Column) -> Column:
    """The first ending that fits goes: ing, ies (to y), ian, an and ic of words of six letters or more, es and ed of five, s and e of four."""
    out = word
    for end, least, to in reversed((("ing", 6, ""), ("ies", 6, "y"), ("ian", 6, ""), ("an", 6, ""), ("ic", 6, ""), ("es", 5, ""), ("ed", 5, ""), ("s", 4, ""), ("e", 4, ""))):
        out = F.when(F.endswith(word, F.lit(end)) & (F.length(word) >= least), F.concat(F.left(word, F.length(word) - len(end)), F.lit(to))).otherwise(out)
    return out


def content_tokens(text: Column, stopwords: list[str] = lex.TOKEN_STOPWORDS, synonyms: dict[str, str] = lex.QUAKE_WORDS) -> Column:
    """Stems of the words that carry meaning, and numbers that aren't years."""
    found = F.filter(runs(text, "[a-z0-9][a-z0-9'-]*"), lambda w: ~w.isin(stopwords) & F.when(w.rlike("^[0-9]+$"), ~_year(w)).otherwise(F.length(w) >= 3))
    bare = F.transform(found, lambda w: F.regexp_replace(w, "'s$", ""))
    return F.array_distinct(F.transform(bare, lambda w: F.when(w.rlike("^[0-9]+$"), w).when(w.isin(list(synonyms)), mapped(w, synonyms)).otherwise(stem_lite(w))))


def signals(title: Column, summary: Column, noise: list[str] | None = None, fields: tuple[str, ...] | None = None) -> Column:
    """All signals of a story as one struct, or those of `fields`; what isn't asked isn't told. noise: words that are no names, such as weekdays and offices."""
    text = F.concat(whole(title), F.lit(" "), whole(summary))

    def of_text(text: Column) -> Column:
        found = F.filter(names(text), lambda w: (F.length(w) >= 2) & ~w.isin(list(noise or ["monday"])))
        found = F.array_distinct(F.transform(found, lambda w: mapped(w, lex.ALIASES)))
        found = bind(F.lower(text), lambda low: _with_phrases(found, low, lex.PLACES_OF_TWO))
        parts = F.struct(found.alias("found"), F.array_distinct(runs(text, "[a-z][a-z0-9]*")).alias("raw"), political_landslide(text).alias("political"), developments(text).alias("dev"))
        return bind(parts, lambda p: _struct(text, title, p, fields))

    return bind(text, of_text)


def _struct(text: Column, title: Column, p: Column, fields: tuple[str, ...] | None) -> Column:
    without = lambda found, *gone: F.when(p.political, F.array_except(found, strings(gone))).otherwise(found)
    acts = F.array_distinct(F.transform(actions(text), lambda a: mapped(a, {"quake": "earthquake"})))
    acts = F.array_except(acts, strings(lex.BROAD_ACTIONS))
    acts = F.array_union(acts, F.array_compact(F.array(*(F.when(F.arrays_overlap(p.raw, strings(v.split())), F.lit(name)) for name, v in lex.RUPTURE.items()))))
    told = {
        "entities": p.found, "places": F.array_union(places(text), among(p.found, lex.PLACES)), "actions": without(acts, "landslide"), "storms": storms(text),
        "core": without(core(F.array_union(p.found, p.raw)), "landslide"), "numbers": event_numbers(text), "consequences": consequences(text), "impact": impact(text),
        "magnitudes": magnitudes(text), "dev": F.size(p.dev) > 0, "dev_facts": p.dev, "reaction": reaction(text), "tokens": without(content_tokens(text), "landslide", "landslides"),
        "title_tokens": without(content_tokens(title), "landslide", "landslides"), "political_landslide": p.political, "text": text,
    }
    return F.struct(*(told[f].alias(f) for f in fields or told))


# ---------------------------------------------------------------- what a story is worth as a description, and what is new in it


def strength(s: Column, summary: Column, tier: Column, primary: Column, strong: Column, corroborating: Column, verified: Column, extracted: Column) -> Column:
    """0 to 30, as a struct with its parts. s: the struct of signals()."""
    count = lambda *fields: sum((F.size(s[f]) for f in fields), F.lit(0))
    n = F.size(F.filter(F.split(F.trim(F.coalesce(summary, F.lit(""))), r"\s+"), lambda w: w != ""))
    length = F.when(n >= 80, 6).when(n >= 40, 5).when(n >= 20, 4).when(n >= 10, 3).when(n >= 5, 2).when(n >= 1, 1).otherwise(0)
    by_tier = F.when(tier == 1, 5).when(tier == 2, 4).when(tier == 3, 3).otherwise(2)
    num = lambda c: F.coalesce(c, F.lit(0))
    parts = {
        "fact_density": F.least(F.lit(8), count("numbers", "magnitudes", "impact", "consequences", "dev_facts")), "specificity": F.least(F.lit(6), count("entities", "places", "actions")), "summary_quality": length,
        "reliability": F.least(F.lit(5), by_tier + F.coalesce(primary, F.lit(False)).cast("int")),
        "corroboration": F.when(num(strong) >= 3, 4).when(num(strong) == 2, 3).when(num(strong) == 1, 2).when(num(corroborating) >= 3, 1).otherwise(0),
        "extraction": F.when(num(verified) >= 2, 3).when(num(verified) == 1, 2).when(F.coalesce(extracted, F.lit(False)), 1).otherwise(0),
    }
    return F.struct(*(c.alias(k) for k, c in parts.items()), F.least(F.lit(30), sum(parts.values(), F.lit(0))).alias("total"))


#: What strength(), status() and identified() ask of a story's signals.
WORTH = ("entities", "places", "actions", "storms", "core", "numbers", "consequences", "impact", "magnitudes", "dev", "dev_facts")


def status(s: Column) -> Column:
    return F.when(s.dev, "developing").when(F.size(s.consequences) > 0, "ongoing").otherwise("reported")


def major(priority: Column, score: Column) -> Column:
    return F.coalesce(priority, score, F.lit(0)) >= 85


def material_number(number: Column, text: Column) -> Column:
    """100 or more, or bound to a unit in the text; never a year."""
    units = "|".join(lex.MATERIAL_UNITS)
    bound = F.transform(F.regexp_extract_all(whole(text), F.lit(rf"(?i)(\d[\d,.]*)\s*(?:{units})\b"), F.lit(1)), _digits)
    return F.coalesce(~_year(number) & ((number.try_cast("double") >= 100) | F.array_contains(bound, number)), F.lit(False))


def material_change(s: Column, known: Column) -> Column:
    """A story adds to what its event has gathered: a development, a material number, a consequence, or an action that is none. known: a struct of the same sets."""
    new = lambda f: F.array_except(s[f], known[f])
    said = [w for ws in lex.CONSEQUENCES.values() for w in ws.split()]
    acts = F.array_except(new("actions"), strings(said))
    return (F.size(new("dev_facts")) > 0) | F.exists(new("numbers"), lambda n: material_number(n, s.text)) | (F.size(new("consequences")) > 0) | (F.size(acts) > 0)


def identified(s: Column, weak: list[str] | None = None) -> Column:
    """A storm's name, a magnitude, an event word, or a name that is neither place nor publisher: enough to found an event."""
    names_ = F.array_except(F.array_except(s.entities, s.places), strings(list(weak or lex.WEAK_ENTITIES)))
    return (F.size(s.storms) > 0) | (F.size(s.magnitudes) > 0) | (F.size(s.core) > 0) | (F.size(names_) > 0)
