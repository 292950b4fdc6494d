"""Where a story belongs: tier, age, topic, region, eligibility, source dimensions. Column in, Column out; built-in functions only.

Lexicons of topics and regions are parameters, {class: [terms]} in order of definition: a deployment keeps its own in a table
or file. The small ones of `lexicons` are defaults.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as lex
from .signals import mapped, whole

Lexicon = dict[str, list[str]]


def site(url: Column) -> Column:
    """The host of an address in lower case, without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def tier(given: Column, url: Column, known: dict[str, int] = lex.KNOWN_TIERS) -> Column:
    """The tier given if it is 1 to 4, else that of the site, else 4."""
    of_site = F.try_element_at(F.create_map(*(F.lit(x) for p in known.items() for x in p)), site(url))
    return F.coalesce(F.when(given.between(1, 4), given), of_site, F.lit(4)).cast("int")


def discovery(flag: Column, url: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | site(url).isin(lex.DISCOVERY_HOSTS)


def recent(time: Column, now: Column, hours: int = 48, skew_minutes: int = 15) -> Column:
    """Not older than `hours`, and not more than the skew ahead; false for null."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(time.cast("timestamp"))
    return F.coalesce(age.between(-60 * skew_minutes, 3600 * hours), F.lit(False))


def maybe_important(level: Column, age_minutes: Column, fresh: int, breaking_immediate: bool) -> Column:
    young = F.coalesce(age_minutes <= fresh, F.lit(False))
    return F.when(level == "IMMEDIATE", F.lit(breaking_immediate)).when(level.isin("HIGH", "EXCLUSIVE"), F.lit(True)).otherwise(young)


def first_present(*texts: Column) -> Column:
    """The first text that is neither null nor empty, such as of effective, published and updated times."""
    return F.coalesce(*(F.when(t != "", t) for t in texts))


def interrupts(level: Column) -> Column:
    """Whether a story goes ahead of the queue."""
    return F.coalesce(level == "IMMEDIATE", F.lit(False))


# ---------------------------------------------------------------- by lexicons


def occurrences(low: Column, terms: list[str], plural: bool = False) -> Column:
    """How often the terms stand in a text as words, each term counted by itself; with `plural`, also with s or es."""
    tail = r"(?:s|es)?\b" if plural else r"\b"
    return sum((F.regexp_count(low, F.lit(rf"\b\Q{t}\E{tail}")) for t in terms), F.lit(0))


def topic(title: Column, summary: Column, label: Column, lexicon: Lexicon, regional: tuple[str, ...] = (), least_beside_region: int = 2, other: str = "world") -> Column:
    """The class with the most occurrences; ties go to the source's own label, then by order. A label that names a region or nothing known needs `least_beside_region`
    occurrences, else the story is `other`; a known label stays unless another class has as many."""
    low = F.lower(F.concat(whole(title), F.lit(" "), whole(summary)))
    own = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    scored = F.array(*(F.struct(occurrences(low, terms).alias("n"), (own == name).cast("int").alias("own"), F.lit(-k).alias("order"), F.lit(name).alias("name")) for k, (name, terms) in enumerate(lexicon.items())))
    best = F.array_max(scored)
    known = own.isin([n for n in lexicon if n not in regional])
    return F.when(best.n >= least_beside_region, best["name"]).when(known, own).otherwise(other)


def sector(title: Column, summary: Column, label: Column, lexicon: Lexicon, top_of: dict[str, str], geographic: tuple[str, ...] = ()) -> Column:
    """Struct (top, sub): the sub-sector with the most occurrences, ties as in topic(); without any, what the source's label says, else (other, general)."""
    low = F.lower(F.concat(whole(title), F.lit(" "), whole(summary)))
    own = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    topical = ~own.isin(list(geographic)) if geographic else F.lit(True)
    scored = F.array(*(F.struct(occurrences(low, terms, plural=True).alias("n"), ((own == name) & topical).cast("int").alias("own"), F.lit(-k).alias("order"), F.lit(name).alias("name")) for k, (name, terms) in enumerate(lexicon.items())))
    best = F.array_max(scored)
    sub = F.when(best.n > 0, best["name"]).when(topical & own.isin(list(lexicon)), own)
    top = F.when(topical & own.isin(sorted(set(top_of.values()))), own)
    return F.struct(F.coalesce(mapped(sub, top_of), top, F.lit("other")).alias("top"), F.coalesce(sub, top, F.lit("general")).alias("sub"))


def region(title: Column, summary: Column, lexicon: dict[str, Lexicon], country_marks: dict[str, str] | None = None, blanked: str = r"(?i)\b(?:latin|south|north|central) america\b") -> Column:
    """Struct (top, sub) of the place that the text names first; nulls if it names none. country_marks: case-sensitive patterns by sub-region, such as US and U.S."""
    text = F.concat(whole(title), F.lit(" "), whole(summary))
    text = F.regexp_replace(text, blanked, " ")
    marks, options = country_marks or {}, []
    for k, (top, sub, terms) in enumerate((t, s, terms) for t, subs in lexicon.items() for s, terms in subs.items()):
        pattern = rf"(?i)\b(?:{'|'.join(rf'\Q{t}\E' for t in terms)})\b"
        at = F.regexp_instr(text, F.lit(pattern))
        if sub in marks:
            exact = F.regexp_instr(text, F.lit(marks[sub]))
            at = F.when((exact > 0) & ((at == 0) | (exact < at)), exact).otherwise(at)
        options.append(F.when(at > 0, F.struct(at.alias("at"), F.lit(k).alias("k"), F.lit(top).alias("top"), F.lit(sub).alias("sub"))))
    first = F.array_min(F.array_compact(F.array(*options)))
    return F.struct(first.top.alias("top"), first["sub"].alias("sub"))


#: Fixed values.
US_MARK = {"United States": r"\bUS\b|\bU\.S\.|\bUSA\b"}
ASTRONOMY = r"(?i)\b(?:solar|lunar) eclipse\b|\bmeteor shower\b|\bcomet\b|\bsupermoon\b"
PRODUCTS = r"(?i)\b(?:phone|smartphone|laptop|tablet|headphones|earbuds|camera|console|game|movie|film|album|car|tv|watch|gadget|app)s?\b"
STRONG_REVIEW = r"(?i)^review\s*:|\bhands-on\b|\bour verdict\b|\bwe tested\b|\bunboxing\b"
ANNIVERSARY = (
    r"(?i)\b(?:a|one|two|three|four|five|six|seven|eight|nine|ten|several|few|multiple|dozen)\s+(?:years?|months?|weeks?|decades?)\s+after\b"
    r"|\b(?:marks?|marked|marking|commemorates?|commemorated)\s+(?:the\s+)?(?:anniversary|centenary|centennial|birthday|death)\b|\b(?:anniversary|retrospective|commemoration)\b"
)
CURRENT = (
    r"(?i)\b(?:releases?|announces?|issues?|reveals?|unveils?|reports?|warns?|declares?|signs?|approves?|launches?|opens?|closes?|finds?|returns?|wins?|strikes?|hits?|kills?|raises?|cuts?|bans?|imposes?|"
    r"arrests?|rescues?|evacuates?|confirms?|rules?|sues?|fines?|charges?|indicts?|convicts?|sentences?|rejects?|votes?|elects?|says?|said)\b|\b(?:is|are|has|have)\s+(?:set to|expected to|about to)\b"
    r"|\b\d+(?:[.,]\d+)?\s*(?:dead|killed|injured|percent|%|million|billion|km|miles|people|arrested|displaced|evacuated|missing)\b"
)
WEATHER, EXTREME = r"\bweather (?:forecast|update|report|outlook)\b|\bforecast for\b", r"(?i)\b(?:hurricane|typhoon|cyclone|tornado|flood\w*|blizzard|heatwave|heat wave|storm surge|record|warning|evacuat\w*)\b"
FEATURE = r"(?i)^(?:the story of|inside the|in pictures|photo essay|long read|explainer|quiz)\b|\beverything you need to know\b"


def rejection(title: Column, summary: Column, rules: tuple[tuple[str, str], ...] = lex.EDITORIAL) -> Column:
    """Why a story isn't current news: the first rule of (name, pattern) that the title or the whole meets, then routine_weather, feature and anniversary; null if it is.

    A review needs a strong form or a product; advice and lifestyle about a great astronomical event stay, as does an anniversary with a current development.
    """
    t = F.trim(F.coalesce(title, F.lit("")))
    both = F.concat(t, F.lit(" "), F.coalesce(summary, F.lit("")))
    sky = both.rlike(ASTRONOMY)
    out = F.lit(None).cast("string")
    late = (("routine_weather", F.lower(t).rlike(WEATHER) & ~both.rlike(EXTREME) & ~sky), ("feature", t.rlike(FEATURE)), ("anniversary", t.rlike(ANNIVERSARY) & ~both.rlike(CURRENT)))
    early = []
    for name, pattern in rules:
        hit = t.rlike(pattern) | both.rlike(pattern)
        if name == "review":
            hit = hit & (both.rlike(STRONG_REVIEW) | both.rlike(PRODUCTS))
        if name in ("howto", "lifestyle"):
            hit = hit & ~sky
        early.append((name, hit))
    for name, hit in reversed((*early, *late)):
        out = F.when(hit, F.lit(name)).otherwise(out)
    return F.when(t != "", out)


# ---------------------------------------------------------------- sources


def source_type(feed_discovery: Column, kind: Column, primary: Column, url: Column, official: str = r"\.gov$|\.gov\.|\.int$|\.mil$", agencies: str = r"reuters|apnews|afp|xinhua|tass|yonhap") -> Column:
    given = F.when(F.coalesce(kind, F.lit("")) != "", kind)
    host = site(url)
    return F.when(F.coalesce(feed_discovery, F.lit(False)), "discovery_aggregator").when(given.isNotNull(), given).when(F.coalesce(primary, F.lit(False)) | host.rlike(official), "primary_source").when(host.rlike(agencies), "news_agency").otherwise("publisher")


def source_region(explicit: Column, category: Column, hints: dict[str, str]) -> Column:
    """The region given if it names a part too (Asia|Japan), else what hints have for it or for the category; world is Global."""
    low = F.lower(F.coalesce(category, F.lit("")))
    hint = F.create_map(*(F.lit(x) for p in (hints or {"": ""}).items() for x in p))
    return F.coalesce(F.when(F.contains(explicit, F.lit("|")), explicit), F.try_element_at(hint, explicit), F.when(low == "world", "Global"), F.try_element_at(hint, low), F.lit("unknown"))


def source_sector(category: Column, sectors: list[str], geographic: list[str]) -> Column:
    low = F.lower(F.coalesce(category, F.lit("")))
    return F.when(low.isin(sectors) & ~low.isin(geographic), low).when(low.isin(geographic) | (low == ""), "general").otherwise(low)


def reliability_label(of_tier: Column) -> Column:
    return F.when(of_tier == 1, "high").when(of_tier == 2, "medium").when(of_tier == 3, "low").otherwise("unknown")


def norm_url(url: Column) -> Column:
    """Host and path in lower case, without slashes at the end."""
    parts = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^?#]*)", 1)
    return F.lower(F.regexp_replace(parts, "/+$", ""))


def looks_like_html(head: Column) -> Column:
    low = F.lower(F.left(F.ltrim(F.coalesce(head, F.lit(""))), F.lit(2048)))
    return F.contains(low, F.lit("<!doctype html")) | F.contains(low, F.lit("<html")) | (F.contains(low, F.lit("<")) & ~F.startswith(low, F.lit("{")))


def paywalled(text: Column, markers: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(low, F.lit(m))
    return out


def json_of(*columns: Column) -> Column:
    """A JSON object of the columns that aren't null, by name."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})
