"""Damaged rows of accounts: seams, quotes, rows of other stories; and the whole against a walk row by row."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewire.operators import narrative, repair

L = F.lit
KEYED = "id long, pos long, sentence string, source string"


@pytest.fixture(scope="module")
def mend(spark):
    def run(sentence, headline="", *others):
        rows = spark.createDataFrame([(1, 0, sentence, "A")], KEYED)
        said = spark.createDataFrame([(1, s) for s in (sentence, *others)], "id long, sentence string")
        head = spark.createDataFrame([(1, headline)], "id long, headline string")
        return [r.sentence for r in repair.repaired(rows, "id", head, said).orderBy("piece").collect()]

    return run


def test_quotes(mend):
    assert mend('"We need rain." The ministry of water said 40 wells are dry.') == ['"We need rain."', "The ministry of water said 40 wells are dry."]
    assert mend('"We need rain." The ministry of water said 40 wells are dry.', "We need rain") == ["The ministry of water said 40 wells are dry."]
    assert mend('"I liked it. I left," she said.') == ['"I liked it. I left," she said.']
    assert mend('"We need rain," the ministry said.') == ['"We need rain," the ministry said.']


def test_seams(mend):
    plain = "The flames reached a nature reserve Turtles rescued last year are in danger."
    assert mend(plain) == []  # Turtles may be a name
    assert mend(plain, "Fire threatens turtles") == ["The flames reached a nature reserve.", "Turtles rescued last year are in danger."]
    assert mend(plain, "", "A turtle was seen.") == ["The flames reached a nature reserve.", "Turtles rescued last year are in danger."]
    assert mend("They cut the line, a 'last thread' Crews are at work.") == ["They cut the line, a 'last thread'.", "Crews are at work."]
    assert mend("Rates stay where they are…Traders wait for more.") == ["Rates stay where they are….", "Traders wait for more."]
    assert mend("Costs have grown since winter 2001 Looking back it was cheap.", "Looking for work") == ["Costs have grown since winter 2001.", "Looking back it was cheap."]
    assert mend("The agency says Visits to parks rose by 4%.", "", "Every visit costs more.") == ["The agency says visits to parks rose by 4%."]
    assert mend("The agency says Putin to parks rose by 4%.") == ["The agency says Putin to parks rose by 4%."]
    hyphen = "The plan takes cover away this winter Cross-benchers have fought it."
    assert mend(hyphen, "", "All cross benchers left.") == ["The plan takes cover away this winter.", "Cross-benchers have fought it."]


@pytest.mark.parametrize("whole", ["He visited the river Thames was high.", "They left for Paris and came back.", "It rained on Tuesday and stopped.", "The mayor said Johnson was ill.", "New York and London are large.", "", " "])
def test_names_are_no_seams(mend, whole):
    assert mend(whole) == ([whole] if whole.strip() else [])


def test_rows_of_other_stories(spark):
    head = "Wildfire near Toronto spreads"
    cases = {
        "Meanwhile, the Atomic Energy Council met its bankers.": True, "The Atomic Energy Council met its bankers.": True, "Meanwhile, the wildfire grew.": False, "It was hot and dry.": False,
        "Meanwhile, 12 people were evacuated.": False, "Toronto Fire Services sent help.": False, "“Nothing is left,” one said.": True, "": False,
    }
    rows = spark.createDataFrame(list(cases), "string").select("value", repair.unrelated(F.col("value"), L(head)).alias("x"), repair.unrelated(F.col("value"), L(None).cast("string")).alias("y")).collect()
    assert {r.value: r.x for r in rows} == cases and not any(r.y for r in rows)
    none = spark.range(1).select(repair.unrelated(L(None).cast("string"), L(head)).alias("x")).first()
    assert none.x is False


# ---------------------------------------------------------------- against a walk

FOLLOW, BARRED, KNOWN = ["is", "was", "and"], ["the", "in"], ["paris", "may"]
SEAMS = dict(follow=FOLLOW, barred=BARRED, known=KNOWN, reporting=["said"], prepositions=["to"])


def seam(s):
    """(place, sure, reported) by words and what stands between them."""
    found = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[A-Za-z]+(?:-[A-Za-z]+)*|\d+", s)]
    by_kind = {}
    for k in range(1, len(found)):
        (a, _, a_end), (t, at, t_end) = found[k - 1], found[k]
        n, n_at = (found[k + 1][0], found[k + 1][1]) if k + 1 < len(found) else ("", len(s))
        gap, after = s[a_end:at], s[t_end:n_at]
        if not re.fullmatch(r"[A-Z][a-z]+(?:-[A-Za-z]+)*", t) or t.lower() in KNOWN:
            continue
        near = [w for w, _, _ in found[:k] if not w[0].isdigit()][-2:]
        free = not {w.lower() for w in near} & {*BARRED}
        lower, blank = a.split("-")[-1][0].islower(), gap.isspace()  # of 'Cross-benchers' the last part stands behind
        if lower and blank and free and after.isspace() and n in FOLLOW:
            by_kind.setdefault(0, (at, False, False))
        if lower and re.fullmatch(r"['\"]\s+", gap) and after.isspace() and n[:1].isalpha():
            by_kind.setdefault(1, (at, True, False))
        if re.fullmatch(r"\d{2,4}", a) and blank and free and after.isspace() and (n in FOLLOW or (t.endswith("ing") and n[:1].islower())):
            by_kind.setdefault(2, (at, False, False))
        if lower and re.fullmatch(r"\s*(?:…|\.\.\.)\s*", gap):
            by_kind.setdefault(3, (at, True, False))
        if a == "said" and blank and after.isspace() and n == "to":
            by_kind.setdefault(4, (at, False, True))
    return by_kind[min(by_kind)] if by_kind else None


def cut(s):
    return [p for p in re.split(r"(?<=[.!?]['\"])\s+", s) if p.strip()]


def plain(w):
    return re.sub("(?<!s)s$", "", w.lower().replace("-", ""))


def bears_out(text, title):
    ws = [plain(w) for w in re.findall(r"[a-z]+(?:-[a-z]+)*", text.lower())]
    return plain(title) in {*ws, *(a + b for a, b in zip(ws, ws[1:], strict=False))}


def walk(rows, heads, said):
    out = []
    for key, pos, s, source in rows:
        if not (s or "").strip():
            continue
        for part, p in enumerate(cut(s)):
            found = seam(p)
            pieces = [p]
            if found:
                at, sure, reported = found
                title = re.match(r"[A-Z][a-z]+(?:-[A-Za-z]+)*", p[at:]).group()
                others = [heads.get(key) or "", *(q for k, t in said if k == key and t for q in cut(t) if q.strip() != p.strip())]
                shown = key is not None and any(bears_out(t, title) for t in others)
                before = p[:at].rstrip()
                if reported:
                    pieces = [p[:at] + title.lower() + p[at + len(title) :]] if shown else [p]
                elif sure or shown:
                    pieces = [before if before[-1] in ".!?" else before + ".", p[at:].strip()]
                else:
                    pieces = []
            for half, x in enumerate(pieces):
                again = seam(x)
                if not again or again[2]:
                    out.append((key, pos, x, source, 2 * part + half))
    return Counter(out)


def test_repair_equals_a_walk(spark):
    rng = random.Random(8)
    words = ["Turtles", "turtle", "Looking", "Paris", "Cross-benchers", "crossbencher", "is", "was", "and", "the", "in", "said", "to", "near", "flames", "word", "2001", "12", "May"]
    gaps = [" "] * 12 + ["' ", '." ', "…", "... ", ", "]
    text = lambda: "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(3, 11))) + rng.choice(["end.", "end"])
    rows = [(rng.choice([1, 2, 3, 4, 5, None]), k, text(), rng.choice("AB")) for k in range(500)]
    rows += [rows[0], rows[1], (1, 900, None, "A"), (2, 901, "  ", "A"), (9, 902, "near flames Turtles was " + "word " * 20000 + "end.", "A")]
    said = [(r[0], r[2]) for r in rows if rng.random() < 0.7] + [(9, "turtle"), (1, None)]
    heads = {1: "Turtles fled", 2: None, 3: "", 4: "crossbenchers met"}
    df = spark.createDataFrame(rows, KEYED)
    head = spark.createDataFrame(list(heads.items()), "id long, headline string")
    said_df = spark.createDataFrame(said, "id long, sentence string")
    seams = repair.Seams(**SEAMS)
    # paraphrases of a headline are looked at in test_quotes; here none of the headlines has three stems in a row's parts
    got = Counter((r.id, r.pos, r.sentence, r.source, r.piece) for r in repair.repaired(df, "id", head, said_df, seams).collect())
    assert got == walk(rows, heads, said)
    assert len(got) > 100 and repair.repaired(df.limit(0), "id", head, said_df).count() == 0


def test_briefing_goes_by_way_of_repair(spark):
    fused = "The flames reached a nature reserve Turtles rescued last year are in danger near Lyon."
    items = [(1, 0, "A", fused + " Meanwhile, the Atomic Energy Council met its bankers.", True, "Fire threatens turtles"), (1, 1, "B", "Twelve people were injured in Lyon.", False, "Fire threatens turtles")]
    df = spark.createDataFrame(items, "id long, rank long, source string, summary string, article boolean, headline string")
    got = narrative.briefing(df, "id", F.col("headline")).first()
    told = [*got.opening, *got.body]
    assert "Turtles rescued last year are in danger near Lyon." in told and "The flames reached a nature reserve." in told and not any("Atomic" in s for s in told)


def test_rows_and_headlines_are_cut_and_cleaned_once(spark):
    from tidewire.plans import news

    for df in news._damaged(spark, "/root/testdata/sf0.001"):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "regexp" not in plan
