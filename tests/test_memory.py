"""Leader clustering and event memory against a plain walk over the rows in order."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import leaders, matching
from tidewire.streaming import event_memory as em

STORY = "id string, seq long, source string, discovery boolean, dev boolean, reaction boolean, " + ", ".join(f"{s} array<string>" for s in em.SETS)


def story(key, seq, source="A", discovery=False, **sets):
    return (key, seq, source, discovery, False, False, *(sets.get(s, []) for s in em.SETS))


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_are_those_of_a_walk(spark, seed):
    rng = random.Random(seed)
    n = 60
    links = {(a, b) for _ in range(110) for a, b in [sorted(rng.sample(range(n), 2))]}
    want, found = {}, []
    for k in range(n):
        first = next((f for f in found if (f, k) in links), None)
        want[k] = k if first is None else first
        found += [k] * (first is None)
    rows = leaders.groups(spark.range(n).unionByName(spark.range(3)), spark.createDataFrame([*links, *list(links)[:3]], "a long, b long"))
    assert dict(map(tuple, rows.collect())) == want


def test_no_rows(spark):
    assert leaders.groups(spark.range(0), spark.createDataFrame([], "a long, b long")).isEmpty()
    decisions, after = em.remember(spark.createDataFrame([], STORY), em.Memory.empty(spark))
    assert decisions.isEmpty() and after.events.isEmpty()


def quakes(spark):
    quake = {"places": ["chile"], "core": ["earthquake"], "tokens": ["quake", "chile"]}
    return spark.createDataFrame(
        [
            story("s1", 1, "A", **quake, impact=["100:killed"]),
            story("s2", 2, "B", **quake, impact=["100:killed"]),
            story("s3", 3, "C", **quake, impact=["100:killed", "120:killed"]),
            story("s4", 4, "D", **quake, impact=["100:killed", "120:killed"]),
            story("s5", 5, "C", **quake, impact=["100:killed", "130:killed"]),
            story("s6", 6, "B", places=["peru"], core=["earthquake"], impact=["100:killed"]),
            story("s7", 7, "E", discovery=True, tokens=["x"]),
            (None, 8, "E", *(None,) * (3 + len(em.SETS))),
            ("s9", 9, None, *(None,) * (3 + len(em.SETS))),
        ],
        STORY,
    ).withColumn("event_id", F.lit("clash"))


WANT = {"s1": ("NEW", "s1"), "s2": ("DUPLICATE", "s1"), "s3": ("UPDATE", "s1"), "s4": ("DUPLICATE", "s1"), "s5": ("DUPLICATE", "s1"), "s6": ("NEW", "s6"), "s7": ("HELD", None), "s9": ("NEW", "s9")}


def test_a_run_sees_its_own_events(spark):
    decisions, after = em.remember(quakes(spark), em.Memory.empty(spark))
    assert {r.id: (r.status, r.event_id) for r in decisions.collect()} == WANT
    assert {r.event_id for r in after.events.collect()} == {"s1", "s6", "s9"}
    assert {r.fact for r in after.facts.where("event_id = 's1'").collect()} == {"impact:100:killed", "impact:120:killed", "impact:130:killed"}
    assert {r.source for r in after.sources.where("event_id = 's1'").collect()} == set("ABCD")


def walk(rows, pairs):
    """Statuses by a plain walk; pairs: (id, event_id) -> score of every match, whatever the order."""
    events, facts, sources, out = [], {}, {}, {}
    for r in rows:
        mine = {f"{k}:{x}" for k in em.FACTS for x in r[k]}
        found = [(-pairs[r["id"], e], e) for e in events if (r["id"], e) in pairs]
        if not found:
            new = not r["discovery"] or any(r[k] for k in ("core", "impact", "places", "entities"))
            out[r["id"]] = ("NEW", r["id"]) if new else ("HELD", None)
            if new:
                events.append(r["id"])
                facts[r["id"]], sources[r["id"]] = mine, {r["source"]}
            continue
        e = min(found)[1]
        more = mine - facts[e] and r["source"] not in sources[e]
        out[r["id"]] = ("UPDATE" if more else "DUPLICATE", e)
        facts[e] |= mine
        sources[e].add(r["source"])
    return out


@pytest.mark.parametrize("seed", [5, 6])
def test_a_run_is_a_walk_in_order(spark, seed):
    rng = random.Random(seed)
    some = lambda words, most: sorted(rng.sample(words, rng.randint(0, most)))
    made = [
        story(f"s{k:02}", k, rng.choice("ABCDE"), rng.random() < 0.3, places=some(["chile", "peru"], 1), core=some(["flood", "quake"], 1), tokens=some(list("abcdef"), 4),
              entities=some(["roe", "poe", "doe"], 2), impact=some(["9:killed", "12:killed", "3:missing"], 2), numbers=some(["7", "80"], 1))
        for k in range(70)
    ]
    rows = spark.createDataFrame(made, STORY)
    own = rows.select(F.col("id").alias("event_id"), *em.SETS)
    pairs = {(r.id, r.event_id): r.score for r in matching.matches(rows, own).collect()}
    decisions, _ = em.remember(rows, em.Memory.empty(spark))
    want = walk([r.asDict() for r in rows.collect()], pairs)
    assert {r.id: (r.status, r.event_id) for r in decisions.collect()} == want
    assert {s for s, _ in want.values()} >= {"NEW", "UPDATE", "DUPLICATE"}


def test_stream_in_parts_equals_one_run(spark, tmp_path):
    rows = quakes(spark).drop("event_id").where("id is not null").orderBy("seq").collect()
    schema = quakes(spark).drop("event_id").schema
    for k, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        em.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
        assert (tmp_path / "out/decisions" / f"batch={k}").exists()
    got = spark.read.parquet(str(tmp_path / "out/decisions"))
    assert {r.id: (r.status, r.event_id) for r in got.collect()} == WANT


def test_candidates_lose_no_match_and_common_names_pair_nothing(spark):
    import random

    rng = random.Random(7)
    some = lambda words, most: sorted(rng.sample(words, rng.randint(0, most)))
    vocabulary = {
        "entities": ["iran", "un", "nato", "acme", "license"], "places": ["iran", "peru"], "actions": ["kill", "sign", "flood", "say"], "core": ["flood"], "numbers": ["5"], "impact": ["3:killed"], "storms": ["ana"], "magnitudes": ["6.1"],
        "tokens": list("abcdef"), "title_tokens": list("abcdef"),
    }
    most = {"entities": 4, "places": 1, "actions": 3, "tokens": 5, "title_tokens": 4}
    rows = [(str(k), k, rng.random() < 0.3, rng.random() < 0.3, *(some(v, most[c]) if c in most else [x for x in v if rng.random() < 0.15] for c, v in vocabulary.items())) for k in range(150)]
    schema = "id string, seq long, dev boolean, reaction boolean, " + ", ".join(f"{c} array<string>" for c in vocabulary)
    stories = spark.createDataFrame(rows, schema)
    events = stories.drop("dev", "reaction").withColumnRenamed("id", "event_id")
    words = {"weak": ["license"], "generic": ["say"], "narrow": ["sign"], "core_words": ["flood", "kill"]}
    pair = stories.select("id", F.struct(*stories.columns).alias("s")).join(events.select("event_id", F.struct(*events.columns).alias("e")), F.col("id") != F.col("event_id"))
    pair = pair.where(~matching.vetoed()).withColumn("sem", matching.semantic())
    pair = pair.withColumn("reason", matching.reason(F.col("sem"), matching.score(F.col("sem")), *words.values())).where("reason is not null")
    want = {(r.id, r.event_id, r.reason) for r in pair.select("id", "event_id", "reason").collect()}
    got = {(r.id, r.event_id, r.reason) for r in matching.matches(stories, events, **words).collect()}
    assert got == want and len({r for _, _, r in want}) >= 7
    ordered = {(r.id, r.event_id, r.reason) for r in matching.matches(stories, events, order="seq", **words).collect()}
    assert ordered == {(a, b, r) for a, b, r in want if int(b) < int(a)}
    # 3,000 stories with one common action and a name of their own meet nowhere
    alike = spark.range(3000).select(F.col("id").cast("string"), F.array(F.lit("un"), F.concat(F.lit("x"), "id")).alias("entities"), F.array(F.lit("die")).alias("actions"), *(F.array().cast("array<string>").alias(c) for c in ("core", "impact", "places")))
    assert matching.candidates(alike, alike.withColumnRenamed("id", "event_id")).where("id <> event_id").isEmpty()


def test_pairs_are_told_where_they_meet(spark, monkeypatch):
    rng = random.Random(3)
    empty = {c: [] for c in em.SETS}
    some = lambda words, least: sorted(rng.sample(words, rng.randint(least, 4)))
    rows = [tuple({**empty, "id": f"{k:03}", "seq": k, "dev": False, "reaction": False, "entities": some(["roe", "poe", "doe", "moe", "joe"], 1), "tokens": some(list("abcdefgh"), 1), "title_tokens": ["a"]}.values()) for k in range(60)]
    schema = ", ".join(f"{c} array<string>" for c in em.SETS) + ", id string, seq long, dev boolean, reaction boolean"
    stories = spark.createDataFrame(rows, schema)
    events = stories.drop("dev", "reaction").withColumnRenamed("id", "event_id")
    monkeypatch.setattr(matching, "_DEALT", 7, raising=False)
    pairs = [(a, b) for a in stories.collect() for b in stories.collect() if b.seq < a.seq and len({*a.entities} & {*b.entities}) > 1]
    jac = lambda x, y: len({*x} & {*y}) / len({*x} | {*y})
    want = sorted((a.id, b.id, "entities") for a, b in pairs if max(jac(a.tokens, b.tokens), jac(a.tokens, b.title_tokens)) >= 0.15)
    found = matching.matches(stories, events, order="seq")
    assert sorted((r.id, r.event_id, r.reason) for r in found.collect()) == want and len(want) < len(pairs)
    # rows are shuffled to where they meet; from there on neither candidates nor matches are
    plan = found._jdf.queryExecution().sparkPlan().toString().split("\n")
    assert "probe" in next(line for line in plan if "Join" in line)
