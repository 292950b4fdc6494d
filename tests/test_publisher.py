"""The publisher against a plain walk round by round, as a table and as a stream."""

import math
import random

import pytest

from tidewire.plans.news import QUERIES
from tidewire.streaming import publisher
from tidewire.streaming.publisher import Limits

SF = "/root/testdata/sf0.01"
IN = "channel string, key string, scheduled double, until double, fails int"


def plainly(entries, limits):
    """Every round in order, every entry at every round."""
    out, waiting, posted = {}, sorted(entries, key=lambda e: (e[1], e[0])), []
    now = math.ceil(min(e[1] for e in entries) / limits.every) * limits.every if entries else 0
    tries = dict.fromkeys((e[0] for e in entries), 0)
    while waiting:
        for e in list(waiting):
            key, at, until, fails = e
            if at > now:
                continue
            if now > until:
                waiting.remove(e)
                out[key] = ("expired", None)
                continue
            if posted and now - posted[-1] < limits.gap or sum(now - p <= 3600 for p in posted) >= limits.per_hour or sum(now - p <= 86400 for p in posted) >= limits.per_day:
                continue
            if tries[key] < fails:
                tries[key] += 1
                if tries[key] >= limits.max_attempts:
                    waiting.remove(e)
                    out[key] = ("failed", None)
                continue
            waiting.remove(e)
            posted.append(now)
            out[key] = ("posted", now)
        now += limits.every
    return out


def crowd(seed, n, hours=30):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        at = rng.choice([rng.uniform(0, hours * 3600), rng.uniform(0, 3600)])
        rows.append((f"k{k:04d}", round(at, 3), round(at + rng.choice([600, 3600, 9000, 30000]) * rng.random(), 3), rng.choice([0, 0, 0, 1, 2, 5])))
    return rows


@pytest.mark.parametrize("limits", [Limits(600, 4, 40, 300, 3), Limits(1800, 3, 9, 300, 2), Limits(60, 20, 150, 60, 3)])
def test_table_equals_walk(spark, limits):
    groups = {"a": crowd(1, 400), "b": crowd(2, 60), None: crowd(3, 30)}
    queue = spark.createDataFrame([(c, *e) for c, rows in groups.items() for e in rows], IN).repartition(5)
    got = {(r.channel, r.key): (r.outcome, r.posted) for r in publisher.publish(queue, limits).collect()}
    assert got == {(c, k): o for c, rows in groups.items() for k, o in plainly(rows, limits).items()}


def test_only_what_caps_can_let_through_meets(spark):
    limits = Limits(600, 4, 40, 300, 3)
    rows = [("a", f"{k:05d}", k * 0.1, k * 0.1 + 7200, 0) for k in range(20000)]  # all within one hour, two hours fresh
    marked = publisher.could_go_out(spark.createDataFrame(rows, IN).repartition(8), limits)
    assert marked.where("hopeful").count() <= 200 and marked.count() == 20000


def test_odd_entries(spark):
    rows = [("a", "x", None, None, None), ("a", "x", 50.0, None, 0), ("a", None, 10.0, 5.0, 0), ("a", "f", 20.0, None, 9)]
    got = sorted((r.key, r.outcome, r.posted, r.attempts) for r in publisher.publish(spark.createDataFrame(rows, IN), Limits(600, 4, 40, 300, 3)).collect())
    assert got == [("", "expired", None, 0), ("f", "failed", None, 3), ("x", "posted", 300.0, 1), ("x", "posted", 900.0, 1)]
    assert publisher.publish(spark.createDataFrame([], IN)).count() == 0


def test_stream_equals_table(spark, tmp_path):
    limits = Limits(600, 4, 40, 300, 3)
    rows = [("a", *e) for e in crowd(5, 300)] + [("b", *e) for e in crowd(6, 40)]
    rows.sort(key=lambda r: r[2])
    for k in range(3):  # three files in order of time
        part = rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3]
        spark.createDataFrame(part, IN).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    end = [("a", "end", 40 * 3600.0, None, 0), ("b", "end", 40 * 3600.0, None, 0)]  # moves the watermark beyond all others
    spark.createDataFrame(end, IN).coalesce(1).write.parquet(str(tmp_path / "in/part=3"))
    want = {(r.channel, r.key): (r.outcome, r.posted) for r in publisher.publish(spark.createDataFrame(rows, IN), limits).collect()}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(IN + ", part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = publisher.publish(stream.drop("part"), limits).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).format("memory").queryName("published").start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r.channel, r.key): (r.outcome, r.posted) for r in spark.table("published").collect() if r.key != "end"}
    assert got == want


def test_query_reads_all_events(spark):
    got = QUERIES["published_events"](spark, SF).collect()
    assert len(got) == 10000 and {r.outcome for r in got} == {"posted", "expired", "failed"}
    times = sorted(r.posted_s for r in got if r.posted_s is not None)
    assert all(b - a >= 600 for a, b in zip(times, times[1:])) and all(t % 300 == 0 for t in times)
