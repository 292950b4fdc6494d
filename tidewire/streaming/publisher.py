"""A channel's publisher: what is posted when, under caps, a minimum gap, freshness and retries.

A publisher comes round every `every` seconds. It takes entries that are due by (scheduled time, key), drops those no longer fresh, tries the first others until
one goes out, and none while the gap or a cap stands against it. A try that fails is made again at the next round; after `max_attempts` the entry is given up.

One channel's posts depend on each other, but few entries of a crowd can go out at all. An entry is hopeless if so many entries ahead of it, scheduled within the same hour, never failing
and fresh at its last round, that caps let no more go out until then: each of those would have to go out first. So of each hour and last round there are no more than the caps' number. `could_go_out` leaves hopeless ones out, first within partitions as they come, without a shuffle,
then by channel and hour; so only what the caps can let through meets in order. The rest is never tried, and expires.

Tables are walked by channel in batches, with the last day's posts and the entries that wait in memory. Streams keep the same in the state of a channel and are driven by event-time timers, one a round.

Defined results: an entry without scheduled time is due when the channel's first entry is; without `until` it never expires; without `fails` it goes out at the first try;
rows that share a key are entries of their own; a null channel is a channel; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR, DAY = 3600.0, 86_400.0
#: In seconds; state keeps no infinite numbers.
NEVER = 1e12
ENTRY = "channel string, key string, scheduled double, until double, fails int"
OUTCOME = "channel string, key string, outcome string, posted double, attempts int"


@dataclass(frozen=True)
class Limits:
    gap: float = 1800
    per_hour: int = 4
    per_day: int = 40
    every: float = 300
    max_attempts: int = 3

    def most(self, seconds: float) -> float:
        """Posts at most within so many seconds."""
        span = max(0.0, seconds)
        return min(self.per_hour * (math.ceil(span / HOUR) + 1), self.per_day * (math.ceil(span / DAY) + 1))


@dataclass(order=True)
class Entry:
    scheduled: float
    key: str
    until: float = field(compare=False)
    fails: int = field(compare=False)
    attempts: int = field(compare=False, default=0)


class Hopeless:
    """For entries of one hour in order: whether those before leave no way for the next to go out."""

    def __init__(self, hour: float, limits: Limits):
        self.start, self.limits, self.ahead = hour * HOUR, limits, []

    def __call__(self, until: float, fails: int) -> bool:
        until = until // self.limits.every * self.limits.every  # its last round
        most = self.limits.most(until - self.start)
        if len(self.ahead) - bisect_left(self.ahead, until) >= most:
            return True
        if not fails:
            insort(self.ahead, until)
            if len(self.ahead) > self.limits.most(self.ahead[-1] - self.start):
                self.ahead.pop(0)  # the first to expire: those behind suffice for all that it stands before
        return False


class Channel:
    """One channel's queue and what it posted within the last day."""

    def __init__(self, limits: Limits, queue: list[Entry] | None = None, posted: list[float] | None = None, after: float = -NEVER):
        self.limits, self.queue, self.posted, self.after = limits, queue or [], deque(posted or []), after
        heapq.heapify(self.queue)

    def add(self, entry: Entry) -> None:
        heapq.heappush(self.queue, entry)

    def _round_from(self, at: float) -> float:
        return float(math.ceil(at / self.limits.every) * self.limits.every)

    def next_round(self) -> float:
        """The first round at which an entry is due and the gap and the caps let one go out."""
        at = max(self.queue[0].scheduled, self.after + self.limits.every)
        if self.posted:
            at = max(at, self.posted[-1] + self.limits.gap)
        round_ = self._round_from(at)
        for most, span in ((self.limits.per_hour, HOUR), (self.limits.per_day, DAY)):
            if len(self.posted) >= most and round_ - self.posted[-most] <= span:
                round_ = self._round_from(self.posted[-most] + span)
                round_ += self.limits.every if round_ - self.posted[-most] <= span else 0
        return round_

    def run(self, before: float) -> Iterator[tuple[str, str, float | None, int]]:
        """Rounds before that time: (key, outcome, posted, attempts) of entries that are done with."""
        while self.queue and (now := self.next_round()) < before:
            again = []
            while self.queue and self.queue[0].scheduled <= now:
                e = heapq.heappop(self.queue)
                if now > e.until:
                    yield e.key, "expired", None, e.attempts
                elif e.attempts < e.fails:
                    e.attempts += 1
                    if e.attempts >= self.limits.max_attempts:
                        yield e.key, "failed", None, e.attempts
                    else:
                        again.append(e)
                else:
                    self.posted.append(now)
                    yield e.key, "posted", now, e.attempts + 1
                    break
            for e in again:
                self.add(e)
            while self.posted and now - self.posted[0] > DAY:
                self.posted.popleft()
            self.after = now


def _entries(b: pa.RecordBatch) -> Iterator[tuple[str | None, Entry]]:
    for c, k, at, until, fails in zip(*(b.column(x).to_pylist() for x in ("channel", "key", "scheduled", "until", "fails")), strict=True):
        yield c, Entry(at, k, until, fails)


def _whole(queue: DataFrame) -> DataFrame:
    """Entries without nulls but in channel and key."""
    rows = queue.select(F.col("channel").cast("string").alias("channel"), F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), F.col("scheduled").cast("double").alias("scheduled"), F.coalesce(F.col("until").cast("double"), F.lit(NEVER)).alias("until"), F.coalesce(F.col("fails").cast("int"), F.lit(0)).alias("fails"))
    if rows.isStreaming:
        return rows
    first = rows.groupBy(F.col("channel").alias("_c")).agg(F.coalesce(F.min("scheduled"), F.lit(0.0)).alias("_first"))
    late = rows.where("scheduled is null").join(first, F.col("channel").eqNullSafe(F.col("_c"))).select("channel", "key", F.col("_first").alias("scheduled"), "until", "fails")
    return rows.where("scheduled is not null").unionByName(late)


def could_go_out(queue: DataFrame, limits: Limits) -> DataFrame:
    """Adds hopeful: False for entries that caps keep from ever being tried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hopeless = None, None
        for b in batches:
            marks = []
            for (c, e), before in zip(_entries(b), b.column("hopeful").to_pylist(), strict=True):
                if not before:
                    marks.append(False)
                    continue
                hour = e.scheduled // HOUR
                if (c, hour) != now:
                    now, hopeless = (c, hour), Hopeless(hour, limits)
                marks.append(not hopeless(e.until, e.fails))
            yield b.set_column(b.schema.get_field_index("hopeful"), "hopeful", pa.array(marks, pa.bool_()))

    order = ["channel", "scheduled", "key"]
    schema = ENTRY + ", hopeful boolean"
    # within partitions as they are: what is hopeless among some is hopeless among all
    first = queue.withColumn("hopeful", F.lit(True)).sortWithinPartitions(*order).mapInArrow(run, schema)
    together = first.where("hopeful").repartition(F.col("channel"), F.floor(F.col("scheduled") / HOUR)).sortWithinPartitions(*order).mapInArrow(run, schema)
    return first.where("not hopeful").unionByName(together)


def publish(queue: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(channel, key, outcome, posted, attempts) of entries (channel, key, scheduled, until: seconds; fails: tries that fail). outcome: posted, expired or failed; on a stream, once it is known."""
    if queue.isStreaming:
        return _publish_stream(queue, limits)
    marked = could_go_out(_whole(queue), limits)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, channel = object(), Channel(limits)

        def rows(name: str | None, done: Iterator[tuple[str, str, float | None, int]]) -> Iterator[pa.RecordBatch]:
            if found := list(done):
                key, outcome, posted, attempts = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(key, pa.string()), pa.array(outcome, pa.string()), pa.array(posted, pa.float64()), pa.array(attempts, pa.int32())], ["channel", "key", "outcome", "posted", "attempts"])

        for b in batches:
            done: list = []
            for c, e in _entries(b):
                if c != now:
                    yield from rows(now, iter([*done, *channel.run(math.inf)]))
                    now, channel, done = c, Channel(limits), []
                done += channel.run(e.scheduled)
                channel.add(e)
            yield from rows(now, iter(done))
        yield from rows(now, channel.run(math.inf))

    walked = marked.where("hopeful").drop("hopeful").repartition("channel").sortWithinPartitions("channel", "scheduled", "key").mapInArrow(walk, OUTCOME)
    never = marked.where("not hopeful").select("channel", "key", F.lit("expired").alias("outcome"), F.lit(None).cast("double").alias("posted"), F.lit(0).alias("attempts"))
    return walked.unionByName(never)


# ---------------------------------------------------------------- streams


class Publisher(StatefulProcessor):
    """Queue and posts of a channel as lists in the state; a timer for the next round. Rounds run when the watermark has passed them, for then all that was due has come."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "scheduled double, key string, until double, fails int, attempts int")
        self.posted = handle.getListState("posted", "at double")
        self.clock = handle.getValueState("clock", "after double")

    def _load(self) -> Channel:
        rows = [Entry(*r) for r in self.waiting.get()] if self.waiting.exists() else []
        posted = [r[0] for r in self.posted.get()] if self.posted.exists() else []
        return Channel(self.limits, rows, posted, self.clock.get()[0] if self.clock.exists() else -NEVER)

    def _save(self, c: Channel, watermark: float) -> None:
        self.waiting.clear()
        self.posted.clear()
        if c.queue:
            self.waiting.put([(e.scheduled, e.key, e.until, e.fails, e.attempts) for e in c.queue])
            self.handle.registerTimer(int(max(c.next_round(), watermark) * 1000) + 1)
        if c.posted:
            self.posted.put([(x,) for x in c.posted])
        self.clock.update((c.after,))

    def _out(self, key: tuple, done: list[tuple]) -> Iterator[pd.DataFrame]:
        if done:
            yield pd.DataFrame([(key[0], *d) for d in done], columns=["channel", "key", "outcome", "posted", "attempts"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        c, done = self._load(), []
        new = [Entry(float(r.scheduled), str(r.key), float(r.until), int(r.fails)) for pdf in rows for r in pdf.itertuples()]
        # what came is held against all that waits, so the state keeps what caps can let through
        kept, hours = [], {}
        for e in sorted([*c.queue, *new]):
            hour = e.scheduled // HOUR
            if hours.setdefault(hour, Hopeless(hour, self.limits))(e.until, e.fails) and not e.attempts:
                done.append((e.key, "expired", None, 0))
            else:
                kept.append(e)
        c.queue = kept
        heapq.heapify(c.queue)
        self._save(c, timerValues.getCurrentWatermarkInMs() / 1000)
        yield from self._out(key, done)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        watermark = timerValues.getCurrentWatermarkInMs() / 1000
        c = self._load()
        done = list(c.run(watermark))
        self._save(c, watermark)
        yield from self._out(key, done)

    def close(self) -> None:
        pass


def _publish_stream(queue: DataFrame, limits: Limits, late: str = "0 seconds") -> DataFrame:
    rows = _whole(queue).withColumn("at", F.timestamp_seconds("scheduled")).withWatermark("at", late)
    return rows.groupBy("channel").transformWithStateInPandas(statefulProcessor=Publisher(limits), outputStructType=OUTCOME, outputMode="Append", timeMode="EventTime")

