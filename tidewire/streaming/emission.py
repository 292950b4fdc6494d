"""Rate-limited emission: a minimum gap, and caps for an hour and a day, by channel.

What is emitted depends on what was emitted before, so a channel is decided in order of time. On a stream the last
day's emissions are the state of a channel, kept in the checkpoint.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY = 86_400


def allowed(times: list[float], sent: deque[float], gap: float, per_hour: int, per_day: int) -> list[bool]:
    out = []
    for t in times:
        while sent and sent[0] <= t - DAY:
            sent.popleft()
        hour = sum(x > t - 3600 for x in sent)
        ok = (not sent or t - sent[-1] >= gap) and hour < per_hour and len(sent) < per_day
        if ok:
            sent.append(t)
        out.append(ok)
    return out


def emit(rows: DataFrame, channel: str, seconds: str, key: str, gap: float = 60, per_hour: int = 20, per_day: int = 150) -> DataFrame:
    """Adds emitted to (channel, seconds, key). A channel's rows are one group: channels are many and small."""
    cols = [channel, seconds, key]
    picked = rows.select(*cols)
    types = {f.name: f.dataType.simpleString() for f in picked.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in cols) + ", emitted boolean"

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([seconds, key], kind="stable")
        return pdf.assign(emitted=allowed(pdf[seconds].tolist(), deque(), gap, per_hour, per_day))

    def stream(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sent = deque(state.get[0]) if state.exists else deque()
        pdf = pd.concat(list(frames)).sort_values([seconds, key], kind="stable")
        marks = allowed(pdf[seconds].tolist(), sent, gap, per_hour, per_day)
        state.update((list(sent),))
        yield pdf.assign(emitted=marks)

    if picked.isStreaming:
        return picked.groupBy(channel).applyInPandasWithState(stream, schema, "sent array<double>", "append", GroupStateTimeout.NoTimeout)
    return picked.groupBy(channel).applyInPandas(table, schema)
