"""Fixed-window rate limits: a key's first event opens a window that lasts ``seconds``; the next event after that opens another."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def step(start: int | None, count: int, at: int, seconds: int) -> tuple[int, int]:
    """The window's start and count after an event."""
    return (at, 1) if start is None or at - start >= seconds else (start, count + 1)


def batch(events: DataFrame, key: str, event: str, at: str, seconds: int, limit: int) -> DataFrame:
    """key, event, window_start, count and allowed of each event.

    A key's events are folded in order of time. The fold's state is two numbers, and rows come
    from a sorted partition one batch after another, so a busy key needs no memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, start, count = object(), None, 0
        for b in batches:
            starts, counts = [], []
            for k, t in zip(b[key].tolist(), b[at].tolist()):
                if k != of:
                    of, start, count = k, None, 0
                start, count = step(start, count, t, seconds)
                starts.append(start)
                counts.append(count)
            yield pd.DataFrame({key: b[key], event: b[event], "window_start": starts, "count": counts, "allowed": [c <= limit for c in counts]})

    types = dict(events.dtypes)
    ordered = events.select(key, event, at).repartition(key).sortWithinPartitions(key, at, event)
    return ordered.mapInPandas(run, f"{key} {types[key]}, {event} {types[event]}, window_start long, count long, allowed boolean")


def stream(events: DataFrame, key: str, at: str, seconds: int, limit: int) -> DataFrame:
    """The same on a stream (``at``: a timestamp with a watermark): a row for each key and batch; idle keys leave the state.

    Spark drops rows that are not after the watermark, the first one (0) included, so late rows change no count.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        blocked = 0
        times = sorted(int(t.timestamp()) for f in frames for t in f[at])
        for t in times:
            start, count = step(start, count, t, seconds)
            blocked += count > limit
        state.update((start, count))
        state.setTimeoutTimestamp(max((start + 2 * seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "window_start": [start], "count": [count], "blocked": [blocked]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(
        run, f"{key} {kind}, window_start long, count long, blocked long", "window_start long, count long", "update", GroupStateTimeout.EventTimeTimeout
    )


def aligned(events: DataFrame, key: str, at: str, seconds: int, limit: int) -> DataFrame:
    """The cheaper clock-aligned rule, without custom state: counts of tumbling windows."""
    w = F.window(at, f"{seconds} seconds")
    return events.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("count")).withColumn("blocked", F.greatest(F.col("count") - limit, F.lit(0)))
