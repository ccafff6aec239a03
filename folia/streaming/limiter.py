"""Sliding-window rate limiter: as a stream with state for each key, and as a replay of a table.

A request is rejected if its key already has ``limit`` accepted ones in the window; rejected requests are
not recorded, so the rule depends on its own past decisions and is no window function.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "key long, ts timestamp, accepted boolean"


def decide(times: list[int], held: list[int], limit: int, seconds: int) -> tuple[list[bool], list[int]]:
    """Decisions on requests in order (microseconds), and the accepted ones still in the window."""
    out = []
    for at in times:
        held = [t for t in held if t >= at - seconds * 1_000_000]
        out.append(len(held) < limit)
        if out[-1]:
            held.append(at)
    return out, held


def replay_limiter(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """key, ts and accepted of each request of a table.

    Requests of a key stream through its task in order and only the window's accepted ones are kept, so
    a hot key needs no more memory than any other.
    """

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for frame in frames:
            accepted = []
            for k, at in zip(frame["key"], frame["ts"].astype("int64"), strict=True):
                if k != key:
                    key, held = k, []
                (ok,), held = decide([at // scale(frame)], held, limit, seconds)
                accepted.append(ok)
            yield frame.assign(accepted=accepted)

    return requests.select("key", "ts").repartition("key").sortWithinPartitions("key", "ts").mapInPandas(f, SCHEMA)


def scale(frame: pd.DataFrame) -> int:
    """Ticks of the frame's time column in a microsecond."""
    return {"ns": 1000, "us": 1}[frame["ts"].dt.unit]


def stream_limiter(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """replay_limiter() for a stream: requests of a batch are decided in order of time; state is dropped
    when its key was silent for a window."""

    def f(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (held,) = state.get if state.exists else ([],)
        frame = pd.concat(list(frames)).sort_values("ts", kind="stable")
        accepted, held = decide([int(t) // scale(frame) for t in frame["ts"].astype("int64")], list(held), limit, seconds)
        state.update((held,))
        state.setTimeoutDuration(seconds * 1000)
        yield pd.DataFrame({"key": key[0], "ts": frame["ts"], "accepted": accepted})

    return requests.groupBy("key").applyInPandasWithState(f, SCHEMA, "held array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)
