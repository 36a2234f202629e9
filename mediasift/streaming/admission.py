"""Admission times as keyed state: the last admission of a key, kept in Spark's state store.

A call is let through at its own time or ``interval`` after the admission before it, whichever is later. Within one
batch, tasks first sort what they hold of a key into blocks, so a hot key sends its calls as arrays; the state
operator merges the blocks of a key and admits them by the closed form of ``operators.throttle``, starting from the
state. A timer on event time clears the state of a key once it can hold back no call that is still in time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BLOCK = "key string, newest long, calls array<long>, times array<long>"
ADMITTED = "key string, call_id long, ts long, admit long"


def sorted_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each key of a batch of rows: its calls in the order of time and id."""
    for frame in frames:
        ordered = frame.sort_values(["key", "ts", "call_id"], kind="stable")
        starts = np.flatnonzero(ordered["key"].ne(ordered["key"].shift()))
        if len(starts):
            times, calls = (np.split(ordered[c].to_numpy(), starts[1:]) for c in ("ts", "call_id"))
            keys = ordered["key"].to_numpy()[starts]
            yield pd.DataFrame({"key": keys, "newest": [t[-1] for t in times], "calls": calls, "times": times})


class Admission(StatefulProcessor):
    """State per key: last admission and the timer that clears it. Times are epoch microseconds."""

    def __init__(self, interval: int) -> None:
        self.interval = interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("admission", "last long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = [frame for frame in rows]
        times = np.concatenate([t for f in frames for t in f["times"]]).astype(np.int64)
        calls = np.concatenate([c for f in frames for c in f["calls"]]).astype(np.int64)
        # Blocks with one call in time may hold older ones: every call is judged alone, however rows were dealt.
        in_time = times // 1000 > timerValues.getCurrentWatermarkInMs()
        times, calls = times[in_time], calls[in_time]
        if not len(times):
            return
        order = np.lexsort((calls, times))
        times, calls = times[order], calls[order]
        steps = np.arange(1, len(times) + 1) * self.interval
        reach = np.maximum.accumulate(times - steps)
        known = self.state.get()
        if known is not None:
            reach = np.maximum(reach, known[0])
            self.handle.deleteTimer(known[1])
        admit = reach + steps
        last = int(admit[-1])
        timer = max((last + self.interval) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1)
        self.state.update((last, timer))
        self.handle.registerTimer(timer)
        yield pd.DataFrame({"key": key[0], "call_id": calls, "ts": times, "admit": admit})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.state.get()
        if known is not None and known[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        yield pd.DataFrame({c: pd.Series([], dtype="object" if c == "key" else "int64") for c in ("key", "call_id", "ts", "admit")})

    def close(self) -> None:
        pass


def admitted(calls: DataFrame, interval: int, delay: int) -> DataFrame:
    """key, call_id, ts and admit of a stream of calls (key, call_id, ts in epoch microseconds).

    Calls may come ``delay`` behind the newest; later ones are dropped. Calls without key or time are let through
    without admission time.
    """
    known = F.col("key").isNotNull() & F.col("ts").isNotNull()
    rows = calls.select(F.col("key").cast("string"), F.col("call_id").cast("long"), F.col("ts").cast("long"))
    blocks = rows.filter(known).mapInPandas(sorted_blocks, BLOCK)
    timed = blocks.withColumn("time", F.timestamp_micros("newest")).withWatermark("time", f"{delay} microseconds")
    found = timed.groupBy("key").transformWithStateInPandas(Admission(interval), ADMITTED, "Append", "EventTime")
    return found.unionByName(rows.filter(~known).withColumn("admit", F.lit(None).cast("long")))
