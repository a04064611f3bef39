"""Structured Streaming: frames, sessions and monitoring windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Numbers remembered for duplicates, and the step past the highest that resets.
REMEMBERED, GAP = 4096, 3


def monitoring_windows(events: DataFrame, at: str = "ts", late: str = "0 seconds", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts of closed five-minute windows."""
    return events.withWatermark(at, late).groupBy(F.window(at, "5 minutes"), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def idle_sessions(events: DataFrame, key: str, at: str = "ts", timeout: str = "300 seconds", late: str = "0 seconds") -> DataFrame:
    """Sessions closed by ``timeout`` without an event."""
    g = events.withWatermark(at, late).groupBy(F.session_window(at, timeout), key)
    return g.agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("first"), F.col("session_window.end").alias("closed"), "n")


def receipts(frames: DataFrame, keys: list[str], at: str, late: str = "10 minutes") -> DataFrame:
    """Each receipt once, however often its frame is sent again."""
    return frames.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def frame_events(frames: DataFrame, remembered: int = REMEMBERED, gap: int = GAP) -> DataFrame:
    """(session_id, arrival, seq, event) of a stream of frames: what each frame is to its session.

    State holds the highest number and the last numbers seen; a duplicate is told before a late one.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        high, seen = state.get if state.exists else (-1, [])
        seen = dict.fromkeys(seen)  # in order, so that the oldest goes first
        rows = []
        for pdf in sorted(pd.concat(list(batches)).itertuples(index=False), key=lambda r: r.arrival):
            if pdf.seq in seen:
                event = "duplicate"
            elif pdf.seq < high:
                event = "out_of_order"
            else:
                event = "vad_reset" if high >= 0 and pdf.seq - high > gap else "ok"
                high = int(pdf.seq)
                seen[high] = None
                if len(seen) > remembered:
                    del seen[next(iter(seen))]
            rows.append((key[0], pdf.arrival, pdf.seq, event))
        state.update((high, list(seen)))
        yield pd.DataFrame(rows, columns=["session_id", "arrival", "seq", "event"])

    return frames.select("session_id", "arrival", "seq").groupBy("session_id").applyInPandasWithState(
        step, "session_id string, arrival long, seq long, event string", "high long, seen array<long>", "append", GroupStateTimeout.NoTimeout
    )
