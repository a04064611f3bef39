"""Incremental operators on streams: chunks by budget, a graph kept up to date. Dialogue units are in ``streaming.dialogue``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from colloquy.operators.upkeep import delta_graph


def chunks(segments: DataFrame, budget: int, idle: str = "300 seconds") -> DataFrame:
    """(recording_id, chunk, first, last, tokens) of a stream of segments (recording_id, idx, tokens, ts).

    A segment that would burst the chunk closes it and opens the next; a recording without
    segments for ``idle`` of event time closes its last. Segments of a batch are taken by number;
    empty ones are left out. A number not above the highest taken is a repeat or late and changes
    nothing. If a recording goes on after it was idle, its chunks are numbered on. The batch twin is ``sequences.packed``.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chunk, first, last, used, high, at = state.get if state.exists else (0, -1, -1, 0, -1, 0)
        rows = []
        if state.hasTimedOut:
            if used:
                rows.append((key[0], chunk, first, last, used))
                chunk, first, last, used = chunk + 1, -1, -1, 0
            state.update((chunk, first, last, used, high, at))
        else:
            for r in sorted(pd.concat(list(batches)).itertuples(index=False), key=lambda r: r.idx):
                if r.tokens <= 0 or r.idx <= high:
                    continue
                gap, at = int(r.ts.timestamp() * 1000) - at, max(at, int(r.ts.timestamp() * 1000))
                if used and (used + r.tokens > budget or gap >= wait):  # the pause counts, whether or not the timer ran in between
                    rows.append((key[0], chunk, first, last, used))
                    chunk, first, used = chunk + 1, -1, 0
                first, last, used, high = (int(r.idx) if first < 0 else first), int(r.idx), used + int(r.tokens), int(r.idx)
            state.update((chunk, first, last, used, high, at))
            state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1) + wait)
        yield pd.DataFrame(rows, columns=["recording_id", "chunk", "first", "last", "tokens"])

    return segments.withWatermark("ts", "0 seconds").select("recording_id", "idx", "tokens", "ts").groupBy("recording_id").applyInPandasWithState(
        step, "recording_id long, chunk long, first long, last long, tokens long", "chunk long, first long, last long, used long, high long, at long", "append", GroupStateTimeout.EventTimeTimeout
    )


def keep_graph(relations: DataFrame, folder: str, checkpoint: str):
    """Starts a query that adds each batch of relations to the merged edges under ``folder``.

    Each batch writes a version of its own, named by its number, from the version before, so a
    batch that runs again writes the same one. Returns the query; :func:`current_graph` reads the last version.
    """
    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select("source", "target", "relation", "weight", "rank")
        old = spark.read.parquet(f"{folder}/{number - 1}") if number else new.limit(0)
        delta_graph(old, new).write.mode("overwrite").parquet(f"{folder}/{number}")

    return relations.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_graph(spark, folder: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/{number}")
