"""Ordered rows: transitions, dialogue units, packing, timelines, sessions and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.functions.grouping import fold_groups
from colloquy.operators.scans import running_sum


def state_chain(units: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """A dense chain: each row's state follows the one before, the first follows ``__start__``; null is ``__unknown__``."""
    w = W.partitionBy(key).orderBy(*order)
    to = F.coalesce(F.col(state), F.lit("__unknown__"))
    return units.withColumn("to_state", to).select(
        key, *order, (F.row_number().over(w) - 1).cast("long").alias("sequence_no"), F.lag("to_state", 1, "__start__").over(w).alias("from_state"), "to_state"
    )


def transition_label(before: Column, now: Column) -> Column:
    """start, stay, advance (by one), jump or backtrack from places in the business order; change without places."""
    return (
        F.when(before.isNull() & now.isNotNull(), "start").when(before.isNull() | now.isNull(), "change")
        .when(now == before, "stay").when(now == before + 1, "advance").when(now > before, "jump").otherwise("backtrack")
    )


def carried_stage(segments: DataFrame) -> DataFrame:
    """Stages with unknown ones taken from the last known: confidence .9 said, .56 carried, .35 unknown."""
    w = W.partitionBy("recording_id").orderBy("start_sec", "end_sec", "segment_id")
    said = F.when(F.col("stage") != "unknown", F.col("stage"))
    carried = F.last(said, ignorenulls=True).over(w)
    return segments.withColumn("final", F.coalesce(carried, F.lit("unknown"))).withColumn("confidence", F.when(said.isNotNull(), 0.9).when(carried.isNotNull(), 0.56).otherwise(0.35))


def boundary_scores(staged: DataFrame) -> DataFrame:
    """The score of a cut before each row: pause (8 s .55, 3 s .30), stage change .25, speaker change .08, at most 1."""
    w = W.partitionBy("recording_id").orderBy("start_sec", "end_sec", "segment_id")
    pause = F.col("start_sec") - F.lag("end_sec").over(w)
    first = F.lag("segment_id").over(w).isNull()
    score = (
        F.when(pause >= 8, 0.55).when(pause >= 3, 0.30).otherwise(0.0) + F.when(F.col("final") != F.lag("final").over(w), 0.25).otherwise(0.0)
        + F.when(F.col("speaker") != F.lag("speaker").over(w), 0.08).otherwise(0.0)
    )
    return staged.withColumn("score", F.round(F.least(F.lit(1.0), score), 4)).withColumn("cut", first | (F.col("score") >= 0.5))


def dialogue_units(segments: DataFrame) -> DataFrame:
    """Units between cuts: span, most frequent stage (first seen on a tie), size, speech confidence."""
    w = W.partitionBy("recording_id").orderBy("start_sec", "end_sec", "segment_id")
    cut = boundary_scores(carried_stage(segments)).withColumn("unit", F.sum(F.col("cut").cast("long")).over(w) - 1)
    # all windows and the aggregation stay within a recording, so the rows are dealt out once
    kind = W.partitionBy("recording_id", "unit", "final")
    mean = lambda c: F.sum(F.col(c).cast("decimal(10,4)")).cast("double") / F.count("*")  # noqa: E731  # whatever the order of the rows
    cut = cut.withColumn("n", F.count("*").over(kind)).withColumn("seen", F.min(F.struct("start_sec", "end_sec", "segment_id")).over(kind))
    return cut.groupBy("recording_id", "unit").agg(
        F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.count("*").alias("segments"),
        F.round(mean("confidence") * 0.65 + mean("vad") * 0.35, 6).alias("confidence"),
        F.min(F.struct((-F.col("n")).alias("n"), "seen", "final"))["final"].alias("stage"),
    )


def timeline(parts: DataFrame, key: str, order: str, length: str, gap: int = 0) -> DataFrame:
    """Each part's place on one line: the lengths before it and a gap for each. A key's parts may be spread over tasks."""
    return running_sum(parts, [key], [F.col(order)], F.col(length) + gap, "at", inclusive=False)


def packed(segments: DataFrame, budget: int, key: str = "recording_id", order: str = "idx", size: str = "tokens") -> DataFrame:
    """Greedy packs: a row opens a new pack when it would burst the current one; empty rows are left out.

    A fold over each key's ordered rows, since a pack's start depends on all packs before it.
    """
    rows = segments.where(F.col(size) > 0).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("n")))).alias("rows"))
    start = F.expr("named_struct('pack', 0L, 'used', 0L, 'out', cast(array() as array<struct<o:bigint,n:bigint,pack:bigint>>))")

    def step(acc, r):
        new = (acc["used"] > 0) & (acc["used"] + r["n"] > budget)
        pack = acc["pack"] + F.when(new, 1).otherwise(0)
        used = F.when(new, r["n"]).otherwise(acc["used"] + r["n"])
        return F.struct(pack.cast("long").alias("pack"), used.cast("long").alias("used"), F.concat(acc["out"], F.array(F.struct(r["o"].cast("long").alias("o"), r["n"].alias("n"), pack.cast("long").alias("pack")))).alias("out"))

    return rows.select(key, F.explode(F.aggregate("rows", start, step)["out"]).alias("x")).select(key, F.col("x.o").alias(order), F.col("x.n").alias(size), "x.pack")


def evicted(entries: DataFrame, key: str, used_at: list[str], size: str, keep: int) -> DataFrame:
    """Entries to drop, oldest use first, until at most ``keep`` of the size stays. A key's entries may be spread over tasks."""
    held = running_sum(entries, [key], [F.desc(c) for c in used_at], F.col(size), "held")
    return held.where(F.col("held") > keep).drop("held")


def round_robin(rows: DataFrame, stratum: str, order: str, limit: int) -> DataFrame:
    """A sample that takes each stratum's next row in turn."""
    place = F.row_number().over(W.partitionBy(stratum).orderBy(order))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= limit).orderBy("place", stratum).limit(limit)


def lanes(intervals: DataFrame, key: str) -> DataFrame:
    """The most intervals of a key that run at once: how many lanes a drawing needs."""
    ends = intervals.select(key, F.explode(F.array(F.struct(F.col("start_sec").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end_sec").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    w = W.partitionBy(key).orderBy("e.at", "e.d").rowsBetween(W.unboundedPreceding, 0)
    return ends.withColumn("open", F.sum("e.d").over(w)).groupBy(key).agg(F.max("open").alias("lanes"))


def assigned_lanes(intervals: DataFrame, key: str, id_col: str, start: str = "start_sec", end: str = "end_sec") -> DataFrame:
    """(key, id, lane): where a drawing puts each interval: the first lane whose last interval ends by its start.

    A fold over a key's intervals in order of start, end and id that holds one end a lane.
    """

    def fold(group_key: tuple, group: list[tuple]) -> list[tuple]:
        out, ends = [], []
        for _, number, begins, stops in group:
            lane = next((i for i, e in enumerate(ends) if e <= begins), len(ends))
            ends[lane : lane + 1] = [stops]
            out.append((group_key[0], number, lane))
        return out

    rows = intervals.select(key, id_col, F.col(start).cast("double").alias("_start"), F.col(end).cast("double").alias("_end"))
    return fold_groups(rows, [key], ["_start", "_end", id_col], fold, f"{key} {dict(intervals.dtypes)[key].replace('bigint', 'long')}, {id_col} long, lane long")


def accepted_frames(frames: DataFrame, gap: int = 3) -> DataFrame:
    """What a session says to each frame in order of arrival: duplicate, out_of_order, vad_reset or ok.

    A seen number is a duplicate even if late; an unseen one below the highest is rejected; a
    step of more than ``gap`` past the highest resets.
    """
    w = W.partitionBy("session_id").orderBy("arrival")
    high = F.max("seq").over(w.rowsBetween(W.unboundedPreceding, -1))
    late = F.col("seq") < F.col("high")
    first = frames.withColumn("high", high).withColumn("first_late", late)
    # a late unseen frame leaves no mark, so only an accepted arrival makes later ones duplicates
    mark = F.max(F.when(~F.coalesce("first_late", F.lit(False)), 1).otherwise(0)).over(W.partitionBy("session_id", "seq").orderBy("arrival").rowsBetween(W.unboundedPreceding, -1))
    event = F.when(F.coalesce("mark", F.lit(0)) == 1, "duplicate").when(late, "out_of_order").when(F.col("seq") - F.col("high") > gap, "vad_reset").otherwise("ok")
    return first.withColumn("mark", mark).withColumn("event", event).drop("mark", "first_late", "high")


def every_nth(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Count-triggered batches: the n-th, 2n-th ... row of a key closes a batch."""
    place = F.row_number().over(W.partitionBy(key).orderBy(order))
    return rows.withColumn("batch", F.floor((place - 1) / n).cast("long"))


def idle_sessions(events: DataFrame, key: str, at: str, timeout: int) -> DataFrame:
    """Sessions that end after ``timeout`` without an event."""
    w = W.partitionBy(key).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > timeout).cast("long"), F.lit(1))
    return events.withColumn("new", new).withColumn("session", F.sum("new").over(w)).groupBy(key, "session").agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


def conflicts(frames: DataFrame) -> DataFrame:
    """Numbers staged more than once with different bytes: a replay that must not be accepted."""
    return frames.groupBy("session_id", "seq").agg(F.count_distinct("payload").alias("kinds"), F.count("*").alias("n")).where("kinds > 1")


def debounced_batches(rows: DataFrame, key: str, order: str, at_ms: str, n: int = 5, debounce_ms: int = 500) -> DataFrame:
    """(key, batch, first, last, size): a row closes a batch if it holds n rows or more and the last batch closed
    ``debounce_ms`` ago or more; what is left at the end of a key is its last batch.

    A fold over each key's ordered rows, since a batch begins where the one before ended.
    """
    def fold(group_key: tuple, group: list[tuple]) -> list[tuple]:
        out, first, size, closed, last = [], None, 0, None, None
        for _, place, at in group:
            first, size, last = (place if first is None else first), size + 1, place
            if size >= n and (closed is None or at - closed >= debounce_ms):
                out.append((group_key[0], len(out), first, place, size))
                first, size, closed = None, 0, at
        return [*out, (group_key[0], len(out), first, last, size)] if size else out

    return fold_groups(rows.select(key, order, at_ms), [key], [order], fold, f"{key} {dict(rows.dtypes)[key].replace('bigint', 'long')}, batch long, first long, last long, size long")


#: Where an event takes a session from each state; other events change nothing.
LIFECYCLE = {
    "start": {"created": "active"}, "finish": {"created": "draining", "active": "draining"}, "commit": {"draining": "committing"}, "committed": {"committing": "closed"},
    "lost": {"active": "incomplete", "draining": "incomplete"}, "error": {s: "failed" for s in ("created", "active", "draining", "committing")},
}


def session_states(events: DataFrame, key: str, order: str, event: str) -> DataFrame:
    """(key, state, changes): the state of each session after its events in order, and how many changed it."""
    def fold(group_key: tuple, group: list[tuple]) -> list[tuple]:
        state, changes = "created", 0
        for _, _, name in group:
            new = LIFECYCLE.get(name, {}).get(state, state)
            changes, state = changes + (new != state), new
        return [(group_key[0], state, changes)]

    return fold_groups(events.select(key, order, event), [key], [order], fold, f"{key} {dict(events.dtypes)[key].replace('bigint', 'long')}, state string, changes long")
