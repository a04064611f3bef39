"""Filters, pages, joins and aggregations over recordings, receptions and transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.operators.pairs import pair_verdicts

#: Rows of a table dealt by key that one task takes, about.
TASK_ROWS = 100_000


def in_window(at: Column, start, end) -> Column:
    """Both ends included; rows without a time stay."""
    return at.isNull() | at.between(start, end)


def recording_page(recordings: DataFrame, stores: list[int], start: int, end: int, limit: int, offset: int = 0) -> DataFrame:
    """A page of recordings, newest first; the upper bound is included."""
    found = recordings.where(F.col("store_id").isin(stores) & F.col("started_sec").between(start, end))
    return found.orderBy(F.desc("started_sec"), F.desc("recording_id")).offset(offset).limit(limit)


def reception_slice(receptions: DataFrame, stores: list[int], scenario: str | None, start: int, end: int) -> DataFrame:
    """Receptions of a half-open window [start, end)."""
    found = receptions.where(F.col("store_id").isin(stores) & (F.col("started_sec") >= start) & (F.col("started_sec") < end))
    return found.where(F.col("scenario") == scenario) if scenario else found


def overlapping(segments: DataFrame, start, end) -> DataFrame:
    return segments.where((F.col("end_sec") > start) & (F.col("start_sec") < end))


def after_cursor(rows: DataFrame, key: str, cursor: int, limit: int) -> DataFrame:
    """The next page of a feed that is read by ascending key."""
    return rows.where(F.col(key) > cursor).orderBy(key).limit(limit)


def owned_segments(segments: DataFrame, windows: DataFrame) -> DataFrame:
    """Segments with the windows of their recording that they overlap; an open window has no end."""
    end = F.coalesce("w_end", F.lit(1 << 60))
    return segments.join(windows, "recording_id").where((F.col("end_sec") > F.col("w_start")) & (F.col("start_sec") < end))


def transition_flow(transitions: DataFrame, receptions: DataFrame) -> DataFrame:
    """Counts, mean confidence and evidence of each pair of states."""
    return transitions.join(receptions.select("reception_id", "tenant_id"), ["reception_id", "tenant_id"]).groupBy("from_state", "to_state").agg(
        F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.sum("evidence").alias("evidence")
    )


def state_nodes(transitions: DataFrame) -> DataFrame:
    """Incoming and outgoing events of each state; a self-loop is one event of both kinds."""
    one = transitions.select(F.explode(F.array_distinct(F.array("from_state", "to_state"))).alias("state"), "from_state", "to_state", "reception_id", "confidence")
    return one.groupBy("state").agg(
        F.count_distinct("reception_id").alias("receptions"), F.count_if(F.col("state") == F.col("to_state")).alias("incoming"), F.count_if(F.col("state") == F.col("from_state")).alias("outgoing"),
        F.round(F.avg("confidence"), 6).alias("confidence"),
    )


def top_reasons(transitions: DataFrame, n: int = 5) -> DataFrame:
    """The n most frequent reasons of each pair of states."""
    counts = transitions.groupBy("from_state", "to_state", "reason").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("from_state", "to_state").orderBy(F.desc("n"), "reason"))
    return counts.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def sample_receptions(transitions: DataFrame, n: int = 5) -> DataFrame:
    """The n smallest receptions of each pair of states."""
    one = transitions.select("from_state", "to_state", "reception_id").distinct()
    rank = F.row_number().over(W.partitionBy("from_state", "to_state").orderBy("reception_id"))
    return one.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, without a shuffle of more than one candidate per task and key."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col("row")[c].alias(c) for c in rest])


def nearest_baseline(candidates: DataFrame, baselines: DataFrame, keys: list[str]) -> DataFrame:
    """For each candidate a baseline of its keys: one of its job first, then the nearest in time either way, then the larger id.

    Takes (keys, job, id, at) on both sides. Both are put in one order of time, in which the
    last baseline before and the first after a candidate are found, so no pairs are made.
    Candidates without a baseline are left out.
    """
    side = lambda d, is_base: d.select(*keys, "job", "id", "at", F.lit(is_base).alias("is_base"))
    rows = side(candidates, False).unionByName(side(baselines, True))
    rows = rows.repartition(max(1, -(-rows.count() // TASK_ROWS)), *keys)  # once for all orders, in tasks that don't grow with the tables
    base = F.when(F.col("is_base"), F.struct("at", "id"))

    def near(*by: str) -> list[Column]:
        up = W.partitionBy(*by).orderBy("at", F.desc("is_base"), "id").rowsBetween(W.unboundedPreceding, 0)
        down = W.partitionBy(*by).orderBy(F.desc("at"), F.desc("is_base"), "id").rowsBetween(W.unboundedPreceding, 0)
        return [F.last(base, ignorenulls=True).over(w) for w in (up, down)]

    found = rows.withColumn("own", F.array(*near(*keys, "job"))).withColumn("any", F.array(*near(*keys))).where("not is_base")
    far = lambda c: F.array_min(F.transform(F.array_compact(c), lambda x: F.struct(F.abs(x["at"] - F.col("at")).alias("far"), (-x["id"]).alias("minus"))))
    best = F.coalesce(far(F.col("own")), far(F.col("any")))
    return found.withColumn("best", best).where("best is not null").select(F.col("id").alias("candidate_id"), (-F.col("best.minus")).alias("baseline_id"))


def _in_cells(recordings: DataFrame, window_sec: int) -> DataFrame:
    """The recordings in cells of time, with the rows of the next cell beside them (``own`` is false), placed in order.

    A cell is as long as the longest recording and the window, so all that starts within the window
    of a recording's end stands in its cell or the next: a busy store is many groups.
    """
    longest = recordings.agg(F.max(F.col("ended_sec") - F.col("started_sec"))).first()[0] or 0
    cell = F.floor(F.col("started_sec") / F.lit(max(1, int(window_sec) + int(longest) + 1)))
    places = F.explode(F.array(F.struct(cell.alias("cell"), F.lit(True).alias("own")), F.struct((cell - 1).alias("cell"), F.lit(False).alias("own"))))
    rows = recordings.withColumn("c", places).select("*", "c.cell", "c.own").drop("c")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("tenant_id", "store_id", "cell").orderBy("started_sec", "recording_id")))


def neighbour_pairs(recordings: DataFrame, window_sec: int, k: int) -> DataFrame:
    """Each recording with its next k of the tenant and store that start within the window of its end; the next ones come by the order of the cell, so recordings are dealt once."""
    r = _in_cells(recordings, window_sec)
    w = W.partitionBy("tenant_id", "store_id", "cell").orderBy("started_sec", "recording_id")
    right = F.struct(*[F.col(c).alias(f"right_{c}") for c in ("recording_id", "started_sec", "ended_sec", "agent_id", "customer")])
    r = r.where("tenant_id is not null and store_id is not null and cell is not null")
    near = r.withColumn("near", F.array(*[F.lead(right, i).over(w) for i in range(1, k + 1)])).where("own")
    both = near.withColumn("right", F.explode(F.array_compact("near"))).where(F.col("right.right_started_sec") - F.col("ended_sec") <= window_sec)
    return both.select("*", "right.*").drop("cell", "own", "near", "right")


def crowded_windows(recordings: DataFrame, window_sec: int, k: int) -> DataFrame:
    """Recordings with more than k neighbours within the window: the report of what k leaves out."""
    nxt = F.lead("started_sec", k + 1).over(W.partitionBy("tenant_id", "store_id", "cell").orderBy("started_sec", "recording_id"))
    return _in_cells(recordings, window_sec).withColumn("nxt", nxt).where("own").where(F.col("nxt") - F.col("ended_sec") <= window_sec).select("recording_id", "nxt")


def evaluate_pairs(pairs: DataFrame, window_sec: int = 900, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rule cascade for two recordings of one tenant and store: verdict and confidence; columns of ``keep`` stay, with their twins."""
    twins = [f"{side}{c}" for c in keep for side in ("", "right_")]
    return pair_verdicts(pairs, window_sec, keep=keep).select("recording_id", "right_recording_id", "verdict", "confidence", *twins)


def count_by(rows: DataFrame, *dims: str) -> DataFrame:
    return rows.groupBy(*dims).agg(F.count("*").alias("n"))


def ledger(calls: DataFrame, price_in: int = 3, price_cached: int = 1, price_out: int = 15) -> DataFrame:
    """Usage by model and purpose: a cache hit saves its tokens, others are billed in whole micro-units, rounded up."""
    raw = (F.col("tokens_in") - F.col("tokens_cached")) * price_in + F.col("tokens_cached") * price_cached + F.col("tokens_out") * price_out
    cost = F.when(F.col("cache_hit"), F.lit(0)).otherwise((raw + 9) / F.lit(10))
    billed = F.when(F.col("cache_hit"), 0).otherwise(F.col("tokens_in") + F.col("tokens_out"))
    saved = F.when(F.col("cache_hit"), F.col("tokens_in") + F.col("tokens_out")).otherwise(0)
    return calls.groupBy("model", "purpose").agg(
        F.count("*").alias("calls"), F.sum(billed).alias("billed"), F.sum(saved).alias("saved"), F.sum(F.floor(cost)).alias("cost"),
        F.count_if("failed").alias("failed"), F.max("latency_ms").alias("slowest"),
    )


def speaking_roles(segments: DataFrame, share: float = 0.6) -> DataFrame:
    """Speech of each speaker; of exactly two, the one with the share is the agent, the other the customer."""
    by = segments.groupBy("recording_id", "speaker").agg(F.sum(F.col("end_sec") - F.col("start_sec")).alias("speech"))
    all_ = W.partitionBy("recording_id")
    by = by.withColumn("total", F.sum("speech").over(all_)).withColumn("people", F.count("*").over(all_)).withColumn("most", F.max("speech").over(all_))
    clear = (F.col("people") == 2) & (F.col("most") >= share * F.col("total"))
    role = F.when(clear & (F.col("speech") == F.col("most")), "agent").when(clear, "customer").otherwise("unknown")
    return by.select("recording_id", "speaker", "speech", role.alias("role"))


def scene_profile(segments: DataFrame) -> DataFrame:
    return segments.groupBy("recording_id").agg(
        (F.max("end_sec") - F.min("start_sec")).alias("duration"), F.count("*").alias("segments"), F.count_distinct("speaker").alias("speakers"), F.round(F.avg("vad"), 6).alias("vad")
    )


def speech_profile(segments: DataFrame) -> DataFrame:
    """Span, segments, speakers who are named, mean speech confidence and characters other than white space of each recording."""
    said = F.length(F.regexp_replace("transcript", r"(?U)\s+", ""))
    return segments.groupBy("recording_id").agg(
        F.round(F.greatest(F.lit(0.0), F.coalesce(F.max("end_sec") - F.min("start_sec"), F.lit(0.0))), 3).alias("duration"), F.count("*").alias("segments"),
        F.count_distinct(F.when(F.col("speaker") != "", F.col("speaker"))).alias("speakers"), F.round(F.avg("vad"), 6).alias("vad"), F.coalesce(F.sum(said), F.lit(0)).alias("characters"),
    )


def assigned_speaker(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """Each segment's one turn: that holding its middle (the first), else the longest overlap, else the nearest edge."""
    mid = (F.col("start_sec") + F.col("end_sec")) / 2
    both = segments.join(turns, "recording_id")
    inside = (mid >= F.col("t_start")) & (mid < F.col("t_end"))
    overlap = F.greatest(F.lit(0), F.least("end_sec", "t_end") - F.greatest("start_sec", "t_start"))
    apart = F.least(F.abs(mid - F.col("t_start")), F.abs(mid - F.col("t_end")))
    order = F.struct((~inside).alias("outside"), F.when(~inside, -overlap).otherwise(0).alias("common"), F.when(~inside, apart).otherwise(0).alias("apart"), "t_idx")
    return both.groupBy("segment_id", "recording_id").agg(F.min(order)["t_idx"].alias("t_idx"))


def key_path_share(transitions: DataFrame, keys: list[str], least: float = 0.8) -> DataFrame:
    """The share of transitions on paths (keys, from, to) whose mean confidence is ``least`` or more, at most 1."""
    f = transitions.groupBy(*keys, "from_state", "to_state").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"))
    share = F.sum(F.when(F.col("c") >= least, F.col("n")).otherwise(0)) / F.sum("n")
    return f.groupBy(*keys).agg(F.round(F.least(F.lit(1.0), share), 6).alias("share"))


def speaker_of_segments(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """(segment_id, label): the speaker of the first turn that holds a segment's middle, else of the longest overlap; null without either."""
    mid = (F.col("start_sec") + F.col("end_sec")) / 2
    both = segments.join(turns, "recording_id").where((F.col("end_sec") > F.col("t_start")) & (F.col("start_sec") < F.col("t_end")))
    outside = ~((mid >= F.col("t_start")) & (mid < F.col("t_end")))
    common = F.least("end_sec", "t_end") - F.greatest("start_sec", "t_start")
    best = both.groupBy("segment_id").agg(F.min(F.struct(outside.alias("o"), F.when(outside, -common).otherwise(0).alias("c"), "t_start", "label"))["label"].alias("label"))
    return segments.select("segment_id").join(best, "segment_id", "left")
