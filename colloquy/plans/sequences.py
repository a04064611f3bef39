"""Queries over ordered rows."""

from pyspark.sql import functions as F

from colloquy.operators import sequences as op
from colloquy.plans.registry import query

S, FR = ("segments",), ("frames",)
STAGED = """staged AS (SELECT *, coalesce(last_value(CASE WHEN stage <> 'unknown' THEN stage END IGNORE NULLS) OVER w, 'unknown') AS final,
  CASE WHEN stage <> 'unknown' THEN CAST(0.9 AS DOUBLE) WHEN last_value(CASE WHEN stage <> 'unknown' THEN stage END IGNORE NULLS) OVER w IS NOT NULL THEN CAST(0.56 AS DOUBLE) ELSE CAST(0.35 AS DOUBLE) END AS confidence
  FROM segments WINDOW w AS (PARTITION BY recording_id ORDER BY start_sec, end_sec, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
SCORED = STAGED + """, scored AS (SELECT *, lag(segment_id) OVER w IS NULL AS first_, round(least(CAST(1 AS DOUBLE),
  CASE WHEN start_sec - lag(end_sec) OVER w >= 8 THEN CAST(0.55 AS DOUBLE) WHEN start_sec - lag(end_sec) OVER w >= 3 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
  + CASE WHEN final <> lag(final) OVER w THEN CAST(0.25 AS DOUBLE) ELSE 0 END + CASE WHEN speaker <> lag(speaker) OVER w THEN CAST(0.08 AS DOUBLE) ELSE 0 END), 4) AS score
  FROM staged WINDOW w AS (PARTITION BY recording_id ORDER BY start_sec, end_sec, segment_id))"""


@query("win7_carried_stage", S, f"WITH {STAGED} SELECT segment_id, final, confidence FROM staged")
def _(t):
    return op.carried_stage(t.segments).select("segment_id", "final", "confidence")


@query("win8_boundary_scores", S, f"WITH {SCORED} SELECT segment_id, score, first_ OR score >= CAST(0.5 AS DOUBLE) AS cut FROM scored")
def _(t):
    return op.boundary_scores(op.carried_stage(t.segments)).select("segment_id", "score", "cut")


@query("win9_dialogue_units", S, f"""WITH {SCORED},
u AS (SELECT *, CAST(sum(CASE WHEN first_ OR score >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY start_sec, end_sec, segment_id) - 1 AS BIGINT) AS unit FROM scored),
st AS (SELECT recording_id, unit, final, row_number() OVER (PARTITION BY recording_id, unit ORDER BY count(*) DESC, min((start_sec, end_sec, segment_id))) AS k FROM u GROUP BY 1, 2, 3)
SELECT u.recording_id, u.unit, min(start_sec) AS start_sec, max(end_sec) AS end_sec, count(*) AS segments, round(CAST(sum(CAST(confidence AS DECIMAL(10,4))) AS DOUBLE) / count(*) * CAST(0.65 AS DOUBLE) + CAST(sum(CAST(vad AS DECIMAL(10,4))) AS DOUBLE) / count(*) * CAST(0.35 AS DOUBLE), 6) AS confidence, any_value(st.final) AS stage
FROM u JOIN st ON st.recording_id = u.recording_id AND st.unit = u.unit AND k = 1 GROUP BY 1, 2""")
def _(t):
    return op.dialogue_units(t.segments)


@query("win11_transition_label", S, """
WITH o AS (SELECT segment_id, recording_id, CASE stage WHEN 'greeting' THEN 0 WHEN 'needs' THEN 1 WHEN 'offer' THEN 2 END AS now, lag(CASE stage WHEN 'greeting' THEN 0 WHEN 'needs' THEN 1 WHEN 'offer' THEN 2 END) OVER (PARTITION BY recording_id ORDER BY idx, segment_id) AS b FROM segments)
SELECT segment_id, CASE WHEN b IS NULL AND now IS NOT NULL THEN 'start' WHEN b IS NULL OR now IS NULL THEN 'change' WHEN now = b THEN 'stay' WHEN now = b + 1 THEN 'advance' WHEN now > b THEN 'jump' ELSE 'backtrack' END AS label FROM o""")
def _(t):
    from pyspark.sql import Window as W

    place = F.when(F.col("stage") == "greeting", 0).when(F.col("stage") == "needs", 1).when(F.col("stage") == "offer", 2)
    s = t.segments.withColumn("now", place)
    s = s.withColumn("before", F.lag("now").over(W.partitionBy("recording_id").orderBy("idx", "segment_id")))
    return s.select("segment_id", op.transition_label(F.col("before"), F.col("now")).alias("label"))


@query("win12_state_chain", S, """
SELECT recording_id, idx, segment_id, row_number() OVER w - 1 AS sequence_no, lag(coalesce(nullif(stage, 'unknown'), '__unknown__'), 1, '__start__') OVER w AS from_state, coalesce(nullif(stage, 'unknown'), '__unknown__') AS to_state
FROM segments WINDOW w AS (PARTITION BY recording_id ORDER BY idx, segment_id)""")
def _(t):
    s = t.segments.withColumn("state", F.nullif("stage", F.lit("unknown")))
    return op.state_chain(s, "recording_id", ["idx", "segment_id"], "state")


@query("win15_timeline", ("recordings",), """
SELECT recording_id, CAST(coalesce(sum(ended_sec - started_sec + 2) OVER (PARTITION BY store_id ORDER BY recording_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM recordings""")
def _(t):
    return op.timeline(t.recordings.withColumn("length", F.col("ended_sec") - F.col("started_sec")), "store_id", "recording_id", "length", 2).select("recording_id", "at")


@query("win16_packed", S, """
WITH RECURSIVE r AS (SELECT recording_id, idx, tokens, row_number() OVER (PARTITION BY recording_id ORDER BY idx, tokens) AS k FROM segments WHERE tokens > 0),
f AS (SELECT recording_id, idx, tokens, k, CAST(0 AS BIGINT) AS pack, tokens AS used FROM r WHERE k = 1
  UNION ALL SELECT r.recording_id, r.idx, r.tokens, r.k, f.pack + CASE WHEN f.used + r.tokens > 60 THEN 1 ELSE 0 END, CASE WHEN f.used + r.tokens > 60 THEN r.tokens ELSE f.used + r.tokens END FROM f JOIN r ON r.recording_id = f.recording_id AND r.k = f.k + 1)
SELECT recording_id, idx, tokens, pack FROM f""")
def _(t):
    return op.packed(t.segments, 60)


@query("win17_round_robin", ("recordings",), """
SELECT recording_id, store_id, place FROM (SELECT recording_id, store_id, row_number() OVER (PARTITION BY store_id ORDER BY recording_id) AS place FROM recordings) ORDER BY place, store_id LIMIT 100""")
def _(t):
    return op.round_robin(t.recordings, "store_id", "recording_id", 100).select("recording_id", "store_id", "place")


@query("win19_evicted", ("calls",), """
SELECT run_id, model, latency_ms FROM (SELECT *, sum(latency_ms) OVER (PARTITION BY model ORDER BY run_id DESC, tokens_in DESC, tokens_out DESC, latency_ms DESC ROWS UNBOUNDED PRECEDING) AS held FROM calls) WHERE held > 100000""")
def _(t):
    return op.evicted(t.calls, "model", ["run_id", "tokens_in", "tokens_out", "latency_ms"], "latency_ms", 100000).select("run_id", "model", "latency_ms")


@query("ui1_lanes", S, """
WITH e AS (SELECT recording_id, start_sec AS at_, 1 AS d FROM segments UNION ALL SELECT recording_id, end_sec, -1 FROM segments),
o AS (SELECT recording_id, sum(d) OVER (PARTITION BY recording_id ORDER BY at_, d ROWS UNBOUNDED PRECEDING) AS open FROM e) SELECT recording_id, CAST(max(open) AS BIGINT) AS lanes FROM o GROUP BY 1""")
def _(t):
    return op.lanes(t.segments, "recording_id")


@query("st2_frame_events", FR, """
WITH h AS (SELECT *, max(seq) OVER (PARTITION BY session_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM frames),
m AS (SELECT *, max(CASE WHEN high IS NULL OR seq >= high THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, seq ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM h)
SELECT session_id, arrival, seq, CASE WHEN mark = 1 THEN 'duplicate' WHEN seq < high THEN 'out_of_order' WHEN seq - high > 3 THEN 'vad_reset' ELSE 'ok' END AS event FROM m""")
def _(t):
    return op.accepted_frames(t.frames).select("session_id", "arrival", "seq", "event")


@query("st4_paired_by_ordinal", ("frames",), """
WITH a AS (SELECT session_id, arrival, row_number() OVER (PARTITION BY session_id ORDER BY arrival) AS k FROM frames WHERE seq % 2 = 0), b AS (SELECT session_id, arrival, row_number() OVER (PARTITION BY session_id ORDER BY arrival) AS k FROM frames WHERE seq % 2 = 1)
SELECT a.session_id, a.arrival AS closed, b.arrival AS confirmed FROM a JOIN b ON a.session_id = b.session_id AND a.k = b.k""")
def _(t):
    from pyspark.sql import Window as W

    k = F.row_number().over(W.partitionBy("session_id").orderBy("arrival"))
    part = lambda r, n: t.frames.where(F.col("seq") % 2 == r).select("session_id", F.col("arrival").alias(n), k.alias("k"))
    return part(0, "closed").join(part(1, "confirmed"), ["session_id", "k"]).drop("k")


@query("st7_count_batches", FR, """
SELECT session_id, batch, count(*) AS n, max(arrival) AS closed_at FROM (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY arrival) - 1) // 5 AS batch FROM frames) GROUP BY 1, 2""")
def _(t):
    return op.every_nth(t.frames, "session_id", "arrival", 5).groupBy("session_id", "batch").agg(F.count("*").alias("n"), F.max("arrival").alias("closed_at"))


@query("st10_replay_conflicts", FR, "SELECT session_id, seq, count(DISTINCT payload) AS kinds, count(*) AS n FROM frames GROUP BY 1, 2 HAVING count(DISTINCT payload) > 1")
def _(t):
    return op.conflicts(t.frames)


@query("st13_idle_sessions", FR, """
WITH x AS (SELECT *, CASE WHEN arrival - lag(arrival) OVER (PARTITION BY session_id ORDER BY arrival) <= 300 THEN 0 ELSE 1 END AS new_ FROM frames),
y AS (SELECT *, sum(new_) OVER (PARTITION BY session_id ORDER BY arrival) AS session FROM x) SELECT session_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(arrival) AS first, max(arrival) AS last FROM y GROUP BY 1, 2""")
def _(t):
    return op.idle_sessions(t.frames, "session_id", "arrival", 300)


@query("st15_session_statistics", FR, "SELECT session_id, count(*) AS frames, CAST(sum(payload) AS BIGINT) AS bytes, max(seq) AS high FROM frames GROUP BY 1")
def _(t):
    return t.frames.groupBy("session_id").agg(F.count("*").alias("frames"), F.sum("payload").alias("bytes"), F.max("seq").alias("high"))


@query("agg9_trend_weeks", ("assignments",), """
SELECT CAST(extract(isoyear FROM occurred_at) AS BIGINT) AS year, CAST(extract(week FROM occurred_at) AS BIGINT) AS week, label_key, count(*) AS n FROM assignments GROUP BY 1, 2, 3""")
def _(t):
    return t.assignments.groupBy(F.expr("extract(YEAROFWEEK FROM occurred_at)").cast("long").alias("year"), F.weekofyear("occurred_at").cast("long").alias("week"), "label_key").agg(F.count("*").alias("n"))


@query("st14_five_minute_windows", (), """
SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def _(t):
    w = t.events.groupBy(F.window("ts", "5 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")
