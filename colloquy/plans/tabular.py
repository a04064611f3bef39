"""Queries of filters, joins and aggregations."""

from pyspark.sql import functions as F

from colloquy.operators import tabular as op
from colloquy.plans.registry import query

R, S, T, REC = ("recordings",), ("segments",), ("transitions",), ("receptions",)


@query("src1_tenant_scan", R, "SELECT recording_id, store_id, status FROM recordings WHERE tenant_id = 't1'")
def _(t):
    return t.recordings.where("tenant_id = 't1'").select("recording_id", "store_id", "status")


@query("src13_feed_after_cursor", (), "SELECT event_id, user_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def _(t):
    return op.after_cursor(t.events, "event_id", 500, 100).select("event_id", "user_id", "event_type")


@query("flt1_recording_page", R, "SELECT recording_id, store_id, started_sec FROM recordings WHERE store_id IN (1, 2, 3) AND started_sec BETWEEN 1000 AND 500000 ORDER BY started_sec DESC, recording_id DESC LIMIT 50 OFFSET 10")
def _(t):
    return op.recording_page(t.recordings, [1, 2, 3], 1000, 500000, 50, 10).select("recording_id", "store_id", "started_sec")


@query("flt3_reception_slice", REC, "SELECT reception_id, store_id, started_sec FROM receptions WHERE store_id IN (0, 1) AND started_sec >= 3 AND started_sec < 90 AND scenario = 'automotive'")
def _(t):
    return op.reception_slice(t.receptions, [0, 1], "automotive", 3, 90).select("reception_id", "store_id", "started_sec")


@query("flt4_tag_prefix", ("assignments",), "SELECT assignment_id, label_key FROM assignments WHERE starts_with(label_key, 'label1')")
def _(t):
    return t.assignments.where(F.startswith("label_key", F.lit("label1"))).select("assignment_id", "label_key")


@query("flt5_time_filter_keeps_null", ("edges",), "SELECT edge_id, valid_at FROM edges WHERE valid_at IS NULL OR valid_at BETWEEN 100 AND 200")
def _(t):
    return t.edges.where(op.in_window(F.col("valid_at"), 100, 200)).select("edge_id", "valid_at")


@query("flt7_page_with_total", R, "SELECT recording_id, (SELECT count(*) FROM recordings WHERE status = 'F') AS total FROM recordings WHERE status = 'F' ORDER BY recording_id LIMIT 20")
def _(t):
    found = t.recordings.where("status = 'F'")
    return found.orderBy("recording_id").limit(20).crossJoin(F.broadcast(found.agg(F.count("*").alias("total")))).select("recording_id", "total")


@query("flt9_interval_overlap", S, "SELECT segment_id FROM segments WHERE end_sec > 50 AND start_sec < 70")
def _(t):
    return op.overlapping(t.segments, 50, 70).select("segment_id")


@query("join1_tenant_composite", ("transitions", "receptions"), "SELECT t.transition_id, r.store_id FROM transitions t JOIN receptions r ON t.reception_id = r.reception_id AND t.tenant_id = r.tenant_id")
def _(t):
    return t.transitions.join(t.receptions, ["reception_id", "tenant_id"]).select("transition_id", "store_id")


@query("join4_interval_join", ("segments", "recordings"), """
WITH w AS (SELECT recording_id, recording_id % 60 AS w_start, CASE WHEN recording_id % 5 <> 0 THEN recording_id % 60 + 40 END AS w_end FROM recordings)
SELECT s.segment_id, w.w_start FROM segments s JOIN w ON s.recording_id = w.recording_id WHERE s.end_sec > w_start AND s.start_sec < coalesce(w_end, 9999999)""")
def _(t):
    w = t.recordings.selectExpr("recording_id", "recording_id % 60 AS w_start", "CASE WHEN recording_id % 5 <> 0 THEN recording_id % 60 + 40 END AS w_end")
    return op.owned_segments(t.segments, w).select("segment_id", "w_start")


@query("join6_semi", ("recordings", "segments"), "SELECT recording_id FROM recordings WHERE recording_id IN (SELECT recording_id FROM segments WHERE speaker = 'sp1')")
def _(t):
    return t.recordings.join(t.segments.where("speaker = 'sp1'"), "recording_id", "left_semi").select("recording_id")


@query("join7_anti", ("recordings", "segments"), "SELECT recording_id FROM recordings r WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.recording_id = r.recording_id AND s.speaker = 'sp2')")
def _(t):
    return t.recordings.join(t.segments.where("speaker = 'sp2'"), "recording_id", "left_anti").select("recording_id")


@query("join8_anti_tuple", ("assignments",), """
SELECT DISTINCT target_id, label_key FROM assignments a WHERE NOT EXISTS (SELECT 1 FROM assignments b WHERE b.is_manual AND a.target_id = b.target_id AND a.label_key = b.label_key)""")
def _(t):
    keys = ["target_id", "label_key"]
    return t.assignments.join(t.assignments.where("is_manual").select(keys).distinct(), keys, "left_anti").select(keys).distinct()


@query("join10_nearest_baseline", ("predictions",), """
WITH p AS (SELECT (subject_id // 10000) % 100000 AS subject, tag_key, cohort // 4 AS job, side, subject_id AS id, subject_id % 977 AS at_ FROM predictions),
x AS (SELECT c.id AS candidate_id, b.id AS baseline_id, row_number() OVER (PARTITION BY c.id ORDER BY c.job <> b.job, abs(c.at_ - b.at_), b.id DESC) AS k
  FROM p c JOIN p b ON c.subject = b.subject AND c.tag_key = b.tag_key AND c.side = 'candidate' AND b.side = 'base')
SELECT candidate_id, baseline_id FROM x WHERE k = 1""")
def _(t):
    p = t.predictions.selectExpr("(subject_id div 10000) % 100000 AS subject", "tag_key", "cohort div 4 AS job", "side", "subject_id AS id", "subject_id % 977 AS at")
    return op.nearest_baseline(p.where("side = 'candidate'"), p.where("side = 'base'"), ["subject", "tag_key"])


@query("join11_word_to_segment", S, """
WITH t AS (SELECT recording_id, idx AS t_idx, start_sec AS t_start, end_sec AS t_end FROM segments WHERE idx % 2 = 0),
w AS (SELECT segment_id, recording_id, start_sec, end_sec, (start_sec + end_sec) / 2 AS mid FROM segments WHERE idx % 2 = 1),
x AS (SELECT segment_id, w.recording_id, t_idx, (mid >= t_start AND mid < t_end) AS inside, greatest(0, least(end_sec, t_end) - greatest(start_sec, t_start)) AS ov, least(abs(mid - t_start), abs(mid - t_end)) AS far_
  FROM w JOIN t ON w.recording_id = t.recording_id),
y AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY inside DESC, CASE WHEN inside THEN 0 ELSE -ov END, CASE WHEN inside THEN 0 ELSE far_ END, t_idx) AS k FROM x)
SELECT segment_id, recording_id, t_idx FROM y WHERE k = 1""")
def _(t):
    turns = t.segments.where("idx % 2 = 0").selectExpr("recording_id", "idx AS t_idx", "start_sec AS t_start", "end_sec AS t_end")
    return op.assigned_speaker(t.segments.where("idx % 2 = 1"), turns)


@query("join20_neighbour_pairs", R, """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, store_id ORDER BY started_sec, recording_id) AS place FROM recordings)
SELECT a.recording_id, b.recording_id AS right_recording_id FROM r a JOIN r b ON a.tenant_id = b.tenant_id AND a.store_id = b.store_id AND b.place - a.place BETWEEN 1 AND 3
WHERE b.started_sec - a.ended_sec <= 900""")
def _(t):
    return op.neighbour_pairs(t.recordings, 900, 3).select("recording_id", "right_recording_id")


@query("rec1_pair_evaluation", R, """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, store_id ORDER BY started_sec, recording_id) AS place FROM recordings),
p AS (SELECT a.recording_id, b.recording_id AS right_recording_id, b.started_sec - a.ended_sec AS gap, a.customer IS NOT NULL AND b.customer IS NOT NULL AS known,
  coalesce(a.customer = b.customer, false) AS same_c, a.agent_id = b.agent_id AS same_a
  FROM r a JOIN r b ON a.tenant_id = b.tenant_id AND a.store_id = b.store_id AND b.place - a.place BETWEEN 1 AND 3 WHERE b.started_sec - a.ended_sec <= 2000),
q AS (SELECT *, CAST(0.2 AS DOUBLE) + CASE WHEN same_a THEN CAST(0.15 AS DOUBLE) ELSE 0 END + CASE WHEN same_c THEN CAST(0.5 AS DOUBLE) ELSE 0 END AS score FROM p)
SELECT recording_id, right_recording_id,
  CASE WHEN known AND NOT same_c THEN 'reject' WHEN gap < 0 THEN 'needs_review' WHEN gap > 900 THEN 'reject' WHEN same_c THEN 'merge' ELSE 'needs_review' END AS verdict,
  round(CASE WHEN known AND NOT same_c THEN CAST(0.99 AS DOUBLE) WHEN gap < 0 THEN CAST(0.82 AS DOUBLE) WHEN gap > 900 THEN least(CAST(1 AS DOUBLE), CAST(0.75 AS DOUBLE) + gap / CAST(9000 AS DOUBLE))
    WHEN same_c THEN least(CAST(0.97 AS DOUBLE), CAST(0.58 AS DOUBLE) + score * CAST(0.38 AS DOUBLE)) ELSE least(CAST(0.85 AS DOUBLE), CAST(0.48 AS DOUBLE) + score * CAST(0.25 AS DOUBLE)) END, 4) AS confidence FROM q""")
def _(t):
    return op.evaluate_pairs(op.neighbour_pairs(t.recordings, 2000, 3))


@query("rec4_crowded_windows", R, """
WITH x AS (SELECT recording_id, ended_sec, lead(started_sec, 3) OVER (PARTITION BY tenant_id, store_id ORDER BY started_sec, recording_id) AS nxt FROM recordings)
SELECT recording_id, nxt FROM x WHERE nxt - ended_sec <= 20000""")
def _(t):
    return op.crowded_windows(t.recordings, 20000, 2)


@query("rec5_discovery_scan", ("recordings", "segments"), """
SELECT r.recording_id, r.ended_sec - r.started_sec AS duration, count(s.segment_id) AS segments FROM recordings r LEFT JOIN segments s ON s.recording_id = r.recording_id
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id = r.recording_id) GROUP BY r.recording_id, r.ended_sec, r.started_sec""")
def _(t):
    free = t.recordings.join(t.events.select(F.col("event_id").alias("recording_id")), "recording_id", "left_anti")
    n = t.segments.groupBy("recording_id").agg(F.count("*").alias("segments"))
    return free.join(n, "recording_id", "left").select("recording_id", (F.col("ended_sec") - F.col("started_sec")).alias("duration"), F.coalesce("segments", F.lit(0)).alias("segments"))


@query("agg1_stage_transition_flow", ("transitions", "receptions"), """
SELECT from_state, to_state, count(*) AS n, round(avg(confidence), 6) AS confidence, CAST(sum(evidence) AS BIGINT) AS evidence
FROM transitions t JOIN receptions r ON t.reception_id = r.reception_id AND t.tenant_id = r.tenant_id GROUP BY 1, 2""")
def _(t):
    return op.transition_flow(t.transitions, t.receptions)


@query("agg2_state_nodes", T, """
WITH e AS (SELECT from_state AS state, transition_id, reception_id, confidence, 0 AS i, 1 AS o FROM transitions UNION ALL SELECT to_state, transition_id, reception_id, confidence, 1, 0 FROM transitions),
one AS (SELECT state, transition_id, reception_id, confidence, max(i) AS i, max(o) AS o FROM e GROUP BY ALL)
SELECT state, count(DISTINCT reception_id) AS receptions, CAST(sum(i) AS BIGINT) AS incoming, CAST(sum(o) AS BIGINT) AS outgoing, round(avg(confidence), 6) AS confidence FROM one GROUP BY state""")
def _(t):
    return op.state_nodes(t.transitions)


@query("win1_top_reasons", T, """
WITH c AS (SELECT from_state, to_state, reason, count(*) AS n FROM transitions GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY from_state, to_state ORDER BY n DESC, reason) AS rank FROM c)
SELECT from_state, to_state, reason, n, rank FROM k WHERE rank <= 5""")
def _(t):
    return op.top_reasons(t.transitions)


@query("win2_sample_receptions", T, """
WITH d AS (SELECT DISTINCT from_state, to_state, reception_id FROM transitions), k AS (SELECT *, row_number() OVER (PARTITION BY from_state, to_state ORDER BY reception_id) AS rank FROM d)
SELECT * FROM k WHERE rank <= 5""")
def _(t):
    return op.sample_receptions(t.transitions)


@query("agg3_tag_stats", ("assignments",), "SELECT store_id, value, count(*) AS n FROM assignments GROUP BY 1, 2")
def _(t):
    return op.count_by(t.assignments, "store_id", "value")


@query("agg4_owner_tag_stats", ("assignments", "recordings"), "SELECT r.agent_id, a.value, count(*) AS n FROM assignments a JOIN recordings r ON a.target_id = r.recording_id GROUP BY 1, 2")
def _(t):
    r = t.recordings.select(F.col("recording_id").alias("target_id"), "agent_id")
    return op.count_by(t.assignments.drop("agent_id").join(r, "target_id"), "agent_id", "value")


@query("agg22_speaking_roles", S, """
WITH b AS (SELECT recording_id, speaker, CAST(sum(end_sec - start_sec) AS BIGINT) AS speech FROM segments GROUP BY 1, 2),
x AS (SELECT *, sum(speech) OVER w AS total, count(*) OVER w AS people, max(speech) OVER w AS most FROM b WINDOW w AS (PARTITION BY recording_id))
SELECT recording_id, speaker, speech, CASE WHEN people = 2 AND most >= CAST(0.6 AS DOUBLE) * total AND speech = most THEN 'agent' WHEN people = 2 AND most >= CAST(0.6 AS DOUBLE) * total THEN 'customer' ELSE 'unknown' END AS role FROM x""")
def _(t):
    return op.speaking_roles(t.segments)


@query("agg23_duplicate_current", ("assignments",), "SELECT count(*) AS n FROM (SELECT target_id, label_key FROM assignments GROUP BY 1, 2 HAVING count(*) > 1)")
def _(t):
    return op.count_by(t.assignments, "target_id", "label_key").where("n > 1").agg(F.count("*").alias("n"))


@query("agg25_scene_profile", S, "SELECT recording_id, max(end_sec) - min(start_sec) AS duration, count(*) AS segments, count(DISTINCT speaker) AS speakers, round(avg(vad), 6) AS vad FROM segments GROUP BY 1")
def _(t):
    return op.scene_profile(t.segments)


@query("agg32_backlog", R, "SELECT tenant_id, status, count(*) AS n FROM recordings GROUP BY 1, 2")
def _(t):
    return op.count_by(t.recordings, "tenant_id", "status")


@query("agg33_usage_ledger", ("calls",), """
SELECT model, purpose, count(*) AS calls, CAST(sum(CASE WHEN cache_hit THEN 0 ELSE tokens_in + tokens_out END) AS BIGINT) AS billed, CAST(sum(CASE WHEN cache_hit THEN tokens_in + tokens_out ELSE 0 END) AS BIGINT) AS saved,
CAST(sum(CASE WHEN cache_hit THEN 0 ELSE ((tokens_in - tokens_cached) * 3 + tokens_cached + tokens_out * 15 + 9) // 10 END) AS BIGINT) AS cost, count(*) FILTER (failed) AS failed, max(latency_ms) AS slowest FROM calls GROUP BY 1, 2""")
def _(t):
    return op.ledger(t.calls)


@query("win4_latest_per_key", R, "SELECT store_id, recording_id, started_sec FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY started_sec DESC, recording_id DESC) AS k FROM recordings) WHERE k = 1")
def _(t):
    return op.latest(t.recordings.select("store_id", "recording_id", "started_sec"), ["store_id"], ["started_sec", "recording_id"])


@query("set4_snapshot_diff", ("links",), """
WITH o AS (SELECT DISTINCT a AS n FROM links), w AS (SELECT DISTINCT b AS n FROM links)
SELECT n, 'removed' AS change FROM o WHERE n NOT IN (SELECT n FROM w) UNION ALL SELECT n, 'added' FROM w WHERE n NOT IN (SELECT n FROM o)""")
def _(t):
    old, new = t.links.select(F.col("a").alias("n")).distinct(), t.links.select(F.col("b").alias("n")).distinct()
    return old.join(new, "n", "left_anti").withColumn("change", F.lit("removed")).unionByName(new.join(old, "n", "left_anti").withColumn("change", F.lit("added")))
