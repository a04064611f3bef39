"""Queries of pages, citations, caches, sessions and summaries."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.functions.text import resolved
from colloquy.operators import retrieval, scores, sequences, tabular, tagging
from colloquy.plans.registry import query
from colloquy.plans.texts import masked_sql

S, R, A, P = ("segments",), ("recordings",), ("assignments",), ("predictions",)


@query("flt10_resolved_text", (), f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE coalesce({masked_sql('text')}, '') END AS resolved FROM documents")
def _(t):
    return t.documents.select("doc_id", resolved(F.when(F.col("doc_id") % 3 == 0, ""), F.col("text")).alias("resolved"))


@query("flt15_keyset_page", R, "SELECT recording_id, status FROM recordings WHERE recording_id > 1000 ORDER BY recording_id LIMIT 50")
def _(t):
    return t.recordings.where("recording_id > 1000").orderBy("recording_id").limit(50).select("recording_id", "status")


@query("join3_four_way", ("assignments", "segments", "recordings", "predictions"), """
SELECT a.assignment_id, r.store_id, p.tag_key FROM assignments a JOIN segments s ON a.assignment_id = s.segment_id AND a.target_id = s.recording_id % 2000 JOIN recordings r ON r.recording_id = s.recording_id JOIN predictions p ON p.subject_id = s.segment_id AND p.expected = p.predicted""")
def _(t):
    a = t.assignments.select("assignment_id", F.col("assignment_id").alias("segment_id"), "target_id")
    s = t.segments.select("segment_id", "recording_id", (F.col("recording_id") % 2000).alias("target_id"))
    p = t.predictions.where("expected = predicted").select(F.col("subject_id").alias("segment_id"), "tag_key")
    return a.join(s, ["segment_id", "target_id"]).join(t.recordings.select("recording_id", "store_id"), "recording_id").join(p, "segment_id").select("assignment_id", "store_id", "tag_key")


@query("join12_overlap_speaker", S, """
WITH d AS (SELECT recording_id, speaker AS label, start_sec AS a, end_sec AS b FROM segments WHERE idx % 2 = 0), o AS (SELECT segment_id, label, a, (start_sec + end_sec) / 2.0::DOUBLE >= a AND (start_sec + end_sec) / 2.0::DOUBLE < b AS i, least(end_sec, b) - greatest(start_sec, a) AS ov FROM segments s JOIN d ON s.recording_id = d.recording_id WHERE idx % 2 = 1 AND end_sec > a AND start_sec < b),
k AS (SELECT segment_id, label FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY i DESC, CASE WHEN i THEN 0 ELSE -ov END, a, label) AS k FROM o) WHERE k = 1)
SELECT s.segment_id, label FROM segments s LEFT JOIN k ON k.segment_id = s.segment_id WHERE idx % 2 = 1""")
def _(t):
    turns = t.segments.where("idx % 2 = 0").select("recording_id", F.col("speaker").alias("label"), F.col("start_sec").alias("t_start"), F.col("end_sec").alias("t_end"))
    return tabular.speaker_of_segments(t.segments.where("idx % 2 = 1"), turns)


@query("ret1_vector_to_chunk", ("vectors", "turns"), """
WITH q AS (SELECT embedding::DOUBLE[] AS q FROM vectors WHERE vec_id = 5), k AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM vectors, q ORDER BY s DESC, vec_id LIMIT 40)
SELECT vec_id, turn, left(text, 200) AS snippet FROM k JOIN turns ON conv_id = vec_id""")
def _(t):
    q = t.vectors.where("vec_id = 5").first().embedding
    top = retrieval.top_k(t.vectors, q, 40).select("vec_id")
    return top.join(t.turns.withColumnRenamed("conv_id", "vec_id"), "vec_id").select("vec_id", "turn", F.left("text", F.lit(200)).alias("snippet"))


@query("ret11_exact_cache", ("calls",), "SELECT model, purpose, run_id, tokens_in FROM calls WHERE cache_hit AND NOT failed AND run_id = 77")
def _(t):
    return t.calls.where("cache_hit and not failed and run_id = 77").select("model", "purpose", "run_id", "tokens_in")


@query("agg14_evidence_samples", ("transitions",), """
WITH r AS (SELECT from_state, to_state, transition_id, evidence, row_number() OVER (PARTITION BY from_state, to_state ORDER BY evidence DESC, transition_id) AS k FROM transitions) SELECT from_state, to_state, transition_id, evidence FROM r WHERE k <= 5""")
def _(t):
    w = W.partitionBy("from_state", "to_state").orderBy(F.desc("evidence"), "transition_id")
    return t.transitions.withColumn("k", F.row_number().over(w)).where("k <= 5").select("from_state", "to_state", "transition_id", "evidence")


@query("agg27_storage", ("documents",), "SELECT source, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


@query("agg35_latency_histogram", ("calls",), "SELECT model, least(latency_ms // 100, 6) AS bucket, count(*) AS n FROM calls GROUP BY 1, 2")
def _(t):
    return t.calls.groupBy("model", F.least(F.expr("latency_ms div 100"), F.lit(6)).alias("bucket")).agg(F.count("*").alias("n"))


@query("tag6_rule_bundle", ("turns",), """
WITH r AS (SELECT 1 AS rule, 'pair' AS tag, 0.8::DOUBLE AS c, (contains(lower(text), 'the ') OR contains(lower(text), 'of ')) AND contains(lower(text), 'and') AND NOT contains(lower(text), 'trash') AS hit, conv_id, turn FROM turns
UNION ALL SELECT 2, 'pair', 0.9::DOUBLE, contains(lower(text), 'tion') AND NOT contains(lower(text), 'and'), conv_id, turn FROM turns UNION ALL SELECT 3, 'any', 0.5::DOUBLE, contains(lower(text), 'er'), conv_id, turn FROM turns),
b AS (SELECT conv_id, tag, rule, max(c) AS c, string_agg(CAST(turn AS STRING), ',' ORDER BY turn) AS e FROM r WHERE hit GROUP BY 1, 2, 3) SELECT conv_id, tag, rule, c AS confidence, e AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, tag ORDER BY c DESC, rule) AS k FROM b) WHERE k = 1""")
def _(t):
    rows = [(1, "pair", ["the ", "of "], ["and"], ["trash"], 0.8), (2, "pair", [], ["tion"], ["and"], 0.9), (3, "any", ["er"], [], [], 0.5)]
    rules = t.turns.sparkSession.createDataFrame(rows, "rule int, tag string, any array<string>, all array<string>, none array<string>, confidence double")
    found = tagging.rule_bundle(t.turns.withColumnRenamed("turn", "segment"), rules, ["conv_id"])
    return found.withColumn("evidence", F.array_join(F.transform("evidence", lambda x: x.cast("string")), ","))


@query("tag7_hybrid_short_circuit", A, "SELECT target_id, bool_and(coalesce(confidence, 0) >= 0.3::DOUBLE) AND NOT bool_or(value = 'v3') AS done FROM assignments WHERE group_key = 'rules' GROUP BY 1")
def _(t):
    ok = F.bool_and(F.coalesce("confidence", F.lit(0.0)) >= 0.3) & ~F.bool_or(F.col("value") == "v3")
    return t.assignments.where("group_key = 'rules'").groupBy("target_id").agg(ok.alias("done"))


@query("tag11_fact_history", A, "SELECT assignment_id, value FROM assignments WHERE target_id = 7 AND label_key = 'label1' ORDER BY assignment_id")
def _(t):
    return t.assignments.where("target_id = 7 and label_key = 'label1'").orderBy("assignment_id").select("assignment_id", "value")


@query("tag13_invalidation", A, "WITH c AS (SELECT DISTINCT target_id FROM assignments WHERE value = 'v2') SELECT 'stays' AS what, assignment_id AS id FROM assignments WHERE target_id NOT IN (SELECT target_id FROM c) UNION ALL SELECT 'again', target_id FROM c")
def _(t):
    stays, again = tagging.invalidated(t.assignments, t.assignments.where("value = 'v2'"), ["target_id"])
    return stays.select(F.lit("stays").alias("what"), F.col("assignment_id").alias("id")).unionByName(again.select(F.lit("again").alias("what"), F.col("target_id").alias("id")))


@query("tag14_patch_eligibility", A, "SELECT label_key, value, count(*) AS support FROM assignments GROUP BY 1, 2 HAVING count(*) >= 30 ORDER BY support DESC, 1, 2 LIMIT 5")
def _(t):
    return t.assignments.groupBy("label_key", "value").agg(F.count("*").alias("support")).where("support >= 30").orderBy(F.desc("support"), "label_key", "value").limit(5)


@query("ev17_wilson_bound", P, "SELECT cohort, round(greatest(0::DOUBLE, (h / n + 1.959963984540054::DOUBLE ** 2 / (2 * n) - 1.959963984540054::DOUBLE * sqrt((h / n * (1 - h / n) + 1.959963984540054::DOUBLE ** 2 / (4 * n)) / n)) / (1 + 1.959963984540054::DOUBLE ** 2 / n)), 6) AS bound FROM (SELECT cohort, CAST(count(*) FILTER (expected = predicted) AS DOUBLE) AS h, CAST(count(*) AS DOUBLE) AS n FROM predictions GROUP BY 1)")
def _(t):
    g = t.predictions.groupBy("cohort").agg(F.count_if(F.col("expected") == F.col("predicted")).cast("double").alias("h"), F.count("*").cast("double").alias("n"))
    return g.select("cohort", F.round(scores.wilson(F.col("h"), F.col("n")), 6).alias("bound"))


@query("ev25_audit_completeness", P, "SELECT subject_id // 1000000000000 AS bundle, count(DISTINCT tag_key) = 4 AND count(DISTINCT probability) = 1 AS complete FROM predictions GROUP BY 1")
def _(t):
    g = t.predictions.groupBy(F.expr("subject_id div 1000000000000").alias("bundle"))
    return g.agg(((F.count_distinct("tag_key") == 4) & (F.count_distinct("probability") == 1)).alias("complete"))


@query("ui5_events_per_reception", ("transitions",), "SELECT from_state, round(count(*) / CAST(count(DISTINCT reception_id) AS DOUBLE), 6) AS per_reception FROM transitions GROUP BY 1")
def _(t):
    return t.transitions.groupBy("from_state").agg(F.round(F.try_divide(F.count("*"), F.count_distinct("reception_id")), 6).alias("per_reception"))


@query("st11_receipts_once", ("frames",), "SELECT session_id, seq, min(arrival) AS arrival FROM frames GROUP BY 1, 2")
def _(t):
    return t.frames.groupBy("session_id", "seq").agg(F.min("arrival").alias("arrival"))


@query("st12_session_state", ("frames",), """
WITH RECURSIVE e AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY arrival) AS k, CASE WHEN seq < 4 THEN ['start', 'frame', 'finish', 'commit'][seq + 1] WHEN seq = 4 THEN 'committed' WHEN seq = 49 THEN 'lost' WHEN seq = 48 AND payload % 3 = 0 THEN 'error' ELSE 'frame' END AS e FROM frames),
f AS (SELECT session_id, CAST(0 AS BIGINT) AS k, 'created' AS s, CAST(0 AS BIGINT) AS n FROM (SELECT DISTINCT session_id FROM e)
 UNION ALL SELECT f.session_id, e.k, CASE WHEN e = 'start' AND s = 'created' THEN 'active' WHEN e = 'finish' AND s IN ('created', 'active') THEN 'draining' WHEN e = 'commit' AND s = 'draining' THEN 'committing' WHEN e = 'committed' AND s = 'committing' THEN 'closed' WHEN e = 'lost' AND s IN ('active', 'draining') THEN 'incomplete' WHEN e = 'error' AND s IN ('created', 'active', 'draining', 'committing') THEN 'failed' ELSE s END,
  n + CASE WHEN (e = 'start' AND s = 'created') OR (e = 'finish' AND s IN ('created', 'active')) OR (e = 'commit' AND s = 'draining') OR (e = 'committed' AND s = 'committing') OR (e = 'lost' AND s IN ('active', 'draining')) OR (e = 'error' AND s IN ('created', 'active', 'draining', 'committing')) THEN 1 ELSE 0 END FROM f JOIN e ON e.session_id = f.session_id AND e.k = f.k + 1)
SELECT session_id, max_by(s, k) AS state, max(n) AS changes FROM f GROUP BY 1""")
def _(t):
    names = F.array(*[F.lit(x) for x in ("start", "frame", "finish", "commit", "committed")])
    rare = F.when(F.col("seq") == 49, "lost").when((F.col("seq") == 48) & (F.col("payload") % 3 == 0), "error").otherwise("frame")
    event = F.when(F.col("seq") <= 4, F.get(names, F.col("seq").cast("int"))).otherwise(rare)
    return sequences.session_states(t.frames.withColumn("event", event), "session_id", "arrival", "event")


@query("st7_debounced_batches", ("frames",), """
WITH RECURSIVE e AS (SELECT session_id, arrival, arrival // 2 AS at_ms, row_number() OVER (PARTITION BY session_id ORDER BY arrival) AS k FROM frames),
f AS (SELECT session_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS size, CAST(NULL AS BIGINT) AS closed, CAST(0 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS mine FROM (SELECT DISTINCT session_id FROM e)
 UNION ALL SELECT f.session_id, e.k, CASE WHEN size + 1 >= 5 AND (closed IS NULL OR at_ms - closed >= 500) THEN 0 ELSE size + 1 END, CASE WHEN size + 1 >= 5 AND (closed IS NULL OR at_ms - closed >= 500) THEN at_ms ELSE closed END, CASE WHEN size + 1 >= 5 AND (closed IS NULL OR at_ms - closed >= 500) THEN batch + 1 ELSE batch END, batch FROM f JOIN e ON e.session_id = f.session_id AND e.k = f.k + 1)
SELECT session_id, mine AS batch, count(*) AS size FROM f WHERE k > 0 GROUP BY 1, 2""")
def _(t):
    return sequences.debounced_batches(t.frames.withColumn("at_ms", F.expr("arrival div 2")), "session_id", "arrival", "at_ms").select("session_id", "batch", "size")
