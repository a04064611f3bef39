"""Queries of visits and the remaining joins, windows and graph views."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.operators import browse, graphs, pairs, receptions as op, retrieval, scores, sequences, tabular, tagging
from colloquy.plans.registry import query

S, R, A, E, T = ("segments",), ("recordings",), ("assignments",), ("edges",), ("transitions",)


@query("rec2_visits", R)
def _(t):
    """Visits from all pairs within 15 minutes; every fifth customer's neighbours are split by hand, every thirteenth recording names its visit."""
    r = t.recordings.withColumn("explicit", F.when(F.col("recording_id") % 13 == 0, F.concat_ws("-", "tenant_id", "store_id", F.expr("started_sec div 3600"))))
    near = pairs.judged_pairs(t.recordings, window_sec=900, names=(), keep=("started_sec", "customer")).drop("reasons")
    split = F.coalesce(F.col("customer") % 5 == 0, F.lit(False))
    # two known customers are never mixed, so nobody need part them, and a pair that is parted itself is never united
    splits = near.where(split & F.coalesce(F.col("customer") == F.col("right_customer"), F.lit(True))).select(F.col("recording_id").alias("a"), F.col("right_recording_id").alias("b"))
    return op.grouped(r, near.where(~split), splits)


@query("rec3_manual_constraints", R, """
WITH p AS (SELECT recording_id, recording_id + 1 AS right_recording_id, 'needs_review' AS verdict FROM recordings), c AS (SELECT recording_id AS a, recording_id + 1 AS b, CASE WHEN recording_id % 3 = 0 THEN 1 ELSE 0 END AS s FROM recordings WHERE recording_id % 2 = 0)
SELECT recording_id, right_recording_id, CASE WHEN s = 1 THEN 'reject' WHEN s = 0 THEN 'merge' ELSE verdict END AS verdict FROM p LEFT JOIN c ON a = recording_id AND b = right_recording_id""")
def _(t):
    p = t.recordings.selectExpr("recording_id", "recording_id + 1 AS right_recording_id", "'needs_review' AS verdict")
    c = t.recordings.where("recording_id % 2 = 0").selectExpr("recording_id + 1 AS a", "recording_id AS b", "CASE WHEN recording_id % 3 = 0 THEN 'force_split' ELSE 'force_merge' END AS mode")
    both = c.unionByName(c.where("mode = 'force_split'").selectExpr("a", "b", "'force_merge' AS mode"))
    return op.constrained(p, both)


@query("rec6_timeline_mapping", ("segments", "recordings"), """
WITH w AS (SELECT recording_id, recording_id % 60 AS ws, recording_id % 60 + 40 AS we, recording_id % 900 AS ts FROM recordings)
SELECT segment_id, greatest(start_sec, ws) + ts - ws AS start, least(end_sec, we) + ts - ws AS end FROM segments s JOIN w ON s.recording_id = w.recording_id WHERE end_sec > ws AND start_sec < we""")
def _(t):
    w = t.recordings.selectExpr("recording_id", "recording_id % 60 AS w_start", "recording_id % 60 + 40 AS w_end", "recording_id % 900 AS t_start")
    return op.on_timeline(tabular.owned_segments(t.segments, w))


@query("rec8_evidence_clipping", S, """
WITH e AS (SELECT segment_id AS evidence_id, CASE WHEN tokens % 5 <> 0 THEN start_sec * 1000 END AS a, CASE WHEN tokens % 5 <> 0 THEN end_sec * 1000 END AS b, CAST(start_sec AS DOUBLE) AS sa, CAST(end_sec AS DOUBLE) + 3 AS sb FROM segments)
SELECT evidence_id, CASE WHEN a IS NOT NULL THEN greatest(a, 50000) END AS start_ms, CASE WHEN a IS NOT NULL THEN least(b, 70000) END AS end_ms, round(CASE WHEN a IS NULL THEN sa ELSE sa + (greatest(a, 50000) - a) * ((sb - sa) / (b - a)) END, 3) AS source_start FROM e WHERE a IS NULL OR (b > 50000 AND a < 70000)""")
def _(t):
    e = t.segments.selectExpr("segment_id AS evidence_id", "CASE WHEN tokens % 5 <> 0 THEN start_sec * 1000 END AS start_ms", "CASE WHEN tokens % 5 <> 0 THEN end_sec * 1000 END AS end_ms", "CAST(start_sec AS DOUBLE) AS source_start", "CAST(end_sec AS DOUBLE) + 3 AS source_end")
    return op.clipped_evidence(e, 50000, 70000)


@query("win14_split_points", S, """
WITH x AS (SELECT *, CASE WHEN stage = 'greeting' AND lag(segment_id) OVER w IS NOT NULL THEN 1 ELSE 0 END AS g, CASE WHEN start_sec - lag(end_sec) OVER w >= 45 THEN 1 ELSE 0 END AS p, CASE WHEN speaker <> lag(speaker) OVER w THEN 1 ELSE 0 END AS c FROM segments WINDOW w AS (PARTITION BY recording_id ORDER BY start_sec, end_sec, segment_id))
SELECT recording_id, segment_id, round(g * 0.34::DOUBLE + p * 0.36::DOUBLE + c * 0.45::DOUBLE, 4) AS score FROM x WHERE g + p + c >= 2 AND round(g * 0.34::DOUBLE + p * 0.36::DOUBLE + c * 0.45::DOUBLE, 4) >= 0.7::DOUBLE""")
def _(t):
    return op.split_points(t.segments)


@query("rec10_split_units", S, "SELECT recording_id, segment_id, start_sec, CASE WHEN start_sec < 50 AND end_sec > 50 THEN 50 ELSE end_sec END AS end_sec FROM segments UNION ALL SELECT recording_id, segment_id, 50, end_sec FROM segments WHERE start_sec < 50 AND end_sec > 50")
def _(t):
    return op.split_units(t.segments, F.lit(50).cast("long"))


@query("rec10_reconciled_tags", A, "SELECT target_id AS unit_id, label_key, max_by(value, (is_manual, priority, coalesce(confidence, -1), assignment_id)) AS value, count(DISTINCT value) > 1 AS conflict FROM assignments GROUP BY 1, 2")
def _(t):
    return op.reconciled(t.assignments.withColumnRenamed("target_id", "unit_id").withColumnRenamed("is_manual", "is_current"))


#: Greedy matching of at most three reference speakers, then frames between neighbouring bounds.
_ROUNDS = ", ".join(f"""m{i} AS (SELECT recording_id, r, h FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY ov DESC, r, h) AS k FROM o{i}) WHERE k = 1),
o{i + 1} AS (SELECT o.* FROM o{i} o JOIN m{i} m ON o.recording_id = m.recording_id WHERE o.r <> m.r AND o.h <> m.h)""" for i in (1, 2, 3))


@query("ev6_diarization_error", S, f"""
WITH r0 AS (SELECT recording_id, speaker, CAST(start_sec AS DOUBLE) AS a, CAST(end_sec AS DOUBLE) AS b FROM segments WHERE end_sec > start_sec),
h0 AS (SELECT * FROM (SELECT recording_id, CASE WHEN tokens % 9 = 0 THEN 'other' ELSE speaker END AS speaker, CAST(start_sec AS DOUBLE) AS a, CAST(end_sec - tokens % 3 AS DOUBLE) AS b FROM segments) WHERE b > a),
n AS (SELECT recording_id, CAST(ceil(max(b) / 0.01::DOUBLE) AS BIGINT) AS n FROM (SELECT * FROM r0 UNION ALL SELECT * FROM h0) GROUP BY 1),
rf AS (SELECT recording_id, speaker, CAST(floor(greatest(0.0::DOUBLE, a - 0.25::DOUBLE) / 0.01::DOUBLE) AS BIGINT) AS f, least(n, CAST(floor(least(n * 0.01::DOUBLE, b + 0.25::DOUBLE) / 0.01::DOUBLE) AS BIGINT) + 1) AS g FROM r0 JOIN n USING (recording_id)),
hf AS (SELECT recording_id, speaker, CAST(floor(a / 0.01::DOUBLE) AS BIGINT) AS f, least(n, CAST(floor(least(n * 0.01::DOUBLE, b) / 0.01::DOUBLE) AS BIGINT) + 1) AS g FROM h0 JOIN n USING (recording_id)),
ru AS (SELECT DISTINCT recording_id, speaker FROM r0), hu AS (SELECT DISTINCT recording_id, speaker FROM h0),
t AS (SELECT recording_id, x AS a, lead(x) OVER (PARTITION BY recording_id ORDER BY x) AS b FROM (SELECT recording_id, a AS x FROM r0 UNION SELECT recording_id, b FROM r0 UNION SELECT recording_id, a FROM h0 UNION SELECT recording_id, b FROM h0)),
tr AS (SELECT DISTINCT t.recording_id, t.a, t.b, speaker FROM t JOIN r0 ON r0.recording_id = t.recording_id AND r0.a <= t.a AND r0.b >= t.b), th AS (SELECT DISTINCT t.recording_id, t.a, t.b, speaker FROM t JOIN h0 ON h0.recording_id = t.recording_id AND h0.a <= t.a AND h0.b >= t.b),
ov AS (SELECT tr.recording_id, tr.speaker AS r, th.speaker AS h, sum(tr.b - tr.a) AS ov FROM tr JOIN th ON tr.recording_id = th.recording_id AND tr.a = th.a GROUP BY 1, 2, 3),
o1 AS (SELECT ru.recording_id, ru.speaker AS r, hu.speaker AS h, coalesce(ov, 0) AS ov FROM ru JOIN hu ON ru.recording_id = hu.recording_id LEFT JOIN ov ON ov.recording_id = ru.recording_id AND ov.r = ru.speaker AND ov.h = hu.speaker),
{_ROUNDS},
m AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3),
hm AS (SELECT hf.recording_id, coalesce(m.r, '~' || speaker) AS speaker, f, g FROM hf LEFT JOIN m ON m.recording_id = hf.recording_id AND m.h = speaker),
i AS (SELECT recording_id, x AS f, lead(x) OVER (PARTITION BY recording_id ORDER BY x) AS g FROM (SELECT recording_id, f AS x FROM rf UNION SELECT recording_id, g FROM rf UNION SELECT recording_id, f FROM hm UNION SELECT recording_id, g FROM hm)),
ri AS (SELECT i.recording_id, i.f, list_sort(list(DISTINCT speaker)) AS s FROM i JOIN rf ON rf.recording_id = i.recording_id AND rf.f <= i.f AND rf.g >= i.g GROUP BY 1, 2), hi AS (SELECT i.recording_id, i.f, list_sort(list(DISTINCT speaker)) AS s FROM i JOIN hm ON hm.recording_id = i.recording_id AND hm.f <= i.f AND hm.g >= i.g GROUP BY 1, 2),
z AS (SELECT i.recording_id, i.g - i.f AS n, ri.s AS r, hi.s AS h FROM i LEFT JOIN ri ON ri.recording_id = i.recording_id AND ri.f = i.f LEFT JOIN hi ON hi.recording_id = i.recording_id AND hi.f = i.f WHERE i.g IS NOT NULL),
e AS (SELECT recording_id, coalesce(sum(n) FILTER (r IS NOT NULL AND h IS NULL), 0) AS missed, coalesce(sum(n) FILTER (r IS NULL AND h IS NOT NULL), 0) AS false_alarm, coalesce(sum(n) FILTER (r <> h), 0) AS confused, sum(n) FILTER (r IS NOT NULL) AS total FROM z GROUP BY 1)
SELECT recording_id, CAST(missed AS BIGINT) AS missed, CAST(false_alarm AS BIGINT) AS false_alarm, CAST(confused AS BIGINT) AS confused, round((missed + false_alarm + confused) / CAST(total AS DOUBLE), 6) AS rate FROM e""")
def _(t):
    hyp = t.segments.withColumn("speaker", F.when(F.col("tokens") % 9 == 0, "other").otherwise(F.col("speaker"))).withColumn("end_sec", F.col("end_sec") - F.col("tokens") % 3)
    return op.error_rate(t.segments, hyp)


@query("rec11_transition_page", T, "SELECT transition_id, sequence_no, to_state FROM transitions WHERE reception_id = 7 ORDER BY sequence_no, transition_id LIMIT 20 OFFSET 10")
def _(t):
    return t.transitions.where("reception_id = 7").orderBy("sequence_no", "transition_id").offset(10).limit(20).select("transition_id", "sequence_no", "to_state")


@query("rec14_evidence_speakers", S, "SELECT recording_id, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS speakers FROM segments GROUP BY 1")
def _(t):
    return t.segments.groupBy("recording_id").agg(F.array_join(F.array_sort(F.collect_set("speaker")), ",").alias("speakers"))


@query("flt6_nulls_last", E, "SELECT edge_id, valid_at FROM edges ORDER BY valid_at ASC NULLS LAST, edge_id LIMIT 40 OFFSET 30")
def _(t):
    return t.edges.orderBy(F.asc_nulls_last("valid_at"), "edge_id").offset(30).limit(40).select("edge_id", "valid_at")


@query("flt8_truncation_probe", T, "SELECT count(*) > 100 AS truncated FROM transitions WHERE reception_id = 7")
def _(t):
    return t.transitions.where("reception_id = 7").limit(101).agg((F.count("*") > 100).alias("truncated"))


@query("flt14_retention_candidates", R, "SELECT recording_id, started_sec FROM recordings WHERE status IN ('F', 'P') AND started_sec < 400000 ORDER BY started_sec, recording_id LIMIT 100")
def _(t):
    return t.recordings.where("status in ('F', 'P') and started_sec < 400000").orderBy("started_sec", "recording_id").limit(100).select("recording_id", "started_sec")


@query("join2_three_way", ("assignments", "segments", "recordings"), "SELECT a.assignment_id, s.segment_id, r.store_id FROM assignments a JOIN segments s ON a.assignment_id = s.segment_id JOIN recordings r ON r.recording_id = s.recording_id WHERE a.is_manual")
def _(t):
    a = t.assignments.where("is_manual").select("assignment_id", F.col("assignment_id").alias("segment_id"))
    return a.join(t.segments.select("segment_id", "recording_id"), "segment_id").join(t.recordings.select("recording_id", "store_id"), "recording_id").select("assignment_id", "segment_id", "store_id")


@query("join5_unowned_evidence", ("segments", "recordings"), """
SELECT segment_id FROM segments s WHERE NOT EXISTS (SELECT 1 FROM recordings r WHERE r.recording_id = s.recording_id AND r.recording_id % 3 = 0 AND s.end_sec > 30 AND s.start_sec < 90)""")
def _(t):
    w = t.recordings.where("recording_id % 3 = 0").select("recording_id", F.lit(30).alias("w_start"), F.lit(90).alias("w_end"))
    return t.segments.join(tabular.owned_segments(t.segments, w).select("segment_id").distinct(), "segment_id", "left_anti").select("segment_id")


@query("join16_community_overlap", ("mentions",), """
WITH m AS (SELECT DISTINCT name, recording_id % 40 AS c, recording_id % 2 AS side FROM mentions) SELECT a.c AS old, b.c AS new, count(*) AS shared FROM m a JOIN m b USING (name) WHERE a.side = 0 AND b.side = 1 GROUP BY 1, 2""")
def _(t):
    m = t.mentions.selectExpr("name", "recording_id % 40 AS c", "recording_id % 2 AS side").distinct()
    return m.where("side = 0").select("name", F.col("c").alias("old")).join(m.where("side = 1").select("name", F.col("c").alias("new")), "name").groupBy("old", "new").agg(F.count("*").alias("shared"))


@query("join17_last_link_wins", S, "SELECT recording_id, idx % 2 AS label, max_by(speaker, segment_id) AS speaker FROM segments GROUP BY 1, 2")
def _(t):
    return t.segments.groupBy("recording_id", (F.col("idx") % 2).alias("label")).agg(F.max_by("speaker", "segment_id").alias("speaker"))


@query("join18_reverse_provenance", ("mentions", "relations"), """
SELECT m.source_id, max_by(r.relation, (r.rank, r.position)) AS relation FROM mentions m JOIN relations r ON m.name = r.source AND m.recording_id = r.recording_id GROUP BY 1""")
def _(t):
    m = t.mentions.select("source_id", F.col("name").alias("source"), "recording_id")
    return m.join(t.relations.drop("source_id"), ["source", "recording_id"]).groupBy("source_id").agg(F.max_by("relation", F.struct("rank", "position")).alias("relation"))


@query("join21_full_outer_buckets", ("calls",), """
WITH a AS (SELECT tokens_out % 50 AS b, count(*) AS n FROM calls WHERE model = 'm1' GROUP BY 1), c AS (SELECT tokens_out % 70 AS b, count(*) AS n FROM calls WHERE model = 'm2' GROUP BY 1) SELECT coalesce(a.b, c.b) AS bucket, coalesce(a.n, 0) AS l, coalesce(c.n, 0) AS r FROM a FULL JOIN c ON a.b = c.b""")
def _(t):
    side = lambda m, k, n: t.calls.where(F.col("model") == m).groupBy((F.col("tokens_out") % k).alias("bucket")).agg(F.count("*").alias(n))
    return side("m1", 50, "l").join(side("m2", 70, "r"), "bucket", "full_outer").fillna(0, ["l", "r"])


@query("agg24_inverse_probability", ("predictions",), "SELECT cohort, round(sum(1 / probability), 6) AS weight, round(sum(1 / probability) ** 2 / sum(1 / probability ** 2), 6) AS ess FROM predictions WHERE probability > 0 GROUP BY 1")
def _(t):
    w = 1 / F.col("probability")
    return t.predictions.where("probability > 0").groupBy("cohort").agg(F.round(F.sum(w), 6).alias("weight"), F.round(F.pow(F.sum(w), 2) / F.sum(w * w), 6).alias("ess"))


@query("agg26_budget_utilisation", ("calls",), """
WITH u AS (SELECT model, greatest(sum(tokens_in) / CAST(50000000 AS DOUBLE), count(*) / CAST(15000 AS DOUBLE)) AS u FROM calls GROUP BY 1) SELECT model, round(u, 6) AS used, CASE WHEN u >= 1 THEN 'exhausted' WHEN u >= 0.9::DOUBLE THEN 'near' ELSE 'ok' END AS state FROM u""")
def _(t):
    u = t.calls.groupBy("model").agg(F.greatest(F.sum("tokens_in") / 50000000, F.count("*") / 15000).alias("u"))
    return u.select("model", F.round("u", 6).alias("used"), F.when(F.col("u") >= 1, "exhausted").when(F.col("u") >= 0.9, "near").otherwise("ok").alias("state"))


@query("agg28_readiness", ("predictions",), """
SELECT tag_key, count(*) FILTER (side = 'base') AS gold, count(*) FILTER (side <> 'base') AS silver, count(*) FILTER (side = 'base') >= 200 AND count(*) FILTER (side <> 'base') >= 30 AS ready FROM predictions GROUP BY 1""")
def _(t):
    g = t.predictions.groupBy("tag_key").agg(F.count_if(F.col("side") == "base").alias("gold"), F.count_if(F.col("side") != "base").alias("silver"))
    return g.withColumn("ready", (F.col("gold") >= 200) & (F.col("silver") >= 30))


@query("agg29_corpus_fingerprint", A, "SELECT count(*) AS n, coalesce(max(assignment_id), 0) AS top, CAST(coalesce(sum(priority), 0) AS BIGINT) AS total FROM assignments")
def _(t):
    return t.assignments.agg(F.count("*").alias("n"), F.coalesce(F.max("assignment_id"), F.lit(0)).alias("top"), F.coalesce(F.sum("priority"), F.lit(0)).alias("total"))


@query("agg30_badcase_clusters", ("predictions",), """
WITH c AS (SELECT subject_id AS id, CASE cohort % 4 WHEN 0 THEN 'asr' WHEN 1 THEN 'tagger' WHEN 2 THEN 'review' ELSE 'ingest' END AS stage, tag_key, coalesce(predicted, 'none') AS reason, CASE WHEN subject_id % 7 = 0 THEN 'known' END AS cluster_key, subject_id % 3 AS occurrences FROM predictions WHERE predicted IS NULL OR predicted <> expected)
SELECT coalesce(cluster_key, concat_ws(':', stage, tag_key, reason)) AS cluster, CAST(sum(greatest(1, occurrences)) AS BIGINT) AS weight, count(*) AS cases, count(DISTINCT id) AS ids FROM c WHERE stage NOT IN ('ingest', 'asr', 'diarization') GROUP BY 1""")
def _(t):
    stage = F.get(F.array(*[F.lit(x) for x in ("asr", "tagger", "review", "ingest")]), (F.col("cohort") % 4).cast("int"))
    bad = t.predictions.where("predicted is null or predicted <> expected")
    cases = bad.select(F.col("subject_id").alias("id"), stage.alias("stage"), "tag_key", F.coalesce("predicted", F.lit("none")).alias("reason"), F.when(F.col("subject_id") % 7 == 0, "known").alias("cluster_key"), (F.col("subject_id") % 3).alias("occurrences"))
    return tagging.badcase_clusters(cases).select("cluster", "weight", "cases", F.size("ids").cast("long").alias("ids"))


@query("agg31_latest_groups", A, "SELECT group_key, max(occurred_at) AS latest FROM assignments GROUP BY 1 ORDER BY latest DESC, group_key LIMIT 8")
def _(t):
    return t.assignments.groupBy("group_key").agg(F.max("occurred_at").alias("latest")).orderBy(F.desc("latest"), "group_key").limit(8)


@query("win3_representative", S, """
SELECT speaker, recording_id, segment_id FROM (SELECT *, row_number() OVER (PARTITION BY speaker, recording_id ORDER BY vad >= 0.7::DOUBLE DESC, end_sec - start_sec DESC, segment_id DESC) AS k FROM segments) WHERE k = 1""")
def _(t):
    s = t.segments.select("speaker", "recording_id", "segment_id", (F.col("vad") >= 0.7).alias("good"), (F.col("end_sec") - F.col("start_sec")).alias("length"))
    return tabular.latest(s, ["speaker", "recording_id"], ["good", "length", "segment_id"]).select("speaker", "recording_id", "segment_id")


@query("win21_renumbered", S, "SELECT segment_id, row_number() OVER (PARTITION BY recording_id ORDER BY start_sec, segment_id) - 1 AS unit_index FROM segments WHERE stage <> 'unknown'")
def _(t):
    w = W.partitionBy("recording_id").orderBy("start_sec", "segment_id")
    return t.segments.where("stage <> 'unknown'").select("segment_id", (F.row_number().over(w) - 1).cast("long").alias("unit_index"))


@query("top5_evidence_budget", ("turns",), "SELECT conv_id, turn FROM (SELECT *, sum(strlen(coalesce(text, ''))) OVER (ORDER BY conv_id, turn ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT * FROM turns ORDER BY conv_id, turn LIMIT 512)) WHERE used <= 32768")
def _(t):
    return browse.evidence_budget(t.turns, ["conv_id", "turn"]).select("conv_id", "turn")


@query("gr9_entity_detail", E, """
WITH n AS (SELECT target AS other, 'out' AS way, relation FROM edges WHERE source = 'e5' UNION ALL SELECT source, 'in', relation FROM edges WHERE target = 'e5') SELECT other, way, relation, count(*) AS n FROM n GROUP BY ALL""")
def _(t):
    out = t.edges.where("source = 'e5'").select(F.col("target").alias("other"), F.lit("out").alias("way"), "relation")
    return out.unionByName(t.edges.where("target = 'e5'").select(F.col("source").alias("other"), F.lit("in").alias("way"), "relation")).groupBy("other", "way", "relation").agg(F.count("*").alias("n"))


@query("gr10_local_search", ("links",), """
WITH sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links), h0 AS (SELECT unnest([7, 9]::BIGINT[]) AS node), h1 AS (SELECT DISTINCT b AS node FROM sym WHERE a IN (SELECT node FROM h0) AND b NOT IN (SELECT node FROM h0)), h AS (SELECT node, 0 AS d FROM h0 UNION ALL SELECT node, 1 FROM h1),
x AS (SELECT 2 * p_partkey AS node, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part) SELECT h.node, round(0.5::DOUBLE / (1 + d) + 0.5::DOUBLE * (len(list_intersect(coalesce(w, []), ['red', 'ring'])) / 2.0::DOUBLE), 6) AS score FROM h LEFT JOIN x ON x.node = h.node""")
def _(t):
    seeds = t.part.sparkSession.range(7, 10, 2).toDF("node")  # 7 and 9, without a DISTINCT of all links
    texts = t.part.select((F.col("p_partkey") * 2).alias("node"), F.col("p_name").alias("text"))
    return retrieval.local_search(t.links, texts, seeds, "red ring", 1)


@query("gr16_retention_cascade", E, """
WITH h AS (SELECT edge_id FROM edges WHERE invalid_at IS NULL AND (source IN ('e9', 'e31') OR target IN ('e9', 'e31'))) SELECT edge_id, CASE WHEN edge_id IN (SELECT edge_id FROM h) THEN 999 ELSE invalid_at END AS invalid_at, edge_id IN (SELECT edge_id FROM h) AS told FROM edges""")
def _(t):
    gone = t.edges.select("source").where("source in ('e9', 'e31')").union(t.edges.select("target").where("target in ('e9', 'e31')")).toDF("name")
    edges, events = graphs.retention_cascade(t.edges, gone, 999)
    told = events.select("edge_id").distinct().withColumn("told", F.lit(True))
    return edges.join(told, "edge_id", "left").select("edge_id", "invalid_at", F.coalesce("told", F.lit(False)).alias("told"))


@query("gr31_weighted_subgraph", E, """
WITH d AS (SELECT unnest(['e5', 'e31']) AS name, 0 AS depth, 1.0::DOUBLE AS w UNION ALL SELECT CASE WHEN way = 1 THEN target ELSE source END, 1, CASE confidence WHEN 'EXTRACTED' THEN 1.0::DOUBLE WHEN 'INFERRED' THEN 0.8::DOUBLE END FROM edges, (SELECT unnest([1, 2]) AS way) WHERE (CASE WHEN way = 1 THEN source ELSE target END) IN ('e5', 'e31') AND expired_at IS NULL AND confidence <> 'AMBIGUOUS')
SELECT name, depth, max(w) AS weight FROM d GROUP BY 1, 2 ORDER BY depth, weight DESC, name LIMIT 30""")
def _(t):
    roots = t.edges.select(F.explode(F.array(F.lit("e5"), F.lit("e31"))).alias("name")).distinct()
    return graphs.weighted_subgraph(t.edges, roots, 30, 0.6)


@query("ret9_mixed_tokens", ("turns",), r"""
SELECT conv_id, count(DISTINCT k) AS tokens FROM (SELECT conv_id, unnest(list_concat(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> ''), list_concat(list_filter(string_split(lower(text), ''), lambda x: regexp_matches(x, '[a-z0-9]')),
  list_filter(list_transform(range(1, greatest(length(text), 1)), lambda i: substr(lower(text), CAST(i AS BIGINT), 2)), lambda x: regexp_full_match(x, '\p{Han}{2}'))))) AS k FROM turns) GROUP BY 1""")
def _(t):
    return t.turns.select("conv_id", F.explode(retrieval.mixed_tokens(F.col("text"))).alias("k")).groupBy("conv_id").agg(F.count_distinct("k").alias("tokens"))


@query("ret10_semantic_cache", ("vectors",), """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS age FROM vectors), q AS (SELECT vec_id AS query_id, label, list_concat([CAST(embedding[1] AS DOUBLE) + 0.02::DOUBLE], (embedding::DOUBLE[])[2:]) AS q FROM vectors WHERE vec_id % 20 = 0),
c AS (SELECT query_id, vec_id AS entry_id, list_cosine_similarity(r.embedding::DOUBLE[], q) AS s FROM q JOIN r ON r.label = q.label AND age <= 256)
SELECT query_id, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, entry_id) AS k FROM c WHERE s >= 0.985::DOUBLE) WHERE k = 1""")
def _(t):
    """Queries are vectors moved a little; the query set is every twentieth."""
    moved = F.concat(F.array(F.get("embedding", F.lit(0)).cast("double") + 0.02), F.transform(F.slice("embedding", 2, 1 << 20), lambda x: x.cast("double")))
    q = t.vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label", moved.alias("asked"))
    return retrieval.semantic_cache(t.vectors.withColumnRenamed("vec_id", "entry_id"), q, ["label"])


@query("ui3_key_path_share", T, """
WITH f AS (SELECT from_state, to_state, reason, count(*) AS n, avg(confidence) AS c FROM transitions GROUP BY 1, 2, 3) SELECT reason, round(least(1.0::DOUBLE, sum(CASE WHEN c >= 0.8::DOUBLE THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE)), 6) AS share FROM f GROUP BY 1""")
def _(t):
    return tabular.key_path_share(t.transitions, ["reason"])


@query("ui4_path_tone", T, """
WITH f AS (SELECT from_state, to_state, avg(confidence) AS c FROM transitions GROUP BY 1, 2) SELECT from_state, to_state, CASE WHEN c < 0.5::DOUBLE THEN 'danger' WHEN c >= 0.8::DOUBLE THEN 'strong' ELSE 'normal' END AS tone FROM f""")
def _(t):
    f = t.transitions.groupBy("from_state", "to_state").agg(F.avg("confidence").alias("c"))
    return f.select("from_state", "to_state", F.when(F.coalesce("c", F.lit(0.0)) < 0.5, "danger").when(F.col("c") >= 0.8, "strong").otherwise("normal").alias("tone"))


@query("ui6_stage_volume", T, "SELECT to_state, count(*) AS n FROM transitions WHERE NOT starts_with(to_state, '__') GROUP BY 1 ORDER BY n DESC, to_state LIMIT 10")
def _(t):
    return t.transitions.where(~F.startswith("to_state", F.lit("__"))).groupBy("to_state").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "to_state").limit(10)


@query("ev2_edge_precision", ("relations",), """
WITH p AS (SELECT DISTINCT source, relation, target, rank FROM relations WHERE position % 3 <> 0), g AS (SELECT DISTINCT source, relation, target FROM relations WHERE position % 5 <> 0)
SELECT rank, round(count(g.source) / CAST(count(*) AS DOUBLE), 6) AS precision FROM p LEFT JOIN g USING (source, relation, target) GROUP BY 1""")
def _(t):
    keys = ["source", "relation", "target"]
    g = t.relations.where("position % 5 <> 0").select(keys).distinct().withColumn("hit", F.lit(1))
    p = t.relations.where("position % 3 <> 0").select(*keys, "rank").distinct()
    return p.join(g, keys, "left").groupBy("rank").agg(F.round(F.count("hit") / F.count("*"), 6).alias("precision"))


@query("ev3_entity_f1", ("mentions",), """
WITH p AS (SELECT DISTINCT recording_id, lower(name) AS n, type FROM mentions WHERE position % 3 <> 0), g AS (SELECT DISTINCT recording_id, lower(name) AS n, type FROM mentions WHERE position % 4 <> 0),
f AS (SELECT coalesce(p.recording_id, g.recording_id) AS recording_id, p.n IS NOT NULL AS a, g.n IS NOT NULL AS b FROM p FULL JOIN g ON p.recording_id = g.recording_id AND p.n = g.n AND p.type = g.type)
SELECT recording_id, round(2 * count(*) FILTER (a AND b) / CAST(count(*) FILTER (a) + count(*) FILTER (b) AS DOUBLE), 6) AS f1 FROM f GROUP BY 1""")
def _(t):
    side = lambda k, n: t.mentions.where(f"position % {k} <> 0").select("recording_id", F.lower("name").alias("n"), "type").distinct().withColumn(n, F.lit(True))
    f = side(3, "a").join(side(4, "b"), ["recording_id", "n", "type"], "full_outer").fillna(False, ["a", "b"])
    return f.groupBy("recording_id").agg(F.round(2 * F.count_if(F.col("a") & F.col("b")) / (F.count_if("a") + F.count_if("b")), 6).alias("f1"))


@query("ev12_scores_by_slice", ("predictions",), """
WITH u AS (SELECT 'cohort' AS slice, CAST(cohort AS STRING) AS member, expected = predicted AS hit FROM predictions UNION ALL SELECT 'side', side, expected = predicted FROM predictions) SELECT slice, member, count(*) AS n, round(count(*) FILTER (hit) / CAST(count(*) AS DOUBLE), 6) AS accuracy FROM u GROUP BY 1, 2""")
def _(t):
    p = t.predictions.withColumn("hit", F.coalesce(F.col("expected") == F.col("predicted"), F.lit(False)))
    u = p.select(F.lit("cohort").alias("slice"), F.col("cohort").cast("string").alias("member"), "hit").unionByName(p.select(F.lit("side").alias("slice"), F.col("side").alias("member"), "hit"))
    return u.groupBy("slice", "member").agg(F.count("*").alias("n"), F.round(F.count_if("hit") / F.count("*"), 6).alias("accuracy"))


@query("ev16_integrity", ("predictions",), "SELECT tag_key, count(*) FILTER (predicted NOT IN ('v0', 'v1')) AS not_allowed, count(*) FILTER (predicted IS NULL) AS missing FROM predictions GROUP BY 1")
def _(t):
    return t.predictions.groupBy("tag_key").agg(F.count_if(~F.col("predicted").isin("v0", "v1")).alias("not_allowed"), F.count_if(F.col("predicted").isNull()).alias("missing"))


@query("ev23_window_health", ("calls",), """
WITH g AS (SELECT purpose, model, count(*) AS n, count(*) FILTER (failed) AS bad, count(*) FILTER (tokens_cached > tokens_in) AS sch, count(*) FILTER (tokens_out = 0) AS ev, count(*) - count(DISTINCT run_id * 10000 + tokens_out) AS dup, avg(CASE WHEN cache_hit THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END) AS rec, max(latency_ms) AS slow, sum(tokens_in) / (count(*) * 2600.0::DOUBLE) AS budget FROM calls GROUP BY 1, 2)
SELECT purpose || '/' || model AS "window", concat_ws(',', CASE WHEN bad >= 0.01::DOUBLE * n THEN 'error_rate' END, CASE WHEN sch > 0 THEN 'schema' END, CASE WHEN ev > 0 THEN 'evidence' END, CASE WHEN dup > 0 THEN 'duplicate_current' END, CASE WHEN rec < 0.95::DOUBLE THEN 'critical_recall' END, CASE WHEN slow > 640 THEN 'drift' END, CASE WHEN budget >= 1 THEN 'budget_exhausted' WHEN budget >= 0.9::DOUBLE THEN 'budget_near' END) AS breaches FROM g""")
def _(t):
    g = t.calls.groupBy(F.concat_ws("/", "purpose", "model").alias("window")).agg(
        F.count("*").alias("n"), F.count_if("failed").alias("failed"), F.count_if(F.col("tokens_cached") > F.col("tokens_in")).alias("schema_violations"), F.count_if(F.col("tokens_out") == 0).alias("evidence_violations"),
        (F.count("*") - F.count_distinct(F.col("run_id") * 10000 + F.col("tokens_out"))).alias("duplicates"), F.avg(F.when(F.col("cache_hit"), 1.0).otherwise(0.9)).alias("critical_recall"), (F.max("latency_ms") > 640).alias("drifted"),
        (F.sum("tokens_in") / (F.count("*") * 2600.0)).alias("budget"),
    )
    return scores.breaches(g, "window")


@query("ev28_boundary_scores", S, """
WITH c AS (SELECT *, last_value(CASE WHEN stage <> 'unknown' THEN stage END IGNORE NULLS) OVER w AS k FROM segments WINDOW w AS (PARTITION BY recording_id ORDER BY start_sec, end_sec, segment_id)),
f AS (SELECT *, coalesce(k, 'unknown') AS final FROM c), b AS (SELECT recording_id, segment_id, final, lag(segment_id) OVER w IS NULL AS first_, least(1.0::DOUBLE, CASE WHEN start_sec - lag(end_sec) OVER w >= 8 THEN 0.55::DOUBLE WHEN start_sec - lag(end_sec) OVER w >= 3 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN final <> lag(final) OVER w THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN speaker <> lag(speaker) OVER w THEN 0.08::DOUBLE ELSE 0 END) AS score, stage = 'greeting' OR lag(segment_id) OVER w IS NULL AS gold FROM f WINDOW w AS (PARTITION BY recording_id ORDER BY start_sec, end_sec, segment_id)),
x AS (SELECT recording_id % 5 AS scenario, count(*) FILTER (gold AND (first_ OR round(score, 4) >= 0.5::DOUBLE)) AS tp, count(*) FILTER (gold) AS g, count(*) FILTER (first_ OR round(score, 4) >= 0.5::DOUBLE) AS p FROM b GROUP BY 1)
SELECT scenario, round(tp / CAST(p AS DOUBLE), 6) AS precision, round(tp / CAST(g AS DOUBLE), 6) AS recall, round(2 * tp / CAST(p + g AS DOUBLE), 6) AS f1, 2 * tp / CAST(p + g AS DOUBLE) >= 0.85::DOUBLE AS passed FROM x""")
def _(t):
    """The segmenter's cuts against the greetings of each recording, by scenario."""
    cut = sequences.boundary_scores(sequences.carried_stage(t.segments))
    first = F.lag("segment_id").over(W.partitionBy("recording_id").orderBy("start_sec", "end_sec", "segment_id")).isNull()
    rows = cut.select((F.col("recording_id") % 5).alias("scenario"), ((F.col("stage") == "greeting") | first).alias("gold"), F.coalesce("cut", F.lit(False)).alias("found"))
    return scores.boundary_scores(rows, "scenario")


@query("tag9_mutual_exclusion", A, "SELECT DISTINCT a.target_id FROM assignments a JOIN assignments b USING (target_id, label_key) WHERE a.value = 'v0' AND b.value = 'v3' AND a.group_key = b.group_key")
def _(t):
    side = lambda v: t.assignments.where(F.col("value") == v).select("target_id", "label_key", "group_key").distinct()
    return side("v0").join(side("v3"), ["target_id", "label_key", "group_key"]).select("target_id").distinct()


@query("tag15_patch_merge", A, "SELECT sha256(label_key || value) AS patch, count(DISTINCT target_id) AS ids, min(target_id) AS first FROM assignments GROUP BY 1")
def _(t):
    p = tagging.patches(t.assignments.groupBy(F.concat("label_key", "value").alias("text"), "store_id").agg(F.collect_set("target_id").alias("ids")))
    return p.select("patch", F.size("ids").cast("long").alias("ids"), F.get("ids", F.lit(0)).alias("first"))
