"""Queries of evaluation over layers, trials, answers and pairs."""

from pyspark.sql import functions as F

from colloquy.operators import evaluations as op
from colloquy.operators import tabular, tagging
from colloquy.plans.registry import query
from colloquy.sources import parsers

P, S, E, V, A = ("predictions",), ("segments",), ("edges",), ("vectors",), ("assignments",)


@query("ev4_layer_precision", E, """
WITH g AS (SELECT DISTINCT source, relation, target, confidence FROM edges WHERE edge_id % 3 <> 0), p AS (SELECT DISTINCT source, relation, target, confidence FROM edges WHERE edge_id % 2 = 0),
n AS (SELECT p.confidence AS layer, count(*) AS predicted, count(g.source) AS hits FROM p LEFT JOIN g ON p.source = g.source AND p.relation = g.relation AND p.target = g.target AND p.confidence = g.confidence GROUP BY 1),
l AS (SELECT x.layer, coalesce(predicted, 0) AS predicted, coalesce(hits, 0) AS hits, hits / CAST(predicted AS DOUBLE) AS precision FROM (SELECT unnest(['EXTRACTED', 'INFERRED', 'AMBIGUOUS']) AS layer) x LEFT JOIN n ON n.layer = x.layer)
SELECT layer, predicted, hits, round(precision, 6) AS precision FROM l UNION ALL SELECT 'macro', CAST(sum(predicted) AS BIGINT), CAST(sum(hits) AS BIGINT), round(coalesce(avg(precision), 0), 6) FROM l""")
def _(t):
    return op.layer_precision(t.edges.where("edge_id % 3 <> 0"), t.edges.where("edge_id % 2 = 0"))


#: The sweep of the oracle: thresholds in order, the best one carried from each to the next.
SWEEP = """
n AS (SELECT confidence * 0.6::DOUBLE + CASE WHEN expected = predicted THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS t, count(*) FILTER (expected = predicted) AS s, count(*) FILTER (expected <> predicted) AS d FROM predictions WHERE predicted IS NOT NULL GROUP BY 1),
x AS (SELECT t, sum(d) OVER w / CAST((SELECT sum(d) FROM n) AS DOUBLE) AS far, 1 - sum(s) OVER w / CAST((SELECT sum(s) FROM n) AS DOUBLE) AS frr, row_number() OVER w AS k FROM n WINDOW w AS (ORDER BY t DESC)),
y AS (SELECT *, abs(far - frr) AS gap, (far + frr) / 2 AS mean FROM x),
f AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0.5 AS DOUBLE) AS best, CAST(1 AS DOUBLE) AS gap, CAST(NULL AS DOUBLE) AS t
 UNION ALL SELECT y.k, CASE WHEN y.gap < best - mean OR (abs(y.gap - (best - mean)) < 1e-12::DOUBLE AND mean < best) THEN mean ELSE best END, CASE WHEN y.gap < best - mean OR (abs(y.gap - (best - mean)) < 1e-12::DOUBLE AND mean < best) THEN y.gap ELSE f.gap END,
  CASE WHEN y.gap < best - mean OR (abs(y.gap - (best - mean)) < 1e-12::DOUBLE AND mean < best) THEN y.t ELSE f.t END FROM f JOIN y ON y.k = f.k + 1),
z AS (SELECT * FROM f WHERE k = (SELECT max(k) FROM f)),
ties AS (SELECT avg(y.far) AS far, avg(y.frr) AS frr FROM (SELECT far, frr FROM y UNION ALL SELECT 0, 1 UNION ALL SELECT 1, 0) y, z WHERE abs(abs(y.far - y.frr) - z.gap) < 1e-9::DOUBLE),
eer AS (SELECT (far + frr) / 2 AS eer, z.t AS threshold, far, frr, (SELECT min(t) FROM y WHERE y.far <= 0.05::DOUBLE) AS strict FROM ties, z)"""


def trials(t):
    same = F.col("expected") == F.col("predicted")
    return t.predictions.where("predicted is not null").select((F.col("confidence") * 0.6 + F.when(same, 0.4).otherwise(0.0)).alias("score"), same.alias("same"))


@query("ev7_equal_error", P, f"WITH RECURSIVE {SWEEP} SELECT round(eer, 6) AS eer, round(threshold, 6) AS threshold, round(far, 6) AS far, round(frr, 6) AS frr, round(strict, 6) AS threshold_at_far FROM eer")
def _(t):
    found = op.equal_error(trials(t), "score", "same", 0.05)
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query("ui9_recommended_thresholds", P, f"""WITH RECURSIVE {SWEEP}
SELECT round(CASE WHEN threshold > strict THEN strict ELSE threshold END, 6) AS merge, round(CASE WHEN threshold IS NOT NULL THEN strict END, 6) AS sure, coalesce(threshold > strict, false) AS inverted, threshold IS NULL AS refused FROM eer""")
def _(t):
    return op.recommended(op.equal_error(trials(t), "score", "same", 0.05), max_eer=1.0).withColumn("merge", F.round("merge", 6)).withColumn("sure", F.round("sure", 6))


@query("ev8_answer_scores", P, """
WITH c AS (SELECT cohort, avg(CASE WHEN expected = predicted THEN 1.0::DOUBLE ELSE 0 END) AS a FROM predictions GROUP BY 1), g AS (SELECT cohort, avg(CAST(subject_id % 3 AS DOUBLE) / 2) AS b FROM predictions GROUP BY 1),
o AS (SELECT cohort, tag_key || subject_id % 100 AS fact, bool_or(side = 'base') AS g, bool_or(coalesce(predicted = 'v1', false)) AS p FROM predictions GROUP BY 1, 2), f AS (SELECT cohort, 2 * count(*) FILTER (g AND p) / CAST(count(*) FILTER (g) + count(*) FILTER (p) AS DOUBLE) AS f FROM o GROUP BY 1)
SELECT cohort, round(a, 6) AS faithfulness, round(b, 6) AS relevance, round(CASE WHEN isnan(f) OR f IS NULL THEN 1 ELSE f END, 6) AS factual_f1 FROM c JOIN g USING (cohort) JOIN f USING (cohort)""")
def _(t):
    claims = t.predictions.select("cohort", F.coalesce(F.col("expected") == F.col("predicted"), F.lit(False)).alias("supported"))
    grades = t.predictions.select("cohort", ((F.col("subject_id") % 3) / 2).alias("grade"))
    fact = F.concat("tag_key", (F.col("subject_id") % 100).cast("string"))
    facts = t.predictions.select("cohort", fact.alias("fact"), (F.col("side") == "base").alias("in_gold"), F.coalesce(F.col("predicted") == "v1", F.lit(False)).alias("in_answer"))
    return op.answer_scores(claims, grades, facts, "cohort")


@query("ev9_aggregated_metrics", P, """
WITH o AS (SELECT subject_id // 100000000 AS example, tag_key AS metric, avg(CASE WHEN predicted IS NOT NULL THEN confidence END) AS v FROM predictions GROUP BY 1, 2) SELECT metric, round(avg(v), 6) AS mean, count(v) AS examples, count(*) FILTER (v IS NULL) AS failed FROM o GROUP BY 1""")
def _(t):
    rows = t.predictions.select(F.expr("subject_id div 100000000").alias("example"), F.col("tag_key").alias("metric"), F.col("side").alias("position"), F.when(F.col("predicted").isNotNull(), F.col("confidence")).alias("value"))
    return op.aggregated(rows)


@query("ev20_output_drift", P, """
WITH b AS (SELECT cohort % 3 AS domain, tag_key, coalesce(predicted, '__missing__') AS v, 1 AS c, 0 AS e FROM predictions UNION ALL SELECT cohort % 3, tag_key, coalesce(expected, '__missing__'), 0, 1 FROM predictions),
n AS (SELECT domain, tag_key, v, CAST(sum(c) AS DOUBLE) AS l, CAST(sum(e) AS DOUBLE) AS r FROM b GROUP BY 1, 2, 3), s AS (SELECT domain, tag_key, sum(l) AS ln, sum(r) AS rn FROM n GROUP BY 1, 2),
q AS (SELECT n.domain, n.tag_key, ln, l / ln AS p, r / rn AS q, (l / ln + r / rn) / 2 AS m FROM n JOIN s USING (domain, tag_key)),
d AS (SELECT domain, tag_key, max(ln) AS ln, sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END) / 2 AS d FROM q GROUP BY 1, 2)
SELECT domain, tag_key, round(d, 6) AS jsd, ln >= 30 AS eligible, ln >= 30 AND d > 0.1::DOUBLE AS breach FROM d""")
def _(t):
    return op.output_drift(t.predictions.select((F.col("cohort") % 3).alias("domain"), "tag_key", F.col("predicted").alias("candidate"), F.col("expected").alias("baseline")))


_CHANCE = f"(('0x' || substr(md5('{op.SEED}|' || block || '|' || id), 1 + 8 * part, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query("ev26_bootstrap_bound", P, f"""
WITH x AS (SELECT concat_ws('|', cohort, tag_key) AS key, CAST(subject_id AS VARCHAR) AS id, CAST(round((confidence - 0.5::DOUBLE) * 1000000) AS BIGINT) AS v FROM predictions),
d AS (SELECT key, v, block * 4 + part AS round, {" + ".join(f"CASE WHEN {_CHANCE} >= {c}::DOUBLE THEN 1 ELSE 0 END" for c in op.DRAWN)} AS n FROM x, (SELECT unnest(range(0, 500)) AS block), (SELECT unnest(range(0, 4)) AS part)),
m AS (SELECT key, round, sum(n * v) / CAST(sum(n) AS DOUBLE) / 1000000 AS mean FROM d GROUP BY 1, 2 HAVING sum(n) > 0),
s AS (SELECT key, mean, row_number() OVER (PARTITION BY key ORDER BY mean) AS k, count(*) OVER (PARTITION BY key) AS rounds FROM m)
SELECT key, round(mean, 9) AS bound FROM s WHERE k = greatest(rounds // 20, 1)""")
def _(t):
    """The bound of each cohort's and tag's confidence over one half, from all 2,000 hashed rounds."""
    key = F.concat_ws("|", "cohort", "tag_key")
    rows = t.predictions.select(key.alias("key"), "subject_id", (F.col("confidence") - 0.5).alias("value"))
    return op.bootstrap_bound(rows, "key", "subject_id", "value").select("key", F.round("bound", 9).alias("bound"))


@query("ui7_loop_summary", A, """
WITH l AS (SELECT target_id, label_key, group_key, max_by(value, assignment_id) AS value FROM assignments GROUP BY 1, 2, 3), c AS (SELECT target_id, label_key, count(DISTINCT value) > 1 AS conflict, count(*) AS n FROM l GROUP BY 1, 2),
g AS (SELECT group_key, count(*) / CAST((SELECT count(*) FROM c) AS DOUBLE) AS rate FROM l GROUP BY 1), a AS (SELECT x.group_key AS l, y.group_key AS r, count(*) FILTER (x.value = y.value) / CAST(count(*) AS DOUBLE) AS rate FROM l x JOIN l y ON x.target_id = y.target_id AND x.label_key = y.label_key AND x.group_key < y.group_key GROUP BY 1, 2)
SELECT (SELECT round(avg(round(rate, 6)), 6) FROM g) AS coverage, (SELECT round(avg(round(rate, 6)), 6) FROM a) AS agreement, round(avg(CASE WHEN conflict THEN 1.0::DOUBLE ELSE 0 END), 6) AS conflicts, round(least(1.0::DOUBLE, sum(n) / (3.0::DOUBLE * count(*))), 6) AS density FROM c""")
def _(t):
    groups = ["rules", "model", "review"]
    last = tagging.cells(t.assignments)
    have = sum(F.col(g).isNotNull().cast("int") for g in groups) / 3.0
    return op.loop_summary(tagging.coverage(last, groups), tagging.agreement(last), tagging.matrix(last, groups), have)


@query("ui10_trial_pairs", V, """
WITH v AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('trials|' || CAST(vec_id AS STRING)), vec_id) AS k FROM vectors), w AS (SELECT * FROM v WHERE k <= 21),
r AS (SELECT label, coalesce(lead(label) OVER (ORDER BY md5(CAST(label AS STRING))), first_value(label) OVER (ORDER BY md5(CAST(label AS STRING)))) AS nxt FROM (SELECT DISTINCT label FROM v))
SELECT a.vec_id AS "left", b.vec_id AS "right", true AS same FROM w a JOIN w b ON a.label = b.label AND b.k = a.k + 1 UNION ALL
SELECT a.vec_id, b.vec_id, false FROM w a JOIN r ON r.label = a.label JOIN w b ON b.label = r.nxt AND b.k = a.k WHERE a.k <= 20""")
def _(t):
    return op.trial_pairs(t.vectors, "label", "vec_id", 20)


@query("vec5_sampled_segments", S, """
WITH u AS (SELECT recording_id, speaker, segment_id, end_sec - start_sec AS length, sum(end_sec - start_sec) OVER (PARTITION BY recording_id, speaker) AS total, row_number() OVER (PARTITION BY recording_id, speaker ORDER BY end_sec - start_sec DESC, segment_id) AS place FROM segments WHERE end_sec - start_sec >= 5)
SELECT recording_id, speaker, segment_id, length, place FROM u WHERE total >= 30 AND place <= 3""")
def _(t):
    return op.sampled_segments(t.segments, ["recording_id", "speaker"], 5, 30, 3)


@query("src6_gold_examples", ("edges",), "SELECT source AS query, count(*) AS n FROM (SELECT DISTINCT source, relation, target, confidence FROM edges) GROUP BY 1")
def _(t):
    e = t.edges.select("source", F.struct(F.col("source").alias("src"), F.col("relation").alias("rel"), F.col("target").alias("dst"), "confidence").alias("g")).distinct()
    one = e.groupBy("source").agg(F.to_json(F.struct(F.col("source").alias("query"), F.collect_list("g").alias("gold_edges"))).alias("value"))
    broken = t.edges.select(F.lit("{broken").alias("value")).limit(1)
    return parsers.gold_examples(one.select("value").union(broken)).select("query", F.size("gold_edges").cast("long").alias("n"))


@query("src9_dialogue_gold", S, """
WITH d AS (SELECT recording_id, count(*) = count(DISTINCT idx) AS ok FROM segments GROUP BY 1) SELECT CAST(s.recording_id AS STRING) AS case_id, CAST(idx AS STRING) AS segment_id, idx % 3 = 0 AS boundary FROM segments s JOIN d ON d.recording_id = s.recording_id WHERE ok""")
def _(t):
    seg = F.struct(F.col("idx").cast("string").alias("segment_id"), F.col("start_sec").cast("double").alias("start_sec"), F.col("end_sec").cast("double").alias("end_sec"), F.lit("").alias("transcript"))
    case = t.segments.groupBy("recording_id").agg(F.collect_list(seg).alias("segments"), F.collect_list(F.when(F.col("idx") % 3 == 0, F.col("idx").cast("string"))).alias("boundary_after_segment_ids"))
    lines = case.select(F.to_json(F.struct(F.col("recording_id").cast("string").alias("case_id"), F.lit("retail").alias("scenario"), "segments", "boundary_after_segment_ids")).alias("value"))
    return parsers.dialogue_gold(lines).select("case_id", "segment_id", "boundary")


@query("join10_paired_drift", P, """
WITH p AS (SELECT (subject_id // 10000) % 100000 AS subject, tag_key, cohort // 4 AS job, side, subject_id AS id, subject_id % 977 AS at_, max(predicted) AS predicted FROM predictions GROUP BY ALL),
x AS (SELECT c.tag_key, c.predicted AS cv, b.predicted AS bv, row_number() OVER (PARTITION BY c.id ORDER BY c.job <> b.job, abs(c.at_ - b.at_), b.id DESC) AS k FROM p c JOIN p b ON c.subject = b.subject AND c.tag_key = b.tag_key AND c.side = 'candidate' AND b.side = 'base')
SELECT tag_key, count(*) AS pairs, count(*) FILTER (cv IS NOT DISTINCT FROM bv) AS same FROM x WHERE k = 1 GROUP BY 1""")
def _(t):
    p = t.predictions.selectExpr("(subject_id div 10000) % 100000 AS subject", "tag_key", "cohort div 4 AS job", "side", "subject_id AS id", "subject_id % 977 AS at", "predicted").groupBy("subject", "tag_key", "job", "side", "id", "at").agg(F.max("predicted").alias("predicted"))
    pairs = tabular.nearest_baseline(p.where("side = 'candidate'"), p.where("side = 'base'"), ["subject", "tag_key"])
    of = lambda n: p.select(F.col("id").alias(f"{n}_id"), F.col("predicted").alias(n), *(["tag_key"] if n == "candidate" else []))
    both = pairs.join(of("candidate"), "candidate_id").join(of("baseline"), "baseline_id")
    return both.groupBy("tag_key").agg(F.count("*").alias("pairs"), F.count_if(F.col("candidate").eqNullSafe(F.col("baseline"))).alias("same"))
