"""Queries of run summaries, integrity, efficiency, segmentation release and entities."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.operators import sequences
from colloquy.operators import summaries as op
from colloquy.plans.registry import query
from colloquy.plans.scores import bound

P = ("predictions",)
JUDGED = """SELECT subject_id, cohort, tag_key, CASE WHEN subject_id % 11 = 0 THEN 'absent' WHEN subject_id % 13 = 0 THEN ' Uncertain' WHEN subject_id % 17 = 0 THEN NULL ELSE 'present' END AS truth,
  expected, predicted, CASE WHEN subject_id % 19 <> 0 THEN confidence * 1.02D END AS confidence, probability > 0.25D AS evidence FROM {p}"""
DEFINED = """SELECT DISTINCT tag_key, CASE tag_key WHEN 'tag0' THEN array('v0', 'v1', 'v2') WHEN 'tag1' THEN array('v0', 'v1', 'v9') WHEN 'tag2' THEN array() END AS allowed, CASE tag_key WHEN 'tag1' THEN array('v1') END AS negative,
  CASE tag_key WHEN 'tag0' THEN array('v1', 'v8') WHEN 'tag1' THEN array('v1', 'v0') END AS critical_values, tag_key = 'tag3' AS critical, tag_key IN ('tag0', 'tag3') AS evidence_required FROM {p} WHERE tag_key <> 'tag2'"""
RULES = """d AS (SELECT * FROM (VALUES ('tag0', ['v0', 'v1', 'v2'], [], ['v1', 'v8'], false, true), ('tag1', ['v0', 'v1', 'v9'], ['v1'], ['v1', 'v0'], false, false), ('tag3', NULL, NULL, NULL, true, true)) x(tag_key, allowed, negative, critical_values, critical, evidence_required)),
j AS (SELECT subject_id, tag_key, CASE WHEN subject_id % 11 = 0 THEN 'absent' WHEN subject_id % 13 = 0 THEN 'uncertain' ELSE 'present' END AS truth, CASE WHEN subject_id % 11 <> 0 THEN expected END AS expected, predicted, CASE WHEN subject_id % 19 <> 0 THEN confidence * 1.02::DOUBLE END AS confidence, probability > 0.25::DOUBLE AS evidence FROM predictions),
k AS (SELECT * FROM j WHERE truth <> 'uncertain')"""
VALUES = f"""{RULES}, names AS (SELECT tag_key, expected AS value FROM k WHERE expected IS NOT NULL UNION SELECT tag_key, predicted FROM k WHERE predicted IS NOT NULL UNION SELECT tag_key, unnest(allowed) FROM d UNION SELECT tag_key, unnest(critical_values) FROM d),
q AS (SELECT n.tag_key, n.value, count(*) FILTER (expected = value AND predicted = value) AS tp, count(*) FILTER (predicted = value AND (expected IS NULL OR expected <> value)) AS fp, count(*) FILTER (expected = value AND (predicted IS NULL OR predicted <> value)) AS fn, count(k.tag_key) AS evaluated FROM names n LEFT JOIN k USING (tag_key) GROUP BY 1, 2),
v AS (SELECT q.*, coalesce(list_contains(negative, value), false) AS negative, NOT coalesce(list_contains(negative, value), false) AND (coalesce(list_contains(critical_values, value), false) OR (coalesce(critical, false) AND (allowed IS NULL OR list_contains(allowed, value)))) AS critical,
  CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END AS re, CASE WHEN tp + fn > 0 THEN round({bound('tp::DOUBLE', '(tp + fn)')}, 6) ELSE 0 END AS rb FROM q LEFT JOIN d USING (tag_key))"""


def _rows(t):
    return t.predictions.sparkSession.sql(JUDGED, p=t.predictions)


def _defined(t):
    return t.predictions.sparkSession.sql(DEFINED, p=t.predictions)


@query("ev10_label_metrics", P, f"""WITH {RULES},
c AS (SELECT tag_key, count(*) FILTER (expected = predicted) AS tp, count(*) FILTER (predicted IS NOT NULL AND (expected IS NULL OR expected <> predicted)) AS fp, count(*) FILTER (expected IS NOT NULL AND (predicted IS NULL OR expected <> predicted)) AS fn, count(*) FILTER (expected IS NULL AND predicted IS NULL) AS tn, count(*) AS support FROM k GROUP BY 1),
r AS (SELECT *, tp / CAST(tp + fp AS DOUBLE) AS p, tp / CAST(tp + fn AS DOUBLE) AS r FROM c) SELECT tag_key, tp, fp, fn, tn, support, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1, support < 30 AS insufficient FROM r""")
def _(t):
    return op.label_metrics(op.cells(_rows(t)))


@query("ev10_value_metrics", P, f"""WITH {VALUES}
SELECT tag_key, value, tp, fp, fn, evaluated - tp - fp - fn AS tn, tp + fn AS support, evaluated, round(pr, 6) AS precision, round(re, 6) AS recall, rb AS recall_bound,
  CASE WHEN pr + re > 0 THEN round(2 * pr * re / (pr + re), 6) ELSE 0 END AS f1, CASE WHEN pr + re > 0 THEN round(5 * pr * re / (4 * pr + re), 6) ELSE 0 END AS f2, negative, critical FROM v""")
def _(t):
    return op.value_metrics(op.cells(_rows(t)), _defined(t))


@query("ev10_run_summary", P, f"""WITH {VALUES},
m AS (SELECT round(avg(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END) FILTER (NOT negative AND (tp + fn > 0 OR fp > 0)), 5) AS macro_f1, round(sum(tp) FILTER (critical) / CAST(sum(tp + fn) FILTER (critical) AS DOUBLE), 6) AS critical_recall, min(rb) FILTER (critical) AS critical_recall_bound, CAST(sum(tp + fn) FILTER (critical) AS BIGINT) AS critical_support FROM v),
e AS (SELECT round(count(*) FILTER (expected = predicted AND evidence) / CAST(count(*) AS DOUBLE), 6) AS evidence_coverage FROM k WHERE expected IS NOT NULL AND tag_key IN ('tag0', 'tag3')),
b AS (SELECT least(floor(least(1::DOUBLE, confidence) * 10), 9) AS bin, least(1::DOUBLE, confidence) AS c, CASE WHEN expected = predicted THEN 1 ELSE 0 END AS r FROM k WHERE predicted IS NOT NULL AND confidence IS NOT NULL),
g AS (SELECT bin, count(*) AS n, avg(c) AS c, avg(r) AS r, sum((c - r) ** 2) AS sq FROM b GROUP BY 1), x AS (SELECT round(sum(sq) / sum(n), 6) AS brier, round(sum(n * abs(c - r)) / sum(n), 6) AS ece FROM g),
few AS (SELECT coalesce(string_agg(tag_key, ',' ORDER BY tag_key), '') AS insufficient FROM (SELECT tag_key FROM k GROUP BY 1 HAVING count(*) < 30)) SELECT * FROM m, e, x, few""")
def _(t):
    return op.run_summary(_rows(t), _defined(t))


@query("ev16_prediction_integrity", P, f"""WITH {RULES}, s AS (SELECT subject_id // 10000000000 - (subject_id // 10000000000 - cohort) % 12 AS subject_id, tag_key, predicted, CASE WHEN subject_id % 19 <> 0 THEN confidence * 1.02::DOUBLE END AS confidence, probability > 0.25::DOUBLE AS evidence FROM predictions WHERE predicted IS NOT NULL),
x AS (SELECT s.*, d.tag_key IS NULL AS u, row_number() OVER (PARTITION BY s.tag_key, subject_id) AS k, allowed IS NOT NULL AND len(allowed) > 0 AND NOT list_contains(allowed, predicted) AS barred, coalesce(confidence > 1, false) AS wild, coalesce(evidence_required, false) AND NOT evidence AS bare FROM s LEFT JOIN d USING (tag_key))
SELECT tag_key, count(*) AS predictions, count(*) FILTER (u) AS unknown_tag, count(*) FILTER (NOT u AND k > 1) AS repeated, count(*) FILTER (NOT u AND barred) AS not_allowed, count(*) FILTER (NOT u AND wild) AS bad_confidence, count(*) FILTER (NOT u AND bare) AS no_evidence FROM x GROUP BY 1""")
def _(t):
    """A subject is an order: its lines of one tag are repeats. A long part key runs over into the order's digits, so the cohort, its rest by 12, settles them."""
    order = F.expr("subject_id div 10000000000")
    said = _rows(t).where("predicted is not null").withColumn("subject_id", order - (order - F.col("cohort")) % 12)
    return op.integrity(said, _defined(t))


RUNS = "l_orderkey AS run_id, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS execution_id, CASE WHEN l_partkey % 3 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN l_partkey % 97 <> 0 THEN l_partkey % 5000 END AS tokens_in, l_suppkey % 90 AS tokens_out, CAST(l_quantity AS BIGINT) % 50 AS cost, CAST(l_linenumber % 4 AS BIGINT) AS calls, CASE WHEN l_orderkey % 101 = 0 THEN 7 ELSE 0 END AS unknown_tokens"


@query("ev22_measured_efficiency", ("recordings",), f"""
WITH e AS (SELECT {RUNS} FROM lineitem), l AS (SELECT * FROM e WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY execution_id DESC) = 1),
f AS (SELECT run_id, tokens_in + tokens_out AS tokens, cost, calls FROM l WHERE tokens_in IS NOT NULL AND unknown_tokens = 0 AND NOT (calls > 0 AND cost = 0)),
p AS (SELECT recording_id // 40 AS block, recording_id AS a, recording_id + 1 AS b FROM recordings WHERE recording_id % 2 = 0), m AS (SELECT block, x.tokens AS ct, x.cost AS cc, x.calls AS cl, y.tokens AS bt, y.cost AS bc, y.calls AS bl, x.run_id IS NOT NULL AND y.run_id IS NOT NULL AS ok FROM p LEFT JOIN f x ON x.run_id = a LEFT JOIN f y ON y.run_id = b),
g AS (SELECT block, count(*) AS pairs, count(*) FILTER (ok) AS measured, count(*) = count(*) FILTER (ok) AS complete, CAST(sum(ct) AS BIGINT) AS ct, CAST(sum(cc) AS BIGINT) AS cc, CAST(sum(cl) AS BIGINT) AS cl, CAST(sum(bt) AS BIGINT) AS bt, CAST(sum(bc) AS BIGINT) AS bc, CAST(sum(bl) AS BIGINT) AS bl FROM m GROUP BY 1)
SELECT block, pairs, measured, complete, CASE WHEN complete THEN ct ELSE 0 END AS candidate_tokens, CASE WHEN complete THEN cc ELSE 0 END AS candidate_cost, CASE WHEN complete THEN cl ELSE 0 END AS candidate_calls, CASE WHEN complete THEN bt ELSE 0 END AS baseline_tokens, CASE WHEN complete THEN bc ELSE 0 END AS baseline_cost, CASE WHEN complete THEN bl ELSE 0 END AS baseline_calls,
  CASE WHEN complete THEN CASE WHEN bt > 0 THEN round(ct / CAST(bt AS DOUBLE) - 1, 6) WHEN ct = 0 THEN 0 END END AS tokens_regression, CASE WHEN complete THEN CASE WHEN bc > 0 THEN round(cc / CAST(bc AS DOUBLE) - 1, 6) WHEN cc = 0 THEN 0 END END AS cost_regression FROM g""")
def _(t):
    """Each even recording's run against that of the next id, by blocks of forty."""
    executions = t.recordings.sparkSession.sql(f"SELECT {RUNS} FROM {{l}}", l=t.lineitem)
    pairs = t.recordings.where("recording_id % 2 = 0").selectExpr("recording_id div 40 AS block", "recording_id AS candidate_run", "recording_id + 1 AS baseline_run")
    return op.efficiency(pairs, executions, "block")


def _measured(name: str, cut: str, stage: str) -> str:
    return f"""{name}x AS (SELECT recording_id % 5 AS scenario, gold_cut, {cut} AS cut, gold AS gold_stage, {stage} AS stage FROM f UNION ALL SELECT NULL, gold_cut, {cut}, gold, {stage} FROM f),
{name}b AS (SELECT scenario, count(*) FILTER (gold_cut AND cut) AS tp, count(*) FILTER (gold_cut) AS g, count(*) FILTER (cut) AS p FROM {name}x GROUP BY 1),
{name}l AS (SELECT scenario, label, 2 * count(*) FILTER (gold_stage = label AND stage = label) AS a, count(*) FILTER (gold_stage = label) + count(*) FILTER (stage = label) AS b FROM (SELECT *, unnest(list_distinct([gold_stage, stage])) AS label FROM {name}x) GROUP BY 1, 2),
{name} AS (SELECT b.scenario, round(2 * tp / CAST(g + p AS DOUBLE), 6) AS boundary_f1, stage_macro_f1 FROM {name}b b JOIN (SELECT scenario, round(avg(round(a / CAST(b AS DOUBLE), 6)), 5) AS stage_macro_f1 FROM {name}l GROUP BY 1) s ON s.scenario IS NOT DISTINCT FROM b.scenario)"""


@query("ev28_segmentation_release", ("segments",), f"""
WITH c AS (SELECT *, last_value(CASE WHEN stage <> 'unknown' THEN stage END IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY start_sec, end_sec, segment_id) AS k FROM segments),
n AS (SELECT *, coalesce(k, 'unknown') AS final, lag(segment_id) OVER w IS NULL AS first_, start_sec - lag(end_sec) OVER w AS pause, lag(speaker) OVER w AS sp0, lag(stage) OVER w AS st0, lag(coalesce(k, 'unknown')) OVER w AS fin0 FROM c WINDOW w AS (PARTITION BY recording_id ORDER BY start_sec, end_sec, segment_id)),
f AS (SELECT recording_id, first_ OR round(least(1.0::DOUBLE, CASE WHEN pause >= 8 THEN 0.55::DOUBLE WHEN pause >= 3 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN final <> fin0 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN speaker <> sp0 THEN 0.08::DOUBLE ELSE 0 END), 4) >= 0.5::DOUBLE AS cut, first_ OR stage = 'greeting' AS gold_cut, CASE WHEN first_ AND stage = 'unknown' THEN 'greeting' ELSE stage END AS gold,
  first_ OR speaker <> sp0 AS cut1, final, coalesce(st0, 'greeting') AS old FROM n),
{_measured('now', 'cut', 'final')}, {_measured('v1', 'cut1', 'old')}
SELECT n.scenario, n.boundary_f1, n.stage_macro_f1, concat_ws(',', CASE WHEN n.scenario IS NULL AND n.boundary_f1 < 0.85::DOUBLE THEN 'boundary_gate' END, CASE WHEN n.scenario IS NULL AND n.stage_macro_f1 < 0.8::DOUBLE THEN 'stage_gate' END, CASE WHEN n.scenario = 3 THEN 'no_baseline' END,
  CASE WHEN n.scenario <> 3 AND n.boundary_f1 < v.boundary_f1 THEN 'boundary_regression' END, CASE WHEN n.scenario <> 3 AND n.stage_macro_f1 < v.stage_macro_f1 THEN 'stage_regression' END) AS failed FROM now n LEFT JOIN v1 v ON v.scenario = n.scenario""")
def _(t):
    """The segmenter against greetings and stated stages, and against one that cuts at each change of speaker and says the stage before."""
    w = W.partitionBy("recording_id").orderBy("start_sec", "end_sec", "segment_id")
    s = sequences.boundary_scores(sequences.carried_stage(t.segments))
    s = s.withColumn("first_", F.lag("segment_id").over(w).isNull()).withColumn("turn", F.coalesce(F.col("speaker") != F.lag("speaker").over(w), F.lit(False))).withColumn("old", F.coalesce(F.lag("stage").over(w), F.lit("greeting")))
    base = [(F.col("recording_id") % 5).alias("scenario"), (F.col("first_") | (F.col("stage") == "greeting")).alias("gold_cut"), F.when(F.col("first_") & (F.col("stage") == "unknown"), "greeting").otherwise(F.col("stage")).alias("gold_stage")]
    now = op.segmentation_scores(s.select(*base, F.coalesce("cut", F.lit(False)).alias("cut"), F.col("final").alias("stage")), "scenario")
    old = op.segmentation_scores(s.select(*base, (F.col("first_") | F.col("turn")).alias("cut"), F.col("old").alias("stage")), "scenario")
    return op.segmentation_release(now, old.where("scenario is null or scenario <> 3"), "scenario")


@query("ev3_entities_strict", ("mentions",), """
WITH p AS (SELECT DISTINCT recording_id, lower(name) AS n, type FROM mentions WHERE position % 3 <> 0), g AS (SELECT DISTINCT recording_id, lower(name) AS n, type FROM mentions WHERE position % 4 <> 0),
f AS (SELECT coalesce(p.recording_id, g.recording_id) AS recording_id, p.n AS a, g.n AS b FROM p FULL JOIN g ON p.recording_id = g.recording_id AND p.n = g.n AND p.type = g.type)
SELECT recording_id, count(b) AS gold, count(a) AS found, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS matched, round(2 * count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / CAST(count(a) + count(b) AS DOUBLE), 6) AS f1 FROM f GROUP BY 1""")
def _(t):
    """Full-width capitals on one side are the same names."""
    wide = t.mentions.where("position % 3 <> 0").withColumn("name", F.concat(F.lit(" "), F.translate("name", "e", "Ｅ")))
    return op.entity_f1(t.mentions.where("position % 4 <> 0"), wide, "recording_id")


@query("ev3_entities_fuzzy", ("mentions",))
def _(t):
    """SQL has no weighted ratio; a test holds the query's operator against plain sets."""
    return op.entity_f1(t.mentions.where("position % 4 <> 0"), t.mentions.where("position % 3 <> 0"), "recording_id", 0.8)
