"""Queries of evaluation and monitoring."""

from pyspark.sql import functions as F

from colloquy.operators import scores as op
from colloquy.plans.registry import query

P = ("predictions",)
Z = "1.959963984540054::DOUBLE"
VALUES = """h AS (SELECT tag_key, expected AS value, expected, predicted FROM predictions UNION ALL SELECT tag_key, predicted, expected, predicted FROM predictions WHERE predicted IS NOT NULL AND predicted <> expected),
v AS (SELECT tag_key, value, count(*) FILTER (expected = value AND predicted = value) AS tp, count(*) FILTER (expected <> value AND predicted = value) AS fp, count(*) FILTER (expected = value AND (predicted IS NULL OR predicted <> value)) AS fn FROM h GROUP BY 1, 2)"""
TWO = """n AS (SELECT tag_key, coalesce(predicted, '__missing__') AS b, count(*) FILTER (side = 'candidate') AS l, count(*) FILTER (side = 'base') AS r FROM predictions GROUP BY 1, 2),
t AS (SELECT tag_key, CAST(sum(l) AS DOUBLE) AS ln, CAST(sum(r) AS DOUBLE) AS rn, count(*) AS kinds FROM n GROUP BY 1)"""


@query("ev11_confusion", P, "SELECT tag_key, coalesce(expected, '__absent__') AS expected, coalesce(predicted, '__missing__') AS predicted, count(*) AS n FROM predictions GROUP BY 1, 2, 3")
def _(t):
    return op.confusion(t.predictions)


def bound(hits, n):
    return f"greatest(0::DOUBLE, (({hits}) / {n} + {Z} * {Z} / (2 * {n}) - {Z} * sqrt((({hits}) / {n} * (1 - ({hits}) / {n}) + {Z} * {Z} / (4 * {n})) / {n})) / (1 + {Z} * {Z} / {n}))"


@query("ev10_value_scores", P, f"WITH {VALUES} SELECT tag_key, value, tp, fp, fn, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1, round({bound('tp::DOUBLE', '(tp + fn)')}, 6) AS recall_bound FROM v")
def _(t):
    return op.value_scores(t.predictions)


@query("ev27_macro_f1", P, f"WITH {VALUES} SELECT tag_key, round(avg(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE)), 5) AS macro_f1 FROM v GROUP BY 1")
def _(t):
    f1 = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return op.value_scores(t.predictions).groupBy("tag_key").agg(F.round(F.avg(f1), 5).alias("macro_f1"))


@query("ev5_tag_accuracy", P, "SELECT tag_key, cohort, round(count(*) FILTER (predicted = expected) / CAST(count(*) AS DOUBLE), 6) AS accuracy FROM predictions GROUP BY 1, 2")
def _(t):
    return t.predictions.groupBy("tag_key", "cohort").agg(F.round(F.count_if(F.col("predicted") == F.col("expected")) / F.count("*"), 6).alias("accuracy"))


@query("ev13_paired_comparison", P, f"""
WITH d AS (SELECT cohort, confidence - probability AS d FROM predictions) SELECT cohort, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses, count(*) FILTER (d = 0) AS ties, round(avg(d), 6) AS mean, round({Z} * sqrt(var_samp(d) / count(*)), 6) AS margin FROM d GROUP BY 1""")
def _(t):
    return op.paired(t.predictions, "cohort", "confidence", "probability")


@query("ev14_calibration", P, """
WITH b AS (SELECT least(floor(confidence * 10), 9) AS bin, confidence, CASE WHEN expected = predicted THEN 1 ELSE 0 END AS r FROM predictions WHERE predicted IS NOT NULL), g AS (SELECT bin, count(*) AS n, avg(confidence) AS c, avg(r) AS r, sum((confidence - r) ** 2) AS sq FROM b GROUP BY 1)
SELECT round(sum(sq) / sum(n), 6) AS brier, round(sum(n * abs(c - r)) / sum(n), 6) AS ece FROM g""")
def _(t):
    return op.calibration(t.predictions)


@query("ev18_jensen_shannon", P, f"""WITH {TWO}, x AS (SELECT tag_key, ln, rn, l / ln AS p, r / rn AS q FROM n JOIN t USING (tag_key)),
d AS (SELECT tag_key, ln, rn, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS d FROM x GROUP BY 1, 2, 3)
SELECT tag_key, round(greatest(0::DOUBLE, least(1::DOUBLE, d)), 6) AS jsd, ln >= 30 AND rn >= 30 AS eligible, ln >= 30 AND rn >= 30 AND d > 0.1::DOUBLE AS breach FROM d""")
def _(t):
    p = t.predictions.withColumn("b", F.coalesce("predicted", F.lit("__missing__")))
    return op.jensen_shannon(p, ["tag_key"], "b", "side", "candidate", "base")


@query("ev19_psi", P, f"""WITH {TWO}, x AS (SELECT tag_key, (l + 1e-6::DOUBLE) / (ln + 1e-6::DOUBLE * kinds) AS p, (r + 1e-6::DOUBLE) / (rn + 1e-6::DOUBLE * kinds) AS q FROM n JOIN t USING (tag_key)) SELECT tag_key, round(sum((p - q) * ln(p / q)), 6) AS psi FROM x GROUP BY 1""")
def _(t):
    p = t.predictions.withColumn("b", F.coalesce("predicted", F.lit("__missing__")))
    return op.psi(p, ["tag_key"], "b", "side", "candidate", "base")


@query("ev21_input_drift", ("segments",), """
WITH n AS (SELECT speaker, least(tokens // 10, 3) AS b, count(*) FILTER (recording_id % 2 = 0) AS l, count(*) FILTER (recording_id % 2 <> 0) AS r FROM segments GROUP BY 1, 2), t AS (SELECT speaker, CAST(sum(l) AS DOUBLE) AS ln, CAST(sum(r) AS DOUBLE) AS rn, count(*) AS kinds FROM n GROUP BY 1),
x AS (SELECT speaker, (l + 1e-6::DOUBLE) / (ln + 1e-6::DOUBLE * kinds) AS p, (r + 1e-6::DOUBLE) / (rn + 1e-6::DOUBLE * kinds) AS q FROM n JOIN t USING (speaker)) SELECT speaker, round(sum((p - q) * ln(p / q)), 6) AS psi FROM x GROUP BY 1""")
def _(t):
    s = t.segments.withColumn("b", F.least(F.expr("tokens div 10"), F.lit(3))).withColumn("side", F.when(F.col("recording_id") % 2 == 0, "now").otherwise("before"))
    return op.psi(s, ["speaker"], "b", "side", "now", "before")


@query("ev24_weighted_recall", P, """
WITH w AS (SELECT tag_key, 1 / probability AS w, expected = predicted AS hit FROM predictions WHERE probability > 0 AND probability <= 1) SELECT tag_key, round(sum(CASE WHEN hit THEN w ELSE 0 END) / sum(w), 6) AS recall, round(sum(w) ** 2 / sum(w * w), 6) AS ess FROM w GROUP BY 1""")
def _(t):
    return op.weighted_recall(t.predictions, "tag_key")


@query("win18_threshold_sweep", P, """
WITH n AS (SELECT confidence AS threshold, count(*) FILTER (expected = predicted) AS s, count(*) FILTER (expected <> predicted) AS d FROM predictions WHERE predicted IS NOT NULL GROUP BY 1),
r AS (SELECT threshold, sum(s) OVER w AS sa, sum(d) OVER w AS da, (SELECT sum(s) FROM n) AS sn, (SELECT sum(d) FROM n) AS dn FROM n WINDOW w AS (ORDER BY threshold DESC)) SELECT threshold, round(da / CAST(dn AS DOUBLE), 6) AS far, round(1 - sa / CAST(sn AS DOUBLE), 6) AS frr FROM r""")
def _(t):
    p = t.predictions.where("predicted is not null").withColumn("same", F.col("expected") == F.col("predicted"))
    return op.sweep(p, "confidence", "same").select("threshold", "far", "frr")


@query("ev22_efficiency_regression", P, """
SELECT tag_key, round(CAST(sum(CASE WHEN side = 'candidate' THEN confidence END) AS DOUBLE) / sum(CASE WHEN side = 'base' THEN confidence END) - 1, 6) AS ratio FROM predictions GROUP BY 1""")
def _(t):
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("confidence")))
    return t.predictions.groupBy("tag_key").agg(F.round(side("candidate") / side("base") - 1, 6).alias("ratio"))


@query("ev29_release_gates", P, f"""WITH {VALUES}, s AS (SELECT tag_key, avg(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE)) AS f, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(tp + fn) AS DOUBLE) AS n FROM v GROUP BY 1),
q AS (SELECT tag_key, avg(CASE WHEN probability > 0.25::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS e, avg(CASE WHEN predicted IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS x FROM predictions GROUP BY 1)
SELECT tag_key, concat_ws(',', CASE WHEN f < 0.8::DOUBLE THEN 'macro_f1' END, CASE WHEN {bound('tp', 'n')} < 0.95::DOUBLE THEN 'critical_recall' END, CASE WHEN e < 0.98::DOUBLE THEN 'evidence' END, CASE WHEN x >= 0.01::DOUBLE THEN 'error_rate' END, CASE WHEN n < 30 THEN 'insufficient' END) AS failed FROM s JOIN q USING (tag_key)""")
def _(t):
    v = op.value_scores(t.predictions)
    s = v.groupBy("tag_key").agg(F.avg(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("macro_f1"), F.sum("tp").alias("tp"), F.sum(F.col("tp") + F.col("fn")).alias("support"))
    q = t.predictions.groupBy("tag_key").agg(F.avg((F.col("probability") > 0.25).cast("int")).alias("evidence"), F.avg(F.col("predicted").isNull().cast("int")).alias("errors"))
    return op.gates(s.join(q, "tag_key").withColumn("bound", op.wilson(F.col("tp").cast("double"), F.col("support").cast("double"))))


@query("ev1_context_precision", ("turns",), """
WITH g AS (SELECT conv_id AS query, list(turn ORDER BY turn) FILTER (turn % 2 = 0) AS gold, list(turn ORDER BY turn DESC) AS got FROM turns GROUP BY 1) SELECT query, round(len(list_intersect(got[1:3], gold)) / CAST(least(3, len(gold)) AS DOUBLE), 6) AS precision, round(len(list_intersect(got, gold)) / CAST(len(gold) AS DOUBLE), 6) AS recall FROM g""")
def _(t):
    g = t.turns.groupBy(F.col("conv_id").alias("query")).agg(F.array_sort(F.collect_set(F.when(F.col("turn") % 2 == 0, F.col("turn")))).alias("gold"), F.sort_array(F.collect_list("turn"), asc=False).alias("got"))
    return op.precision_recall(g, 3)


@query("ev15_interval_iou", ("segments",), """
WITH g AS (SELECT DISTINCT recording_id, start_sec AS gs, end_sec AS ge FROM segments WHERE idx % 2 = 0), p AS (SELECT recording_id, start_sec AS ps, end_sec AS pe FROM segments WHERE idx % 2 = 1),
b AS (SELECT g.recording_id, gs, ge, coalesce(max(greatest(0, least(ge, pe) - greatest(gs, ps)) / CAST(greatest(ge, pe) - least(gs, ps) AS DOUBLE)) FILTER (pe IS NOT NULL), 0) AS iou FROM g LEFT JOIN p ON g.recording_id = p.recording_id GROUP BY 1, 2, 3) SELECT recording_id, round(avg(iou), 6) AS iou FROM b GROUP BY 1""")
def _(t):
    gold = t.segments.where("idx % 2 = 0").selectExpr("recording_id", "start_sec g_start", "end_sec g_end").distinct()
    pred = t.segments.where("idx % 2 = 1").selectExpr("recording_id", "start_sec p_start", "end_sec p_end")
    return op.interval_iou(pred, gold, "recording_id")
