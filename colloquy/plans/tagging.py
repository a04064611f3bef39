"""Queries of tags."""

from pyspark.sql import functions as F

from colloquy.operators import tagging as op
from colloquy.plans.registry import query

A = ("assignments",)
G = ["rules", "model", "review"]
LAST = "last AS (SELECT * FROM assignments QUALIFY row_number() OVER (PARTITION BY target_id, label_key, group_key ORDER BY assignment_id DESC) = 1)"


@query("tag1_matrix", A, f"""WITH {LAST} SELECT target_id, label_key, max(CASE WHEN group_key = 'rules' THEN value END) AS rules, max(CASE WHEN group_key = 'model' THEN value END) AS model, max(CASE WHEN group_key = 'review' THEN value END) AS review,
count(*) < 3 AS missing, count(DISTINCT value) > 1 AS conflict FROM last GROUP BY 1, 2""")
def _(t):
    return op.matrix(op.cells(t.assignments), G)


@query("tag2_merge_strategies", A, f"""WITH {LAST}, x AS (SELECT target_id, label_key, string_agg(DISTINCT value, ',' ORDER BY value) AS u, string_agg(DISTINCT CASE WHEN is_manual THEN value END, ',' ORDER BY CASE WHEN is_manual THEN value END) AS m,
count(*) AS n, count(DISTINCT value) AS k, max_by(value, (priority, value)) AS p FROM last GROUP BY 1, 2)
SELECT target_id, label_key, u AS all, CASE WHEN n = 3 AND k = 1 THEN u ELSE '' END AS agreed, p AS by_priority, coalesce(m, u) AS manual_wins FROM x""")
def _(t):
    return op.merged(op.cells(t.assignments), G)


@query("agg6_coverage", A, f"""WITH {LAST}, c AS (SELECT count(*) AS cells FROM (SELECT DISTINCT target_id, label_key FROM last)), g AS (SELECT unnest(['rules', 'model', 'review', 'unused']) AS group_key)
SELECT g.group_key, count(last.value) AS assigned, any_value(cells) - count(last.value) AS missing, round(count(last.value) / CAST(any_value(cells) AS DOUBLE), 6) AS rate FROM g CROSS JOIN c LEFT JOIN last USING (group_key) GROUP BY 1""")
def _(t):
    return op.coverage(op.cells(t.assignments), [*G, "unused"])


@query("agg7_agreement", A, f"""WITH {LAST}, s AS (SELECT group_key, count(*) AS n FROM last GROUP BY 1),
p AS (SELECT a.group_key AS left, b.group_key AS right, count(*) AS comparable, count(*) FILTER (a.value = b.value) AS agreements FROM last a JOIN last b USING (target_id, label_key) WHERE a.group_key < b.group_key GROUP BY 1, 2)
SELECT p.left, p.right, comparable, agreements, l.n - comparable AS left_only, r.n - comparable AS right_only, round(agreements / CAST(comparable AS DOUBLE), 6) AS rate FROM p JOIN s l ON l.group_key = p.left JOIN s r ON r.group_key = p.right""")
def _(t):
    return op.agreement(op.cells(t.assignments))


@query("agg8_distribution", A, f"WITH {LAST} SELECT group_key, label_key, value, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY group_key, label_key) AS DOUBLE), 6) AS share FROM last GROUP BY 1, 2, 3")
def _(t):
    return op.distribution(op.cells(t.assignments), ["group_key", "label_key"], "value")


@query("agg10_cooccurrence", A, f"""WITH {LAST}, k AS (SELECT DISTINCT group_key, target_id, label_key || '=' || value AS token FROM last)
SELECT a.group_key, a.token AS left, b.token AS right, count(*) AS n FROM k a JOIN k b USING (group_key, target_id) WHERE a.token < b.token GROUP BY 1, 2, 3 ORDER BY n DESC, 1, 2, 3 LIMIT 25""")
def _(t):
    return op.cooccurrence(op.cells(t.assignments), 25)


@query("agg11_confidence_histogram", A, "SELECT group_key, CASE WHEN confidence IS NULL THEN 'unknown' ELSE CAST(CAST(least(floor(confidence * 5), 4) AS BIGINT) AS STRING) END AS bucket, count(*) AS n, round(avg(confidence), 6) AS mean FROM assignments GROUP BY 1, 2")
def _(t):
    return op.confidence_histogram(t.assignments)


@query("agg12_by_dimension", A, f"""WITH {LAST}, d AS (SELECT 'store' AS dimension, CAST(store_id AS STRING) AS member, group_key, target_id, confidence FROM last UNION ALL SELECT 'agent', CAST(agent_id AS STRING), group_key, target_id, confidence FROM last)
SELECT dimension, member, group_key, count(*) AS n, count(DISTINCT target_id) AS targets, round(avg(confidence), 6) AS confidence FROM d GROUP BY 1, 2, 3""")
def _(t):
    return op.by_dimension(op.cells(t.assignments))


@query("agg13_overview", A, f"""WITH {LAST}, m AS (SELECT count(*) < 3 AS missing, count(DISTINCT value) > 1 AS conflict FROM last GROUP BY target_id, label_key)
SELECT count(*) AS cells, count(*) FILTER (NOT missing) AS complete, count(*) FILTER (conflict) AS conflicts, round(count(*) FILTER (conflict) / CAST(count(*) AS DOUBLE), 6) AS conflict_rate FROM m""")
def _(t):
    m = op.matrix(op.cells(t.assignments), G)
    return m.agg(F.count("*").alias("cells"), F.count_if(~F.col("missing")).alias("complete"), F.count_if("conflict").alias("conflicts"), F.round(F.count_if("conflict") / F.count("*"), 6).alias("conflict_rate"))


@query("agg5_incremental_counts", A, """
WITH d AS (SELECT value, 1 AS delta FROM assignments UNION ALL SELECT lag(value) OVER (PARTITION BY target_id, label_key, group_key ORDER BY assignment_id), -1 FROM assignments)
SELECT value, greatest(CAST(sum(delta) AS BIGINT), 0) AS n FROM d WHERE value IS NOT NULL GROUP BY 1""")
def _(t):
    v = op.versions(t.assignments)
    deltas = t.assignments.select("value", F.lit(1).alias("delta")).unionByName(v.where("previous is not null").select(F.col("previous").alias("value"), F.lit(-1).alias("delta")))
    return deltas.groupBy("value").agg(F.greatest(F.sum("delta"), F.lit(0)).alias("n"))


@query("win6_versions", A, "SELECT assignment_id, target_id, label_key, row_number() OVER w AS version, lag(value) OVER w AS previous FROM assignments WINDOW w AS (PARTITION BY target_id, label_key, group_key ORDER BY assignment_id)")
def _(t):
    return op.versions(t.assignments)


@query("tag5_rule_tags", ("turns",), """
WITH h AS (SELECT conv_id, turn, CAST((length(lower(text)) - length(replace(lower(text), 'th', ''))) // 2 AS BIGINT) AS a, CAST((length(lower(text)) - length(replace(lower(text), 'er', ''))) // 2 AS BIGINT) AS b FROM turns)
SELECT conv_id, turn, 'sound' AS label, CASE WHEN a >= b THEN 'th' ELSE 'er' END AS option, greatest(a, b) AS hits, round(least(0.99::DOUBLE, 0.7::DOUBLE + 0.01::DOUBLE * (greatest(a, b) - 1)), 4) AS confidence FROM h WHERE greatest(a, b) > 0""")
def _(t):
    return op.rule_tags(t.turns, {"sound": {"th": ["th"], "er": ["er"]}})


@query("tag8_fusion", A, f"WITH {LAST} SELECT target_id, label_key, max_by(value, (priority, value)) AS value, count(DISTINCT value) > 1 AS review FROM last GROUP BY 1, 2")
def _(t):
    return op.fused(op.cells(t.assignments))


@query("tag10_canary_routing", ("recordings",), """
WITH b AS (SELECT recording_id, ['shadow', 'canary_5', 'canary_25', 'awaiting_admin', 'production', 'retired'][agent_id % 6 + 1] AS s, CAST('0x' || left(sha256(CAST(recording_id AS STRING) || '|d' || CAST(agent_id AS STRING)), 8) AS BIGINT) % 100 AS bucket FROM recordings),
c AS (SELECT *, bucket < CASE s WHEN 'canary_5' THEN 5 WHEN 'canary_25' THEN 25 WHEN 'awaiting_admin' THEN 60 WHEN 'production' THEN 100 ELSE 0 END AS publishes FROM b) SELECT recording_id, bucket, CASE WHEN s = 'shadow' THEN bucket < 10 ELSE publishes END AS runs, publishes FROM c""")
def _(t):
    status = F.get(F.array(*[F.lit(x) for x in ("shadow", "canary_5", "canary_25", "awaiting_admin", "production", "retired")]), (F.col("agent_id") % 6).cast("int"))
    deployment = F.concat(F.lit("d"), F.col("agent_id").cast("string"))
    return op.routed(t.recordings, "recording_id", deployment, status, F.lit(60), F.lit(10)).select("recording_id", "bucket", "runs", "publishes")


@query("tag17_canonical_overrides", A, "SELECT assignment_id FROM assignments a WHERE is_manual OR NOT EXISTS (SELECT 1 FROM assignments m WHERE m.is_manual AND m.target_id = a.target_id AND m.label_key = a.label_key)")
def _(t):
    return op.overridden(t.assignments.where("is_manual"), t.assignments.where("not is_manual")).select("assignment_id")
