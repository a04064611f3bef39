"""Queries of upkeep: merging, soft deletion, projections, current values, batches, reports."""

from pyspark.sql import functions as F

from colloquy.operators import graphs, sequences, tabular, tagging
from colloquy.operators import upkeep as op
from colloquy.operators.matching import speaker_scores, speaker_verdicts
from colloquy.plans.registry import query

R, S, A, E, T, M, L, C, P = ("receptions",), ("segments",), ("assignments",), ("edges",), ("transitions",), ("mentions",), ("links",), ("turns",), ("predictions",)
MR = ("mentions", "relations")
TYPES = "ty AS (SELECT name, type, count(*) AS n, min(position) AS seen FROM mentions GROUP BY 1, 2), b AS (SELECT name, type FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, seen) AS k FROM ty) WHERE k = 1)"


@query("join14_speaker_verdicts", ("vectors",), """
WITH s AS (SELECT vec_id AS q, label AS candidate, CAST(vec_id * 7 % 100 AS DOUBLE) / 100 AS score, CASE WHEN vec_id % 3 <> 0 THEN CAST(vec_id % 11 AS DOUBLE) / 10 END AS cosine FROM vectors),
x AS (SELECT q // 4 AS query, max_by(struct_pack(c := candidate, s := score, v := cosine), (score, -candidate)) AS b FROM s GROUP BY 1)
SELECT query, CASE WHEN b.s >= 0.7::DOUBLE THEN b.c END AS candidate, CASE WHEN b.s >= 0.85::DOUBLE AND coalesce(b.v >= 0.7::DOUBLE, false) THEN 'CONFIRMED' WHEN b.s >= 0.85::DOUBLE THEN 'AMBIGUOUS' WHEN b.s >= 0.7::DOUBLE THEN 'INFERRED' ELSE 'NO_MATCH' END AS verdict,
b.s >= 0.85::DOUBLE AND NOT coalesce(b.v >= 0.7::DOUBLE, false) AS reconfirm FROM x""".replace("vec_id * 7 % 100", "(vec_id * 7) % 101"))
def _(t):
    s = t.vectors.select(F.expr("vec_id div 4").alias("query"), F.col("label").alias("candidate"), ((F.col("vec_id") * 7 % 101) / 100).alias("score"), F.when(F.col("vec_id") % 3 != 0, (F.col("vec_id") % 11) / 10).alias("cosine"))
    return speaker_verdicts(s)


@query("join14_speaker_names", ("part",))
def _(t):
    """Who of the named parts of its size a name with a letter less and its words the other way round means."""
    tenant = (F.col("p_size") % 10).cast("string").alias("tenant")
    words = F.split("p_name", " ")
    said = F.concat(words[1], F.lit(" "), F.left(words[0], F.length(words[0]) - 1))
    none = F.lit(None).cast("array<double>").alias("vector")
    queries = t.part.select(F.col("p_partkey").alias("query"), tenant, said.alias("name"), none)
    speakers = t.part.groupBy("p_name", tenant).agg(F.min("p_partkey").alias("candidate")).select("candidate", "tenant", F.col("p_name").alias("name"), none)
    return speaker_verdicts(speaker_scores(queries, speakers))


@query("agg16_description_concat", M, "WITH d AS (SELECT name, description, min(position) AS p FROM mentions GROUP BY 1, 2) SELECT name, left(string_agg(description, ' | ' ORDER BY p), 512) AS description FROM d GROUP BY 1")
def _(t):
    return graphs.merged_nodes(t.mentions).select("name", "description")


@query("agg17_ordered_union", M, "WITH d AS (SELECT name, source_id, min(position) AS p FROM mentions GROUP BY 1, 2) SELECT name, string_agg(source_id, ',' ORDER BY p, source_id) AS sources FROM d GROUP BY 1")
def _(t):
    return op.ordered_union(t.mentions, "name", "position", "source_id").select("name", F.array_join("values", ",").alias("sources"))


@query("set5_upserted_arrays", M, """
WITH o AS (SELECT name, list(source_id ORDER BY source_id) AS o FROM (SELECT DISTINCT name, source_id FROM mentions WHERE recording_id % 2 = 0) GROUP BY 1), n AS (SELECT name, list(source_id ORDER BY source_id) AS n FROM (SELECT DISTINCT name, source_id FROM mentions WHERE recording_id % 3 = 0) GROUP BY 1)
SELECT coalesce(o.name, n.name) AS name, len(coalesce(o, [])) + len(list_filter(coalesce(n, []), lambda x: NOT list_contains(coalesce(o, []), x))) AS n FROM o FULL JOIN n ON o.name = n.name""")
def _(t):
    side = lambda k, c: t.mentions.where(F.col("recording_id") % k == 0).groupBy("name").agg(F.array_sort(F.collect_set("source_id")).alias(c))
    both = side(2, "o").join(side(3, "n"), "name", "full_outer")
    return both.select("name", F.size(op.upserted_arrays(F.col("o"), F.col("n"))).cast("long").alias("n"))


@query("gr25_merge_pairs", ("edges", "mentions"), f"""
WITH {TYPES}, deg AS (SELECT name, count(*) AS degree FROM (SELECT source AS name FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1),
n AS (SELECT name, CAST(substr(name, 2) AS BIGINT) AS id, type || '|' || CAST(substr(name, 2) AS BIGINT) % 4 AS g FROM b JOIN deg USING (name) WHERE degree <= 30), v0 AS (SELECT name, id, g, name AS x, 0 AS n FROM n),
v1 AS (SELECT DISTINCT name, id, g, left(x, i - 1) || substr(x, i + 1) AS x, 1 AS n FROM (SELECT *, unnest(range(1, length(x) + 1)) AS i FROM v0)), v2 AS (SELECT DISTINCT name, id, g, left(x, i - 1) || substr(x, i + 1) AS x, 2 AS n FROM (SELECT *, unnest(range(1, length(x) + 1)) AS i FROM v1)),
v AS (SELECT * FROM v0 UNION ALL SELECT * FROM v1 UNION ALL SELECT * FROM v2), p AS (SELECT a.id AS canonical_id, b.id AS source_id, length(a.name) + length(b.name) AS l, min(a.n + b.n) AS d FROM v a JOIN v b ON a.x = b.x AND a.g = b.g AND a.id < b.id AND a.n + b.n <= 2 GROUP BY 1, 2, 3),
s AS (SELECT source_id, canonical_id, 100.0::DOUBLE * (l - d) / l AS score FROM p WHERE 100.0::DOUBLE * (l - d) / l >= 85) SELECT source_id, canonical_id, CAST(floor(score) AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY floor(score) DESC, canonical_id) AS k FROM s) WHERE k = 1""")
def _(t):
    n = graphs.node_types(t.mentions).join(graphs.degrees(t.edges), "name")
    number = F.substr("name", F.lit(2)).cast("long")
    nodes = n.select(number.alias("entity_id"), "name", "type", (number % 4).alias("community"), "degree", F.lit(None).cast("long").alias("expired_at"))
    return op.merge_pairs(nodes, most_degree=30)


@query("gr26_soft_delete", ("edges", "mentions"), "WITH g AS (SELECT DISTINCT name FROM mentions WHERE type = 'brand' AND recording_id <= 500) SELECT edge_id, coalesce(expired_at, CASE WHEN source IN (SELECT name FROM g) OR target IN (SELECT name FROM g) THEN 999 END) AS expired_at FROM edges")
def _(t):
    gone = t.mentions.where("type = 'brand' and recording_id <= 500").select("name")
    nodes = t.mentions.select("name").distinct().withColumn("expired_at", F.lit(None).cast("long"))
    return op.soft_deleted(nodes, t.edges, gone, 999)[1].select("edge_id", "expired_at")


@query("gr30_topic_clusters", M, """
WITH c AS (SELECT recording_id % 200 AS cluster, 'topic ' || CAST(recording_id % 200 AS STRING) AS title, list(DISTINCT name) AS members FROM mentions WHERE recording_id % 2 = 1 GROUP BY 1, 2), f AS (SELECT * FROM c WHERE contains(title, '13') OR len(list_filter(members, lambda m: contains(m, '13'))) > 0)
SELECT cluster, title, len(members) AS members, (SELECT count(DISTINCT m) FROM (SELECT unnest(members) AS m FROM f)) AS total FROM f""")
def _(t):
    rows = t.mentions.groupBy((F.col("recording_id") % 200).alias("cluster"), (F.col("recording_id") % 2).alias("job")).agg(F.collect_set("name").alias("members"))
    return op.topic_clusters(rows.withColumn("title", F.concat(F.lit("topic "), F.col("cluster").cast("string"))).withColumn("level", F.lit(0)), 1, 0, "13")


@query("gr32_remapped_edges", E, """
WITH c AS (SELECT DISTINCT source AS name, source AS canonical FROM edges WHERE CAST(substr(source, 2) AS BIGINT) % 5 <> 0 UNION SELECT DISTINCT source, 'e' || CAST(CAST(substr(source, 2) AS BIGINT) // 5 AS STRING) FROM edges WHERE CAST(substr(source, 2) AS BIGINT) % 5 = 0)
SELECT edge_id, coalesce(a.canonical, source) AS source, coalesce(b.canonical, target) AS target, CASE WHEN coalesce(a.canonical, source) <> source OR coalesce(b.canonical, target) <> target THEN 'AMBIGUOUS' ELSE confidence END AS confidence FROM edges LEFT JOIN c a ON a.name = source LEFT JOIN c b ON b.name = target""")
def _(t):
    n = F.substr("name", F.lit(2)).cast("long")
    names = t.edges.select(F.col("source").alias("name")).distinct()
    return op.remapped_edges(t.edges, names.select("name", F.when(n % 5 == 0, F.concat(F.lit("e"), F.expr("cast(substr(name, 2) as bigint) div 5").cast("string"))).otherwise(F.col("name")).alias("canonical")))


@query("win5_latest_facts", A, """
WITH d AS (SELECT target_id AS run, label_key AS tag, priority AS revision, assignment_id AS id, value FROM assignments WHERE target_id % 3 <> 0), c AS (SELECT DISTINCT target_id AS run, target_id + 1 AS of_run FROM assignments WHERE target_id % 3 = 0),
a AS (SELECT * FROM d UNION ALL SELECT c.run, tag, revision, id, value FROM c JOIN d ON d.run = of_run) SELECT run, tag, max_by(value, (revision, id)) AS value FROM a GROUP BY 1, 2""")
def _(t):
    d = t.assignments.where("target_id % 3 <> 0").select(F.col("target_id").alias("run"), F.col("label_key").alias("tag"), F.col("priority").alias("revision"), F.col("assignment_id").alias("id"), "value")
    c = t.assignments.where("target_id % 3 = 0").select(F.col("target_id").alias("run"), (F.col("target_id") + 1).alias("of_run")).distinct()
    return op.latest_facts(d, c)


@query("tag12_current_upsert", A, "SELECT target_id, label_key, max_by(value, (priority, assignment_id)) AS value FROM assignments GROUP BY 1, 2")
def _(t):
    rows = t.assignments.select("target_id", "label_key", "value", F.col("priority").alias("revision"), F.col("assignment_id").alias("id"))
    current = tabular.latest(rows.where("revision < 30"), ["target_id", "label_key"], ["revision", "id"])
    return op.current_upsert(current, rows.where("revision = 30"), ["target_id", "label_key"]).select("target_id", "label_key", "value")


@query("win20_latest_group_versions", A, """
WITH v AS (SELECT group_key, value AS version, max(assignment_id) AS m FROM assignments GROUP BY 1, 2), o AS (SELECT group_key, max_by(version, (m, version)) AS version, max(m) AS m FROM v GROUP BY 1) SELECT group_key, version, m AS assigned_at FROM o ORDER BY m DESC, group_key LIMIT 8""")
def _(t):
    return op.latest_group_versions(t.assignments.select("group_key", F.col("value").alias("version"), F.col("assignment_id").alias("assigned_at")))


@query("win13_edited_stages", T, """
WITH e AS (SELECT reception_id, sequence_no, 'edited' AS state FROM transitions WHERE transition_id % 9 = 0) SELECT transition_id, coalesce(f.state, from_state) AS from_state, coalesce(g.state, to_state) AS to_state FROM transitions t
LEFT JOIN e g ON g.reception_id = t.reception_id AND g.sequence_no = t.sequence_no LEFT JOIN e f ON f.reception_id = t.reception_id AND f.sequence_no + 1 = t.sequence_no""")
def _(t):
    edits = t.transitions.where("transition_id % 9 = 0").select("reception_id", "sequence_no", F.lit("edited").alias("state"))
    return op.edited_stages(t.transitions, edits).select("transition_id", "from_state", "to_state")


@query("tag3_insight_report", A, """
WITH l AS (SELECT target_id, label_key, group_key, value, store_id AS s, agent_id AS a, confidence AS c FROM (SELECT *, row_number() OVER (PARTITION BY target_id, label_key, group_key ORDER BY assignment_id DESC, value DESC, confidence DESC NULLS LAST, store_id DESC NULLS LAST, agent_id DESC, occurred_at DESC) AS k FROM assignments) WHERE k = 1)
SELECT 'matrix' AS part, count(*) AS n FROM (SELECT DISTINCT target_id, label_key FROM l) UNION ALL SELECT 'merged', count(*) FROM (SELECT DISTINCT target_id, label_key FROM l) UNION ALL SELECT 'coverage', 3 UNION ALL SELECT 'agreement', 3
UNION ALL SELECT 'distribution', count(*) FROM (SELECT DISTINCT group_key, label_key, value FROM l) UNION ALL SELECT 'confidence', count(*) FROM (SELECT DISTINCT group_key, CASE WHEN c IS NULL THEN -1 ELSE least(floor(c * 5), 4) END FROM l)
UNION ALL SELECT 'dimensions', count(*) FROM (SELECT DISTINCT 'store', s, group_key FROM l UNION SELECT DISTINCT 'agent', a, group_key FROM l)""")
def _(t):
    parts = op.insight_report(tagging.cells(t.assignments), ["rules", "model", "review"])
    out = None
    for name in ("matrix", "merged", "coverage", "agreement", "distribution", "confidence", "dimensions"):
        one = parts[name].agg(F.lit(name).alias("part"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("tag4_insight_load", ("receptions", "assignments"), """
WITH p AS (SELECT reception_id AS target_id FROM receptions ORDER BY started_sec DESC, reception_id DESC LIMIT 40), m AS (SELECT a.* FROM assignments a JOIN p USING (target_id)), c AS (SELECT * FROM m WHERE group_key IN ('rules', 'model') AND assignment_id % 2 = 0)
SELECT assignment_id FROM c UNION ALL SELECT assignment_id FROM m x WHERE assignment_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM c WHERE c.target_id = x.target_id AND c.label_key = x.label_key)""")
def _(t):
    side = lambda k: t.assignments.where(F.col("assignment_id") % 2 == k)
    groups = t.assignments.where("group_key in ('rules', 'model')").select("group_key").distinct()
    return op.insight_load(t.receptions, side(0), side(1), groups, 40).select("assignment_id")


@query("tag16_prompt_batches", C, """
WITH RECURSIVE s AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM turns WHERE length(coalesce(text, '')) > 0),
f AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS turn, CAST(0 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS used FROM (SELECT DISTINCT conv_id FROM s)
 UNION ALL SELECT f.conv_id, s.k, s.turn, CASE WHEN used = 0 OR used + 1 + n <= 300 THEN batch + (greatest(n, 1) - 1) // 300 ELSE batch + 1 + (n - 1) // 300 END,
  CASE WHEN used > 0 AND used + 1 + n <= 300 THEN used + 1 + n WHEN n % 300 = 0 THEN 300 ELSE n % 300 END FROM f JOIN s ON s.conv_id = f.conv_id AND s.k = f.k + 1)
SELECT conv_id, turn, batch AS last_batch FROM f WHERE k > 0""")
def _(t):
    b = op.prompt_batches(t.turns, "conv_id", "turn", "text", 300)
    return b.groupBy("conv_id", "turn").agg(F.max("batch").alias("last_batch"))


@query("tag18_bootstrap_candidates", P, "SELECT subject_id AS example, tag_key FROM predictions WHERE side = 'base' AND expected = 'v1' ORDER BY subject_id LIMIT 50")
def _(t):
    gold = t.predictions.where("expected = 'v1'").select(F.col("subject_id").alias("example"), "tag_key", F.when(F.col("side") == "base", "train").otherwise("test").alias("split"))
    return op.bootstrap_candidates(gold, 50).select("example", "tag_key")


@query("tag9_dependency_order", ("transitions",), """
WITH RECURSIVE n AS (SELECT DISTINCT 'w' || CAST(sequence_no % 40 + 1 AS STRING) AS tag, 'w' || CAST((sequence_no % 40) // 2 AS STRING) AS up FROM transitions), t AS (SELECT tag FROM n UNION SELECT up FROM n),
d AS (SELECT tag, 0 AS depth FROM t UNION SELECT n.tag, d.depth + 1 FROM n JOIN d ON n.up = d.tag) SELECT tag, max(depth) AS depth FROM d GROUP BY 1""")
def _(t):
    k = F.col("sequence_no") % 40
    needs = t.transitions.select(F.concat(F.lit("w"), (k + 1).cast("string")).alias("tag"), F.concat(F.lit("w"), F.floor(k / 2).cast("string")).alias("on")).distinct()
    tags = needs.select("tag").union(needs.select("on")).distinct()
    return op.dependency_order(tags, needs)


@query("gr8_shortest_paths", L, """
WITH sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links), h1 AS (SELECT b AS node, min([7::BIGINT, b]) AS p FROM sym WHERE a = 7 AND b <> 7 GROUP BY 1),
h2 AS (SELECT b AS node, min(list_append(p, b)) AS p FROM sym JOIN h1 ON a = node WHERE b <> 7 AND b NOT IN (SELECT node FROM h1) GROUP BY 1) SELECT 7 AS node, '7' AS path UNION ALL SELECT node, array_to_string(p, '-') FROM h1 UNION ALL SELECT node, array_to_string(p, '-') FROM h2""")
def _(t):
    return op.paths(t.links, 7, 2).select("node", F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"))


@query("st6_chunks", S, """
WITH RECURSIVE s AS (SELECT recording_id, idx, tokens, row_number() OVER (PARTITION BY recording_id ORDER BY idx, tokens) AS k FROM segments WHERE tokens > 0), f AS (SELECT recording_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS pack, CAST(0 AS BIGINT) AS used FROM (SELECT DISTINCT recording_id FROM s)
 UNION ALL SELECT f.recording_id, s.k, CASE WHEN used > 0 AND used + tokens > 60 THEN pack + 1 ELSE pack END, CASE WHEN used > 0 AND used + tokens > 60 THEN tokens ELSE used + tokens END FROM f JOIN s ON s.recording_id = f.recording_id AND s.k = f.k + 1)
SELECT recording_id, pack AS chunk, max(used) AS tokens FROM f WHERE k > 0 GROUP BY 1, 2""")
def _(t):
    """The batch twin of the streamed chunks."""
    return sequences.packed(t.segments, 60).groupBy("recording_id", F.col("pack").alias("chunk")).agg(F.sum("tokens").alias("tokens"))


@query("st9_delta_graph", ("relations",), "SELECT source, target, relation, CAST(sum(weight) AS BIGINT) AS weight, max(rank) AS rank FROM relations GROUP BY 1, 2, 3")
def _(t):
    """Merged edges of three parts of the relations, added one after another."""
    part = lambda k: t.relations.where(F.col("recording_id") % 3 == k)
    none = t.relations.limit(0)
    return op.delta_graph(op.delta_graph(op.delta_graph(none, part(0)), part(1)), part(2))
