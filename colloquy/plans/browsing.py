"""Queries of lists, searches, bounded windows, pages and citations."""

from pyspark.sql import functions as F

from colloquy.operators import browse as op
from colloquy.operators import receptions, retrieval, tabular
from colloquy.plans.registry import query

R, S, A, E, T, V, M, C = ("receptions",), ("segments",), ("assignments",), ("edges",), ("transitions",), ("vectors",), ("mentions",), ("turns",)
DEGREES = "deg AS (SELECT name, count(*) AS degree FROM (SELECT source AS name FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1)"


@query("flt1_recording_list", ("recordings",), """
WITH f AS (SELECT * FROM recordings WHERE store_id IN (3, 4, 5, 6) AND status = 'O' AND agent_id = 2 AND started_sec BETWEEN 1000 AND 700000)
SELECT recording_id, coalesce(customer, agent_id) AS owner, (SELECT count(*) FROM f) AS total FROM f ORDER BY ended_sec - started_sec DESC, recording_id LIMIT 25""")
def _(t):
    f = t.recordings.where("store_id in (3, 4, 5, 6) and status = 'O' and agent_id = 2").where(F.col("started_sec").between(1000, 700000))
    page = f.orderBy(F.desc(F.col("ended_sec") - F.col("started_sec")), "recording_id").limit(25)
    return page.select("recording_id", F.coalesce("customer", "agent_id").alias("owner")).crossJoin(F.broadcast(f.agg(F.count("*").alias("total"))))


@query("flt2_reception_list", R, "SELECT reception_id, started_sec FROM receptions WHERE tenant_id = 't1' AND started_sec BETWEEN 5 AND 5000 ORDER BY started_sec DESC, reception_id DESC LIMIT 20 OFFSET 5")
def _(t):
    return op.reception_list(t.receptions, "t1", 5, 5000, 20, 5).select("reception_id", "started_sec")


@query("flt12_text_search", C, "SELECT conv_id, count(*) AS n FROM turns WHERE contains(lower(text), 'the') OR contains(lower(role), 'the') GROUP BY 1")
def _(t):
    return op.text_search(t.turns, " THE ", ["text", "role"]).groupBy("conv_id").agg(F.count("*").alias("n"))


@query("flt13_browse_nodes", ("edges", "mentions"), f"""
WITH {DEGREES}, ty AS (SELECT name, type, count(*) AS n, min(position) AS seen FROM mentions GROUP BY 1, 2), b AS (SELECT name, type FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, seen) AS k FROM ty) WHERE k = 1)
SELECT name, degree FROM b JOIN deg USING (name) WHERE type = 'product' AND degree >= 20 ORDER BY name LIMIT 50""")
def _(t):
    from colloquy.operators import graphs

    nodes = graphs.node_types(t.mentions).join(graphs.degrees(t.edges), "name")
    return op.browse_nodes(nodes, "product", 20, 50).select("name", "degree")


@query("top4_induced_window", E, f"""
WITH {DEGREES}, top AS (SELECT name FROM deg ORDER BY degree DESC, name LIMIT 60), i AS (SELECT * FROM edges WHERE source IN (SELECT name FROM top) AND target IN (SELECT name FROM top))
SELECT edge_id, (SELECT count(*) FROM i) AS total, (SELECT count(*) FROM i) > 30 AS truncated FROM i ORDER BY edge_id LIMIT 30""")
def _(t):
    from colloquy.operators import graphs

    top = graphs.degrees(t.edges).orderBy(F.desc("degree"), "name").limit(60)
    return op.induced_window(t.edges, top, 30, 1000).select("edge_id", "total", "truncated")


@query("top6_latest_succeeded", ("recordings",), "SELECT recording_id AS job_id, ended_sec AS finished FROM recordings WHERE status = 'F' ORDER BY ended_sec DESC, recording_id DESC LIMIT 1")
def _(t):
    jobs = t.recordings.select(F.col("recording_id").alias("job_id"), F.col("ended_sec").alias("finished"), F.when(F.col("status") == "F", "succeeded").otherwise("failed").alias("status"))
    return op.latest_succeeded(jobs).select("job_id", "finished")


@query("top3_global_search", C, """
WITH w AS (SELECT DISTINCT conv_id, lower(k) AS k FROM (SELECT conv_id, unnest(string_split_regex(text, '\\s+')) AS k FROM turns) WHERE k <> ''), q AS (SELECT k FROM w WHERE conv_id = 2),
s AS (SELECT conv_id, count(*) FILTER (k IN (SELECT k FROM q)) / CAST((SELECT count(*) FROM q) AS DOUBLE) AS score FROM w GROUP BY 1) SELECT conv_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, conv_id LIMIT 5""")
def _(t):
    w = retrieval.word_sets(t.turns, "conv_id")
    q = w.where("conv_id = 2").select("word", F.lit(1).alias("hit"))
    s = w.join(q, "word", "left").groupBy("conv_id").agg(F.count("hit").alias("hits")).crossJoin(F.broadcast(q.agg(F.count("*").alias("q"))))
    return op.best_scored(s.select("conv_id", (F.col("hits") / F.col("q")).alias("score")), "conv_id").select("conv_id", F.round("score", 6).alias("score"))


@query("vec2_search_tables", V, """
WITH q AS (SELECT embedding::DOUBLE[] AS q FROM vectors WHERE vec_id = 4), s AS (SELECT CASE vec_id % 3 WHEN 0 THEN 'chunks' WHEN 1 THEN 'entities' ELSE 'audio' END AS kind, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM vectors, q)
SELECT kind, vec_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY s DESC, vec_id) AS k FROM s) WHERE k <= 10""")
def _(t):
    q = t.vectors.where("vec_id = 4").first().embedding
    tables = {n: t.vectors.where(F.col("vec_id") % 3 == i) for i, n in enumerate(["chunks", "entities", "audio"])}
    return op.search_tables(tables, q, 10).withColumn("score", F.round("score", 6))


@query("ret3_audio_channel", ("vectors", "segments"), """
WITH q AS (SELECT embedding::DOUBLE[] AS q FROM vectors WHERE vec_id = 6), k AS (SELECT vec_id, vec_id * 3 AS heard, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM vectors, q ORDER BY s DESC, vec_id LIMIT 100)
SELECT k.vec_id, segment_id, round(s, 6) AS score FROM k JOIN segments g ON g.recording_id % 500 = k.vec_id WHERE g.recording_id = heard""")
def _(t):
    q = t.vectors.where("vec_id = 6").first().embedding
    found = retrieval.top_k(t.vectors, q, 100).select("vec_id", (F.col("vec_id") * 3).alias("recording_id"), "score")
    chunks = t.segments.select((F.col("recording_id") % 500).alias("vec_id"), "recording_id", "segment_id")
    return op.audio_candidates(found, chunks).select("vec_id", "segment_id", F.round("score", 6).alias("score"))


@query("ret7_citations", ("turns", "relations"), """
WITH e AS (SELECT recording_id AS chunk_id, max(rank) AS r FROM relations GROUP BY 1), f AS (SELECT chunk_id, r, min(source) AS entity FROM relations JOIN e ON chunk_id = recording_id AND rank = r GROUP BY 1, 2)
SELECT conv_id * 1000 + turn AS chunk_id, coalesce(entity, '未知实体') AS entity, CASE r WHEN 0 THEN 'AMBIGUOUS' WHEN 1 THEN 'INFERRED' ELSE 'EXTRACTED' END AS confidence, left(coalesce(text, ''), 200) AS snippet FROM turns LEFT JOIN f ON f.chunk_id = conv_id * 1000 + turn""")
def _(t):
    from colloquy.operators.graphs import RANKS

    name = F.get(F.array(*[F.lit(r) for r in RANKS]), F.col("rank").cast("int"))
    entities = t.relations.select(F.col("recording_id").alias("chunk_id"), F.col("source").alias("entity"), "rank", name.alias("confidence"))
    return op.citations(t.turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), "text"), entities)


@query("ret12_entities_in_answers", C, """
WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM turns), n AS (SELECT DISTINCT w[1] || ' ' || w[2] AS name FROM w WHERE turn = 1 AND len(w) > 1 UNION SELECT DISTINCT w[3] FROM w WHERE turn = 1 AND len(w) > 2),
g AS (SELECT DISTINCT conv_id, turn, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS name FROM w) SELECT conv_id, turn, name FROM g WHERE name IN (SELECT name FROM n)""")
def _(t):
    w = t.turns.where("turn = 1").select(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "").alias("w"))
    names = w.where(F.size("w") > 1).select(F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("name")).union(w.where(F.size("w") > 2).select(F.get("w", F.lit(2))))
    return op.named_in(t.turns, names, ["conv_id", "turn"])


@query("rec7_workspace", ("segments", "assignments"), """
WITH p AS (SELECT 'transcript' AS part, segment_id AS id, start_sec, end_sec FROM segments UNION ALL SELECT 'units', min(segment_id), min(start_sec), max(end_sec) FROM segments GROUP BY recording_id
UNION ALL SELECT 'tags', assignment_id, CASE WHEN assignment_id % 2 = 0 THEN target_id END, CASE WHEN assignment_id % 2 = 0 THEN target_id + 5 END FROM assignments),
i AS (SELECT * FROM p WHERE start_sec IS NULL OR (end_sec > 30 AND start_sec < 60)), c AS (SELECT part, count(*) AS total FROM i GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY start_sec NULLS FIRST, id) AS k FROM i) SELECT part, id, total FROM k JOIN c USING (part) WHERE k <= CASE part WHEN 'transcript' THEN 300 WHEN 'units' THEN 100 ELSE 200 END""")
def _(t):
    units = t.segments.groupBy("recording_id").agg(F.min("segment_id").alias("id"), F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"))
    even = F.col("assignment_id") % 2 == 0
    tags = t.assignments.select(F.col("assignment_id").alias("id"), F.when(even, F.col("target_id")).alias("start_sec"), F.when(even, F.col("target_id") + 5).alias("end_sec"))
    parts = {"transcript": t.segments.withColumnRenamed("segment_id", "id"), "units": units, "tags": tags}
    out = None
    for name, rows in op.workspace(parts, 30, 60).items():
        one = rows.select(F.lit(name).alias("part"), "id", "total")
        out = one if out is None else out.unionByName(one)
    return out


@query("rec9_tags_in_window", ("assignments", "segments"), """
WITH e AS (SELECT segment_id AS tag_id, start_sec, end_sec FROM segments WHERE speaker <> 'sp2') SELECT assignment_id AS tag_id FROM assignments a WHERE NOT EXISTS (SELECT 1 FROM e WHERE tag_id = a.assignment_id) OR EXISTS (SELECT 1 FROM e WHERE tag_id = a.assignment_id AND end_sec > 40 AND start_sec < 80)""")
def _(t):
    e = t.segments.where("speaker <> 'sp2'").select(F.col("segment_id").alias("tag_id"), "start_sec", "end_sec")
    return op.tags_in_window(t.assignments.select(F.col("assignment_id").alias("tag_id")), e, 40, 80)


@query("rec12_provenance_page", T, "WITH m AS (SELECT transition_id AS id, sequence_no AS s FROM transitions WHERE to_state = 'view' AND reception_id = 7) SELECT id, s AS place, (SELECT count(*) FROM m) AS total FROM m ORDER BY s, id LIMIT 10 OFFSET 2")
def _(t):
    rows = t.transitions.select(F.col("transition_id").alias("id"), F.col("sequence_no").alias("at"), F.col("to_state").alias("object_type"), F.col("reception_id").alias("object_ref"))
    return op.provenance_page(rows, "view", 7, 10, 2).select("id", F.col("at").alias("place"), "total")


@query("rec13_proposals", ("recordings",))
def _(t):
    """Proposed visits with their pairs; visits depend on earlier unions, so a test holds them against plain ones."""
    judged = tabular.evaluate_pairs(tabular.neighbour_pairs(t.recordings, 900, 3), keep=("started_sec",))
    return op.proposals(t.recordings, judged, receptions.grouped(t.recordings, judged))


@query("rec11_transition_page_total", T, "SELECT transition_id, (SELECT count(*) FROM transitions WHERE reception_id = 7) AS total FROM transitions WHERE reception_id = 7 ORDER BY sequence_no, transition_id LIMIT 20 OFFSET 10")
def _(t):
    rows = t.transitions.select(F.col("transition_id").alias("id"), F.col("sequence_no").alias("at"), F.lit("reception").alias("object_type"), F.col("reception_id").alias("object_ref"))
    return op.provenance_page(rows, "reception", 7, 20, 10).select(F.col("id").alias("transition_id"), "total")


@query("ui2_relation_projection", ("edges", "mentions"), """
WITH n AS (SELECT name AS id, bool_or(type = 'brand') AS preferred FROM mentions GROUP BY 1), s AS (SELECT id FROM n ORDER BY preferred DESC, id LIMIT 120) SELECT DISTINCT edge_id FROM edges WHERE source IN (SELECT id FROM s) AND target IN (SELECT id FROM s)""")
def _(t):
    nodes = t.mentions.select(F.col("name").alias("id"), (F.col("type") == "brand").alias("preferred"))
    return op.projection(nodes, t.edges, 120)[1].select("edge_id")


@query("join9_not_assigned", ("recordings", "assignments"), "SELECT recording_id FROM recordings r WHERE NOT EXISTS (SELECT 1 FROM assignments a WHERE a.target_id = r.recording_id AND a.is_manual AND a.confidence >= 0.5::DOUBLE)")
def _(t):
    active = t.assignments.where("is_manual and confidence >= 0.5").select(F.col("target_id").alias("recording_id"))
    return t.recordings.select("recording_id").join(active, "recording_id", "left_anti")


@query("join19_adjacent_rows", S, 'SELECT * FROM (SELECT recording_id, lag(speaker) OVER (PARTITION BY recording_id ORDER BY segment_id) AS "left", speaker AS "right" FROM segments) WHERE "left" IS NOT NULL')
def _(t):
    from colloquy.operators.upkeep import close_rows

    return close_rows(t.segments, "recording_id", "segment_id", "speaker")


@query("set1_endpoints", E, "SELECT source AS name, 'out' AS side FROM edges UNION ALL SELECT target, 'in' FROM edges")
def _(t):
    return t.edges.select(F.col("source").alias("name"), F.lit("out").alias("side")).unionByName(t.edges.select(F.col("target").alias("name"), F.lit("in").alias("side")))


@query("set7_distinct", A, "SELECT DISTINCT target_id, label_key, value FROM assignments")
def _(t):
    return t.assignments.select("target_id", "label_key", "value").distinct()


@query("vec3_cosine_scalars", V, "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1")
def _(t):
    b = t.vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.vectors.join(b, "vec_id").select("vec_id", F.round(retrieval.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))
