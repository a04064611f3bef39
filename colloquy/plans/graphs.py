"""Queries of the knowledge graph and of retrieval."""

from pyspark.sql import functions as F

from colloquy.operators import graphs as op
from colloquy.operators import retrieval as ret
from colloquy.plans.registry import query

M, MR, E, L, V = ("mentions",), ("mentions", "relations"), ("edges",), ("links",), ("vectors",)
NODES = """ty AS (SELECT name, type, count(*) AS n, min(position) AS seen FROM mentions GROUP BY 1, 2),
amb AS (SELECT name, count(*) > 1 AS ambiguous FROM ty GROUP BY 1), bt AS (SELECT name, type FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, seen) AS k FROM ty) WHERE k = 1)"""
BOTH = "sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links)"
BFS = BOTH + """, h0 AS (SELECT CAST(7 AS BIGINT) AS node), h1 AS (SELECT DISTINCT b AS node FROM sym JOIN h0 ON a = node WHERE b NOT IN (SELECT node FROM h0)),
h2 AS (SELECT DISTINCT b AS node FROM sym JOIN h1 ON a = node WHERE b NOT IN (SELECT node FROM h0 UNION SELECT node FROM h1)),
hops AS (SELECT node, 0 AS hop FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2)"""


def start(t):
    """Node 7, if there is any link."""
    return t.lineitem.limit(1).select(F.lit(7).cast("long").alias("node"))


@query("agg15_merged_nodes", M, f"""WITH {NODES},
d AS (SELECT name, left(string_agg(description, ' | ' ORDER BY seen), 512) AS description FROM (SELECT name, description, min(position) AS seen FROM mentions GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT name, count(DISTINCT recording_id) AS recordings, count(*) AS mentions FROM mentions GROUP BY 1)
SELECT name, type, ambiguous, description, recordings, mentions FROM bt JOIN amb USING (name) JOIN d USING (name) JOIN r USING (name)""")
def _(t):
    return op.merged_nodes(t.mentions)


@query("agg18_merged_edges", MR, f"""WITH {NODES},
e AS (SELECT source, target, relation, CAST(sum(weight) AS BIGINT) AS weight, max(rank) AS rank, count(DISTINCT recording_id) AS recordings FROM relations GROUP BY 1, 2, 3)
SELECT source, target, relation, weight, CASE WHEN source IN (SELECT name FROM amb WHERE ambiguous) OR target IN (SELECT name FROM amb WHERE ambiguous) OR rank = 0 THEN 'AMBIGUOUS' WHEN rank = 1 THEN 'INFERRED' ELSE 'EXTRACTED' END AS confidence, recordings FROM e""")
def _(t):
    return op.merged_edges(t.relations, op.node_types(t.mentions))


@query("agg19_degrees", ("edges",), "WITH d AS (SELECT DISTINCT source, target, relation FROM edges) SELECT name, count(*) AS degree FROM (SELECT source AS name FROM d UNION ALL SELECT target FROM d) GROUP BY 1")
def _(t):
    return op.degrees(t.edges.select("source", "target", "relation").distinct())


@query("agg20_cross_recording_entities", M, "SELECT count(*) AS n FROM (SELECT name FROM mentions GROUP BY 1 HAVING count(DISTINCT recording_id) >= 2)")
def _(t):
    return t.mentions.groupBy("name").agg(F.count_distinct("recording_id").alias("r")).where("r >= 2").agg(F.count("*").alias("n"))


@query("agg21_relation_counts", E, "SELECT name, relation, count(*) AS n FROM (SELECT source AS name, relation FROM edges UNION ALL SELECT target, relation FROM edges) GROUP BY 1, 2")
def _(t):
    return op.relation_counts(t.edges)


@query("gr3_missing_endpoints", ("mentions", "edges"), "SELECT DISTINCT name, '未知' AS type FROM (SELECT source AS name FROM edges UNION SELECT target FROM edges) WHERE name NOT IN (SELECT name FROM mentions)")
def _(t):
    return op.missing_endpoints(t.edges, t.mentions)


@query("gr4_incident_edges", E, "SELECT edge_id FROM edges WHERE source = 'e5' OR target = 'e5'")
def _(t):
    return t.edges.where("source = 'e5' or target = 'e5'").select("edge_id")


@query("gr5_neighbours", L, f"WITH {BFS} SELECT node, hop FROM hops")
def _(t):
    return op.neighbours(t.links, start(t), 2)


@query("gr6_subgraph", L, f"WITH {BFS}, top AS (SELECT node FROM hops ORDER BY hop, node LIMIT 40) SELECT a, b FROM links WHERE a IN (SELECT node FROM top) AND b IN (SELECT node FROM top)")
def _(t):
    return op.induced(t.links, op.neighbours(t.links, start(t), 2).orderBy("hop", "node").limit(40))


@query("gr8_shortest_path_length", L, f"WITH {BFS} SELECT node, hop AS length FROM hops")
def _(t):
    return op.shortest_paths(t.links, 7, 2)


@query("gr11_as_of", E, "SELECT edge_id FROM edges WHERE valid_at IS NULL OR (valid_at <= 300 AND (invalid_at IS NULL OR invalid_at > 300) AND expired_at IS NULL)")
def _(t):
    return op.as_of(t.edges, 300).select("edge_id")


@query("gr12_valid_in_range", E, "SELECT edge_id FROM edges WHERE (valid_at IS NULL OR valid_at < 260) AND (invalid_at IS NULL OR invalid_at > 200)")
def _(t):
    return op.valid_in(t.edges, 200, 260).select("edge_id")


@query("gr13_superseded", E, "SELECT edge_id, valid_at, lead(valid_at) OVER w AS invalid_at, lead(edge_id) OVER w AS superseded_by FROM edges WHERE valid_at IS NOT NULL WINDOW w AS (PARTITION BY source, target, relation ORDER BY valid_at, edge_id)")
def _(t):
    return op.superseded(t.edges)


@query("gr14_edge_history", E, "SELECT edge_id, valid_at FROM edges WHERE source = 'e1' AND relation = 'buys' ORDER BY edge_id DESC LIMIT 20 OFFSET 5")
def _(t):
    return t.edges.where("source = 'e1' and relation = 'buys'").orderBy(F.desc("edge_id")).offset(5).limit(20).select("edge_id", "valid_at")


@query("gr15_edges_of_recording", MR, "SELECT position FROM relations WHERE starts_with(source_id, '77_')")
def _(t):
    return t.relations.where(F.startswith("source_id", F.lit("77_"))).select("position")


@query("gr17_without_recording", M, "SELECT name, count(DISTINCT source_id) AS sources FROM mentions WHERE recording_id <> 77 GROUP BY 1")
def _(t):
    return op.without_recording(t.mentions, 77)


@query("gr18_label_propagation", L, "WITH " + BOTH + ", l0 AS (SELECT DISTINCT a AS node, a AS c FROM sym), " + ", ".join(f"l{i} AS (SELECT a AS node, c FROM (SELECT a, c, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, c) AS k FROM sym JOIN l{i - 1} ON b = node GROUP BY a, c) WHERE k = 1)" for i in range(1, 4)) + " SELECT node, c AS community FROM l3")
def _(t):
    return op.label_propagation(t.links, 3)


@query("gr19_modularity", L, """
WITH e AS (SELECT a % 5 AS ca, b % 5 AS cb FROM links), m AS (SELECT count(*) AS m FROM e), d AS (SELECT c, count(*) AS d FROM (SELECT ca AS c FROM e UNION ALL SELECT cb FROM e) GROUP BY 1), i AS (SELECT ca AS c, count(*) AS l FROM e WHERE ca = cb GROUP BY 1)
SELECT round(sum(coalesce(l, 0) / m - (d / (2.0::DOUBLE * m)) ** 2), 6) AS q FROM d LEFT JOIN i USING (c), m""")
def _(t):
    nodes = t.links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return op.modularity(t.links, nodes.withColumn("community", F.col("node") % 5))


@query("gr20_partition_diff", L, """
WITH o AS (SELECT DISTINCT a AS node, a % 5 AS was FROM links), w AS (SELECT DISTINCT b AS node, b % 7 AS now FROM links), f AS (SELECT coalesce(o.node, w.node) AS node, was, now FROM o FULL JOIN w ON o.node = w.node)
SELECT count(*) FILTER (was IS NULL) AS added, count(*) FILTER (now IS NULL) AS removed, count(*) FILTER (was <> now) AS moved, round((count(*) FILTER (was IS NULL) + count(*) FILTER (now IS NULL)) / CAST(count(was) AS DOUBLE) * 100, 4) AS percent FROM f""")
def _(t):
    side = lambda c, k: t.links.select(F.col(c).alias("node"), (F.col(c) % k).alias("community")).distinct()
    return op.diff(side("a", 5), side("b", 7))


@query("gr21_hierarchy_levels", L, "SELECT DISTINCT a AS node, a % 50 AS level0, (a % 50) // 2 AS level1, ((a % 50) // 2) // 3 AS level2 FROM links")
def _(t):
    return t.links.selectExpr("a AS node", "a % 50 AS level0", "(a % 50) div 2 AS level1", "((a % 50) div 2) div 3 AS level2").distinct()


@query("gr22_community_members", L, "WITH n AS (SELECT a % 5 AS community, a AS node FROM links UNION SELECT b % 5, b FROM links) SELECT community, count(*) AS members, (SELECT count(*) FROM links WHERE a % 5 = community AND b % 5 = community) AS inner_links FROM n GROUP BY community")
def _(t):
    nodes = t.links.select(F.explode(F.array("a", "b")).alias("node")).distinct().groupBy((F.col("node") % 5).alias("community")).agg(F.count("*").alias("members"))
    inner = t.links.where("a % 5 = b % 5").groupBy((F.col("a") % 5).alias("community")).agg(F.count("*").alias("inner_links"))
    return nodes.join(inner, "community", "left").select("community", "members", F.coalesce("inner_links", F.lit(0)).alias("inner_links"))


@query("gr23_parallel_weights", ("relations",), "SELECT least(source, target) AS a, greatest(source, target) AS b, CAST(sum(weight) AS BIGINT) AS weight FROM relations GROUP BY 1, 2")
def _(t):
    return t.relations.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum("weight").alias("weight"))


@query("gr24_stale_candidates", MR, f"""WITH {NODES}, r AS (SELECT name, count(DISTINCT recording_id) AS recordings FROM mentions GROUP BY 1),
g AS (SELECT name, count(*) AS degree FROM (SELECT source AS name FROM relations UNION ALL SELECT target FROM relations) GROUP BY 1), x AS (SELECT r.name, recordings, coalesce(degree, 0) AS degree FROM r LEFT JOIN g ON r.name = g.name)
SELECT name, CASE WHEN degree >= 50 THEN 'god' WHEN recordings = 1 THEN 'stale' ELSE 'orphan' END AS reason, CASE WHEN degree >= 50 THEN CAST(0.9 AS DOUBLE) WHEN recordings = 1 THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END AS score FROM x WHERE degree >= 50 OR recordings = 1 OR degree = 0""")
def _(t):
    nodes = op.merged_nodes(t.mentions).join(op.degrees(t.relations), "name", "left").fillna(0, ["degree"])
    return op.stale_candidates(nodes)


@query("gr27_deprecated", E, """
SELECT edge_id FROM edges o WHERE confidence = 'AMBIGUOUS' AND expired_at IS NULL AND valid_at < 870 AND NOT EXISTS (SELECT 1 FROM edges n WHERE n.valid_at >= 870 AND n.source = o.source AND n.target = o.target AND n.relation = o.relation)""")
def _(t):
    return op.deprecated(t.edges, 900).select("edge_id")


@query("gr28_orphan_edges", E, "SELECT edge_id FROM edges WHERE invalid_at IS NULL AND (source IN ('e1', 'e2') OR target IN ('e1', 'e2'))")
def _(t):
    live = t.edges.select(F.explode(F.array("source", "target")).alias("name")).distinct().where("name not in ('e1', 'e2')")
    return op.orphans(t.edges, live).select("edge_id")


@query("gr29_edge_key", E, "SELECT edge_id, concat_ws('|', source, relation, target) AS edge_key, sha256(concat_ws('|', source, relation, target)) AS fingerprint FROM edges")
def _(t):
    key = F.concat_ws("|", "source", "relation", "target")
    return t.edges.select("edge_id", key.alias("edge_key"), F.sha2(key, 256).alias("fingerprint"))


@query("gr33_content_hash_dedupe", ("turns",), "SELECT sha256(text) AS content_hash, min(conv_id * 1000 + turn) AS first FROM turns GROUP BY 1")
def _(t):
    return t.turns.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("first"))


@query("src3_vector_validation", V, "SELECT vec_id FROM vectors WHERE len(embedding) = (SELECT max(len(embedding)) FROM vectors) AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0")
def _(t):
    size = t.vectors.agg(F.max(F.size("embedding"))).first()[0]
    return ret.valid(t.vectors, size).select("vec_id")


@query("vec1_cosine_top_k", V, """
WITH q AS (SELECT embedding AS q FROM vectors WHERE vec_id = 3) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM vectors, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) DESC, vec_id LIMIT 20""")
def _(t):
    q = t.vectors.where("vec_id = 3").first().embedding
    return ret.top_k(t.vectors, q, 20).select("vec_id", F.round("score", 6).alias("score"))


@query("join15_nearest_label_centroid", V, """
WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM vectors), c AS (SELECT label, d, avg(v) AS v FROM x GROUP BY 1, 2),
s AS (SELECT x.vec_id, c.label, sum(x.v * c.v) / sqrt(sum(x.v * x.v) * sum(c.v * c.v)) AS cos FROM x JOIN c ON x.d = c.d GROUP BY 1, 2)
SELECT vec_id, label AS nearest FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, label) AS k FROM s) WHERE k = 1""")
def _(t):
    return ret.nearest(t.vectors, ret.centroids(t.vectors, "label"), "label")


@query("vec4_centroids", V, """
WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM vectors) SELECT label, d - 1 AS d, round(avg(v), 6) AS v FROM x GROUP BY 1, 2""")
def _(t):
    return ret.centroids(t.vectors, "label").select("label", F.posexplode("centroid").alias("d", "v")).select("label", F.col("d").cast("long").alias("d"), F.round("v", 6).alias("v"))


@query("ret2_channel_union", V, """
WITH a AS (SELECT vec_id, CAST(vec_id % 10 AS DOUBLE) / 10 AS score, 0 AS channel FROM vectors WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id, CAST(vec_id % 7 AS DOUBLE) / 10, 1 FROM vectors WHERE vec_id % 3 = 0)
SELECT vec_id, score, channel FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, channel) AS k FROM a) WHERE k = 1""")
def _(t):
    side = lambda m, k, c: t.vectors.where(f"vec_id % {k} = 0").select("vec_id", ((F.col("vec_id") % m) / 10).alias("score"), F.lit(c).alias("channel"))
    return ret.channel_union(side(10, 2, 0).unionByName(side(7, 3, 1)), "vec_id")


@query("ret2_graph_channel", ("turns",), """
WITH nodes AS (SELECT p_partkey AS k, p_name || ' ' || p_partkey AS name FROM part),
e AS (SELECT DISTINCT a.name AS source, b.name AS target, l_returnflag AS relation FROM lineitem JOIN nodes a ON a.k = l_partkey JOIN nodes b ON b.k = l_suppkey * 7),
s AS (SELECT DISTINCT name, l_orderkey AS chunk FROM lineitem JOIN nodes ON k = l_partkey),
q AS (SELECT DISTINCT conv_id AS query, keyword FROM (SELECT conv_id, unnest(string_split_regex(text, '[\\s,.;:!?]+')) AS keyword FROM turns) WHERE length(keyword) >= 2),
c AS (SELECT name, count(*) AS n FROM (SELECT source AS name FROM e UNION ALL SELECT target FROM e) GROUP BY 1),
w AS (SELECT DISTINCT keyword FROM q), h AS (SELECT keyword, name FROM w, (SELECT DISTINCT name FROM s UNION SELECT name FROM c) x WHERE contains(name, keyword) OR contains(keyword, name)),
m AS (SELECT DISTINCT query, name, coalesce(n, 0) AS n FROM q JOIN h USING (keyword) LEFT JOIN c USING (name)),
r AS (SELECT *, max(n) OVER (PARTITION BY query) AS most, row_number() OVER (PARTITION BY query ORDER BY n DESC, name) AS i FROM m),
t AS (SELECT query, name, CASE WHEN most > 0 THEN n / CAST(most AS DOUBLE) ELSE 0 END AS score FROM r WHERE i <= 5),
v AS (SELECT query, name, score FROM t UNION ALL SELECT query, o.b, score * CAST(0.5 AS DOUBLE) FROM t JOIN (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e) o ON o.a = t.name AND o.a <> o.b),
g AS (SELECT query, chunk, max(score) AS score FROM v JOIN s USING (name) GROUP BY 1, 2)
SELECT query, chunk, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) AS i FROM g) WHERE i <= 20""")
def _(t):
    """The twenty chunks that each conversation's words lead to in the graph of parts."""
    nodes = t.part.select(F.col("p_partkey").alias("k"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"))
    of = lambda k, n: nodes.select(F.col("k").alias(k), F.col("name").alias(n))
    lines = t.lineitem.select("l_partkey", (F.col("l_suppkey") * 7).alias("other"), "l_returnflag", "l_orderkey").join(of("l_partkey", "source"), "l_partkey")
    edges = lines.join(of("other", "target"), "other").select("source", "target", "l_returnflag").distinct()
    sources = lines.select(F.col("source").alias("name"), F.col("l_orderkey").alias("chunk"))
    asked = ret.keywords(t.turns).select(F.col("conv_id").alias("query"), "keyword")
    return ret.graph_channel(asked, sources, edges, chunks=20).select("query", "chunk", F.round("score", 6).alias("score"))


@query("ret5_weighted_channels", V, """
SELECT vec_id, CAST(vec_id % 3 AS INTEGER) AS channel, round(CAST(vec_id % 10 AS DOUBLE) / 10 * CASE vec_id % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END * CASE WHEN vec_id % 5 = 0 THEN 0.7::DOUBLE ELSE 1 END, 6) AS score FROM vectors""")
def _(t):
    c = t.vectors.select("vec_id", (F.col("vec_id") % 3).cast("int").alias("channel"), ((F.col("vec_id") % 10) / 10).alias("score"), F.when(F.col("vec_id") % 5 == 0, "AMBIGUOUS").otherwise("EXTRACTED").alias("confidence"))
    return ret.weighted(c).select("vec_id", "channel", F.round("score", 6).alias("score"))


@query("ret5_without_audio", V, """
SELECT vec_id, round(CAST(vec_id % 10 AS DOUBLE) / 10 * CASE vec_id % 2 WHEN 0 THEN 0.625::DOUBLE ELSE 0.375::DOUBLE END, 6) AS score FROM vectors""")
def _(t):
    c = t.vectors.select("vec_id", (F.col("vec_id") % 2).cast("int").alias("channel"), ((F.col("vec_id") % 10) / 10).alias("score"), F.lit("EXTRACTED").alias("confidence"))
    return ret.weighted(c, ret.channel_weights(audio=False)).select("vec_id", F.round("score", 6).alias("score"))


@query("ret4_keywords", ("turns",), """
SELECT conv_id, turn, k AS keyword, count(*) AS n FROM (SELECT conv_id, turn, unnest(string_split_regex(text, '[\\s,.;:!?]+')) AS k FROM turns) WHERE length(k) >= 2 GROUP BY 1, 2, 3""")
def _(t):
    return ret.keywords(t.turns).groupBy("conv_id", "turn", "keyword").agg(F.count("*").alias("n"))


@query("ret8_jaccard_search", ("turns",), """
WITH w AS (SELECT DISTINCT conv_id, lower(k) AS k FROM (SELECT conv_id, unnest(string_split_regex(text, '\\s+')) AS k FROM turns) WHERE k <> ''), q AS (SELECT k FROM w WHERE conv_id = 1),
s AS (SELECT conv_id, count(*) AS size, count(*) FILTER (k IN (SELECT k FROM q)) AS both_ FROM w GROUP BY 1) SELECT conv_id, round(both_ / CAST(size + (SELECT count(*) FROM q) - both_ AS DOUBLE), 6) AS score FROM s ORDER BY both_ / CAST(size + (SELECT count(*) FROM q) - both_ AS DOUBLE) DESC, conv_id LIMIT 10""")
def _(t):
    return ret.jaccard_search(ret.word_sets(t.turns, "conv_id"), "conv_id", 1, 10)
