"""The knowledge graph: merging mentions, time travel, walks, communities, upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.session import settled

RANKS = ["AMBIGUOUS", "INFERRED", "EXTRACTED"]
DESCRIPTION = 512


def merged_nodes(mentions: DataFrame) -> DataFrame:
    """One node per name: most frequent type (first seen on a tie), distinct descriptions in order of
    appearance cut to 512 characters, how many recordings and mentions, whether types disagree.

    Values are made distinct before they are gathered, so a node's lists hold what it has, not how often.
    """
    type_ = node_types(mentions)
    said = mentions.groupBy("name", "description").agg(F.min("position").alias("seen")).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("seen", "description")))["description"].alias("d"))
    seen = mentions.groupBy("name", "recording_id").agg(F.count("*").alias("n")).groupBy("name").agg(F.count("*").alias("recordings"), F.sum("n").alias("mentions"))
    return type_.join(said, "name").join(seen, "name").select("name", "type", "ambiguous", F.left(F.array_join("d", " | "), F.lit(DESCRIPTION)).alias("description"), "recordings", "mentions")


def node_types(mentions: DataFrame) -> DataFrame:
    """(name, type, ambiguous): the most frequent type, the first seen on a tie, and whether there are others."""
    types = mentions.groupBy("name", "type").agg(F.count("*").alias("n"), F.min("position").alias("seen"))
    return types.groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("n"), "seen", "type"))["type"].alias("type"), (F.count("*") > 1).alias("ambiguous"))


def merged_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge per (source, target, relation): weights added, best confidence; an endpoint of several types makes it AMBIGUOUS."""
    e = relations.groupBy("source", "target", "relation").agg(F.sum("weight").alias("weight"), F.max("rank").alias("rank"), F.count_distinct("recording_id").alias("recordings"))
    unsure = nodes.where("ambiguous").select("name")
    for end in ("source", "target"):
        e = e.join(unsure.select(F.col("name").alias(end), F.lit(True).alias(f"{end}_unsure")), end, "left")
    rank = F.when(F.coalesce("source_unsure", "target_unsure").isNotNull(), 0).otherwise(F.col("rank"))
    name = F.get(F.array(*[F.lit(r) for r in RANKS]), rank.cast("int"))
    return e.select("source", "target", "relation", "weight", name.alias("confidence"), "recordings")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("name")).groupBy("name").agg(F.count("*").alias("degree"))


def relation_counts(edges: DataFrame) -> DataFrame:
    """Relations of each node, in and out; a self-loop counts twice."""
    return edges.select(F.explode(F.array("source", "target")).alias("name"), "relation").groupBy("name", "relation").agg(F.count("*").alias("n"))


def missing_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stub nodes for endpoints that no mention names."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("name")).distinct()
    return ends.join(nodes.select("name"), "name", "left_anti").withColumn("type", F.lit("未知"))


def as_of(edges: DataFrame, at: int, include_soft: bool = False) -> DataFrame:
    """Edges valid at a time; one without a start is always visible, whatever else it says."""
    live = (F.col("valid_at") <= at) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > at))
    return edges.where(F.col("valid_at").isNull() | (live if include_soft else live & F.col("expired_at").isNull()))


def valid_in(edges: DataFrame, start: int, end: int) -> DataFrame:
    """Edges valid at some time of [start, end); soft deletion plays no part."""
    return edges.where((F.col("valid_at").isNull() | (F.col("valid_at") < end)) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > start)))


def superseded(edges: DataFrame) -> DataFrame:
    """Versions of an edge in time: each ends where the next begins and points to it."""
    w = W.partitionBy("source", "target", "relation").orderBy("valid_at", "edge_id")
    dated = edges.where("valid_at is not null")
    return dated.select("edge_id", "valid_at", F.lead("valid_at").over(w).alias("invalid_at"), F.lead("edge_id").over(w).alias("superseded_by"))


def neighbours(links: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(node, hop) within so many undirected steps of the start nodes, each at its least hop.

    Each frontier is written, so a step's plan holds no step before it and knows how small it is: links
    are kept by a semi-join, which Spark does before their own DISTINCT, so only what a frontier touches is dealt.
    """
    edge = settled(start.select("node").distinct().withColumn("hop", F.lit(0)), "frontier")
    found = edge
    for hop in range(1, hops + 1):
        step = stepped(links, edge).join(found.select("node"), "node", "left_anti")
        edge = settled(step.withColumn("hop", F.lit(hop)), "frontier")
        found = found.unionByName(edge)
    return found


def touching(links: DataFrame, front: DataFrame) -> DataFrame:
    """(a, b): undirected links from the nodes of ``front``, which stand in a."""
    near = lambda end, other: links.join(front.select(F.col("node").alias(end)), end, "left_semi").select(F.col(end).alias("a"), F.col(other).alias("b"))
    return near("a", "b").union(near("b", "a"))


def stepped(links: DataFrame, front: DataFrame) -> DataFrame:
    """The distinct nodes that undirected links lead to from the nodes of ``front``."""
    return touching(links, front).select(F.col("b").alias("node")).distinct()


def induced(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with both ends among the nodes."""
    one = nodes.select("node").distinct()
    return links.join(one.select(F.col("node").alias("a")), "a", "left_semi").join(one.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")


def subgraph_window(links: DataFrame, start: DataFrame, hops: int, nodes: int, edges: int) -> DataFrame:
    """(a, b, total_nodes): links among the nearest nodes, nearest first and by name within a hop, and how many nodes there are within so many hops."""
    near = settled(neighbours(links, start, hops), "near")
    kept = induced(links, near.orderBy("hop", "node").limit(nodes)).orderBy("a", "b").limit(edges)
    return kept.crossJoin(near.agg(F.count("*").alias("total_nodes")))  # one row


def modularity(links: DataFrame, community: DataFrame) -> DataFrame:
    """Q of a partition: for each community its inner links' share less the share by degrees squared."""
    c = lambda end: community.select(F.col("node").alias(end), F.col("community").alias(f"c_{end}"))
    e = links.join(c("a"), "a").join(c("b"), "b")
    degree = e.select(F.explode(F.array("c_a", "c_b")).alias("c")).groupBy("c").agg(F.count("*").alias("d"))
    inner = e.where("c_a = c_b").groupBy(F.col("c_a").alias("c")).agg(F.count("*").alias("l"))
    total = e.agg(F.count("*").alias("m"))
    part = F.coalesce("l", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)
    return degree.join(inner, "c", "left").crossJoin(F.broadcast(total)).agg(F.round(F.sum(part), 6).alias("q"))


def label_propagation(links: DataFrame, rounds: int = 5) -> DataFrame:
    """Communities by repeated majority of the neighbours' labels, the smallest label on a tie.

    The labels of every other round are written, so plans do not grow with the rounds.
    """
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    label = both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
    for done in range(1, rounds + 1):
        votes = both.join(label.select(F.col("node").alias("b"), "community"), "b").groupBy("a", "community").agg(F.count("*").alias("n"))
        label = votes.groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("n"), "community"))["community"].alias("community")).withColumnRenamed("a", "node")
        label = settled(label, "labels") if done % 2 == 0 and done < rounds else label
    return label


def stale_candidates(nodes: DataFrame, god: int = 50) -> DataFrame:
    """Nodes to compress and why: too many links .9, one recording .7, no description .5, no link .2; the first that holds."""
    c = F.when(F.col("degree") >= god, F.struct(F.lit("god").alias("reason"), F.lit(0.9).alias("score")))
    c = c.when(F.col("recordings") == 1, F.struct(F.lit("stale").alias("reason"), F.lit(0.7).alias("score")))
    c = c.when(F.trim("description") == "", F.struct(F.lit("blank").alias("reason"), F.lit(0.5).alias("score")))
    c = c.when(F.col("degree") == 0, F.struct(F.lit("orphan").alias("reason"), F.lit(0.2).alias("score")))
    return nodes.withColumn("c", c).where("c is not null").select("name", "c.reason", "c.score")


def deprecated(edges: DataFrame, now: int, age: int = 30) -> DataFrame:
    """AMBIGUOUS edges not expired and older than ``age`` that were not met again since."""
    old = edges.where((F.col("confidence") == "AMBIGUOUS") & F.col("expired_at").isNull() & (F.col("valid_at") < now - age))
    again = edges.where(F.col("valid_at") >= now - age).select("source", "target", "relation").distinct()
    return old.join(again, ["source", "target", "relation"], "left_anti")


def orphans(edges: DataFrame, live: DataFrame) -> DataFrame:
    """Open edges with an endpoint that is not live."""
    found = edges.where("invalid_at is null")
    for end in ("source", "target"):
        found = found.join(live.select(F.col("name").alias(end), F.lit(True).alias(f"{end}_live")), end, "left")
    return found.where("source_live is null or target_live is null")


def without_recording(mentions: DataFrame, recording_id: int) -> DataFrame:
    """Nodes left when a recording goes: those only it mentions drop out, others lose its source."""
    return mentions.where(F.col("recording_id") != recording_id).groupBy("name").agg(F.count_distinct("source_id").alias("sources"))


def shortest_paths(links: DataFrame, start: int, max_hops: int) -> DataFrame:
    """(node, length) of the nodes reached from one; ties between equal paths play no part in the length."""
    one = links.sparkSession.createDataFrame([(start,)], "node long")
    return neighbours(links, one, max_hops).withColumnRenamed("hop", "length")


def path_between(links: DataFrame, start: int, end: int) -> DataFrame:
    """(place, node): the shortest path of undirected links between two nodes, of any length; the first in order of its nodes; no rows without a path.

    Both ends are searched at once, the smaller frontier a step at a time, until one reaches the other. Then
    only nodes on shortest paths are kept, a step at a time back to either end, and paths of least
    nodes are joined along them. Null ends are no nodes.
    """
    links = links.where("a is not null and b is not null and a <> b")
    one = lambda n: links.where((F.col("a") == n) | (F.col("b") == n)).limit(1).select(F.lit(n).cast("long").alias("node"))
    if start == end:
        return one(start).select(F.lit(0).alias("place"), "node")
    steps = {True: [settled(one(start), "frontier")], False: [settled(one(end), "frontier")]}
    seen = {True: steps[True][0], False: steps[False][0]}
    sizes = {True: steps[True][0].count(), False: steps[False][0].count()}
    near = lambda front: stepped(links, front)
    while all(sizes.values()):
        side = sizes[True] <= sizes[False]
        front = settled(near(steps[side][-1]).join(seen[side], "node", "left_anti"), "frontier")
        steps[side].append(front)
        sizes[side] = front.count()
        seen[side] = seen[side].unionByName(front)
        met = settled(front.join(steps[not side][-1], "node", "left_semi"), "met")
        if not met.isEmpty():
            break
    else:
        return one(start).limit(0).select(F.lit(0).alias("place"), "node")
    back, forth = [met], [met]
    for layer in reversed(steps[True][:-1]):
        back.append(settled(near(back[-1]).join(layer, "node", "left_semi"), "kept"))
    for layer in reversed(steps[False][:-1]):
        forth.append(settled(near(forth[-1]).join(layer, "node", "left_semi"), "kept"))
    layers = back[::-1] + forth[1:]
    path = layers[0].select("node", F.array("node").alias("path"))
    for layer in layers[1:]:
        step = path.join(touching(links, path), F.col("node") == F.col("a")).select(F.col("b").alias("node"), "path").join(layer, "node", "left_semi")
        path = settled(step.groupBy("node").agg(F.min("path").alias("path")).select("node", F.concat("path", F.array("node")).alias("path")), "path")
    return path.select(F.posexplode("path").alias("place", "node"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and moved nodes between two partitions and the share of change in per cent."""
    both = old.withColumnRenamed("community", "was").join(new.withColumnRenamed("community", "now"), "node", "full_outer")
    added, removed = F.count_if(F.col("was").isNull()), F.count_if(F.col("now").isNull())
    share = F.when(F.count("was") == 0, 100.0).otherwise((added + removed) / F.greatest(F.count("was"), F.lit(1)) * 100)
    return both.agg(added.alias("added"), removed.alias("removed"), F.count_if(F.col("was") != F.col("now")).alias("moved"), F.round(share, 4).alias("percent"))


def retention_cascade(edges: DataFrame, gone: DataFrame, at) -> tuple[DataFrame, DataFrame]:
    """(edges, events): still open edges at nodes that go end at ``at``; one event for each. Doing it again changes nothing."""
    mark = gone.select("name").distinct().withColumn("gone", F.lit(True))
    e = edges
    for end in ("source", "target"):
        e = e.join(mark.withColumnRenamed("name", end).withColumnRenamed("gone", f"{end}_gone"), end, "left")
    hit = F.col("invalid_at").isNull() & F.coalesce("source_gone", "target_gone", F.lit(False))
    e = e.withColumn("hit", hit)
    events = e.where("hit").select("edge_id", F.lit("invalidated").alias("event"), F.lit(at).alias("at"))
    return e.withColumn("invalid_at", F.when(F.col("hit"), F.lit(at)).otherwise(F.col("invalid_at"))).drop("source_gone", "target_gone", "hit"), events


#: What an edge of each confidence passes on.
PASSED = {"EXTRACTED": 1.0, "INFERRED": 0.8, "AMBIGUOUS": 0.5}


def weighted_subgraph(edges: DataFrame, roots: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """(name, depth, weight): roots at depth 0 with weight 1, their neighbours with the most an edge passes on; deprecated
    and expired edges and ones that pass on less than ``least`` are left out; at most k rows, near ones first."""
    w = F.lit(None).cast("double")
    for name, value in PASSED.items():
        w = F.when(F.col("confidence") == name, value).otherwise(w)
    live = edges.where("expired_at is null").withColumn("w", w).where(F.col("w") >= least)  # others, as DEPRECATED, have no weight
    root = F.broadcast(roots.select(F.col("name").alias("root")).distinct())
    step = lambda a, b: live.join(root, F.col(a) == F.col("root"), "left_semi").select(F.col(b).alias("name"), F.lit(1).alias("depth"), "w")
    both = roots.select("name", F.lit(0).alias("depth"), F.lit(1.0).alias("w")).unionByName(step("source", "target")).unionByName(step("target", "source"))
    return both.groupBy("name", "depth").agg(F.max("w").alias("weight")).orderBy("depth", F.desc("weight"), "name").limit(k)
