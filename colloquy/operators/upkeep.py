"""Upkeep of graphs, facts and reports: merging, soft deletion, projections, current values, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.functions.grouping import fold_groups
from colloquy.operators import graphs, tagging
from colloquy.operators.browse import text_search
from colloquy.operators.matching import all_alike
from colloquy.session import settled


def merge_pairs(nodes: DataFrame, most_degree: int = 1, least: float = 85.0) -> DataFrame:
    """(source_id, canonical_id, score): live nodes of few links with a node of the same community and type of a like name.

    Names are scored by their words. The smaller id is canonical. Each source stands once, with its
    best score, then its smallest canonical. Nodes of one name are pairs with the least of them only, and
    of two like names only the least ids meet the others, so pairs grow with nodes.
    """
    low = nodes.where(F.col("expired_at").isNull() & (F.col("degree") <= most_degree))
    group = F.concat_ws("|", F.coalesce(F.col("community").cast("string"), F.lit("")), "type")
    named = low.select("entity_id", "name", group.alias("type"))
    first = named.groupBy("name", "type").agg(F.min("entity_id").alias("least_id"))
    alike = all_alike(first, least)
    sides = alike.select(F.col("a").alias("name"), F.col("b").alias("other"), "type", "score").unionByName(alike.select(F.col("b").alias("name"), F.col("a").alias("other"), "type", "score"))
    reach = sides.join(first.select(F.col("name").alias("other"), "type", F.col("least_id").alias("canonical_id")).hint("merge"), ["other", "type"]).select("name", "type", "canonical_id", "score")
    same = first.select("name", "type", F.col("least_id").alias("canonical_id"), F.lit(100.0).alias("score"))
    both = named.join(reach.unionByName(same).hint("merge"), ["name", "type"]).where("canonical_id < entity_id").select(F.col("entity_id").alias("source_id"), "canonical_id", F.floor("score").alias("score"))
    best = F.max_by(F.struct("canonical_id", "score"), F.struct("score", -F.col("canonical_id"))).alias("x")
    return both.groupBy("source_id").agg(best).select("source_id", "x.canonical_id", "x.score")


def soft_deleted(nodes: DataFrame, edges: DataFrame, gone: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with ``now`` as the end of the nodes that are gone and of all edges at them; earlier ends stay."""
    mark = gone.select("name").distinct().withColumn("gone", F.lit(True))
    end = lambda d, hit: d.withColumn("expired_at", F.coalesce("expired_at", F.when(hit, F.lit(now))))
    n = end(nodes.join(mark, "name", "left"), F.col("gone")).drop("gone")
    e = edges
    for side in ("source", "target"):
        e = e.join(mark.withColumnRenamed("name", side).withColumnRenamed("gone", f"{side}_gone"), side, "left")
    return n, end(e, F.coalesce("source_gone", "target_gone")).drop("source_gone", "target_gone")


def topic_clusters(rows: DataFrame, job, level: int, query: str = "") -> DataFrame:
    """(cluster, title, members, total): clusters of one job and level whose title or members hold the query; members are distinct."""
    mine = rows.where((F.col("job") == job) & (F.col("level") == level))
    found = text_search(mine, query, ["title"], "members")
    total = found.select(F.explode("members").alias("m")).agg(F.count_distinct("m").alias("total"))
    return found.select("cluster", "title", F.size("members").cast("long").alias("members")).crossJoin(F.broadcast(total))


def remapped_edges(edges: DataFrame, canonical: DataFrame) -> DataFrame:
    """Edges with canonical endpoint names (name, canonical); one with a remapped endpoint is AMBIGUOUS."""
    e = edges
    for side in ("source", "target"):
        e = e.join(canonical.select(F.col("name").alias(side), F.col("canonical").alias(f"{side}_c")), side, "left")
    moved = (F.coalesce("source_c", "source") != F.col("source")) | (F.coalesce("target_c", "target") != F.col("target"))
    return e.select("edge_id", F.coalesce("source_c", "source").alias("source"), F.coalesce("target_c", "target").alias("target"), F.when(moved, "AMBIGUOUS").otherwise(F.col("confidence")).alias("confidence"))


def ordered_union(rows: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """(key, values): each value once, in order of its first place."""
    first = rows.groupBy(key, value).agg(F.min(position).alias("p"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", value))), lambda x: x[value]).alias("values"))


def upserted_arrays(old: Column, new: Column) -> Column:
    """The old values, then those of the new ones that are not among them."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(old, none), F.coalesce(new, none))


def latest_facts(direct: DataFrame, cached: DataFrame) -> DataFrame:
    """(run, tag, value): the fact of the highest revision, then id, of each run and tag, its own or one of a run it refers to.

    Takes facts (run, tag, revision, id, value) and references (run, of_run).
    """
    borrowed = cached.join(direct.withColumnRenamed("run", "of_run"), "of_run").select("run", "tag", "revision", "id", "value")
    return direct.select("run", "tag", "revision", "id", "value").unionByName(borrowed).groupBy("run", "tag").agg(F.max_by("value", F.struct("revision", "id")).alias("value"))


def current_upsert(current: DataFrame, facts: DataFrame, key: list[str]) -> DataFrame:
    """The current rows with the latest fact of each key put in; an older fact changes nothing."""
    rest = [c for c in current.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct("revision", "id")).alias("r")
    return current.unionByName(facts.select(*current.columns)).groupBy(*key).agg(best).select(*key, *[F.col("r")[c].alias(c) for c in rest])


def latest_group_versions(assignments: DataFrame, most: int = 8) -> DataFrame:
    """(group_key, version, assigned_at): of each group the version assigned to last, the groups assigned to last first, at most ``most``."""
    v = assignments.groupBy("group_key", "version").agg(F.max("assigned_at").alias("assigned_at"))
    one = v.groupBy("group_key").agg(F.max(F.struct("assigned_at", "version")).alias("x"))
    return one.select("group_key", "x.version", "x.assigned_at").orderBy(F.desc("assigned_at"), "group_key").limit(most)


def edited_stages(transitions: DataFrame, edits: DataFrame) -> DataFrame:
    """Transitions after stages were edited: an edit of unit i is where transition i leads and where i + 1 begins."""
    to = edits.select("reception_id", "sequence_no", F.col("state").alias("to_edit"))
    from_ = edits.select("reception_id", (F.col("sequence_no") + 1).alias("sequence_no"), F.col("state").alias("from_edit"))
    key = ["reception_id", "sequence_no"]
    return transitions.join(to, key, "left").join(from_, key, "left").withColumn("from_state", F.coalesce("from_edit", "from_state")).withColumn("to_state", F.coalesce("to_edit", "to_state")).drop("to_edit", "from_edit")


def insight_report(last: DataFrame, groups: list[str], top: int = 20) -> dict[str, DataFrame]:
    """All parts of the tag report, each a table of its own; nothing is run before a part is read."""
    return {
        "matrix": tagging.matrix(last, groups), "merged": tagging.merged(last, groups), "coverage": tagging.coverage(last, groups), "agreement": tagging.agreement(last),
        "distribution": tagging.distribution(last, ["group_key", "label_key"], "value"), "cooccurrence": tagging.cooccurrence(last, top), "confidence": tagging.confidence_histogram(last), "dimensions": tagging.by_dimension(last),
    }


def insight_load(receptions: DataFrame, canonical: DataFrame, legacy: DataFrame, groups: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Assignments of a page of receptions, the latest first: canonical ones of the latest groups, and legacy ones of cells without any."""
    page = receptions.orderBy(F.desc("started_sec"), F.desc("reception_id")).offset(offset).limit(limit).select(F.col("reception_id").alias("target_id"))
    mine = lambda d: d.join(F.broadcast(page), "target_id", "left_semi")
    return tagging.overridden(mine(canonical).join(F.broadcast(groups.select("group_key")), "group_key", "left_semi").select(legacy.columns), mine(legacy))


def prompt_batches(segments: DataFrame, key: str, order: str, text: str, budget: int) -> DataFrame:
    """(key, batch, order, start, end): greedy batches of at most ``budget`` characters, one line feed between texts.

    A text that does not fit an empty batch is cut at the longest beginning that fits, as often as needed; empty
    texts are left out. A fold over each key's ordered rows, since a batch starts where the one before ended.
    """
    if budget < 1:
        raise ValueError("nothing fits a budget under one character")

    def fold(group_key: tuple, group: list[tuple]) -> list[tuple]:
        out, batch, used = [], 0, 0
        for _, place, length in group:
            at = 0
            while at < length:
                gap = 1 if used else 0
                if used and used + gap + length - at > budget:
                    batch, used = batch + 1, 0
                    continue
                n = min(length - at, budget)
                out.append((group_key[0], batch, place, at, at + n))
                used, at = used + gap + n, at + n
        return out

    return fold_groups(segments.select(key, order, F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n")), [key], [order], fold, f"{key} long, batch long, {order} long, start long, end long")


def bootstrap_candidates(gold: DataFrame, n: int) -> DataFrame:
    """The first n gold rows of the train split, by example."""
    return gold.where("split = 'train'").orderBy("example").limit(n)


def delta_graph(edges: DataFrame, delta: DataFrame) -> DataFrame:
    """Merged edges (source, target, relation, weight, rank) with a batch of relations added: weights add up, the best rank stays."""
    cols = ["source", "target", "relation", "weight", "rank"]
    return edges.select(cols).unionByName(delta.select(cols)).groupBy("source", "target", "relation").agg(F.sum("weight").alias("weight"), F.max("rank").alias("rank"))


def dependency_order(tags: DataFrame, needs: DataFrame) -> DataFrame:
    """(tag, depth): how many steps of ``needs`` (tag, on) lie under each tag; an error if there is a circle.

    A tag's depth is one more than the deepest of those it needs. Rounds end when no depth changes; one
    that still changes after as many rounds as there are tags lies in a circle.
    """
    one = tags.select("tag").distinct()
    depth, most = one.withColumn("depth", F.lit(0)), one.count()
    for _ in range(most + 1):
        up = needs.join(depth.select(F.col("tag").alias("on"), F.col("depth").alias("d")), "on").groupBy("tag").agg((F.max("d") + 1).alias("up"))
        new = settled(depth.join(up, "tag", "left").select("tag", F.col("depth").alias("old"), F.greatest("depth", F.coalesce("up", F.lit(0))).alias("depth")), "depth")
        depth = new.select("tag", "depth")
        if new.where("old <> depth").isEmpty():
            return depth
    raise ValueError("the tags need each other in a circle")


def paths(links: DataFrame, start: int, hops: int) -> DataFrame:
    """(node, path) of the nodes within so many steps of one: a shortest path, the first in order of its nodes."""
    edge = settled(links.sparkSession.createDataFrame([(start, [start])], "node long, path array<long>"), "paths")
    found = edge
    for _ in range(hops):
        step = edge.join(graphs.touching(links, edge), F.col("node") == F.col("a")).groupBy(F.col("b").alias("node")).agg(F.min(F.concat("path", F.array("b"))).alias("path"))
        edge = settled(step.join(found.select("node"), "node", "left_anti"), "paths")
        found = found.unionByName(edge)
    return found


def close_rows(rows: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """Neighbouring rows of a key side by side: (key, left, right) values of a column."""
    w = W.partitionBy(key).orderBy(order)
    return rows.select(key, F.lag(column).over(w).alias("left"), F.col(column).alias("right")).where("left is not null")

