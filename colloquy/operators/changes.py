"""Edges as the outcome of a log of requests: insert, merge and supersede, with an event for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.grouping import fold_groups

_OUT = "source string, row string, position long, relation string, target string, weight long, valid_at long, invalid_at long, superseded_by string, event string"


def edge_key(source: str, relation: str, target: str) -> str:
    return f"{source}|{relation}|{target}"


def _fold(group_key: tuple, requests: list[tuple]) -> list[tuple]:
    """Versions and events of one source's edges; only open edges and the last version of each name are held."""
    source, out, live = group_key[0], [], {}

    def version(edge: dict) -> tuple:
        return (source, "edge", edge["position"], edge["relation"], edge["target"], edge["weight"], edge["valid_at"], edge["invalid_at"], edge["superseded_by"], None)

    def event(position: int, relation: str, target: str, what: str) -> None:
        out.append((source, "event", position, relation, target, None, None, None, None, what))

    def opened(position: int, relation: str, target: str, weight: int, at: int | None) -> None:
        if (relation, target) in live:
            out.append(version(live[relation, target]))
        live[relation, target] = {"position": position, "relation": relation, "target": target, "weight": weight, "valid_at": at, "invalid_at": None, "superseded_by": None}
        event(position, relation, target, "insert")

    for _, position, what, relation, target, weight, at, new_relation, new_target in requests:
        old = live.get((relation, target))
        is_open = old is not None and old["invalid_at"] is None
        if what == "insert" and not is_open:
            opened(position, relation, target, weight, at)
        elif what in ("insert", "merge") and is_open:
            old["weight"] += weight
            event(position, relation, target, "merge")
        elif what == "supersede" and is_open and old["valid_at"] is not None:
            to = new_relation or relation, new_target or target
            old |= {"invalid_at": at, "superseded_by": edge_key(source, *to)}
            event(position, relation, target, "supersede")
            opened(position, *to, old["weight"] if weight is None else weight, at)
        else:
            why = "missing" if old is None else "superseded" if not is_open else "undated" if what == "supersede" else "unknown"
            event(position, relation, target, f"refused: {why}")
    return out + [version(e) for e in live.values()]


def applied(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, events) of requests (source, position, op, relation, target, weight, at, new_relation, new_target) in order of position.

    insert opens an edge at ``at``, or adds its weight to the open one; merge adds weight to an open
    edge; supersede ends it at ``at``, points to the edge of the new relation and target (the old ones where
    missing), opens that with the old weight if none is given, and makes two events. Refused with an
    event are requests on an edge that is missing, already superseded or, to supersede it, without a start. A
    replacement keeps its source, so a source's requests are one fold.

    edges: (source, relation, target, position, weight, valid_at, invalid_at, superseded_by), a row a version; events: (source, position, relation, target, event).
    """
    columns = ["source", "position", "op", "relation", "target", "weight", "at", "new_relation", "new_target"]
    done = fold_groups(requests.select(*columns), ["source"], ["position"], _fold, _OUT)
    edges = done.where("row = 'edge'").select("source", "relation", "target", "position", "weight", "valid_at", "invalid_at", "superseded_by")
    return edges, done.where("row = 'event'").select("source", "position", "relation", "target", "event")


def request_log(edges: DataFrame, weight: str) -> DataFrame:
    """Requests that rebuild dated edges (edge_id, source, relation, target, valid_at): of each name's rows in time the first
    inserts, every third after it supersedes in place, the others merge."""
    from pyspark.sql import Window as W

    order = F.row_number().over(W.partitionBy("source").orderBy("valid_at", "edge_id", "relation", "target")).cast("long")
    rows = edges.where("valid_at is not null").withColumn("order", order)
    place = F.row_number().over(W.partitionBy("source", "relation", "target").orderBy("order")) - 1
    rows = rows.withColumn("place", place)
    op = F.when(F.col("place") == 0, "insert").when(F.col("place") % 3 == 0, "supersede").otherwise("merge")
    none = F.lit(None).cast("string")
    return rows.select("source", F.col("order").alias("position"), op.alias("op"), "relation", "target", F.col(weight).cast("long").alias("weight"), F.col("valid_at").cast("long").alias("at"), none.alias("new_relation"), none.alias("new_target"))
