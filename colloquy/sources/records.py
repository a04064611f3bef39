"""Records in a model's answer, whatever of the two formats it took, and all that is held about a recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import scrubbed
from colloquy.sources.parsers import DONE, FIELD, RECORD

#: Fixed values of the extraction protocol: the first field of a record, and a field of a line with commas.
ENTITY, RELATION = ("实体", "entity"), ("关系", "relation")
COMMA_FIELD = r"""\"([^\"]*)\"|'([^']*)'|([^,]+)"""


def _clean(field: Column) -> Column:
    """Without white space around, then without one pair of equal quotes around, then without white space again."""
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return trim(F.regexp_replace(trim(field), r"(?s)^([\"'])(.*)\1$", "$2"))


def records(outputs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, place, fields) of every record in an answer, up to the mark that says it is complete.

    Records are parted by the record mark or, in an answer without one, by lines. A record's
    fields are parted by the field mark or, in one without, by commas; a quote that follows a comma
    at once holds commas together. Parentheses around a record and quotes around a field go. Null and empty answers have no records.
    """
    said = F.split_part(F.col(column), F.lit(DONE), F.lit(1))
    parts = F.when(F.contains(said, F.lit(RECORD)), F.split(said, RECORD)).otherwise(F.split(said, "\n"))
    one = outputs.select(key, F.posexplode(F.transform(parts, lambda r: F.regexp_replace(r, r"(?U)^\s+|\s+$", ""))).alias("place", "r")).where("r <> ''")
    bare = one.withColumn("r", F.regexp_replace("r", r"(?s)^\((.*)\)$", "$1"))
    fields = F.when(F.contains("r", F.lit(FIELD)), F.split("r", r"<\|>")).otherwise(F.regexp_extract_all("r", F.lit(COMMA_FIELD), F.lit(0)))
    return bare.select(key, "place", F.transform(fields, _clean).alias("fields"))


def entities_and_relations(outputs: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(key, place, name, type, description) and (key, place, source, target, relation, description); records of another kind, or too short, are left out."""
    r = records(outputs, key, column)
    at = lambda i: F.get("fields", F.lit(i))
    e = r.where(at(0).isin(*ENTITY) & (F.size("fields") >= 4)).select(key, "place", at(1).alias("name"), at(2).alias("type"), at(3).alias("description"))
    f = r.where(at(0).isin(*RELATION) & (F.size("fields") >= 5)).select(key, "place", at(1).alias("source"), at(3).alias("target"), at(2).alias("relation"), at(4).alias("description"))
    return e, f


def parsed(outputs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, entities, relations, parsed) of every answer, also of those that hold nothing."""
    e, r = entities_and_relations(outputs, key, column)
    n = e.select(key, F.lit(1).alias("e"), F.lit(0).alias("r")).unionByName(r.select(key, F.lit(0).alias("e"), F.lit(1).alias("r"))).groupBy(key).agg(F.sum("e").alias("entities"), F.sum("r").alias("relations"))
    return outputs.select(key).distinct().join(n, key, "left").fillna(0, ["entities", "relations"]).withColumn("parsed", F.col("entities") + F.col("relations") > 0)


def export(parts: dict[str, tuple[DataFrame, str, list[str]]], key: str, value) -> DataFrame:
    """(kind, id, body): everything of every part (rows, id column, columns to give) whose ``key`` is the value; the filter reaches each scan.

    What a part does not name, such as a raw voice vector, stays inside.
    """
    out = None
    for kind, (rows, id_, columns) in parts.items():
        one = rows.where(F.col(key) == value).select(F.lit(kind).alias("kind"), F.col(id_).cast("string").alias("id"), F.to_json(F.struct(*columns)).alias("body"))
        out = one if out is None else out.unionByName(one)
    return out


def transcripts(segments: DataFrame, key: str, value) -> DataFrame:
    """(kind, id, body) of a recording's raw and masked transcript, a line a segment; a segment without words is an empty line."""
    mine = segments.where(F.col(key) == value).groupBy(F.col(key).cast("string").alias("id")).agg(F.array_sort(F.collect_list(F.struct("start_sec", "end_sec", "segment_id", F.coalesce("transcript", F.lit("")).alias("said")))).alias("s"))
    line = lambda mask: F.array_join(F.transform("s", lambda x: scrubbed(x["said"]) if mask else x["said"]), "\n")
    kinds = F.explode(F.array(F.struct(F.lit("transcript").alias("kind"), line(False).alias("body")), F.struct(F.lit("scrubbed_transcript").alias("kind"), line(True).alias("body"))))
    return mine.select("id", kinds.alias("k")).select("k.kind", "id", "k.body")
