"""Text formats as DataFrames: speaker files, trial files, extraction output, lists in JSON, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rttm(lines: DataFrame, column: str = "value") -> DataFrame:
    """(file, speaker, start_sec, end_sec) of SPEAKER lines; other and short lines are left out."""
    p = F.split(F.trim(column), r"\s+")
    ok = lines.withColumn("p", p).where((F.get("p", F.lit(0)) == "SPEAKER") & (F.size("p") >= 8))
    start, length = F.get("p", F.lit(3)).try_cast("double"), F.get("p", F.lit(4)).try_cast("double")
    return ok.select(F.get("p", F.lit(1)).alias("file"), F.get("p", F.lit(7)).alias("speaker"), start.alias("start_sec"), (start + length).alias("end_sec")).where("end_sec is not null")


def trials(lines: DataFrame, column: str = "value") -> DataFrame:
    """(enrollment, test, same) of `path path 0|1` lines; blanks, comments and broken lines are left out."""
    p = F.split(F.trim(column), r"\s+")
    ok = lines.withColumn("p", p).where(~F.startswith(F.trim(column), F.lit("#")) & (F.size("p") == 3) & F.get("p", F.lit(2)).isin("0", "1"))
    return ok.select(F.get("p", F.lit(0)).alias("enrollment"), F.get("p", F.lit(1)).alias("test"), (F.get("p", F.lit(2)) == "1").alias("same"))


#: Fixed values of the extraction protocol.
FIELD, RECORD, DONE = "<|>", "##", "<|COMPLETE|>"


def extraction(outputs: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) from a model's output; records of the wrong kind or length are left out."""
    records = outputs.select(key, F.explode(F.split(F.replace(column, F.lit(DONE), F.lit("")), RECORD)).alias("r"))
    fields = F.transform(F.split(F.regexp_replace(F.trim("r"), r"^\(|\)$", ""), r"<\|>"), lambda x: F.trim(F.replace(x, F.lit('"'), F.lit(""))))
    f = records.select(key, fields.alias("f"))
    g = lambda i: F.get("f", F.lit(i))
    entities = f.where((F.lower(g(0)) == "entity") & (F.size("f") == 4)).select(key, g(1).alias("name"), g(2).alias("type"), g(3).alias("description"))
    relations = f.where((F.lower(g(0)) == "relationship") & (F.size("f") >= 5)).select(key, g(1).alias("source"), g(2).alias("target"), g(3).alias("description"), F.coalesce(g(4).try_cast("double"), F.lit(1.0)).alias("weight"))
    return entities, relations


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with rows of the same key replaced."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes)


def export_bundle(recordings: DataFrame, segments: DataFrame, recording_id: int) -> DataFrame:
    """Everything held about one recording, one row per thing."""
    a = recordings.where(F.col("recording_id") == recording_id).select(F.lit("recording").alias("kind"), F.col("recording_id").alias("id"), F.to_json(F.struct("store_id", "status")).alias("body"))
    b = segments.where(F.col("recording_id") == recording_id).select(F.lit("segment").alias("kind"), F.col("segment_id").alias("id"), F.to_json(F.struct("idx", "speaker")).alias("body"))
    return a.unionByName(b)


GOLD = "query string, gold_answer string, gold_context_ids array<string>, gold_edges array<struct<src:string,rel:string,dst:string,confidence:string>>"


def gold_examples(lines: DataFrame, column: str = "value") -> DataFrame:
    """Gold examples from one JSON document a row: a list of them or a single one; broken rows and ones without a query are left out."""
    one = F.from_json(column, GOLD)
    many = F.from_json(column, f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in GOLD.split(', '))}>>")
    listed = F.startswith(F.trim(column), F.lit("["))
    return lines.select(F.explode(F.when(listed, many).otherwise(F.array(one))).alias("g")).where("g.query is not null").select("g.*")


DIALOGUE = "case_id string, scenario string, segments array<struct<segment_id:string,start_sec:double,end_sec:double,transcript:string>>, boundary_after_segment_ids array<string>"


def dialogue_gold(lines: DataFrame, column: str = "value") -> DataFrame:
    """(case_id, scenario, segment_id, start_sec, end_sec, transcript, boundary) of valid cases.

    A case is valid if its segment ids are distinct and its boundaries stand after segments it has.
    """
    c = lines.select(F.from_json(column, DIALOGUE).alias("c")).select("c.*").where("case_id is not null")
    ids = F.col("segments.segment_id")
    known = F.coalesce("boundary_after_segment_ids", F.array().cast("array<string>"))
    ok = c.where((F.size(F.array_distinct(ids)) == F.size(ids)) & (F.size(F.array_except(known, ids)) == 0))
    s = ok.select("case_id", "scenario", known.alias("known"), F.explode("segments").alias("s"))
    return s.select("case_id", "scenario", "s.*", F.array_contains("known", F.col("s.segment_id")).alias("boundary"))
