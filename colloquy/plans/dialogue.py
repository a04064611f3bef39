"""Queries of dialogue units from transcripts and vectors."""

from pyspark.sql import functions as F

from colloquy.operators import dialogue as op
from colloquy.plans.registry import query

U = ("utterances",)


def utterances(t):
    vector = F.when(F.col("e0").isNotNull(), F.array("e0", "e1"))
    return t.utterances.withColumn("embedding", vector).drop("e0", "e1")


_PHRASES = ", ".join(f"('{s}', {i}, '{stage}', '{p}')" for s, stages in op.PHRASES.items() for i, (stage, phrases) in enumerate(stages.items()) for p in phrases)
_TOPICS = " ".join(f"WHEN '{s}' THEN '{t}'" for s, t in op.TOPICS.items())
W = "(PARTITION BY recording_id ORDER BY start_sec, end_sec, segment_id)"
STAGED = f"""ph AS (SELECT * FROM (VALUES {_PHRASES}) v(scenario, place, stage, phrase)),
x AS (SELECT *, regexp_replace(coalesce(transcript, ''), '^\\s+|\\s+$', '', 'g') AS txt FROM utterances),
hit AS (SELECT recording_id, segment_id, stage, sum(length(phrase)) AS strength, count(*) AS n, row_number() OVER (PARTITION BY recording_id, segment_id ORDER BY sum(length(phrase)) DESC, place) AS k
  FROM x JOIN ph USING (scenario) WHERE contains(transcript, phrase) GROUP BY recording_id, segment_id, stage, place),
o AS (SELECT x.*, CASE WHEN txt <> '' THEN stage_hint END AS said, CASE WHEN txt = '' OR stage_hint IS NULL THEN hit.stage END AS matched, strength, n, row_number() OVER (PARTITION BY x.recording_id ORDER BY start_sec, end_sec, x.segment_id) AS i FROM x LEFT JOIN hit ON hit.recording_id = x.recording_id AND hit.segment_id = x.segment_id AND k = 1),
kn AS (SELECT *, last_value(coalesce(said, matched) IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY start_sec, end_sec, segment_id ROWS UNBOUNDED PRECEDING) AS known FROM o),
st AS (SELECT *, coalesce(known, 'unknown') AS stage, CAST(CASE WHEN said IS NOT NULL THEN 9800 WHEN matched IS NOT NULL THEN least(9600, 6400 + 500 * n + 100 * strength) WHEN known IS NOT NULL THEN 5600 ELSE 3500 END AS BIGINT) AS conf FROM kn),
ab AS (SELECT *, CASE WHEN txt <> '' OR i = 1 THEN coalesce(CASE WHEN txt <> '' THEN topic_hint END, CASE stage {_TOPICS} ELSE '未分类' END) END AS about FROM st),
tp AS (SELECT *, last_value(about IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY start_sec, end_sec, segment_id ROWS UNBOUNDED PRECEDING) AS topic FROM ab)"""
SCORED = f"""{STAGED},
lg AS (SELECT *, start_sec - lag(end_sec) OVER w AS pause, lag(stage) OVER w AS stage0, lag(topic) OVER w AS topic0, lag(speaker) OVER w AS speaker0,
  CASE WHEN txt <> '' AND lag(txt) OVER w <> '' AND e0 IS NOT NULL AND lag(e0) OVER w IS NOT NULL AND (e0 <> 0 OR e1 <> 0) AND (lag(e0) OVER w <> 0 OR lag(e1) OVER w <> 0)
    THEN 1 - (e0 * lag(e0) OVER w + e1 * lag(e1) OVER w) / (sqrt(e0 * e0 + e1 * e1) * sqrt(lag(e0) OVER w * lag(e0) OVER w + lag(e1) OVER w * lag(e1) OVER w)) END AS away FROM tp WINDOW w AS {W}),
sg AS (SELECT *, list_filter([CASE WHEN pause >= 8 THEN 'long_pause' WHEN pause >= 3 THEN 'pause' END, CASE WHEN away >= 0.35::DOUBLE THEN 'semantic_shift' END, CASE WHEN stage <> stage0 AND stage <> 'unknown' AND stage0 <> 'unknown' THEN 'business_stage_change' END,
  CASE WHEN topic <> topic0 AND topic <> '未分类' AND topic0 <> '未分类' THEN 'topic_change' END, CASE WHEN speaker <> speaker0 THEN 'speaker_change' END], lambda c: c IS NOT NULL) AS codes FROM lg),
sc AS (SELECT *, CASE WHEN i = 1 THEN 0 ELSE least(100, CASE WHEN pause >= 8 THEN 55 WHEN pause >= 3 THEN 30 ELSE 0 END + CASE WHEN away >= 0.6::DOUBLE THEN 35 WHEN away >= 0.35::DOUBLE THEN 22 ELSE 0 END + CASE WHEN list_contains(codes, 'business_stage_change') THEN 25 ELSE 0 END
  + CASE WHEN list_contains(codes, 'topic_change') THEN 20 ELSE 0 END + CASE WHEN list_contains(codes, 'speaker_change') THEN 8 ELSE 0 END) END AS score, CASE WHEN i = 1 THEN 'recording_start' ELSE array_to_string(codes, '+') END AS reason FROM sg)"""


@query("win7_stages_from_text", U, f"WITH {STAGED} SELECT segment_id, stage, conf AS confidence, topic FROM tp")
def _(t):
    return op.staged(utterances(t)).select("segment_id", "stage", "confidence", "topic")


@query("win8_boundaries_from_text", U, f"WITH {SCORED} SELECT segment_id, score, reason, i = 1 OR score >= 50 AS cut FROM sc")
def _(t):
    return op.scored(utterances(t)).select("segment_id", "score", "reason", "cut")


@query("win10_units_from_text", U, f"""WITH {SCORED},
u AS (SELECT *, CAST(sum(CASE WHEN i = 1 OR score >= 50 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY i) - 1 AS BIGINT) AS unit FROM sc),
ms AS (SELECT recording_id, unit, stage, sum(conf) AS total, count(*) AS n, row_number() OVER (PARTITION BY recording_id, unit ORDER BY count(*) DESC, min(i)) AS k FROM u GROUP BY 1, 2, 3),
mt AS (SELECT recording_id, unit, topic, row_number() OVER (PARTITION BY recording_id, unit ORDER BY count(*) DESC, min(i)) AS k FROM u GROUP BY 1, 2, 3),
g AS (SELECT recording_id, unit, min(start_sec) AS start_sec, max(end_sec) AS end_sec, count(*) AS segments, coalesce(string_agg(txt, ' ' ORDER BY i) FILTER (txt <> ''), '') AS whole, arg_min(score, i) AS score, arg_min(reason, i) AS reason,
  65 * sum(conf) + 35 * sum(CAST(round(vad * 10000) AS BIGINT)) AS num, 100 * count(*) AS den FROM u GROUP BY 1, 2)
SELECT g.recording_id, g.unit, start_sec, end_sec, segments, ms.stage, mt.topic, CASE WHEN length(whole) > 180 THEN left(whole, 179) || '…' ELSE whole END AS summary,
  CAST(least(10000, (2 * num + den) // (2 * den)) AS BIGINT) AS confidence, CAST((2 * total + n) // (2 * n) AS BIGINT) AS stage_confidence, score, reason
FROM g JOIN ms ON ms.recording_id = g.recording_id AND ms.unit = g.unit AND ms.k = 1 JOIN mt ON mt.recording_id = g.recording_id AND mt.unit = g.unit AND mt.k = 1""")
def _(t):
    return op.units(utterances(t))
