"""Queries of answers in two formats, whole exports, lists in every order, profiles from transcripts."""

from pyspark.sql import functions as F

from colloquy.operators import browse, graphs, tabular
from colloquy.plans.graphs import BFS, start
from colloquy.plans.registry import query
from colloquy.sources import records as op

SAID = """SELECT position, concat(CASE position % 3 WHEN 0 THEN '("实体"<|>' WHEN 1 THEN '(entity,' ELSE 'entity,' END,
  CASE position % 3 WHEN 0 THEN concat(name, '<|>', type, '<|>"', description, '")##("关系"<|>a<|>b)##(entity<|>short)<|COMPLETE|>(entity<|>x<|>y<|>z)') WHEN 1 THEN concat('"', name, '",''', type, ''',"', description, ', more")') ELSE concat(name, ',', type, ',', description, ',extra') END,
  CASE WHEN position % 3 = 2 THEN concat('\\n\\n (relation,"', name, '", likes ,''b, c'', why)\\nnothing here') ELSE '' END) AS said FROM {m}"""


def _answers(t):
    return t.mentions.sparkSession.sql(SAID, m=t.mentions)


@query("src10_answers", ("mentions",), "SELECT position, name, type, CASE WHEN position % 3 = 1 THEN description || ', more' ELSE description END AS description FROM mentions")
def _(t):
    """Marked records and lines with commas, quoted or not."""
    return op.entities_and_relations(_answers(t), "position", "said")[0].drop("place")


@query("src10_answer_relations", ("mentions",), "SELECT position, name AS source, 'b, c' AS target, 'likes' AS relation, 'why' AS description FROM mentions WHERE position % 3 = 2")
def _(t):
    return op.entities_and_relations(_answers(t), "position", "said")[1].drop("place")


@query("src12_whole_export", ("recordings", "utterances", "assignments", "calls", "vectors"), """
SELECT 'segment' AS kind, CAST(segment_id AS STRING) AS id, '{"start_sec":' || CAST(start_sec AS STRING) || ',"end_sec":' || CAST(end_sec AS STRING) || '}' AS body FROM utterances WHERE recording_id = 8
UNION ALL SELECT 'recording', CAST(recording_id AS STRING), '{"store_id":' || CAST(store_id AS STRING) || ',"status":"' || status || '"}' FROM recordings WHERE recording_id = 8
UNION ALL SELECT 'tag', CAST(assignment_id AS STRING), '{"label_key":"' || label_key || '","value":"' || value || '"}' FROM assignments WHERE target_id = 8
UNION ALL SELECT 'audit', CAST(run_id AS STRING), '{"model":"' || model || '","purpose":"' || purpose || '"}' FROM calls WHERE run_id = 8
UNION ALL SELECT 'voiceprint', CAST(vec_id AS STRING), '{"label":' || CAST(label AS STRING) || '}' FROM vectors WHERE vec_id = 8
UNION ALL SELECT k, '8', said FROM (SELECT string_agg(coalesce(transcript, ''), chr(10) ORDER BY start_sec, end_sec, segment_id) AS said FROM utterances WHERE recording_id = 8), (VALUES ('transcript'), ('scrubbed_transcript')) v(k) WHERE said IS NOT NULL""")
def _(t):
    """One recording's rows of every table, and its transcripts; vectors stay inside."""
    parts = {
        "recording": (t.recordings, "recording_id", ["store_id", "status"]), "segment": (t.utterances, "segment_id", ["start_sec", "end_sec"]),
        "tag": (t.assignments.withColumn("recording_id", F.col("target_id")), "assignment_id", ["label_key", "value"]), "audit": (t.calls.withColumn("recording_id", F.col("run_id")), "run_id", ["model", "purpose"]),
        "voiceprint": (t.vectors.withColumn("recording_id", F.col("vec_id")), "vec_id", ["label"]),
    }
    return op.export(parts, "recording_id", 8).unionByName(op.transcripts(t.utterances, "recording_id", 8))


@query("flt1_recordings_in_order", ("recordings",), """
WITH f AS (SELECT * FROM recordings WHERE store_id IN (3, 4, 5, 6) AND agent_id = 2 AND started_sec BETWEEN 1000 AND 700000), n AS (SELECT count(*) AS total FROM f)
SELECT 'started_sec' AS "order", recording_id, total FROM (SELECT * FROM f ORDER BY started_sec, recording_id LIMIT 25 OFFSET 25), n UNION ALL SELECT '-started_sec', recording_id, total FROM (SELECT * FROM f ORDER BY started_sec DESC, recording_id DESC LIMIT 25 OFFSET 25), n
UNION ALL SELECT 'recording_id', recording_id, total FROM (SELECT * FROM f ORDER BY recording_id LIMIT 25 OFFSET 25), n UNION ALL SELECT '-recording_id', recording_id, total FROM (SELECT * FROM f ORDER BY recording_id DESC LIMIT 25 OFFSET 25), n""")
def _(t):
    """The second page in each order; a stable owner outranks the display name."""
    pages = [browse.recording_list(t.recordings.withColumn("agent_name", F.lit("someone else")), {"store_id": [3, 4, 5, 6]}, ("started_sec", 1000, 700000), o, 2, 25, owner=2, name="nobody").select(F.lit(o).alias("order"), "recording_id", "total") for o in ("started_sec", "-started_sec", "recording_id", "-recording_id")]
    return pages[0].unionByName(pages[1]).unionByName(pages[2]).unionByName(pages[3])


@query("agg25_profile_of_speech", ("utterances",), """
SELECT recording_id, round(greatest(0, max(end_sec) - min(start_sec)), 3) AS duration, count(*) AS segments, count(DISTINCT speaker) AS speakers, round(avg(vad), 6) AS vad, CAST(coalesce(sum(length(regexp_replace(transcript, '\\s', '', 'g'))), 0) AS BIGINT) AS characters FROM utterances GROUP BY 1""")
def _(t):
    return tabular.speech_profile(t.utterances)


@query("gr6_subgraph_window", ("links",), f"WITH {BFS}, top AS (SELECT node FROM hops ORDER BY hop, node LIMIT 40) SELECT a, b, (SELECT count(*) FROM hops) AS total_nodes FROM links WHERE a IN (SELECT node FROM top) AND b IN (SELECT node FROM top) ORDER BY a, b LIMIT 100")
def _(t):
    return graphs.subgraph_window(t.links, start(t), 2, 40, 100)
