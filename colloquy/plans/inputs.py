"""The library's domain tables, derived from the given star schema by plain SQL.

One SELECT per table, in SQL that Spark and the oracle both read, so both sides of a
comparison start from the same rows and everything grows with the given tables. Times are
whole seconds or days, as the operators take them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.session import bounded

#: name -> (domain or given tables it reads, SELECT)
SELECTS: dict[str, tuple[tuple[str, ...], str]] = {
    "receptions": (("events",), """
        SELECT user_id AS reception_id, concat('t', CAST(user_id % 2 AS STRING)) AS tenant_id, user_id % 5 AS store_id, user_id % 11 AS agent_id,
               CASE WHEN user_id % 3 = 0 THEN 'jewelry' ELSE 'automotive' END AS scenario, min(event_id) AS started_sec, max(event_id) AS ended_sec
        FROM {events} GROUP BY user_id"""),
    "transitions": (("events",), """
        SELECT event_id AS transition_id, user_id AS reception_id, concat('t', CAST(user_id % 2 AS STRING)) AS tenant_id,
               CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS sequence_no,
               coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), '__start__') AS from_state, event_type AS to_state,
               concat('trigger', CAST(event_id % 7 AS STRING)) AS reason, CAST(event_id % 100 AS DOUBLE) / 100 AS confidence, event_id % 4 AS evidence
        FROM {events}"""),
    "recordings": (("orders",), """
        SELECT o_orderkey AS recording_id, concat('t', CAST(o_custkey % 3 AS STRING)) AS tenant_id, o_custkey % 20 AS store_id, o_custkey % 7 AS agent_id,
               CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey % 50 END AS customer, o_orderstatus AS status,
               (o_orderkey * 37) % 864000 AS started_sec, (o_orderkey * 37) % 864000 + 60 + o_orderkey % 600 AS ended_sec
        FROM {orders}"""),
    "segments": (("lineitem",), """
        SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS segment_id, l_orderkey AS recording_id, CAST(l_linenumber AS BIGINT) AS idx,
               l_linenumber * 20 + l_partkey % 7 AS start_sec, l_linenumber * 20 + l_partkey % 7 + 1 + CAST(l_quantity AS BIGINT) % 30 AS end_sec,
               concat('sp', CAST(l_suppkey % 3 AS STRING)) AS speaker, CAST(l_quantity AS BIGINT) % 40 AS tokens, CAST(l_partkey % 100 AS DOUBLE) / 100 AS vad,
               CASE l_partkey % 6 WHEN 0 THEN 'greeting' WHEN 1 THEN 'needs' WHEN 2 THEN 'offer' ELSE 'unknown' END AS stage
        FROM {lineitem}"""),
    "utterances": (("lineitem",), """
        SELECT DISTINCT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS segment_id, l_orderkey AS recording_id, CAST(l_linenumber * 20 + l_partkey % 7 AS DOUBLE) AS start_sec,
               CAST(l_linenumber * 20 + l_partkey % 7 + 1 + CAST(l_quantity AS BIGINT) % 30 AS DOUBLE) AS end_sec, CASE WHEN l_suppkey % 7 <> 0 THEN concat('sp', CAST(l_suppkey % 3 AS STRING)) END AS speaker,
               CAST(l_partkey % 100 AS DOUBLE) / 100 AS vad, CASE l_orderkey % 5 WHEN 0 THEN 'generic' WHEN 1 THEN 'automotive' WHEN 2 THEN 'automotive' ELSE 'gold_jewelry' END AS scenario,
               CASE l_partkey % 14 WHEN 0 THEN '您好，欢迎光临' WHEN 1 THEN '想看项链，预算不高' WHEN 2 THEN '足金的克重和工费怎么算' WHEN 3 THEN '金价有优惠活动' WHEN 4 THEN '太贵，再便宜一点，考虑一下' WHEN 5 THEN '微信付款' WHEN 6 THEN ''
                 WHEN 7 THEN '嗯' WHEN 8 THEN '配置和续航怎么样' WHEN 9 THEN ' 分期首付多少 ' WHEN 10 THEN '预约试驾' WHEN 11 THEN '  ' WHEN 12 THEN concat('编号 ', CAST(l_partkey AS STRING), ' 的这款车，空间很大，说明书第 ', CAST(l_suppkey AS STRING), ' 页写得很清楚，请您慢慢看，不用着急做决定') ELSE '慢走，再见' END AS transcript,
               CASE WHEN l_suppkey % 11 = 0 THEN '活动' END AS topic_hint, CASE WHEN l_suppkey % 13 = 0 AND l_orderkey % 5 <> 0 THEN 'needs' END AS stage_hint,
               CASE WHEN l_partkey % 4 <> 0 THEN CAST(l_partkey % 5 - 2 AS DOUBLE) END AS e0, CAST(l_suppkey % 3 AS DOUBLE) AS e1
        FROM {lineitem}"""),
    "assignments": (("lineitem",), """
        SELECT CASE l_returnflag WHEN 'A' THEN 'rules' WHEN 'N' THEN 'model' ELSE 'review' END AS group_key,
               CASE l_returnflag WHEN 'A' THEN 10 WHEN 'N' THEN 20 ELSE 30 END AS priority, l_returnflag = 'R' AS is_manual,
               l_orderkey % 2000 AS target_id, concat('label', CAST(l_linenumber % 3 AS STRING)) AS label_key, concat('v', CAST(l_suppkey % 4 AS STRING)) AS value,
               CASE WHEN l_partkey % 10 <> 0 THEN CAST(l_partkey % 100 AS DOUBLE) / 100 END AS confidence, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS assignment_id,
               CASE WHEN l_suppkey % 9 <> 0 THEN l_suppkey % 5 END AS store_id, l_partkey % 9 AS agent_id, l_shipdate AS occurred_at
        FROM {lineitem}"""),
    "mentions": (("lineitem",), """
        SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS position, concat('e', CAST(l_partkey AS STRING)) AS name,
               CASE l_suppkey % 5 WHEN 0 THEN 'brand' WHEN 1 THEN 'person' ELSE 'product' END AS type, concat('about ', CAST(l_suppkey % 6 AS STRING)) AS description,
               concat(CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS source_id, l_orderkey AS recording_id
        FROM {lineitem}"""),
    "relations": (("lineitem",), """
        SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS position, concat('e', CAST(l_partkey AS STRING)) AS source, concat('e', CAST(l_suppkey * 31 AS STRING)) AS target,
               CASE l_returnflag WHEN 'A' THEN 'buys' WHEN 'N' THEN 'likes' ELSE 'asks' END AS relation, CAST(l_quantity AS BIGINT) AS weight,
               l_linenumber % 3 AS rank, l_orderkey AS recording_id, concat(CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS source_id
        FROM {lineitem}"""),
    "edges": (("lineitem",), """
        SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS edge_id, concat('e', CAST(l_partkey AS STRING)) AS source, concat('e', CAST(l_suppkey * 31 AS STRING)) AS target,
               CASE l_returnflag WHEN 'A' THEN 'buys' WHEN 'N' THEN 'likes' ELSE 'asks' END AS relation,
               CASE WHEN l_orderkey % 10 <> 0 THEN l_orderkey % 1000 END AS valid_at, CASE WHEN l_linenumber % 3 = 0 THEN l_orderkey % 1000 + 50 END AS invalid_at,
               CASE WHEN l_partkey % 8 = 0 THEN l_orderkey % 1000 + 80 END AS expired_at, CASE l_suppkey % 3 WHEN 0 THEN 'AMBIGUOUS' WHEN 1 THEN 'INFERRED' ELSE 'EXTRACTED' END AS confidence
        FROM {lineitem}"""),
    "links": (("lineitem",), """
        SELECT DISTINCT least(2 * l_partkey, 2 * l_suppkey + 1) AS a, greatest(2 * l_partkey, 2 * l_suppkey + 1) AS b FROM {lineitem}"""),
    "vectors": (("embeddings",), "SELECT vec_id, embedding, label FROM {embeddings}"),
    "turns": (("conversations",), "SELECT conv_id, turn, role, text FROM {conversations}"),
    "frames": (("events",), """
        SELECT concat('s', CAST(user_id AS STRING)) AS session_id, event_id AS arrival, (event_id * 7919) % 50 AS seq, CAST(floor(value) AS BIGINT) AS payload, user_id FROM {events}"""),
    "calls": (("lineitem",), """
        SELECT concat('m', CAST(l_suppkey % 4 AS STRING)) AS model, concat('p', CAST(l_partkey % 3 AS STRING)) AS purpose, l_orderkey % 5000 AS tokens_in, l_partkey % 900 AS tokens_out,
               least(l_orderkey % 5000, l_suppkey % 700) AS tokens_cached, l_linenumber % 3 = 0 AS cache_hit, CAST(l_quantity AS BIGINT) * 13 AS latency_ms, l_linenumber % 5 = 0 AS failed, l_orderkey AS run_id
        FROM {lineitem}"""),
    "predictions": (("lineitem",), """
        SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS subject_id, concat('tag', CAST(l_linenumber % 4 AS STRING)) AS tag_key, concat('v', CAST(l_suppkey % 3 AS STRING)) AS expected,
               CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_partkey % 5 = 0 THEN concat('v', CAST((l_suppkey + 1) % 3 AS STRING)) ELSE concat('v', CAST(l_suppkey % 3 AS STRING)) END AS predicted,
               CAST(l_partkey % 101 AS DOUBLE) / 101 AS confidence, CASE WHEN l_orderkey % 2 = 0 THEN 'base' ELSE 'candidate' END AS side, CAST(1 + l_suppkey % 4 AS DOUBLE) / 4 AS probability, l_orderkey % 12 AS cohort
        FROM {lineitem}"""),
}


class Inputs:
    """``inputs.segments`` and so on: each domain or given table of ``sf_dir`` as a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        bounded(spark)
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in SELECTS:
            return self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        reads, select = SELECTS[name]
        return self._spark.sql(select, **{t: getattr(self, t) for t in reads})


def with_clause(names: tuple[str, ...]) -> str:
    """The same tables as common table expressions of an oracle query."""
    parts = [f"{n} AS ({SELECTS[n][1].format(**{t: t for t in SELECTS[n][0]})})" for n in names if n in SELECTS]
    return "WITH " + ",\n".join(parts) if parts else ""
