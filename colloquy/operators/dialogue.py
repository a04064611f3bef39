"""Dialogue units from transcripts: business stages by phrases, topics, boundary scores, units with their text.

Takes segments (recording_id, segment_id, start_sec, end_sec, transcript, scenario, speaker, vad, embedding,
topic_hint, stage_hint). Within a recording they go by start, end and id. Confidences and scores are
counted in whole ten-thousandths and hundredths, so that a mean is the same whatever the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.operators.retrieval import dot

# The stages of each scenario in their order, and the phrases that tell them.
PHRASES: dict[str, dict[str, list[str]]] = {
    "gold_jewelry": {
        "greeting": ["欢迎光临", "您好", "你好", "欢迎到店"],
        "needs": ["预算", "送人", "自戴", "婚戒", "项链", "手镯", "想买", "想看", "喜欢什么", "主要是"],
        "selection_try_on": ["试戴", "选款", "看看这款", "戴一下", "挑一款"],
        "product_explanation": ["足金", "纯度", "克重", "工费", "材质", "999", "计价"],
        "price_promotion": ["金价", "价格", "活动", "优惠", "满减", "折扣价"],
        "objection_negotiation": ["太贵", "贵", "申请", "再便宜", "谈优惠", "折扣", "考虑一下"],
        "payment": ["付款", "刷卡", "微信", "支付宝", "结账", "收款"],
        "after_sales": ["保修", "售后", "以旧换新", "清洗", "换款", "维修"],
        "closing": ["感谢光临", "慢走", "欢迎下次", "再见"],
    },
    "automotive": {
        "greeting": ["欢迎到店", "欢迎光临", "您好", "你好", "看车"],
        "needs": ["预算", "家用", "通勤", "几口人", "需求", "想看", "SUV", "轿车"],
        "vehicle_intro": ["配置", "续航", "动力", "高配", "低配", "车型", "空间", "这款车"],
        "quote": ["报价", "裸车", "落地价", "指导价", "保险", "购置税"],
        "finance": ["分期", "首付", "贷款", "月供", "利率", "金融"],
        "trade_in": ["置换", "旧车", "置换补贴", "二手车"],
        "test_drive": ["试驾", "试乘", "预约试驾"],
        "objection": ["太贵", "价格高", "担心", "再谈", "竞品", "考虑"],
        "appointment_order": ["定金", "订金", "锁单", "下单", "预约到店"],
        "delivery_after_sales": ["提车", "交付", "上牌", "保养", "售后", "质保"],
        "closing": ["感谢到店", "随时联系", "慢走", "再见", "回去考虑"],
    },
}
# What a unit of each stage is about.
TOPICS = {
    "greeting": "接待问候", "needs": "需求了解", "selection_try_on": "选款试戴", "product_explanation": "产品讲解", "price_promotion": "价格优惠", "objection_negotiation": "异议议价",
    "payment": "成交支付", "after_sales": "售后说明", "vehicle_intro": "车型配置", "quote": "报价方案", "finance": "金融方案", "trade_in": "置换方案", "test_drive": "试乘试驾",
    "objection": "异议处理", "appointment_order": "预约下订", "delivery_after_sales": "交付售后", "closing": "结束送别",
}
UNKNOWN, NO_TOPIC = "unknown", "未分类"
# Fixed values, in hundredths: what speaks for a boundary, and from where on there is one.
LONG_PAUSE, PAUSE, FAR, APART, STAGE, TOPIC, SPEAKER, BOUNDARY = 55, 30, 35, 22, 25, 20, 8, 50
LONG_SEC, MEDIUM_SEC, FAR_AT, APART_AT = 8.0, 3.0, 0.60, 0.35
# Fixed values, in ten-thousandths: confidence of a hint, of a carried stage and of none.
SAID, CARRIED, NONE = 9800, 5600, 3500
SUMMARY = 180


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def by_phrases(text: Column, scenario: Column) -> Column:
    """(strength, place, stage, found) of the stage whose phrases in the text are longest together, the earlier on a tie; null without any."""
    found = F.lit(None).cast("struct<strength:int,place:int,stage:string,found:int>")
    for name, stages in PHRASES.items():
        known = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("s"), F.array(*[F.lit(p) for p in phrases]).alias("p")) for i, (s, phrases) in enumerate(stages.items())])
        hits = F.transform(known, lambda d: F.struct(d["i"].alias("i"), d["s"].alias("s"), F.filter(d["p"], lambda p: F.contains(text, p)).alias("p")))
        told = F.transform(hits, lambda d: F.struct(F.length(F.array_join(d["p"], "")).alias("strength"), (-d["i"]).alias("place"), d["s"].alias("stage"), F.size(d["p"]).alias("found")))
        found = F.when(scenario == name, F.array_max(F.filter(told, lambda d: d["found"] > 0))).otherwise(found)
    return found


def _order():
    return W.partitionBy("recording_id").orderBy("start_sec", "end_sec", "segment_id")


def staged(segments: DataFrame) -> DataFrame:
    """Segments with ``text`` (stripped), ``stage``, ``confidence`` (ten-thousandths) and ``topic``.

    A hint decides, else phrases, else the last known stage is carried. A segment without text
    takes no hints and no vector into account and keeps the topic before it.
    """
    text = stripped(F.col("transcript"))
    rows = segments.withColumn("text", text).withColumn("said", F.when(F.col("text") != "", F.col("stage_hint")))
    rows = rows.withColumn("match", F.when(F.col("said").isNull(), by_phrases(F.col("transcript"), F.col("scenario"))))
    own = F.coalesce("said", "match.stage")
    known = F.last(F.when(own != UNKNOWN, own), ignorenulls=True).over(_order())
    strength = F.least(F.lit(9600), 6400 + 500 * F.col("match.found") + 100 * F.col("match.strength"))
    sure = F.when(F.col("said").isNotNull(), SAID).when(F.col("match").isNotNull(), strength).when(known.isNotNull(), CARRIED).otherwise(NONE)
    rows = rows.withColumn("stage", F.coalesce(F.col("said"), known, F.lit(UNKNOWN))).withColumn("confidence", sure.cast("long"))
    topics = F.create_map(*[F.lit(x) for pair in TOPICS.items() for x in pair])
    about = F.coalesce(F.when(F.col("text") != "", F.col("topic_hint")), F.try_element_at(topics, F.col("stage")), F.lit(NO_TOPIC))
    first = F.row_number().over(_order()) == 1
    topic = F.last(F.when((F.col("text") != "") | first, about), ignorenulls=True).over(_order())
    return rows.withColumn("topic", topic).withColumn("vector", F.when(F.col("text") != "", F.col("embedding"))).drop("said", "match")


def far(a: Column, b: Column) -> Column:
    """Cosine distance; null without vectors of one length that have a direction."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (n > 0), F.least(F.lit(2.0), F.greatest(F.lit(0.0), 1 - dot(a, b) / n)))


def scored(segments: DataFrame) -> DataFrame:
    """Staged segments with ``score`` (hundredths, at most 100), ``reason`` and ``cut`` of the boundary before each."""
    w = _order()
    last = F.lag(F.struct("end_sec", "stage", "topic", "speaker", "vector")).over(w)
    rows = staged(segments).withColumn("last", last)
    pause = F.col("start_sec") - F.col("last.end_sec")
    distance = far(F.col("last.vector"), F.col("vector"))
    changed = lambda c, none: (F.col(c) != F.col(f"last.{c}")) & (F.col(c) != none) & (F.col(f"last.{c}") != none)
    signals = [
        ("long_pause", LONG_PAUSE, pause >= LONG_SEC), ("pause", PAUSE, (pause >= MEDIUM_SEC) & (pause < LONG_SEC)),
        ("semantic_shift", FAR, distance >= FAR_AT), ("semantic_shift", APART, (distance >= APART_AT) & (distance < FAR_AT)),
        ("business_stage_change", STAGE, changed("stage", UNKNOWN)), ("topic_change", TOPIC, changed("topic", NO_TOPIC)), ("speaker_change", SPEAKER, changed("speaker", "")),
    ]
    found = F.filter(F.array(*[F.when(on, F.struct(F.lit(code).alias("code"), F.lit(points).alias("points"))) for code, points, on in signals]), lambda s: s.isNotNull())
    rows = rows.withColumn("signals", found)
    score = F.least(F.lit(100), F.aggregate("signals", F.lit(0), lambda acc, s: acc + s["points"]))
    first = F.col("last").isNull()
    rows = rows.withColumn("score", F.when(first, 0).otherwise(score)).withColumn("cut", first | (F.col("score") >= BOUNDARY))
    return rows.withColumn("reason", F.when(first, "recording_start").otherwise(F.array_join(F.col("signals.code"), "+"))).drop("last", "signals")


def half_up(part: Column, whole: Column) -> Column:
    """part / whole as a whole number, halves up."""
    return F.floor((2 * part + whole) / (2 * whole)).cast("long")


def units(segments: DataFrame) -> DataFrame:
    """(recording_id, unit, start_sec, end_sec, segments, stage, topic, summary, confidence, stage_confidence, score, reason).

    The most frequent stage and topic (the first seen on a tie), the stripped texts with spaces between, cut to
    180 characters, 65 parts of the stages' mean confidence and 35 of the voice's (ten-thousandths). Segments
    that repeat as a whole count once; :func:`conflicting` tells those that repeat otherwise. No text is
    gathered beyond the first 180 characters of a unit.
    """
    w = _order()
    rows = scored(segments.dropDuplicates()).withColumn("unit", F.sum(F.col("cut").cast("long")).over(w) - 1)
    own = W.partitionBy("recording_id", "unit").orderBy("start_sec", "end_sec", "segment_id")
    before = F.sum(F.when(F.col("text") != "", F.length("text") + 1).otherwise(0)).over(own.rowsBetween(W.unboundedPreceding, -1))
    place = F.struct("start_sec", "end_sec", "segment_id")
    for c in ("stage", "topic"):
        kind = W.partitionBy("recording_id", "unit", c)
        rows = rows.withColumn(f"{c}_rank", F.struct((-F.count("*").over(kind)).alias("n"), F.min(place).over(kind).alias("seen"), F.col(c).alias("value")))
    rows = rows.withColumn("stage_sum", F.sum("confidence").over(W.partitionBy("recording_id", "unit", "stage")))
    rows = rows.withColumn("piece", F.when((F.col("text") != "") & (F.coalesce(before, F.lit(0)) <= SUMMARY), F.struct("start_sec", "end_sec", "segment_id", F.left("text", F.lit(SUMMARY + 1)).alias("text"))))
    best = F.min(F.struct(F.col("stage_rank"), "stage_sum"))
    size = F.count("*")
    done = rows.groupBy("recording_id", "unit").agg(
        F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), size.alias("segments"), best.alias("best"), F.min("topic_rank")["value"].alias("topic"),
        F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["text"]), " ").alias("text"),
        half_up(65 * F.sum("confidence") + 35 * F.sum(F.round(F.col("vad") * 10000).cast("long")), 100 * size).alias("confidence"),
        F.min_by("score", place).alias("score"), F.min_by("reason", place).alias("reason"),
    )
    summary = F.when(F.length("text") > SUMMARY, F.concat(F.left("text", F.lit(SUMMARY - 1)), F.lit("…"))).otherwise(F.col("text"))
    return done.select(
        "recording_id", "unit", "start_sec", "end_sec", "segments", F.col("best.stage_rank.value").alias("stage"), "topic", summary.alias("summary"), F.least(F.lit(10000).cast("long"), "confidence").alias("confidence"),
        half_up(F.col("best.stage_sum"), -F.col("best.stage_rank.n")).alias("stage_confidence"), "score", "reason",
    )


def conflicting(segments: DataFrame) -> DataFrame:
    """(recording_id, segment_id) of segments that come more than once with different contents."""
    return segments.dropDuplicates().groupBy("recording_id", "segment_id").agg(F.count("*").alias("n")).where("n > 1").drop("n")
