"""Versioned tags: matrix cells, merge strategies, agreement, coverage, routing, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELL = ["target_id", "label_key"]


def cells(assignments: DataFrame) -> DataFrame:
    """The last assignment of each cell and group; of several with one id the greatest by value, confidence, store and so on."""
    rest = [c for c in assignments.columns if c not in (*CELL, "group_key")]
    ties = [c for c in ("value", "confidence", "store_id", "agent_id", "occurred_at") if c in rest]
    last = F.max_by(F.struct(*rest), F.struct("assignment_id", *ties)).alias("row")
    return assignments.groupBy(*CELL, "group_key").agg(last).select(*CELL, "group_key", *[F.col("row")[c].alias(c) for c in rest])


def matrix(last: DataFrame, groups: list[str]) -> DataFrame:
    """One row per cell with each group's value, whether any is missing, whether they conflict."""
    values = [F.max(F.when(F.col("group_key") == g, F.col("value"))).alias(g) for g in groups]
    return last.groupBy(*CELL).agg(*values, F.count_distinct("value").alias("kinds"), F.count("*").alias("n")).select(
        *CELL, *groups, (F.col("n") < len(groups)).alias("missing"), (F.col("kinds") > 1).alias("conflict")
    )


def merged(last: DataFrame, groups: list[str]) -> DataFrame:
    """Each cell's values by strategy: union, intersection (all groups agree), priority, manual_wins."""
    all_ = F.array_sort(F.collect_set("value"))
    manual = F.array_sort(F.collect_set(F.when(F.col("is_manual"), F.col("value"))))
    return last.groupBy(*CELL).agg(all_.alias("u"), manual.alias("m"), F.count("*").alias("n"), F.max_by("value", F.struct("priority", "value")).alias("p")).select(
        *CELL, F.array_join("u", ",").alias("all"), F.when((F.col("n") == len(groups)) & (F.size("u") == 1), F.array_join("u", ",")).otherwise("").alias("agreed"),
        F.col("p").alias("by_priority"), F.array_join(F.when(F.size("m") > 0, F.col("m")).otherwise(F.col("u")), ",").alias("manual_wins"),
    )


def agreement(last: DataFrame) -> DataFrame:
    """For each pair of groups: comparable cells, agreements, cells of one side only, rate."""
    by = last.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("group_key", "value"))).alias("g"))  # at most one of each group
    both = by.select(F.explode(_pairs(F.col("g"))).alias("x")).groupBy(F.col("x.left.group_key").alias("left"), F.col("x.right.group_key").alias("right")).agg(
        F.count("*").alias("comparable"), F.count_if(F.col("x.left.value") == F.col("x.right.value")).alias("agreements")
    )
    size = by.select(F.explode("g.group_key").alias("group_key")).groupBy("group_key").agg(F.count("*").alias("n"))
    s = lambda g, n: F.broadcast(size.select(F.col("group_key").alias(g), F.col("n").alias(n)))
    return both.join(s("left", "ln"), "left").join(s("right", "rn"), "right").select(
        "left", "right", "comparable", "agreements", (F.col("ln") - F.col("comparable")).alias("left_only"), (F.col("rn") - F.col("comparable")).alias("right_only"),
        F.round(F.col("agreements") / F.col("comparable"), 6).alias("rate"),
    )


def _pairs(items: Column) -> Column:
    """Ordered pairs (left, right) of an array's items, which are few."""
    rest = lambda x, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda y: F.struct(x.alias("left"), y.alias("right")))
    return F.flatten(F.transform(items, rest))


def coverage(last: DataFrame, groups: list[str]) -> DataFrame:
    """Assigned and missing cells of each declared group, also of one without any."""
    total = last.select(*CELL).distinct().agg(F.count("*").alias("cells"))
    declared = last.sparkSession.createDataFrame([(g,) for g in groups], "group_key string")
    n = last.groupBy("group_key").agg(F.count("*").alias("assigned"))
    return declared.join(n, "group_key", "left").crossJoin(F.broadcast(total)).select(
        "group_key", F.coalesce("assigned", F.lit(0)).alias("assigned"), (F.col("cells") - F.coalesce("assigned", F.lit(0))).alias("missing"), F.round(F.coalesce("assigned", F.lit(0)) / F.col("cells"), 6).alias("rate")
    )


def distribution(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts of values and their share within the keys; the counts are summed before any window."""
    n = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(*keys)), 6))


def cooccurrence(last: DataFrame, top: int) -> DataFrame:
    """The most frequent unordered pairs of label=value in one target of one group."""
    tokens = last.groupBy("group_key", "target_id").agg(F.array_sort(F.collect_set(F.concat_ws("=", "label_key", "value"))).alias("tokens"))  # at most one of each label
    pairs = tokens.select("group_key", F.explode(_pairs(F.col("tokens"))).alias("x")).select("group_key", "x.left", "x.right")
    return pairs.groupBy("group_key", "left", "right").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "group_key", "left", "right").limit(top)


def confidence_histogram(rows: DataFrame, bins: int = 5) -> DataFrame:
    b = F.when(F.col("confidence").isNull(), "unknown").otherwise(F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("string"))
    return rows.groupBy("group_key", b.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"))


def by_dimension(last: DataFrame) -> DataFrame:
    """Store and agent, unpivoted: assignments, targets, mean confidence of each value and group."""
    d = lambda c: last.select(F.lit(c).alias("dimension"), F.col(f"{c}_id").cast("string").alias("member"), "group_key", "target_id", "confidence")
    return d("store").unionByName(d("agent")).groupBy("dimension", "member", "group_key").agg(F.count("*").alias("n"), F.count_distinct("target_id").alias("targets"), F.round(F.avg("confidence"), 6).alias("confidence"))


def stable_bucket(*keys: Column) -> Column:
    """A bucket of 0 to 99 that depends on the keys alone: the first 32 bits of their SHA-256."""
    return F.conv(F.left(F.sha2(F.concat_ws("|", *keys), 256), F.lit(8)), 16, 10).cast("long") % 100


def routed(subjects: DataFrame, key: str, deployment: Column, status: Column, traffic: Column, shadow: Column) -> DataFrame:
    """Subjects with their bucket in a deployment and whether its tagger runs and publishes for them: the same every time.

    A shadow runs for its share and never publishes; canaries take 5 or 25 of a hundred, one that waits for
    approval its share of the traffic, one in production all, others none.
    """
    rows = subjects.withColumn("bucket", stable_bucket(F.col(key).cast("string"), deployment))
    limit = F.when(status == "canary_5", 5).when(status == "canary_25", 25).when(status == "awaiting_admin", traffic).when(status == "production", 100).otherwise(0)
    publishes = F.col("bucket") < limit
    return rows.withColumn("runs", F.when(status == "shadow", F.col("bucket") < shadow).otherwise(publishes)).withColumn("publishes", publishes)


def rule_tags(texts: DataFrame, rules: dict[str, dict[str, list[str]]], base: float = 0.7) -> DataFrame:
    """Per label the option with most phrase hits, the earlier option on a tie; confidence grows by .01 a hit."""
    out = None
    for label, options in rules.items():
        hits = [sum(((F.length(F.lower("text")) - F.length(F.replace(F.lower("text"), F.lit(p)))) / len(p)).cast("int") for p in phrases) for phrases in options.values()]
        ranked = F.array_max(F.array(*[F.struct(h.alias("n"), F.lit(-i).alias("i"), F.lit(o).alias("option")) for i, (o, h) in enumerate(zip(options, hits))]))
        one = texts.withColumn("best", ranked).where("best.n > 0").select("conv_id", "turn", F.lit(label).alias("label"), F.col("best.option").alias("option"), F.col("best.n").cast("long").alias("hits"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("confidence", F.round(F.least(F.lit(0.99), base + 0.01 * (F.col("hits") - 1)), 4))


def fused(rows: DataFrame, by: str = "priority") -> DataFrame:
    """One value per cell from several sources, and whether they disagree and need a review."""
    best = F.max_by("value", F.struct(F.col(by), "value"))
    return rows.groupBy(*CELL).agg(best.alias("value"), (F.count_distinct("value") > 1).alias("review"))


def versions(assignments: DataFrame) -> DataFrame:
    """Facts numbered within their cell and group, with the value before."""
    w = W.partitionBy(*CELL, "group_key").orderBy("assignment_id")
    return assignments.select("assignment_id", *CELL, F.row_number().over(w).cast("long").alias("version"), F.lag("value").over(w).alias("previous"))


def overridden(canonical: DataFrame, legacy: DataFrame) -> DataFrame:
    """Canonical rows, and legacy ones of cells without any."""
    return canonical.unionByName(legacy.join(canonical.select(*CELL).distinct(), CELL, "left_anti"))


#: Stages whose failures lie before the tagger.
UPSTREAM = ("ingest", "asr", "diarization")


def badcase_clusters(cases: DataFrame) -> DataFrame:
    """(cluster, weight, cases, ids) of (id, stage, tag_key, reason, cluster_key, occurrences), without upstream stages.

    A case without a cluster key belongs to stage:tag:reason; it weighs its occurrences, one at least.
    """
    mine = cases.where(~F.col("stage").isin(*UPSTREAM))
    name = F.coalesce("cluster_key", F.concat_ws(":", "stage", "tag_key", "reason"))
    return mine.groupBy(name.alias("cluster")).agg(F.sum(F.greatest(F.lit(1), F.coalesce("occurrences", F.lit(1)))).alias("weight"), F.count("*").alias("cases"), F.array_sort(F.collect_set("id")).alias("ids"))


def patches(advice: DataFrame) -> DataFrame:
    """(patch, ids): one patch for equal advice, named by the SHA-256 of its text, with the ids of all that ask for it."""
    return advice.groupBy(F.sha2("text", 256).alias("patch")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))


def rule_bundle(segments: DataFrame, rules: DataFrame, key: list[str]) -> DataFrame:
    """(key, tag, rule, confidence, evidence): per tag the matching rule of most confidence, the first on a tie, and the segments that match it.

    A rule (rule, tag, any, all, none, confidence) matches a text that holds any of ``any`` (if it names some),
    all of ``all`` and none of ``none``. Rules are a bundle of a release, and go to all tasks.
    """
    low = F.lower("text")
    holds = lambda p: F.contains(low, F.lower(p))
    fits = ((F.size("any") == 0) | F.exists("any", holds)) & F.forall("all", holds) & ~F.exists("none", holds)
    hits = segments.join(F.broadcast(rules), fits)
    by = hits.groupBy(*key, "tag", "rule").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("segment")).alias("evidence"))
    best = F.max_by(F.struct("rule", "confidence", "evidence"), F.struct("confidence", -F.col("rule"))).alias("b")
    return by.groupBy(*key, "tag").agg(best).select(*key, "tag", "b.*")


def invalidated(current: DataFrame, changed: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, units to extract again): current rows of changed units go, and each such unit is queued once."""
    units = changed.select(*key).distinct()
    return current.join(units, key, "left_anti"), current.join(units, key, "left_semi").select(*key).distinct()
