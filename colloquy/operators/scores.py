"""Evaluation, calibration, drift and release gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = 1.959963984540054


def wilson(hits: Column, n: Column, z: float = Z) -> Column:
    """Lower bound of a share; 0 without trials."""
    p = hits / n
    bound = (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), bound)).otherwise(0.0)


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tag_key", F.coalesce("expected", F.lit("__absent__")).alias("expected"), F.coalesce("predicted", F.lit("__missing__")).alias("predicted")).agg(F.count("*").alias("n"))


def value_scores(rows: DataFrame) -> DataFrame:
    """Counts and F1 of each value of each tag: a wrong value is a miss of one and a false alarm of the other."""
    hit = rows.select("tag_key", F.explode(F.array_distinct(F.array_compact(F.array("expected", "predicted")))).alias("value"), "expected", "predicted")
    e, p = F.col("expected") == F.col("value"), F.coalesce(F.col("predicted") == F.col("value"), F.lit(False))
    c = hit.groupBy("tag_key", "value").agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"))
    return c.withColumn("f1", F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 6)).withColumn("recall_bound", F.round(wilson(F.col("tp"), F.col("tp") + F.col("fn")), 6))


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error over equal bins."""
    right = F.coalesce((F.col("expected") == F.col("predicted")).cast("int"), F.lit(0))
    b = rows.where("predicted is not null").select(F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).alias("bin"), "confidence", right.alias("right"))
    by = b.groupBy("bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg("right").alias("r"), F.sum(F.pow(F.col("confidence") - F.col("right"), 2)).alias("sq"))
    return by.agg(F.round(F.sum("sq") / F.sum("n"), 6).alias("brier"), F.round(F.sum(F.col("n") * F.abs(F.col("c") - F.col("r"))) / F.sum("n"), 6).alias("ece"))


def paired(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Wins, losses, ties and the mean difference with its margin (1 for a single pair)."""
    d = F.col(a) - F.col(b)
    margin = F.when(F.count("*") > 1, Z * F.sqrt(F.var_samp(d) / F.count("*"))).otherwise(1.0)
    return rows.groupBy(key).agg(F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"), F.round(F.avg(d), 6).alias("mean"), F.round(margin, 6).alias("margin"))


def _two_sides(rows: DataFrame, keys: list[str], bucket: str, side: str, left: str, right: str) -> DataFrame:
    n = rows.groupBy(*keys, bucket).agg(F.count_if(F.col(side) == left).alias("l"), F.count_if(F.col(side) == right).alias("r"))
    total = n.groupBy(*keys).agg(F.sum("l").alias("ln"), F.sum("r").alias("rn"), F.count("*").alias("kinds"))
    return n.join(total, keys)


def jensen_shannon(rows: DataFrame, keys: list[str], bucket: str, side: str, left: str, right: str, least: int = 30, breach: float = 0.10) -> DataFrame:
    """Base-2 divergence of two sides' distributions; 0 if a side is empty; eligible with enough rows on both."""
    x = _two_sides(rows, keys, bucket, side, left, right).withColumn("p", F.col("l") / F.greatest("ln", F.lit(1))).withColumn("q", F.col("r") / F.greatest("rn", F.lit(1)))
    m = (F.col("p") + F.col("q")) / 2
    part = F.when(F.col("p") > 0, F.col("p") * F.log2(F.col("p") / m)).otherwise(0.0) + F.when(F.col("q") > 0, F.col("q") * F.log2(F.col("q") / m)).otherwise(0.0)
    out = x.groupBy(*keys, "ln", "rn").agg((F.sum(part) / 2).alias("d"))
    d = F.when((F.col("ln") == 0) | (F.col("rn") == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("d"))))
    ok = (F.col("ln") >= least) & (F.col("rn") >= least)
    return out.select(*keys, F.round(d, 6).alias("jsd"), ok.alias("eligible"), (ok & (d > breach)).alias("breach"))


def psi(rows: DataFrame, keys: list[str], bucket: str, side: str, left: str, right: str, smooth: float = 1e-6) -> DataFrame:
    """Population stability index with smoothing; 0 if a side is empty."""
    x = _two_sides(rows, keys, bucket, side, left, right)
    p = (F.col("l") + smooth) / (F.col("ln") + smooth * F.col("kinds"))
    q = (F.col("r") + smooth) / (F.col("rn") + smooth * F.col("kinds"))
    return x.groupBy(*keys, "ln", "rn").agg(F.sum((p - q) * F.ln(p / q)).alias("d")).select(*keys, F.round(F.when((F.col("ln") == 0) | (F.col("rn") == 0), 0.0).otherwise(F.col("d")), 6).alias("psi"))


def weighted_recall(rows: DataFrame, key: str) -> DataFrame:
    """Recall weighted by inverse sampling probability, and the effective sample size."""
    ok = rows.where("probability > 0 and probability <= 1 and expected is not null").withColumn("w", 1 / F.col("probability"))
    hit = F.when(F.col("expected") == F.col("predicted"), F.col("w")).otherwise(0.0)
    return ok.groupBy(key).agg(F.round(F.sum(hit) / F.sum("w"), 6).alias("recall"), F.round(F.pow(F.sum("w"), 2) / F.sum(F.col("w") * F.col("w")), 6).alias("ess"))


def sweep(trials: DataFrame, score: str, same: str, cells: int = 1000) -> DataFrame:
    """(threshold, s_above, d_above, sn, dn, far, frr) at each distinct threshold (accept at or above it).

    Counts are summed by threshold first. Thresholds are dealt to ``cells`` equal ranges of the
    scores; a running sum passes over each range alone, and over the ranges' totals for what lies above.
    """
    from pyspark.sql import Window as W

    n = trials.groupBy(F.col(score).alias("threshold")).agg(F.count_if(same).alias("s"), F.count_if(~F.col(same)).alias("d"))
    total = n.agg(F.sum("s").alias("sn"), F.sum("d").alias("dn"), F.min("threshold").alias("low"), F.max("threshold").alias("high"))
    cell = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("threshold") - F.col("low")) / (F.col("high") - F.col("low")) * cells), F.lit(cells - 1))).otherwise(0)
    n = n.crossJoin(F.broadcast(total)).withColumn("cell", cell.cast("int"))
    by = n.groupBy("cell").agg(F.sum("s").alias("cs"), F.sum("d").alias("cd"))  # at most ``cells`` rows
    above = W.orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, -1)
    offset = by.select("cell", F.coalesce(F.sum("cs").over(above), F.lit(0)).alias("os"), F.coalesce(F.sum("cd").over(above), F.lit(0)).alias("od"))
    w = W.partitionBy("cell").orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, 0)
    run = n.withColumn("rs", F.sum("s").over(w)).withColumn("rd", F.sum("d").over(w)).join(F.broadcast(offset), "cell")
    run = run.withColumn("s_above", F.col("rs") + F.col("os")).withColumn("d_above", F.col("rd") + F.col("od"))
    return run.select("threshold", "s_above", "d_above", "sn", "dn", F.round(F.try_divide("d_above", "dn"), 6).alias("far"), F.round(1 - F.try_divide("s_above", "sn"), 6).alias("frr"))


def gates(summary: DataFrame) -> DataFrame:
    """The codes of the release gates that a tag fails: macro F1 .80, lower bound of critical recall .95, evidence .98, errors under .01, support 30."""
    codes = F.array_compact(F.array(
        F.when(F.col("macro_f1") < 0.80, "macro_f1"), F.when(F.col("bound") < 0.95, "critical_recall"), F.when(F.col("evidence") < 0.98, "evidence"),
        F.when(F.col("errors") >= 0.01, "error_rate"), F.when(F.col("support") < 30, "insufficient"),
    ))
    return summary.select("tag_key", F.array_join(codes, ",").alias("failed"))


def breaches(health: DataFrame, key: str) -> DataFrame:
    """(key, breaches): what is wrong in a window of (n, failed, schema_violations, evidence_violations, duplicates, critical_recall, drifted, budget)."""
    codes = F.array_compact(F.array(
        F.when(F.col("failed") >= 0.01 * F.col("n"), "error_rate"), F.when(F.col("schema_violations") > 0, "schema"), F.when(F.col("evidence_violations") > 0, "evidence"), F.when(F.col("duplicates") > 0, "duplicate_current"),
        F.when(F.col("critical_recall") < 0.95, "critical_recall"), F.when(F.col("drifted"), "drift"), F.when(F.col("budget") >= 1, "budget_exhausted").when(F.col("budget") >= 0.9, "budget_near"),
    ))
    return health.select(key, F.array_join(codes, ",").alias("breaches"))


def boundary_scores(rows: DataFrame, key: str, f1_gate: float = 0.85) -> DataFrame:
    """Precision, recall and F1 of boundaries (gold, found) by key over all its rows, and whether the gate is passed."""
    c = rows.groupBy(key).agg(F.count_if(F.col("gold") & F.col("found")).alias("tp"), F.count_if("gold").alias("g"), F.count_if("found").alias("p"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("p") + F.col("g")), F.lit(0.0))
    part = lambda n: F.round(F.coalesce(F.try_divide("tp", n), F.lit(0.0)), 6)
    return c.select(key, part("p").alias("precision"), part("g").alias("recall"), F.round(f1, 6).alias("f1"), (f1 >= f1_gate).alias("passed"))


def precision_recall(queries: DataFrame, k: int) -> DataFrame:
    """Context precision at k and recall of retrieved against gold ids, as arrays."""
    hits = F.size(F.array_intersect(F.slice("got", 1, k), F.col("gold")))
    return queries.select("query", F.round(hits / F.least(F.lit(k), F.size("gold")), 6).alias("precision"), F.round(F.size(F.array_intersect("got", "gold")) / F.size("gold"), 6).alias("recall"))


def interval_iou(pred: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Mean over gold spans of the best overlap share with a predicted span of the key; 0 without one."""
    both = gold.join(pred, key, "left")
    inter = F.greatest(F.lit(0), F.least("g_end", "p_end") - F.greatest("g_start", "p_start"))
    union = F.greatest("g_end", "p_end") - F.least("g_start", "p_start")
    best = both.groupBy(key, "g_start", "g_end").agg(F.coalesce(F.max(F.when(F.col("p_end").isNotNull(), inter / union)), F.lit(0.0)).alias("iou"))
    return best.groupBy(key).agg(F.round(F.avg("iou"), 6).alias("iou"))
