"""Running sums over keys of any size: a scan in two levels, so no key lands whole in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.session import settled


def running_sum(rows: DataFrame, keys: list[str], order: list[Column], value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """Rows with ``name``: the sum of ``value`` over a key's rows up to each in order, itself included or not.

    Rows are dealt by ranges of key and order and written with the number of their range, so a key
    spreads over as many ranges as it fills. Sums run within a range; what lies in a key's ranges before is
    one row for each of them. Rows of equal order are in one range and follow each other as they come; missing values count 0.
    """
    dealt = settled(rows.withColumn("_value", F.coalesce(value, F.lit(0))).repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*keys, "_range").agg(F.sum("_value").alias("_sum"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_at"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    own = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    here = dealt.withColumn("_own", F.coalesce(F.sum("_value").over(own), F.lit(0)))
    return here.join(offsets, same).withColumn(name, F.col("_own") + F.col("_before")).select(*rows.columns, name)
