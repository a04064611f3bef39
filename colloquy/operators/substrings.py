"""Texts within texts: a join by an index of character n-grams, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest n-grams that are indexed.
GRAM = 3


def grams(text: Column, n: int) -> Column:
    """All stretches of n characters of a text, in order; none if it is shorter."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def contained(needles: DataFrame, haystacks: DataFrame, n: int = GRAM) -> DataFrame:
    """(needle, haystack): every pair of different columns' texts where the first stands within the second.

    A haystack that holds a needle holds all of its n-grams, so a needle looks only where its rarest
    one is; needles of fewer than n characters are n-grams of their own length. Counts cover all
    haystacks, texts are taken once, empty and null ones find nothing and are found by nothing.
    """
    needle = needles.select(F.col(needles.columns[0]).alias("needle")).where("needle <> ''").distinct()
    haystack = haystacks.select(F.col(haystacks.columns[0]).alias("haystack")).where("haystack <> ''").distinct()
    held = F.array_distinct(F.concat(*[grams(F.col("haystack"), k) for k in range(1, n + 1)]))
    index = haystack.select("haystack", F.explode(held).alias("gram"))
    often = index.groupBy("gram").agg(F.count("*").alias("often"))
    asked = F.when(F.length("needle") <= n, F.array("needle")).otherwise(F.array_distinct(grams(F.col("needle"), n)))
    wanted = needle.select("needle", F.explode(asked).alias("gram"), F.size(asked).alias("all"))
    # a needle with a gram that no haystack holds is in none
    rarest = wanted.join(often, "gram").groupBy("needle").agg(F.min_by("gram", F.struct("often", "gram")).alias("gram"), F.count("*").alias("found"), F.first("all").alias("all")).where("found = all")
    return index.join(rarest.select("needle", "gram"), "gram").where(F.contains("haystack", "needle")).select("needle", "haystack")
