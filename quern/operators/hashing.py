"""Counting matches of an equi-join, the workload of hash-table benchmarks. All strategies give the same number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRATEGIES = ("join", "shuffle_hash", "counted", "counted_both")


def multiplicity(r: DataFrame, key: str) -> DataFrame:
    """How often each key occurs; null keys match nothing and are left out."""
    return r.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("multiplicity"))


def lookup_counts(r: DataFrame, s: DataFrame, key: str) -> DataFrame:
    """Each row of s with its key's count in r (0 if it has none)."""
    return s.join(multiplicity(r, key), key, "left").withColumn("multiplicity", F.coalesce("multiplicity", F.lit(0).cast("bigint")))


def match_count(r: DataFrame, s: DataFrame, key: str, strategy: str = "counted_both") -> DataFrame:
    """One row, matches: the number of pairs with equal keys.

    join, shuffle_hash: count the join; counted: multiplicities of r joined to s; counted_both: both sides are counted
    before the shuffle, so neither duplicates nor hot keys reach the join.
    """
    left, right = r.select(key), s.select(key)
    if strategy in ("join", "shuffle_hash"):
        left = left.hint("shuffle_hash") if strategy == "shuffle_hash" else left
        return left.join(right, key).agg(F.count("*").alias("matches"))
    if strategy == "counted":
        total = F.sum("multiplicity")
        return multiplicity(left, key).join(right, key).agg(F.coalesce(total, F.lit(0)).cast("bigint").alias("matches"))
    if strategy == "counted_both":
        both = multiplicity(left, key).join(multiplicity(right, key).withColumnRenamed("multiplicity", "other"), key)
        return both.agg(F.coalesce(F.sum(F.col("multiplicity") * F.col("other")), F.lit(0)).cast("bigint").alias("matches"))
    raise ValueError(f"unknown strategy {strategy!r}")
