"""String arrays (set_id, i, s): sets in order of first occurrence, splits, joins, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unique(sa: DataFrame) -> DataFrame:
    """Distinct strings of each array with their first place."""
    return sa.groupBy("set_id", "s").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct strings of a that b holds too (arrays of the same id), with their first place in a."""
    return unique(a).join(b.select("set_id", "s"), ["set_id", "s"], "left_semi").select("set_id", "s", "first")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct strings of a that b lacks, with their first place in a."""
    return unique(a).join(b.select("set_id", "s"), ["set_id", "s"], "left_anti").select("set_id", "s", "first")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct strings of both, those of a first: set_id, s, place."""
    both = a.select("set_id", "s", F.lit(0).alias("o"), "i").unionByName(b.select("set_id", "s", F.lit(1).alias("o"), "i"))
    first = both.groupBy("set_id", "s").agg(F.min(F.struct("o", "i")).alias("f"))
    w = Window.partitionBy("set_id").orderBy("f.o", "f.i")
    return first.select("set_id", "s", (F.row_number().over(w) - 1).alias("place"))


def joined(sa: DataFrame, sep: str) -> DataFrame:
    """Each array as one string."""
    return sa.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("l")).select("set_id", F.array_join(F.transform("l", lambda e: e["s"]), sep).alias("text"))


def containing(sa: DataFrame, part: str) -> DataFrame:
    return sa.where(F.contains(F.col("s"), F.lit(part)))
