"""Connected components of a table of links, by alternating large-star and small-star steps (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.tables import drop, keep


def _least(pairs: DataFrame) -> DataFrame:
    """Each u with the least of itself and its neighbours."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b), root being the least node that it can reach.

    Links from a node to itself and null ends are ignored. Every step meets a node's links by a sum or a join that
    Spark can split, never in one list, so a node may have any number of links.
    """
    edges = keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = keep(both.join(_least(both), F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        drop(edges)
        least = _least(large)
        small = large.join(least, F.col("u") == F.col("c")).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = keep(small.where("u <> v").distinct(), "small")
        drop(large)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    # stable: every node points at its root
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
