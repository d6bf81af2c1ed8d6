"""Connected components of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.sources.scratch import scratch


def connected(links: DataFrame, by: str) -> DataFrame:
    """(by, node, root) of every node of links (by, a, b): the least node that it reaches among links of the same `by`.

    A node's links meet by partial sums and by joins that Spark can split, never in one list.
    """
    edges = scratch(links.where("a <> b").select(by, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(by, F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy(by, "u").agg(F.min("v").alias("m")).select(by, "u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(m, [by, "u"]).select(by, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch(large, "large")
        m = large.groupBy(by, "u").agg(F.min("v").alias("m"))
        star = large.join(m, [by, "u"]).select(by, F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = scratch(star.where("u <> v").distinct(), "small")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(by, "u", "v"))).first()
        if now == before:
            break
        before = now
    return edges.select(by, F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(by, F.col("v").alias("node"), F.col("v").alias("root")).distinct())
