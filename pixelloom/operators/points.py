"""Point sets (set_id, x, y): least squares and order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def linear_fit(pt: DataFrame) -> DataFrame:
    """Slope and intercept of the least-squares line."""
    return pt.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope("y", "x"), 4).alias("slope"), F.round(F.regr_intercept("y", "x"), 2).alias("intercept"))


def origin_fit(pt: DataFrame) -> DataFrame:
    """Slope of the least-squares line through the origin."""
    return pt.groupBy("set_id").agg(F.round(F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x")), 4).alias("slope"))


def quadratic_fit(pt: DataFrame) -> DataFrame:
    """y = a x^2 + b x + c from moments about the mean of x, in closed form."""
    m = pt.groupBy("set_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    d = pt.join(m, "set_id").select("set_id", "mx", "my", (F.col("x") - F.col("mx")).alias("u"), (F.col("y") - F.col("my")).alias("w"))
    u, w = F.col("u"), F.col("w")
    s = d.groupBy("set_id", "mx", "my").agg(F.avg(u * u).alias("s2"), F.avg(u * u * u).alias("s3"), F.avg(u * u * u * u).alias("s4"), F.avg(u * w).alias("t1"), F.avg(u * u * w).alias("t2"))
    a = F.expr("(t2 * s2 - t1 * s3) / (s4 * s2 - s3 * s3 - s2 * s2 * s2)")
    s = s.withColumn("a", a).withColumn("bu", F.expr("(t1 - a * s3) / s2"))
    return s.select("set_id", F.round("a", 4).alias("a"), F.round(F.expr("bu - 2 * a * mx"), 2).alias("b"), F.round(F.expr("my - a * s2 - bu * mx + a * mx * mx"), 0).alias("c"))


def refit(pt: DataFrame, factor: float) -> DataFrame:
    """A second line through the points whose error is at most factor times the median error (rank rule) of the first."""
    one = pt.groupBy("set_id").agg(F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("b"))
    err = pt.join(one, "set_id").select("set_id", "x", "y", F.round(F.abs(F.col("y") - F.col("a") * F.col("x") - F.col("b")), 4).alias("e"))
    # the median error by counting equal errors, not by ranking all points of a set in one task
    from pyspark.sql import Window

    w = Window.partitionBy("set_id").orderBy("e").rowsBetween(Window.unboundedPreceding, 0)
    n = err.groupBy("set_id", "e").agg(F.count(F.lit(1)).alias("k"))
    c = n.select("set_id", "e", F.sum("k").over(w).alias("c"), F.sum("k").over(Window.partitionBy("set_id")).alias("n"))
    med = c.where(F.col("c") > F.floor((F.col("n") - 1) * 0.5 + 0.5)).groupBy("set_id").agg(F.min("e").alias("med"))
    return linear_fit(err.join(med, "set_id").where(F.col("e") <= factor * F.col("med")).select("set_id", "x", "y"))


def selected(pt: DataFrame, x: float, y: float, relation: str, both: bool) -> DataFrame:
    """Points whose coordinates stand in the relation (<, >, <=, >=) to x and (or) y."""
    return pt.where(f"x {relation} {float(x)} {'AND' if both else 'OR'} y {relation} {float(y)}")


def moments(pt: DataFrame) -> DataFrame:
    """Extremes and centroid."""
    return pt.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("y"), 4).alias("cy"))


def cubic_fit(pt: DataFrame) -> DataFrame:
    """y = a u^3 + b u^2 + c u + d with u = x - mean x: normal equations of moments, solved by Cramer's rule."""
    m = pt.groupBy("set_id").agg(F.avg("x").alias("mx"))
    d = pt.join(m, "set_id").select("set_id", "mx", (F.col("x") - F.col("mx")).alias("u"), "y")
    s = d.groupBy("set_id", "mx").agg(*(F.avg(F.pow("u", F.lit(float(k)))).alias(f"s{k}") for k in range(7)), *(F.avg(F.pow("u", F.lit(float(k))) * F.col("y")).alias(f"t{k}") for k in range(4)))

    def det(rows: list[list[str]]):
        if len(rows) == 1:
            return F.col(rows[0][0])
        out = None
        for k, head in enumerate(rows[0]):
            part = F.col(head) * det([r[:k] + r[k + 1 :] for r in rows[1:]])
            out = part if out is None else out - part if k % 2 else out + part
        return out

    base = [[f"s{i + j}" for j in range(4)] for i in range(4)]
    solve = lambda k: det([[f"t{i}" if j == k else base[i][j] for j in range(4)] for i in range(4)]) / det(base)
    return s.select("set_id", *(F.round(solve(k), 2).alias(n) for k, n in ((3, "a"), (2, "b"), (1, "c"))))


def inside_polygon(pt: DataFrame, corners: list[tuple[float, float]]) -> DataFrame:
    """Points that a ray to the right leaves an odd number of sides of a polygon."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y1 != y2:
            at = F.lit(float(x1)) + (F.col("y") - float(y1)) * (float(x2 - x1) / float(y2 - y1))
            low, high = sorted((float(y1), float(y2)))
            crossings = crossings + F.when((F.col("y") >= low) & (F.col("y") < high) & (F.col("x") < at), 1).otherwise(0)
    return pt.where(crossings % 2 == 1)


def is_convex(corners: list[tuple[float, float]]) -> bool:
    """Whether a polygon turns one way at every corner."""
    n = len(corners)
    turns = set()
    for k in range(n):
        (ax, ay), (bx, by), (cx, cy) = (corners[(k + j) % n] for j in range(3))
        cross = (bx - ax) * (cy - by) - (by - ay) * (cx - bx)
        if cross:
            turns.add(cross > 0)
    return len(turns) <= 1
