"""Boxes (set_id, i, x, y, w, h), half-open; w = 0 or h = 0 marks a missing one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def extent(bx: DataFrame) -> DataFrame:
    """The bounding box of each set's valid boxes."""
    v = bx.where("w > 0 AND h > 0").groupBy("set_id").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("r"), F.max(F.col("y") + F.col("h")).alias("b"))
    return v.select("set_id", "x", "y", (F.col("r") - F.col("x")).alias("w"), (F.col("b") - F.col("y")).alias("h"))


def coverage(bx: DataFrame, cw: int, ch: int) -> DataFrame:
    """The sum of areas over the canvas's, at most 1."""
    return bx.groupBy("set_id").agg(F.round(F.least(F.sum(F.col("w").cast("long") * F.col("h")) / (cw * ch), F.lit(1.0)), 6).alias("coverage"), F.count(F.lit(1)).alias("n"))


def select_by_size(bx: DataFrame, w: int, h: int, both: bool, relation: str) -> DataFrame:
    """Boxes whose width and (or) height stands in the relation (<, >, <=, >=) to the given."""
    return bx.where(f"w {relation} {int(w)} {'AND' if both else 'OR'} h {relation} {int(h)}")


def _cells(bx: DataFrame, cell: int) -> DataFrame:
    """Each box in every grid cell that it touches."""
    part = lambda a, n: F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(a) + F.col(n) - 1) / cell))
    return bx.where("w > 0 AND h > 0").withColumn("cx", F.explode(part("x", "w"))).withColumn("cy", F.explode(part("y", "h")))


def overlaps(bx: DataFrame, cell: int = 64) -> DataFrame:
    """Pairs i < j of a set that share area, with the area shared.

    An equi-join on grid cells; a pair is reported in the one cell that holds its intersection's corner.
    """
    c = _cells(bx, cell)
    a, b = c.alias("a"), c.alias("b")
    pair = a.join(b, F.expr("a.set_id = b.set_id AND a.cx = b.cx AND a.cy = b.cy AND a.i < b.i")).select(
        F.col("a.set_id").alias("set_id"), F.col("a.i").alias("i"), F.col("b.i").alias("j"), F.col("a.cx").alias("cx"), F.col("a.cy").alias("cy"),
        F.greatest("a.x", "b.x").alias("x0"), F.greatest("a.y", "b.y").alias("y0"),
        F.least(F.expr("a.x + a.w"), F.expr("b.x + b.w")).alias("x1"), F.least(F.expr("a.y + a.h"), F.expr("b.y + b.h")).alias("y1"),
    )
    return pair.where(f"x0 < x1 AND y0 < y1 AND floor(x0 / {cell}) = cx AND floor(y0 / {cell}) = cy").select("set_id", "i", "j", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))


def contained(bx: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """Valid boxes inside a rectangle."""
    return bx.where(f"w > 0 AND h > 0 AND x >= {x} AND y >= {y} AND x + w <= {x + w} AND y + h <= {y + h}")


def clipped(bx: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """Boxes cut to a rectangle; those outside go."""
    x0, y0 = F.greatest(F.col("x"), F.lit(x)), F.greatest(F.col("y"), F.lit(y))
    x1, y1 = F.least(F.col("x") + F.col("w"), F.lit(x + w)), F.least(F.col("y") + F.col("h"), F.lit(y + h))
    return bx.where("w > 0 AND h > 0").select("set_id", "i", x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h")).where("w > 0 AND h > 0")


def nearest(bx: DataFrame, x: int, y: int) -> DataFrame:
    """In each set the box whose centre is nearest to a point; ties: the lowest index."""
    dx, dy = F.col("x") * 2 + F.col("w") - 2 * x, F.col("y") * 2 + F.col("h") - 2 * y
    d = (dx.cast("long") * dx + dy.cast("long") * dy).alias("d")
    return bx.where("w > 0 AND h > 0").select("set_id", d, "i").groupBy("set_id").agg(F.min(F.struct("d", "i")).alias("m")).select("set_id", F.col("m.i").alias("i"), F.round(F.sqrt(F.col("m.d") / 4.0), 6).alias("distance"))


def ranked(bx: DataFrame, *keys: str) -> DataFrame:
    """Boxes with their place in each set's order by keys, then index."""
    w = Window.partitionBy("set_id").orderBy(*keys, "i")
    return bx.withColumn("place", F.row_number().over(w) - 1)


def size_histogram(bx: DataFrame) -> DataFrame:
    return bx.groupBy("set_id", "w", "h").agg(F.count(F.lit(1)).alias("n"))


def transformed(bx: DataFrame, sx: float, sy: float, tx: int, ty: int) -> DataFrame:
    """Shifted, then scaled, rounded by adding 0.5."""
    r = lambda e: F.floor(e + 0.5).cast("int")
    return bx.select("set_id", "i", r((F.col("x") + tx) * sx).alias("x"), r((F.col("y") + ty) * sy).alias("y"), F.greatest(F.lit(1), r(F.col("w") * sx)).alias("w"), F.greatest(F.lit(1), r(F.col("h") * sy)).alias("h"))


def combined(bx: DataFrame, cell: int = 64) -> DataFrame:
    """Boxes of a set united while any two overlap: the finest division into bounding boxes that share no area.

    Each round unites the connected groups of overlapping boxes (touching is not overlapping); rounds end when none do.
    """
    from pixelloom.operators.graph import connected
    from pixelloom.sources.scratch import scratch

    now = scratch(bx.where("w > 0 AND h > 0").select("set_id", F.col("i").cast("long").alias("i"), "x", "y", "w", "h"), "boxes")
    while True:
        links = scratch(overlaps(now, cell).select("set_id", F.col("i").alias("a"), F.col("j").alias("b")), "overlaps")
        if links.isEmpty():
            return now
        root = connected(links, "set_id").withColumnRenamed("node", "i")
        g = now.join(root, ["set_id", "i"], "left").withColumn("i", F.coalesce("root", "i"))
        g = g.groupBy("set_id", "i").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("r"), F.max(F.col("y") + F.col("h")).alias("b"))
        now = scratch(g.select("set_id", "i", "x", "y", (F.col("r") - F.col("x")).alias("w"), (F.col("b") - F.col("y")).alias("h")), "boxes")


def aligned_stats(bx: DataFrame) -> DataFrame:
    """Median (rank rule) and range of each side over a set."""
    side = bx.select("set_id", F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(k).alias("v")) for k in ("x", "y", "w", "h")))).alias("e")).select("set_id", "e.side", "e.v")
    n = side.groupBy("set_id", "side", "v").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("set_id", "side")
    c = n.select("set_id", "side", "v", F.sum("k").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)).alias("c"), F.sum("k").over(w).alias("n"))
    at = F.floor((F.col("n") - 1) * 0.5 + 0.5)
    return c.groupBy("set_id", "side").agg(F.min(F.when(F.col("c") > at, F.col("v"))).alias("median"), F.min("v").alias("low"), F.max("v").alias("high"))
