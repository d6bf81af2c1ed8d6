"""Regions, masks and blends of rasters, and statistics within them (mask: a binary raster of the same size)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.operators.pixels import KEY


def inside(x: int, y: int, w: int, h: int) -> Column:
    return (F.col("x") >= x) & (F.col("x") < x + w) & (F.col("y") >= y) & (F.col("y") < y + h)


def set_rectangle(px: DataFrame, x: int, y: int, w: int, h: int, value: int) -> DataFrame:
    """The pixels of a rectangle become value (0: cleared)."""
    return px.withColumn("v", F.when(inside(x, y, w, h), value).otherwise(F.col("v")))


def mask_of_value(px: DataFrame, value: int) -> DataFrame:
    return px.withColumn("v", F.when(F.col("v") == value, 1).otherwise(0))


def mask_of_band(px: DataFrame, low: int, high: int, use_in: bool = True) -> DataFrame:
    """1 for values of low to high, both included (use_in False: for all others)."""
    within = F.col("v").between(low, high)
    return px.withColumn("v", F.when(within if use_in else ~within, 1).otherwise(0))


def mask_of_table(px: DataFrame, chosen: list[int]) -> DataFrame:
    """1 for the values that a table of 256 flags chooses."""
    return px.withColumn("v", F.when(F.element_at(F.array(*map(F.lit, chosen)), F.col("v") + 1) != 0, 1).otherwise(0))


def _shifted(mask: DataFrame, x: int, y: int) -> DataFrame:
    return mask.where("v <> 0").select("image_id", (F.col("y") + y).alias("y"), (F.col("x") + x).alias("x"), F.lit(1).alias("m"))


def paint_through(px: DataFrame, mask: DataFrame, x: int, y: int, value: int) -> DataFrame:
    """value where the mask, moved by (x, y), is set."""
    return px.join(_shifted(mask, x, y), KEY, "left").select(*KEY, F.when(F.col("m").isNotNull(), value).otherwise(F.col("v")).alias("v"))


def blend_gray(px: DataFrame, other: DataFrame, x: int, y: int, share: float, inverse: bool = False) -> DataFrame:
    """Another raster at (x, y), mixed in by `share`; inverse: the darker it is, the more values are drawn to 128."""
    top = other.select("image_id", (F.col("y") + y).alias("y"), (F.col("x") + x).alias("x"), F.col("v").alias("c"))
    v, c = F.col("v").cast("double"), F.col("c").cast("double")
    mixed = v + share * ((128.0 - v) * (255.0 - c) / 256.0) if inverse else (1.0 - share) * v + share * c
    return px.join(top, KEY, "left").select(*KEY, F.when(F.col("c").isNull(), F.col("v")).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), mixed)) + 0.5)).cast("int").alias("v"))


def blend_mask(px: DataFrame, mask: DataFrame, x: int, y: int, share: float, kind: str) -> DataFrame:
    """Where the mask at (x, y) is set, values move by `share` to their 'inverse', to 'white' or to 'black'."""
    p = F.col("v") / 255.0
    to = {"inverse": p + share * (1.0 - 2.0 * p), "white": p + share * (1.0 - p), "black": (1.0 - share) * p}[kind]
    # a margin so that halves are told apart alike everywhere
    v = F.floor(F.round(to * 255.0, 4) + 0.5).cast("int")
    return px.join(_shifted(mask, x, y), KEY, "left").select(*KEY, F.when(F.col("m").isNotNull(), v).otherwise(F.col("v")).alias("v"))


def histogram_where(px: DataFrame, rows: DataFrame) -> DataFrame:
    """The dense histogram of some rows of a raster, 0 to 255 for each image of px."""
    bins = px.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("v"))
    n = rows.groupBy("image_id", "v").agg(F.count(F.lit(1)).alias("n"))
    return bins.join(n, ["image_id", "v"], "left").select("image_id", "v", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_in(px: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    return histogram_where(px, px.where(inside(x, y, w, h)))


def histogram_masked(px: DataFrame, mask: DataFrame, x: int, y: int) -> DataFrame:
    """Of the pixels under the mask moved by (x, y)."""
    return histogram_where(px, px.join(_shifted(mask, x, y), KEY, "left_semi"))


def histogram_tiled(px: DataFrame, nx: int, ny: int) -> DataFrame:
    """The counts of each value in each of nx * ny tiles of w div nx by h div ny pixels (the last ones take the rest)."""
    size = px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    at = lambda c, n, k: F.least(F.lit(k - 1), F.floor(F.col(c) / F.greatest(F.lit(1), F.floor(F.col(n) / k))))
    tiled = px.join(size, "image_id").select("image_id", at("y", "h", ny).cast("int").alias("ty"), at("x", "w", nx).cast("int").alias("tx"), "v")
    return tiled.groupBy("image_id", "ty", "tx", "v").agg(F.count(F.lit(1)).alias("n"))


def colour_histogram(colour: DataFrame) -> DataFrame:
    """Of each channel, the counts of its values."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in "rgb"))).alias("p")
    return colour.select("image_id", pairs).groupBy("image_id", "p.channel", "p.v").agg(F.count(F.lit(1)).alias("n"))


def rank_masked(px: DataFrame, mask: DataFrame, x: int, y: int, rank: float) -> DataFrame:
    """The value at which a share `rank` of the pixels under the mask is reached, linear inside a value's bin."""
    h = histogram_masked(px, mask, x, y)
    w = Window.partitionBy("image_id")
    c = h.select("image_id", "v", "n", (F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"), F.sum("n").over(w).alias("total"))
    hit = c.where((F.col("total") > 0) & (F.col("before") + F.col("n") >= F.col("total") * rank)).groupBy("image_id").agg(F.min(F.struct("v", "n", "before", "total")).alias("b"))
    fract = F.when(F.col("b.n") > 0, (F.col("b.total") * rank - F.col("b.before")) / F.col("b.n")).otherwise(0.0)
    return hit.select("image_id", F.round(F.col("b.v") + fract, 4).alias("value"))


def line_stats(px: DataFrame, by: str) -> DataFrame:
    """Of each row (by 'y') or column ('x'): mean, variance, its root, lower median, least mode and its count."""
    mean, square = F.avg("v"), F.avg(F.col("v") * F.col("v"))
    n = px.groupBy("image_id", by, "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("image_id", by)
    c = n.select("image_id", by, "v", "n", F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)).alias("c"), F.sum("n").over(w).alias("t"))
    best = F.max(F.struct("n", (-F.col("v")).alias("m")))
    ranks = c.groupBy("image_id", by).agg(F.min(F.when(F.col("c") * 2 >= F.col("t"), F.col("v"))).alias("median"), best.alias("b"))
    stats = px.groupBy("image_id", by).agg(F.round(mean, 6).alias("mean"), F.round(square - mean * mean, 4).alias("var"), F.round(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))), 4).alias("rootvar"))
    return stats.join(ranks, ["image_id", by]).select("image_id", by, "mean", "var", "rootvar", "median", (-F.col("b.m")).alias("mode"), F.col("b.n").alias("mode_count"))


def line_differences(px: DataFrame, by: str) -> DataFrame:
    """The mean absolute difference of neighbours within each row ('y') or column ('x')."""
    along = "x" if by == "y" else "y"
    d = px.select("image_id", by, F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("image_id", by).orderBy(along))).alias("d"))
    return d.groupBy("image_id", by).agg(F.round(F.avg("d"), 6).alias("diff"))


def sorted_lines(px: DataFrame, by: str) -> DataFrame:
    """The values of each row (by 'y') or column ('x') in ascending order."""
    along = "x" if by == "y" else "y"
    w = Window.partitionBy("image_id", by).orderBy("v", along)
    return px.select("image_id", by, (F.row_number().over(w) - 1).alias(along), "v").select(*KEY, "v")


def count_in(px: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """Pixels that are not 0, their mean and root variance in a rectangle."""
    m, s = F.avg("v"), F.avg(F.col("v") * F.col("v"))
    return px.where(inside(x, y, w, h)).groupBy("image_id").agg(F.count_if(F.col("v") != 0).alias("n"), F.round(m, 6).alias("mean"), F.round(F.sqrt(F.greatest(s - m * m, F.lit(0.0))), 4).alias("rootvar"))


def _targets(at: str, size: Column, before: int, after: int, kind: str) -> Column:
    """The places along one axis at which a bordered raster shows the line `at`."""
    c = F.col(at)
    if kind == "continued":
        low = F.when(c == 0, F.lit(-before)).otherwise(c)
        high = F.when(c == size - 1, size - 1 + after).otherwise(c)
        return F.sequence(low, high)
    more = (c - size, c + size) if kind == "repeated" else (-1 - c, 2 * size - 1 - c)
    return F.filter(F.array(c, *more), lambda t: (t >= -before) & (t < size + after))


def bordered(px: DataFrame, left: int, right: int, top: int, bottom: int, across: str, down: str) -> DataFrame:
    """The raster with a border; across and down: 'mirrored', 'repeated' (the other side) or 'continued' (the edge pixel)."""
    size = px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    out = px.join(size, "image_id")
    out = out.select("image_id", F.explode(_targets("y", F.col("h"), top, bottom, down)).alias("ty"), "x", "w", "v")
    out = out.select("image_id", "ty", F.explode(_targets("x", F.col("w"), left, right, across)).alias("tx"), "v")
    return out.select("image_id", (F.col("ty") + top).alias("y"), (F.col("tx") + left).alias("x"), "v")


def framed(px: DataFrame, left: int, right: int, top: int, bottom: int, value: int) -> DataFrame:
    """The raster with a border of one value."""
    size = px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    rows = size.select("image_id", "w", "h", F.explode(F.sequence(F.lit(0), F.col("h") + (top + bottom - 1))).alias("y"))
    edge = rows.select("image_id", "w", "h", "y", F.explode(F.sequence(F.lit(0), F.col("w") + (left + right - 1))).alias("x"))
    outside = ~((F.col("x") >= left) & (F.col("x") < F.col("w") + left) & (F.col("y") >= top) & (F.col("y") < F.col("h") + top))
    return px.select("image_id", (F.col("y") + top).alias("y"), (F.col("x") + left).alias("x"), "v").unionByName(edge.where(outside).select(*KEY, F.lit(value).alias("v")))


def unframed(px: DataFrame, left: int, right: int, top: int, bottom: int) -> DataFrame:
    """The raster without its outer lines."""
    size = px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    inner = px.join(size, "image_id").where((F.col("x") >= left) & (F.col("x") < F.col("w") - right) & (F.col("y") >= top) & (F.col("y") < F.col("h") - bottom))
    return inner.select("image_id", (F.col("y") - top).alias("y"), (F.col("x") - left).alias("x"), "v")
