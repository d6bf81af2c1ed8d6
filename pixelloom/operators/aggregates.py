"""Aggregates of rasters: histograms, profiles, tiles, pyramids, comparison, thresholds from histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.operators.pixels import KEY, paired


def histogram(px: DataFrame, bins: int = 256) -> DataFrame:
    """Counts of every value from 0 to bins - 1, zeros included: image_id, v, n."""
    counts = px.groupBy("image_id", "v").agg(F.count(F.lit(1)).alias("n"))
    every = px.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("v"))
    return every.join(counts, ["image_id", "v"], "left").select("image_id", "v", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def otsu(px: DataFrame) -> DataFrame:
    """The threshold t in 1..255 that maximises the variance between v < t and the rest; the first of equals."""
    w = Window.partitionBy("image_id").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("image_id")
    h = histogram(px).select(
        "image_id", F.col("v").alias("t"), F.sum("n").over(w).alias("nb"), F.sum(F.col("v") * F.col("n")).over(w).alias("sb"), F.sum("n").over(all_).alias("n"), F.sum(F.col("v") * F.col("n")).over(all_).alias("s")
    )
    nf, mb, mf = F.col("n") - F.col("nb"), F.col("sb") / F.col("nb"), (F.col("s") - F.col("sb")) / (F.col("n") - F.col("nb"))
    score = F.when((F.col("nb") > 0) & (nf > 0), (F.col("nb") / F.col("n")) * (nf / F.col("n")) * (mb - mf) * (mb - mf)).otherwise(0.0)
    best = h.where("t >= 1").select("image_id", "t", F.round(score, 6).alias("score")).groupBy("image_id").agg(F.max(F.struct("score", (-F.col("t")).alias("t"))).alias("m"))
    return best.select("image_id", (-F.col("m.t")).alias("t"), F.col("m.score").alias("score"))


def profile(px: DataFrame, by: str) -> DataFrame:
    """Foreground count, mean, least and largest value of each row (by='y') or column (by='x')."""
    return px.groupBy("image_id", by).agg(F.sum(F.when(F.col("v") != 0, 1).otherwise(0)).alias("n_fg"), F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))


def tile_stats(px: DataFrame, tw: int, th: int) -> DataFrame:
    """Mean, population variance and extremes of tiles of tw x th pixels."""
    return px.groupBy("image_id", F.floor(F.col("y") / th).cast("int").alias("ty"), F.floor(F.col("x") / tw).cast("int").alias("tx")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.avg(F.col("v") * F.col("v")) - F.avg("v") * F.avg("v"), 4).alias("var"), F.min("v").alias("low"), F.max("v").alias("high")
    )


def quadtree(px: DataFrame, levels: int) -> DataFrame:
    """Mean and variance of each cell of 2^level x 2^level cells, for levels below `levels`.

    Cell i of a level covers ((W - 1) i / 2^level) + [i > 0] to (W - 1)(i + 1) / 2^level. Each finer level is summed
    first; all levels come from one pass over the finest cells' edges, as cells of different levels don't nest.
    """
    size = px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")

    def cell(p: str, n: str):
        # the least i with p <= (n - 1)(i + 1) div 2^level
        return F.greatest(F.lit(0), F.floor((F.col(p) * F.col("side") + F.col(n) - 2) / (F.col(n) - 1)) - 1).cast("int")

    at = px.join(size, "image_id").select("*", level).withColumn("side", F.expr("shiftleft(1, level)"))
    at = at.select("image_id", "level", cell("y", "h").alias("qy"), cell("x", "w").alias("qx"), "v")
    mean = F.avg("v")
    return at.groupBy("image_id", "level", "qy", "qx").agg(F.count(F.lit(1)).alias("n"), F.round(mean, 6).alias("mean"), F.round(F.greatest(F.avg(F.col("v") * F.col("v")) - mean * mean, F.lit(0.0)), 4).alias("var"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differing pixels, mean absolute and root mean square difference, and PSNR, of two rasters of equal size."""
    d = F.col("a") - F.col("b")
    mse = F.avg((d * d).cast("double"))
    return paired(a, b).groupBy("image_id").agg(
        F.sum(F.when(d != 0, 1).otherwise(0)).alias("n_diff"),
        F.max(F.abs(d)).alias("max_diff"),
        F.round(F.avg(F.abs(d)), 6).alias("mean_abs"),
        F.round(F.sqrt(mse), 6).alias("rms"),
        F.round(F.when(mse == 0, 1000.0).otherwise(10 * F.log10(255.0 * 255.0 / mse)), 6).alias("psnr"),
    )


def masked_stats(px: DataFrame, mask: DataFrame) -> DataFrame:
    """Statistics of the pixels where the mask is 1."""
    on = mask.where("v = 1").select(*KEY)
    return px.join(on, KEY, "left_semi").groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"), F.round(F.var_pop("v"), 4).alias("var"))


def max_location(px: DataFrame) -> DataFrame:
    """The largest value and its first pixel in raster order; where all are 0, the middle of the raster."""
    m = px.groupBy("image_id").agg(F.max(F.struct("v", (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))).alias("m"), F.max("x").alias("w"), F.max("y").alias("h"))
    none = F.col("m.v") == 0
    return m.select("image_id", F.col("m.v").alias("v"), F.when(none, F.floor((F.col("h") + 1) / 2)).otherwise(-F.col("m.y")).cast("int").alias("y"), F.when(none, F.floor((F.col("w") + 1) / 2)).otherwise(-F.col("m.x")).cast("int").alias("x"))


def top_colours(rgb: DataFrame, k: int) -> DataFrame:
    """The k most frequent colours of each raster; ties by colour. The colours are counted before they are ranked."""
    n = rgb.groupBy("image_id", "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("image_id").orderBy(F.desc("n"), "r", "g", "b")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def aligned_stats(px: DataFrame) -> DataFrame:
    """Mean, least and largest value of each pixel over a set of rasters of equal size."""
    return px.groupBy("y", "x").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))
