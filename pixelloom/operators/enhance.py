"""Enhancement: tone curves from histograms, normalisation by tiles, sharpening, smoothing, quantisation of colour."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions import colour
from pixelloom.operators.aggregates import histogram
from pixelloom.operators.neighbourhood import windowed_sum
from pixelloom.operators.pixels import KEY


def equalise(px: DataFrame) -> DataFrame:
    """Histogram equalisation: v becomes floor(255 * share of pixels up to v + 0.5). The curve has 256 rows per image."""
    w = Window.partitionBy("image_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    curve = histogram(px).select("image_id", "v", (F.sum("n").over(w) / F.sum("n").over(Window.partitionBy("image_id"))).alias("share"))
    return px.join(curve, ["image_id", "v"]).select(*KEY, F.floor(F.col("share") * 255 + 0.5).cast("int").alias("v"))


def stretch(px: DataFrame, low: float, high: float) -> DataFrame:
    """Linear contrast so that the ranks low and high (shares of pixels) become 0 and 255."""
    w = Window.partitionBy("image_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    c = histogram(px).select("image_id", "v", (F.sum("n").over(w) / F.sum("n").over(Window.partitionBy("image_id"))).alias("share"))
    ends = c.groupBy("image_id").agg(F.min(F.when(F.col("share") >= low, F.col("v"))).alias("lo"), F.min(F.when(F.col("share") >= high, F.col("v"))).alias("hi"))
    v = F.floor((F.col("v") - F.col("lo")) * 255.0 / F.greatest(F.col("hi") - F.col("lo"), F.lit(1)) + 0.5)
    return px.join(ends, "image_id").select(*KEY, F.greatest(F.lit(0), F.least(F.lit(255), v)).cast("int").alias("v"))


def normalise_background(px: DataFrame, tw: int, th: int, foreground: int, least: int, target: int) -> DataFrame:
    """v * target / background of its tile, at most 255.

    A tile's background is the rounded mean of its pixels at or above `foreground`; tiles with fewer than `least` of
    them take the nearest filled tile above in their column, else below, else the target.
    """
    ty, tx = F.floor(F.col("y") / th).cast("int"), F.floor(F.col("x") / tw).cast("int")
    at = px.withColumn("ty", ty).withColumn("tx", tx)
    on = F.col("v") >= foreground
    tiles = at.groupBy("image_id", "ty", "tx").agg(F.sum(F.when(on, 1).otherwise(0)).alias("n"), F.sum(F.when(on, F.col("v")).otherwise(0)).alias("s"))
    tiles = tiles.withColumn("bg", F.when(F.col("n") >= least, F.floor(F.col("s") / F.col("n") + 0.5).cast("int")))
    col = Window.partitionBy("image_id", "tx").orderBy("ty")
    up = F.last("bg", ignorenulls=True).over(col.rowsBetween(Window.unboundedPreceding, 0))
    down = F.first("bg", ignorenulls=True).over(col.rowsBetween(0, Window.unboundedFollowing))
    filled = tiles.select("image_id", "ty", "tx", F.coalesce(up, down, F.lit(target)).alias("bg"))
    return at.join(filled, ["image_id", "ty", "tx"]).select(*KEY, F.least(F.floor(F.col("v") * target / F.greatest(F.col("bg"), F.lit(1))), F.lit(255)).cast("int").alias("v"))


def block_mean(px: DataFrame, wc: int, hc: int) -> DataFrame:
    """Mean over the part of the window inside the raster, rounded by adding 0.5."""
    a = windowed_sum(px, F.col("v"), wc, hc).withColumnRenamed("_s", "_a")
    return windowed_sum(a, F.lit(1), wc, hc).select(*KEY, F.floor(F.col("_a") / F.col("_s") + 0.5).cast("int").alias("v"))


def unsharp(px: DataFrame, half: int, fract: float) -> DataFrame:
    """v + fract (v - mean of its window), clamped and rounded by adding 0.5."""
    mean = block_mean(px, half, half).withColumnRenamed("v", "m")
    v = F.floor(F.col("v") + fract * (F.col("v") - F.col("m")) + 0.5)
    return px.join(mean, KEY).select(*KEY, F.greatest(F.lit(0), F.least(F.lit(255), v)).cast("int").alias("v"))


def census(px: DataFrame, half: int) -> DataFrame:
    """1 where v is above the mean of its window."""
    mean = block_mean(px, half, half).withColumnRenamed("v", "m")
    return px.join(mean, KEY).select(*KEY, F.when(F.col("v") > F.col("m"), 1).otherwise(0).alias("v"))


def bilateral(px: DataFrame, half: int, spatial: float, range_: float, tile: int = 256) -> DataFrame:
    """Weights by distance and by difference of value; borders replicated; rounded by adding 0.5.

    Works on tiles with a halo of `half` pixels, so an image of any size is cut into bounded pieces.
    """
    size = px.groupBy("image_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    halo = lambda p: F.sequence(F.floor(F.greatest(F.col(p) - half, F.lit(0)) / tile), F.floor((F.col(p) + half) / tile))
    sent = px.join(size, "image_id").select("image_id", "y", "x", "v", "mx", "my", F.explode(halo("y")).alias("ty"), halo("x").alias("t")).select("image_id", "y", "x", "v", "mx", "my", "ty", F.explode("t").alias("tx")).where(f"tx * {tile} <= mx AND ty * {tile} <= my")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx, mx, my = (int(pdf[c].iloc[0]) for c in ("ty", "tx", "mx", "my"))
        y0, x0, y1, x1 = ty * tile, tx * tile, min(ty * tile + tile - 1, my), min(tx * tile + tile - 1, mx)
        ly, lx = max(y0 - half, 0), max(x0 - half, 0)
        inner = np.zeros((min(y1 + half, my) - ly + 1, min(x1 + half, mx) - lx + 1))
        inner[pdf.y - ly, pdf.x - lx] = pdf.v
        ys, xs = np.clip(np.arange(y0 - half, y1 + half + 1), 0, my) - ly, np.clip(np.arange(x0 - half, x1 + half + 1), 0, mx) - lx
        a = inner[np.ix_(ys, xs)]
        h, w = y1 - y0 + 1, x1 - x0 + 1
        mid = a[half : half + h, half : half + w]
        top, bottom = np.zeros((h, w)), np.zeros((h, w))
        for j in range(2 * half + 1):
            for i in range(2 * half + 1):
                b = a[j : j + h, i : i + w]
                k = np.exp(-((j - half) ** 2 + (i - half) ** 2) / (2 * spatial**2) - (b - mid) ** 2 / (2 * range_**2))
                top += k * b
                bottom += k
        y, x = np.divmod(np.arange(h * w), w)
        return pd.DataFrame({"image_id": pdf.image_id.iloc[0], "y": (y + y0).astype(np.int32), "x": (x + x0).astype(np.int32), "v": np.minimum(255, np.floor(top / bottom + 0.5)).astype(np.int32).ravel()})

    return sent.groupBy("image_id", "ty", "tx").applyInPandas(work, "image_id long, y int, x int, v int")


def octcube_quantise(rgb: DataFrame, level: int) -> DataFrame:
    """Each pixel's octcube, with the rounded mean colour of the cube's pixels."""
    c = rgb.withColumn("cube", colour.octcube(F.col("r"), F.col("g"), F.col("b"), level))
    mean = c.groupBy("image_id", "cube").agg(*(F.floor(F.avg(k) + 0.5).cast("int").alias(f"q{k}") for k in "rgb"))
    return c.select(*KEY, "cube").join(mean, ["image_id", "cube"]).select(*KEY, "cube", "qr", "qg", "qb")


def median_cut(rgb: DataFrame, colours: int, bits: int = 5) -> DataFrame:
    """A palette of at most `colours` boxes: the box with most pixels is cut at the median of its longest side.

    Works on the histogram of the channels' leading bits: at most 2^(3 bits) rows per image, whatever its size.
    """
    cube = lambda c: F.shiftright(F.col(c), 8 - bits)
    hist = rgb.groupBy("image_id", cube("r").alias("r"), cube("g").alias("g"), cube("b").alias("b")).agg(F.count(F.lit(1)).alias("n"))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pts, n = pdf[["r", "g", "b"]].to_numpy(), pdf.n.to_numpy()
        parts = [np.arange(len(n))]
        while len(parts) < colours:
            for k in sorted(range(len(parts)), key=lambda k: (-n[parts[k]].sum(), k)):
                p = parts[k]
                side = np.ptp(pts[p], axis=0)
                if side.max() > 0:
                    break
            else:
                break
            axis = int(side.argmax())
            order = p[np.lexsort((*pts[p].T[::-1], pts[p][:, axis]))]
            values = pts[order, axis]
            total = np.cumsum(n[order])
            at = values[min(int(np.searchsorted(total, total[-1] / 2)), len(values) - 1)]
            at = at if at < values[-1] else values[values < values[-1]].max()
            parts[k : k + 1] = [order[values <= at], order[values > at]]
        rows = [(pdf.image_id.iloc[0], i, *(int(x) for x in np.floor(((pts[p] + 0.5) * (1 << (8 - bits)) * n[p][:, None]).sum(axis=0) / n[p].sum())), int(n[p].sum())) for i, p in enumerate(parts)]
        return pd.DataFrame(rows, columns=["image_id", "i", "r", "g", "b", "n"])

    return hist.groupBy("image_id").applyInPandas(cut, "image_id long, i int, r int, g int, b int, n long")
