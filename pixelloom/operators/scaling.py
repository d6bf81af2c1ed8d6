"""Scaling by interpolation, smoothing and counting; transforms solved from point pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.operators.geometry import gather, gather4
from pixelloom.operators.pixels import KEY
from pixelloom.sources.scratch import scratch


def _sizes(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def _measured(px: DataFrame, sx: float, sy: float) -> DataFrame:
    """px with its raster's sides w, h and those of the scaled one, tw, th, which are rounded and at least 1.

    The sizes are a table of their own, so Spark knows how large they are and sends them to all tasks if that is little.
    """
    to = lambda c, s: F.greatest(F.lit(1), F.floor(F.col(c) * s + 0.5).cast("int"))
    return px.join(scratch(_sizes(px).withColumn("tw", to("w", sx)).withColumn("th", to("h", sy)), "sizes"), "image_id")


def _reached(line: str, n: str, t: str, back: int) -> Column:
    """The targets whose source may be the line or one of the `back` lines before it, and some more at either end.

    From the last `back` + 1 lines on, all up to the end. Sources are in single precision, so a line's share is widened.
    """
    s, per = F.col(line), F.col(t) / F.col(n)
    low = F.greatest(F.lit(0), F.floor((s - back) * per * (1 - 2**-20)).cast("int") - 1)
    high = F.when(s >= F.col(n) - 1 - back, F.col(t) - 1).otherwise(F.least(F.col(t) - 1, F.floor((s + 1) * per * (1 + 2**-20)).cast("int") + 1))
    return F.explode(F.sequence(low, high))


def _single(c: Column) -> Column:
    return c.cast("float")


def scale_linear(px: DataFrame, sx: float, sy: float) -> DataFrame:
    """Each target from four taps in sixteenths of a source pixel, the last line being its own neighbour.

    A pixel goes to the targets that it is a tap of, weighed, and is added up there before anything is shuffled.
    """

    def weight(p: str, line: str, n: str, t: str) -> Column:
        """Of a source line for target p: as the lower tap, the upper one or both."""
        at = (_single(16.0 * F.col(n) / F.col(t)) * _single(F.col(p))).cast("int")
        low, part = F.shiftright(at, 4), at.bitwiseAND(F.lit(15))
        is_ = lambda c: F.least(c, F.col(n) - 1) == F.col(line)
        return F.when(is_(low), 16 - part).otherwise(0) + F.when(is_(low + 1), part).otherwise(0)

    d = _measured(px, sx, sy).where("x >= 0 AND y >= 0")
    d = d.withColumn("ty", _reached("y", "h", "th", 1)).withColumn("ky", weight("ty", "y", "h", "th")).where("ky > 0")
    d = d.withColumn("tx", _reached("x", "w", "tw", 1)).withColumn("kx", weight("tx", "x", "w", "tw")).where("kx > 0")
    return _at_targets(d, F.floor((F.sum(F.col("v") * F.col("ky") * F.col("kx")) + 128) / 256))


def _at_targets(d: DataFrame, v: Column) -> DataFrame:
    return d.groupBy("image_id", F.col("ty").alias("y"), F.col("tx").alias("x")).agg(v.cast("int").alias("v"))


def scale_smooth(px: DataFrame, sx: float, sy: float) -> DataFrame:
    """Each target the cut mean of a square box of round(1 / scale) pixels from its source on, kept inside the raster.

    Scales are below 0.7; a raster smaller than the box becomes its middle pixel. A pixel goes to the boxes that hold it.
    """
    size = min(10000, max(2, int(1 / min(sx, sy) + 0.5)))

    def held(p: str, line: str, n: str, t: str) -> Column:
        start = F.least((_single(F.col(n) / F.col(t)) * _single(F.col(p))).cast("int"), F.col(n) - size)
        return (F.col(line) >= start) & (F.col(line) < start + size)

    fits = (F.col("w") >= size) & (F.col("h") >= size)
    all_ = _measured(px, sx, sy)
    d = all_.where(fits).where("x >= 0 AND y >= 0")
    d = d.withColumn("ty", _reached("y", "h", "th", size - 1)).where(held("ty", "y", "h", "th"))
    d = d.withColumn("tx", _reached("x", "w", "tw", size - 1)).where(held("tx", "x", "w", "tw"))
    middle = all_.where(~fits & (F.col("y") == F.floor(F.col("h") / 2)) & (F.col("x") == F.floor(F.col("w") / 2)))
    return _at_targets(d, F.floor(F.sum("v") / (size * size))).unionByName(middle.select("image_id", F.lit(0).alias("y"), F.lit(0).alias("x"), "v"))


def to_gray(px: DataFrame, n: int) -> DataFrame:
    """Binary to gray: the white share of n x n cells (2, 3, 4, 6, 8, 16); the width is cut to what its words hold (3, 4, 6)."""
    size = _sizes(px).withColumn("tw", F.floor(F.col("w") / n) if n not in (3, 4, 6) else F.floor(F.floor(F.col("w") / n) / (2 if n == 4 else 8)) * (2 if n == 4 else 8)).withColumn("th", F.floor(F.col("h") / n))
    cell = px.groupBy("image_id", F.floor(F.col("y") / n).cast("int").alias("y"), F.floor(F.col("x") / n).cast("int").alias("x")).agg(F.count_if(F.col("v") != 0).alias("black"))
    gray = 255 - F.least(F.col("black"), F.lit(255)) if n == 16 else 255 - F.floor(F.col("black") * 255 / (n * n))
    return cell.join(size, "image_id").where("x < tw AND y < th").select(*KEY, gray.cast("int").alias("v"))


def half_by_rank(px: DataFrame, rank: int) -> DataFrame:
    """Half the size: the rank-th (1 to 4) of each four values in ascending order; an odd last line is dropped."""
    cell = px.groupBy("image_id", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x")).agg(F.sort_array(F.collect_list("v")).alias("four"))
    return cell.where(F.size("four") == 4).select(*KEY, F.col("four")[rank - 1].alias("v"))


def replicated(px: DataFrame, factor: int) -> DataFrame:
    """Each pixel factor x factor times."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    rows = px.select("image_id", "x", "v", F.explode(F.transform(steps, lambda k: k + F.col("y") * factor)).alias("yy"))
    return rows.select("image_id", F.col("yy").alias("y"), F.explode(F.transform(steps, lambda k: k + F.col("x") * factor)).alias("x"), "v")


Points = list[tuple[float, float]]


def affine_of(to: Points, source: Points) -> list[float]:
    """a, b, c, d, e, f of the affine map that takes three points to three others."""
    m = np.array([[x, y, 1.0] for x, y in to])
    return [float(v) for k in (0, 1) for v in np.linalg.solve(m, [p[k] for p in source])]


def bilinear_of(to: Points, source: Points) -> list[float]:
    """For x and then y: the weights of x, y, x y and 1 of the bilinear map that takes four points to four others."""
    m = np.array([[x, y, x * y, 1.0] for x, y in to])
    return [float(v) for k in (0, 1) for v in np.linalg.solve(m, [p[k] for p in source])]


def projective_of(to: Points, source: Points) -> list[float]:
    """The eight weights of the projective map that takes four points to four others (see projective_sampled)."""
    m, b = [], []
    for (x, y), (u, v) in zip(to, source, strict=True):
        m += [[x, y, 1, 0, 0, 0, -x * u, -y * u], [0, 0, 0, x, y, 1, -x * v, -y * v]]
        b += [u, v]
    return [float(v) for v in np.linalg.solve(np.array(m, float), b)]


def _bilinear(m: list[float]) -> tuple[Column, Column]:
    x, y = F.col("x"), F.col("y")
    return m[4] * x + m[5] * y + m[6] * x * y + m[7], m[0] * x + m[1] * y + m[2] * x * y + m[3]


def bilinear_sampled(px: DataFrame, m: list[float], fill: int = 255) -> DataFrame:
    """Each pixel from its source under bilinear_of, plus 0.5 and truncated."""
    sy, sx = _bilinear(m)
    return gather(px, sy + 0.5, sx + 0.5, fill)


def bilinear_interpolated(px: DataFrame, m: list[float], fill: int = 255) -> DataFrame:
    """As bilinear_sampled, from four taps."""
    return gather4(px, *_bilinear(m), fill)


def projective_interpolated(px: DataFrame, m: list[float], fill: int = 255) -> DataFrame:
    """As projective_sampled, from four taps."""
    x, y = F.col("x"), F.col("y")
    k = x * m[6] + y * m[7] + 1.0
    return gather4(px, (x * m[3] + y * m[4] + m[5]) / k, (x * m[0] + y * m[1] + m[2]) / k, fill)
