"""Geometry: coordinate projections, gather joins on inverse maps, scaling by cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.operators.pixels import KEY


def _sized(px: DataFrame) -> DataFrame:
    """px with its raster's width and height. The sizes are one row per image, summed before they are shuffled."""
    return px.join(px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")), "image_id")


def turn(px: DataFrame, quarter: int) -> DataFrame:
    """Clockwise turns by 90 degrees."""
    y, x, w, h = F.col("y"), F.col("x"), F.col("w"), F.col("h")
    to = {0: (y, x), 1: (x, h - 1 - y), 2: (h - 1 - y, w - 1 - x), 3: (w - 1 - x, y)}[quarter % 4]
    return _sized(px).select("image_id", to[0].alias("y"), to[1].alias("x"), "v")


def flip(px: DataFrame, axis: str) -> DataFrame:
    """Mirror left-right (axis='x') or top-bottom (axis='y')."""
    s = _sized(px)
    return s.select("image_id", *((F.col("w") - 1 - F.col("x"), F.col("h") - 1 - F.col("y"))[k == "y"].alias(k) if k == axis else F.col(k) for k in ("y", "x")), "v")


def translate(px: DataFrame, dx: int, dy: int, fill: int = 0) -> DataFrame:
    """Moved within its frame; uncovered pixels get fill."""
    return gather(px, F.col("y") - dy, F.col("x") - dx, fill)


def gather(px: DataFrame, sy: Column, sx: Column, fill: int = 0) -> DataFrame:
    """Each pixel's value from the source pixel (sy, sx), expressions of y and x; outside: fill. One equi-join."""
    to = px.select("image_id", "y", "x", sy.cast("int").alias("sy"), sx.cast("int").alias("sx")).alias("d")
    src = px.select(F.col("image_id").alias("i"), F.col("y").alias("ys"), F.col("x").alias("xs"), "v")
    return to.join(src, (F.col("image_id") == F.col("i")) & (F.col("sy") == F.col("ys")) & (F.col("sx") == F.col("xs")), "left").select("image_id", "y", "x", F.coalesce("v", F.lit(fill)).alias("v"))


def affine_sampled(px: DataFrame, a: float, b: float, c: float, d: float, e: float, f: float, fill: int = 255) -> DataFrame:
    """The source of (x, y) is (a x + b y + c, d x + e y + f), each plus 0.5 and truncated toward zero."""
    sx = F.col("x") * a + F.col("y") * b + c + 0.5
    sy = F.col("x") * d + F.col("y") * e + f + 0.5
    return gather(px, sy, sx, fill)


def shear_rows(px: DataFrame, slope: float, fill: int = 0) -> DataFrame:
    """Each row moved right by its distance from the middle row times slope, rounded."""
    s = _sized(px)
    shift = F.floor((F.col("y") - F.floor(F.col("h") / 2)) * slope + 0.5)
    src = s.select("image_id", "y", (F.col("x") + shift).cast("int").alias("x"), "v")
    return px.select(*KEY).join(src, KEY, "left").select(*KEY, F.coalesce("v", F.lit(fill)).alias("v"))


def half_by_mean(px: DataFrame) -> DataFrame:
    """Half the size: the truncated mean of four pixels; an odd last row or column is dropped."""
    cell = px.groupBy("image_id", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x")).agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    return cell.where("n = 4").select(*KEY, F.floor(F.col("s") / 4).cast("int").alias("v"))


def reduce_extreme(px: DataFrame, nx: int, ny: int, largest: bool) -> DataFrame:
    """The least or largest value of cells of nx x ny."""
    return px.groupBy("image_id", F.floor(F.col("y") / ny).cast("int").alias("y"), F.floor(F.col("x") / nx).cast("int").alias("x")).agg((F.max if largest else F.min)("v").alias("v"))


def crop(px: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """The rectangle [x, x + w) x [y, y + h), moved to the origin."""
    return px.where((F.col("x") >= x) & (F.col("x") < x + w) & (F.col("y") >= y) & (F.col("y") < y + h)).select("image_id", (F.col("y") - y).alias("y"), (F.col("x") - x).alias("x"), "v")


def mirrored_border(px: DataFrame, n: int) -> DataFrame:
    """n more pixels on every side, mirrored with the edge pixel."""
    s = _sized(px)
    ys = F.array_compact(F.array(F.col("y"), F.when(F.col("y") < n, -1 - F.col("y")), F.when(F.col("y") >= F.col("h") - n, 2 * F.col("h") - 1 - F.col("y"))))
    xs = F.array_compact(F.array(F.col("x"), F.when(F.col("x") < n, -1 - F.col("x")), F.when(F.col("x") >= F.col("w") - n, 2 * F.col("w") - 1 - F.col("x"))))
    return s.select("image_id", F.explode(ys).alias("yy"), xs.alias("xs"), "v").select("image_id", (F.col("yy") + n).alias("y"), F.explode("xs").alias("xx"), "v").select("image_id", "y", (F.col("xx") + n).alias("x"), "v")


def gather4(px: DataFrame, sy: Column, sx: Column, fill: int) -> DataFrame:
    """Each pixel from the four around (sy, sx), weighted by sixteenths of a pixel; outside: fill.

    One equi-join: each target asks for its four taps, and taps are summed before the shuffle back.
    """
    at = px.select(*KEY, sy.alias("sy"), sx.alias("sx")).select(*KEY, F.floor("sy").cast("int").alias("iy"), F.floor("sx").cast("int").alias("ix"), F.floor((F.col("sy") - F.floor("sy")) * 16).cast("int").alias("fy"), F.floor((F.col("sx") - F.floor("sx")) * 16).cast("int").alias("fx"))
    taps = F.array(*(F.struct((F.col("iy") + j).alias("ys"), (F.col("ix") + i).alias("xs"), ((F.col("fy") if j else 16 - F.col("fy")) * (F.col("fx") if i else 16 - F.col("fx"))).alias("wt")) for j in (0, 1) for i in (0, 1)))
    ask = at.select(*KEY, F.explode(taps).alias("t")).select(*KEY, "t.ys", "t.xs", "t.wt")
    src = px.select("image_id", F.col("y").alias("ys"), F.col("x").alias("xs"), "v")
    return ask.join(src, ["image_id", "ys", "xs"], "left").groupBy(*KEY).agg(F.floor((F.sum(F.coalesce("v", F.lit(fill)) * F.col("wt")) + 128) / 256).cast("int").alias("v"))


def affine_interpolated(px: DataFrame, a: float, b: float, c: float, d: float, e: float, f: float, fill: int = 255) -> DataFrame:
    """As affine_sampled, from four taps."""
    return gather4(px, F.col("x") * d + F.col("y") * e + f, F.col("x") * a + F.col("y") * b + c, fill)


def rotate_sampled(px: DataFrame, radians: float, fill: int = 255) -> DataFrame:
    """Turned clockwise about the middle, sampled; angles under 0.001 change nothing."""
    import math

    if abs(radians) < 0.001:
        return px
    s, c = math.sin(radians), math.cos(radians)
    z = _sized(px)
    cx, cy = F.floor(F.col("w") / 2), F.floor(F.col("h") / 2)
    dx, dy = F.col("x") - cx, F.col("y") - cy
    to = z.select(*KEY, (cy + F.floor(dy * c - dx * s + 0.5)).cast("int").alias("ys"), (cx + F.floor(dx * c + dy * s + 0.5)).cast("int").alias("xs"))
    src = px.select("image_id", F.col("y").alias("ys"), F.col("x").alias("xs"), "v")
    return to.join(src, ["image_id", "ys", "xs"], "left").select(*KEY, F.coalesce("v", F.lit(fill)).alias("v"))


def projective_sampled(px: DataFrame, m: list[float], fill: int = 255) -> DataFrame:
    """The source of (x, y) is ((m0 x + m1 y + m2) / k, (m3 x + m4 y + m5) / k), k = m6 x + m7 y + 1, plus 0.5, truncated."""
    k = F.col("x") * m[6] + F.col("y") * m[7] + 1.0
    return gather(px, (F.col("x") * m[3] + F.col("y") * m[4] + m[5]) / k + 0.5, (F.col("x") * m[0] + F.col("y") * m[1] + m[2]) / k + 0.5, fill)


def scale_sampled(px: DataFrame, sx: float, sy: float) -> DataFrame:
    """Scaled by sampling: target (x, y) takes source (floor(x / sx), floor(y / sy)), at most the last pixel.

    Sources are sent to the targets that ask for them, so no list of targets is made.
    """
    z = _sized(px)
    wide, high = F.floor(F.col("w") * sx + 0.5), F.floor(F.col("h") * sy + 0.5)

    def targets(p: str, s: float, n, size):
        first = F.ceil(F.col(p) * s - 1e-9)
        last = F.when(F.col(p) == size - 1, n - 1).otherwise(F.least(F.ceil((F.col(p) + 1) * s - 1e-9) - 1, n - 1))
        return F.when(last >= first, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))

    return z.select("image_id", F.explode(targets("y", sy, high, F.col("h"))).alias("ty"), targets("x", sx, wide, F.col("w")).alias("t"), "v").select("image_id", F.col("ty").alias("y"), F.explode("t").alias("x"), "v")
