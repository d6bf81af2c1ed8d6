"""Colour rasters (image_id, y, x, r, g, b): other spaces and back, shifts of hue, saturation and brightness, matrices, morphology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.operators import neighbourhood as N
from pixelloom.operators.pixels import KEY


def hsv(colour: DataFrame) -> DataFrame:
    """Hue, saturation and value from 0 to 1."""
    r, g, b = (F.col(c) / 255.0 for c in "rgb")
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d = high - low
    h = F.when(r == high, (g - b) / d).when(g == high, 2.0 + (b - r) / d).otherwise(4.0 + (r - g) / d) / 6.0
    h = F.when(d == 0, 0.0).when(h < 0, h + 1.0).otherwise(h)
    return colour.select(*KEY, F.round(h, 6).alias("h"), F.round(F.when(d == 0, 0.0).otherwise(d / high), 6).alias("s"), F.round(high, 6).alias("val"))


def _back(h: Column, s: Column, v: Column) -> list[Column]:
    """r, g, b from hue in sixths, saturation and value from 0 to 1."""
    i = F.floor(h)
    f = h - i
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    parts = [(v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q)]
    out = []
    for k in range(3):
        e = parts[5][k]
        for turn in range(4, -1, -1):
            e = F.when(i % 6 == turn, parts[turn][k]).otherwise(e)
        # a margin so that halves are told apart alike everywhere
        out.append(F.floor(F.round(F.when(s == 0, v).otherwise(e) * 255.0, 4) + 0.5).cast("int"))
    return out


def from_hsv(px: DataFrame) -> DataFrame:
    """r, g, b from h, s, val (0 to 1)."""
    made = _back(F.col("h") * 6.0, F.col("s"), F.col("val"))
    return px.select(*KEY, *(e.alias(c) for e, c in zip(made, "rgb", strict=True)))


def saturated(colour: DataFrame, share: float) -> DataFrame:
    """Saturation moved by a share of the way to none (negative) or to full."""
    h = hsv(colour)
    s = F.col("s") * (1 + share) if share < 0 else F.when(F.col("s") > 0, F.col("s") + share * (1 - F.col("s"))).otherwise(F.col("s"))
    return from_hsv(h.withColumn("s", s))


def brightened(colour: DataFrame, share: float) -> DataFrame:
    """Value moved by a share of the way to black (negative) or to full."""
    h = hsv(colour)
    v = F.col("val") * (1 + share) if share < 0 else F.col("val") + share * (1 - F.col("val"))
    return from_hsv(h.withColumn("val", v))


def turned(colour: DataFrame, share: float) -> DataFrame:
    """Hue moved by a share of the circle."""
    h = hsv(colour)
    moved = F.col("h") + (share % 1.0)
    return from_hsv(h.withColumn("h", F.when(moved >= 1, moved - 1).otherwise(moved)))


def by_matrix(colour: DataFrame, m: list[list[float]]) -> DataFrame:
    """Each channel a weighted sum of all three, rounded and kept from 0 to 255."""
    def channel(row: list[float]) -> Column:
        total = sum((w * F.col(c) for w, c in zip(row, "rgb", strict=True)), F.lit(0.0))
        return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(total, 6))) + 0.5).cast("int")

    return colour.select(*KEY, *(channel(row).alias(c) for row, c in zip(m, "rgb", strict=True)))


def by_factors(colour: DataFrame, factors: tuple[float, float, float]) -> DataFrame:
    """Each channel times its factor, cut and at most 255."""
    return colour.select(*KEY, *(F.least(F.lit(255), F.floor(F.col(c) * k)).cast("int").alias(c) for c, k in zip("rgb", factors, strict=True)))


def xyz_back(r_from: DataFrame) -> DataFrame:
    """r, g, b from xx, yy, zz (D65)."""
    x, y, z = (F.col(c) for c in ("xx", "yy", "zz"))
    linear = (3.2406 * x - 1.5372 * y - 0.4986 * z, -0.9689 * x + 1.8758 * y + 0.0415 * z, 0.0557 * x - 0.2040 * y + 1.0570 * z)

    def code(v: Column) -> Column:
        curved = F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)
        return F.floor(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), curved)) * 255.0, 3) + 0.5).cast("int")

    return r_from.select(*KEY, *(code(v).alias(c) for v, c in zip(linear, "rgb", strict=True)))


def _channels(colour: DataFrame, work) -> DataFrame:
    """work on each channel as a gray raster, as three images of their own."""
    apart = colour.select("image_id", "y", "x", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in enumerate("rgb")))).alias("p"))
    gray = work(apart.select((F.col("image_id") * 3 + F.col("p.k")).alias("image_id"), "y", "x", F.col("p.v").alias("v")))
    which = F.pmod("image_id", F.lit(3))
    at = [F.max(F.when(which == k, F.col("v"))).alias(c) for k, c in enumerate("rgb")]
    return gray.groupBy(F.floor(F.col("image_id") / 3).cast("long").alias("image_id"), "y", "x").agg(*at)


def dilated(colour: DataFrame, w: int, h: int) -> DataFrame:
    """Each channel's greatest value in a brick."""
    return _channels(colour, lambda px: N.dilate(px, w | 1, h | 1))


def eroded(colour: DataFrame, w: int, h: int) -> DataFrame:
    """Each channel's least value in a brick."""
    return _channels(colour, lambda px: N.erode(px, w | 1, h | 1, None))
