"""Per-pixel operators: projections, colour spaces, and joins of two rasters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["image_id", "y", "x"]


def clamp(v: Column, top: int = 255) -> Column:
    return F.least(F.greatest(v, F.lit(0)), F.lit(top))


def add_constant(px: DataFrame, c: int, top: int = 255) -> DataFrame:
    """v + c, saturating."""
    return px.withColumn("v", clamp(F.col("v") + c, top).cast("int"))


def multiply_constant(px: DataFrame, factor: float, top: int = 255) -> DataFrame:
    """v * factor, truncated and saturating."""
    if factor < 0:
        raise ValueError("factor is negative")
    return px.withColumn("v", F.least(F.floor(F.col("v") * F.lit(float(factor))), F.lit(top)).cast("int"))


def threshold(px: DataFrame, t: int) -> DataFrame:
    """1 where v < t: dark is foreground."""
    return px.withColumn("v", F.when(F.col("v") < t, 1).otherwise(0))


def quantise(px: DataFrame, cuts: list[int]) -> DataFrame:
    """The number of cuts at or below v."""
    return px.withColumn("v", reduce(lambda a, b: a + b, [F.when(F.col("v") >= c, 1).otherwise(0) for c in cuts]))


def lookup(px: DataFrame, curve: list[int]) -> DataFrame:
    """v through a table of 256 values."""
    return px.withColumn("v", F.element_at(F.array(*map(F.lit, curve)), F.col("v") + 1))


def gamma_curve(gamma: float, low: int = 0, high: int = 255) -> list[int]:
    """The tone curve of a gamma between two levels."""
    out = []
    for i in range(256):
        x = min(1.0, max(0.0, (i - low) / (high - low)))
        out.append(int(255 * x ** (1 / gamma) + 0.5))
    return out


def gray_weighted(rgb: DataFrame, wr: float = 0.3, wg: float = 0.5, wb: float = 0.2) -> DataFrame:
    """floor(weighted sum + 0.5); weights are scaled to sum to 1."""
    total = wr + wg + wb
    if abs(total - 1) > 1e-9:
        wr, wg, wb = wr / total, wg / total, wb / total
    return rgb.select(*KEY, F.least(F.floor(F.col("r") * wr + F.col("g") * wg + F.col("b") * wb + 0.5), F.lit(255)).cast("int").alias("v"))


def gray_shifted(rgb: DataFrame) -> DataFrame:
    """(77 r + 150 g + 29 b) >> 8."""
    return rgb.select(*KEY, F.shiftright(F.col("r") * 77 + F.col("g") * 150 + F.col("b") * 29, 8).alias("v"))


def gray_extreme(rgb: DataFrame, kind: str) -> DataFrame:
    """The least, the largest, or the spread of the three channels."""
    low, high = F.least("r", "g", "b"), F.greatest("r", "g", "b")
    return rgb.select(*KEY, {"min": low, "max": high, "diff": high - low}[kind].alias("v"))


def hsv(rgb: DataFrame) -> DataFrame:
    """Hue in [0, 240), saturation and value in [0, 255], as integers."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    low, high = F.least(r, g, b), F.greatest(r, g, b)
    d = high - low
    turn = F.when(r == high, (g - b) / d).when(g == high, 2 + (b - r) / d).otherwise(4 + (r - g) / d) * 40.0
    turn = F.when(turn < 0, turn + 240).otherwise(turn)
    turn = F.when(turn >= 239.5, 0.0).otherwise(turn)
    hue = F.when(d == 0, 0).otherwise(F.floor(turn + 0.5).cast("int"))
    sat = F.when(d == 0, 0).otherwise(F.floor(255.0 * d / high + 0.5).cast("int"))
    return rgb.select(*KEY, hue.alias("h"), sat.alias("s"), high.alias("val"))


def yuv(rgb: DataFrame) -> DataFrame:
    """BT.601 studio-range Y, U and V, rounded."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    parts = {"yy": (65.738, 129.057, 25.064, 16), "u": (-37.945, -74.494, 112.439, 128), "v": (112.439, -94.154, -18.285, 128)}
    return rgb.select(*KEY, *(F.floor((r * a + g * c + b * d) / 256.0 + e + 0.5).cast("int").alias(n) for n, (a, c, d, e) in parts.items()))


def paired(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Two rasters joined on their pixels: image_id, y, x, a, b. One shuffle of each side on the pixel's key."""
    return a.select(*KEY, F.col("v").alias("a")).join(b.select(*KEY, F.col("v").alias("b")), KEY, how)


def combine(a: DataFrame, b: DataFrame, op: str, top: int = 255) -> DataFrame:
    """Saturating arithmetic and bitwise operations of two rasters."""
    p, q = F.col("a"), F.col("b")
    v = {
        "add": clamp(p + q, top),
        "subtract": clamp(p - q, top),
        "absdiff": F.abs(p - q),
        "min": F.least(p, q),
        "max": F.greatest(p, q),
        "and": p.bitwiseAND(q),
        "or": p.bitwiseOR(q),
        "xor": p.bitwiseXOR(q),
        "clear": p.bitwiseAND(F.bitwise_not(q)),
    }[op]
    return paired(a, b).select(*KEY, v.cast("int").alias("v"))


def blend(a: DataFrame, b: DataFrame, mode: str, fract: float = 0.5) -> DataFrame:
    """a under b; products are divided by 255 and truncated."""
    p, q = F.col("a"), F.col("b")
    part = lambda x: F.floor(x / 255)
    v = {
        "normal": F.floor(p * (1 - fract) + q * fract),
        "multiply": part(p * q),
        "screen": 255 - part((255 - p) * (255 - q)),
        "overlay": F.when(p < 128, part(2 * p * q)).otherwise(255 - part(2 * (255 - p) * (255 - q))),
        "hard_light": F.when(q < 128, part(2 * p * q)).otherwise(255 - part(2 * (255 - p) * (255 - q))),
    }[mode]
    return paired(a, b).select(*KEY, clamp(v).cast("int").alias("v"))


def combine_masked(a: DataFrame, b: DataFrame, mask: DataFrame) -> DataFrame:
    """b's pixels where the mask is 1, else a's."""
    on = mask.where("v = 1").select(*KEY, F.lit(1).alias("m"))
    return paired(a, b).join(on, KEY, "left").select(*KEY, F.when(F.col("m") == 1, F.col("b")).otherwise(F.col("a")).alias("v"))


def nearest_colour(rgb: DataFrame, palette: list[tuple[int, int, int]]) -> DataFrame:
    """The index of the nearest colour of a palette (at most 256 colours, a literal in the plan); ties: the lowest."""
    if len(palette) > 256:
        raise ValueError("a palette has at most 256 colours")
    far = [F.struct(((F.col("r") - r) * (F.col("r") - r) + (F.col("g") - g) * (F.col("g") - g) + (F.col("b") - b) * (F.col("b") - b)).alias("d"), F.lit(i).alias("i")) for i, (r, g, b) in enumerate(palette)]
    return rgb.select(*KEY, F.least(*far)["i"].alias("v")) if len(far) > 1 else rgb.select(*KEY, F.lit(0).alias("v"))
