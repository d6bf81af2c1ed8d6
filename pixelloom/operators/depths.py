"""Conversions between pixel depths: per-pixel expressions on image_id, y, x, v (or r, g, b[, a])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.operators.pixels import KEY


def unpacked(px: DataFrame, off: int, on: int) -> DataFrame:
    """1 bit to any depth: 0 becomes `off`, 1 `on`."""
    return px.withColumn("v", F.when(F.col("v") == 0, off).otherwise(on))


def looked_up(px: DataFrame, values: list[int]) -> DataFrame:
    """2 bits to 8: each of the four values by a table."""
    return px.withColumn("v", F.element_at(F.array(*map(F.lit, values)), F.col("v") + 1))


def widened(px: DataFrame, bits: int) -> DataFrame:
    """2 or 4 bits to 8, the largest value becoming 255."""
    return px.withColumn("v", F.col("v") * (255 // ((1 << bits) - 1)))


def top_bits(px: DataFrame, bits: int) -> DataFrame:
    """8 bits to the highest `bits` of them."""
    return px.withColumn("v", F.shiftright("v", 8 - bits))


def to_16(px: DataFrame, shift: int) -> DataFrame:
    """8 bits to 16, moved up by `shift`; by 8 the value is in both bytes."""
    v = F.shiftleft("v", shift)
    return px.withColumn("v", v.bitwiseOR(F.col("v")) if shift == 8 else v)


def from_16(px: DataFrame, kind: str) -> DataFrame:
    """16 bits to 8: the 'low' or 'high' byte, 'clip' to 255, or 'auto': the low byte where an image fits it, else the high."""
    v = F.col("v")
    low, high = v.bitwiseAND(F.lit(255)), F.shiftright(v, 8).bitwiseAND(F.lit(255))
    if kind == "auto":
        most = px.groupBy("image_id").agg(F.max("v").alias("most"))
        return px.join(most, "image_id").withColumn("v", F.when(F.col("most") <= 255, low).otherwise(high)).drop("most")
    return px.withColumn("v", {"low": low, "high": high, "clip": F.least(v, F.lit(255))}[kind])


def words(colour: DataFrame) -> DataFrame:
    """r, g, b as one word of 32 bits, alpha 255."""
    r, g, b = (F.col(c).cast("long") for c in "rgb")
    return colour.select(*KEY, (F.shiftleft(r, 24) + F.shiftleft(g, 16) + F.shiftleft(b, 8) + 255).alias("v"))


def from_32(px: DataFrame, kind: str) -> DataFrame:
    """Words of 32 bits to 16: the 'low' or 'high' half, or 'clip' to 65535."""
    v = F.col("v")
    low, high = v.bitwiseAND(F.lit(0xFFFF)), F.shiftright(v, 16)
    return px.withColumn("v", {"low": low, "high": high, "clip": F.least(v, F.lit(0xFFFF))}[kind].cast("int"))


def levels(px: DataFrame, n: int, spread: bool) -> DataFrame:
    """8 bits to n equal levels by rounding; spread: the levels' gray values in place of their numbers."""
    v = F.floor((F.col("v") * (n - 1) + 127) / 255)
    return px.withColumn("v", (F.floor(v * 255 / (n - 1)) if spread else v).cast("int"))


def over_white(colour: DataFrame) -> DataFrame:
    """r, g, b, a blended over white: alpha removed."""
    a = F.col("a")
    return colour.select(*KEY, *(F.least(F.lit(255), F.floor((a * F.col(c) + (255 - a) * 255) / 255)).cast("int").alias(c) for c in "rgb"))


def over_colour(colour: DataFrame, back: tuple[int, int, int]) -> DataFrame:
    """r, g, b, a blended over one colour, cut to whole numbers."""
    # the share is rounded to single precision before it is used
    share = (F.col("a").cast("float") / F.lit(255.0).cast("float")).cast("float").cast("double")
    return colour.select(*KEY, *(F.floor((1 - share) * float(k) + share * F.col(c)).cast("int").alias(c) for c, k in zip("rgb", back, strict=True)))


def subpixels(px: DataFrame, factor: int, reverse: bool = False) -> DataFrame:
    """Gray to r, g, b of three samples side by side, enlarged by `factor` (reverse: b, g, r)."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))
    big = px.select("image_id", F.col("y"), F.col("x"), "v", steps.alias("dy")).select("*", steps.alias("dx"))
    # the three samples of an enlarged pixel lie in one source pixel
    names = "bgr" if reverse else "rgb"
    return big.select("image_id", (F.col("y") * factor + F.col("dy")).alias("y"), (F.col("x") * factor + F.col("dx")).alias("x"), *(F.col("v").alias(c) for c in names)).select(*KEY, "r", "g", "b")


def every(px: DataFrame, factor: int) -> DataFrame:
    """Each factor-th pixel of each factor-th row."""
    y, x = F.col("y"), F.col("x")
    small = px.where((y % factor == 0) & (x % factor == 0))
    return small.withColumn("y", F.floor(y / factor).cast("int")).withColumn("x", F.floor(x / factor).cast("int"))


def _extremes() -> tuple[Column, Column]:
    return F.least("r", "g", "b"), F.greatest("r", "g", "b")


#: Fixed value: the channel value that a boost leaves as it is.
NEUTRAL = 180


def boosted(colour: DataFrame, largest: bool) -> DataFrame:
    """The square of the least or greatest channel over the neutral value, at most 255."""
    v = _extremes()[largest]
    return colour.select(*KEY, F.least(F.lit(255), F.floor(v * v / NEUTRAL)).cast("int").alias("v"))


def saturation_boosted(colour: DataFrame, reference: int) -> DataFrame:
    """The greatest channel, raised with the saturation, most where it equals `reference`."""
    low, high = _extremes()
    single = lambda c: c.cast("float")
    inverse = single(single(F.lit(1.0)) / single(high))
    s = F.when(low == high, 0).otherwise(F.floor(single(single(single(F.lit(255.0)) * single(high - low)) * inverse) + F.lit(0.5)).cast("int"))
    full = F.least(F.lit(255), F.floor(single(single(F.lit(255.0)) * single(single(high) / single(F.lit(float(reference)))))).cast("int"))
    return colour.select(*KEY, F.floor((s * full + (255 - s) * high) / 255).cast("int").alias("v"))
