"""Colour spaces as column expressions. Channels are 0-255 unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear(c: Column) -> Column:
    """sRGB channel to linear light in 0-1."""
    x = c / 255.0
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def xyz(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE XYZ for the D65 white, Y in 0-1."""
    r, g, b = linear(r), linear(g), linear(b)
    return 0.4124 * r + 0.3576 * g + 0.1805 * b, 0.2126 * r + 0.7152 * g + 0.0722 * b, 0.0193 * r + 0.1192 * g + 0.9505 * b


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*a*b* for the D65 white."""
    f = lambda t: F.when(t > 216 / 24389, F.cbrt(t)).otherwise((t * (24389 / 27) + 16) / 116)
    x, y, z = xyz(r, g, b)
    fx, fy, fz = f(x / 0.95047), f(y), f(z / 1.08883)
    return 116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """From hue in [0, 240), saturation and value in 0-255."""
    sector = F.floor(h / 40) % 6
    part = h / 40.0 - F.floor(h / 40)
    i = lambda e: F.floor(e + 0.5).cast("int")
    x, y, z = i(v * (1 - s / 255.0)), i(v * (1 - s / 255.0 * part)), i(v * (1 - s / 255.0 * (1 - part)))
    pick = lambda *c: F.element_at(F.array(*c), (sector + 1).cast("int"))
    return pick(v, y, x, x, z, v), pick(z, v, v, y, x, x), pick(x, x, z, v, v, y)


def octcube(r: Column, g: Column, b: Column, level: int) -> Column:
    """The index of the cube at a level: the channels' leading bits interleaved, red first."""
    out = F.lit(0)
    for k in range(level):
        bit = 7 - k
        out = out * 8 + F.shiftright(r, bit).bitwiseAND(F.lit(1)) * 4 + F.shiftright(g, bit).bitwiseAND(F.lit(1)) * 2 + F.shiftright(b, bit).bitwiseAND(F.lit(1))
    return out
