"""Neighbourhoods: convolution, windowed means, rank filters, morphology.

Row and column operators are windows over (image, row) and (image, column), so a raster of any size is spread by its
lines and no pixel is repeated. Only operators that can't be split by direction (rank, hit-miss) repeat pixels, once
per kernel element, before a partial aggregate.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.operators.pixels import KEY


def _line(axis: str):
    return Window.partitionBy("image_id", "y" if axis == "x" else "x").orderBy(axis)


def _frame(axis: str, before: int, after: int):
    return _line(axis).rowsBetween(-before, after)


def convolve3(px: DataFrame, kernel: list[list[float]]) -> DataFrame:
    """3 x 3 correlation with mirrored borders (the edge pixel is its own outer neighbour).

    The sum's absolute value is rounded by adding 0.5 and wraps at 256. Two windows: along rows, then columns.
    """
    x, y = _line("x"), _line("y")
    side = lambda v, k, w: F.coalesce(F.lag(v, -k).over(w), F.col(v))
    rows = px
    for j, (a, b, c) in enumerate(kernel):
        rows = rows.withColumn(f"r{j}", a * side("v", -1, x) + b * F.col("v") + c * side("v", 1, x))
    total = side("r0", -1, y) + F.col("r1") + side("r2", 1, y)
    return rows.select(*KEY, (F.floor(F.abs(total) + 0.5) % 256).cast("int").alias("v"))


def gradient_edges(px: DataFrame) -> DataFrame:
    """Sum of the absolute horizontal and vertical Sobel responses, divided by 8, at most 255; mirrored borders."""
    side = lambda v, k, w: F.coalesce(F.lag(v, -k).over(w), F.col(v))
    x, y = _line("x"), _line("y")
    rows = px.withColumn("d", side("v", 1, x) - side("v", -1, x)).withColumn("s", side("v", -1, x) + 2 * F.col("v") + side("v", 1, x))
    gx = side("d", -1, y) + 2 * F.col("d") + side("d", 1, y)
    gy = side("s", 1, y) - side("s", -1, y)
    return rows.select(*KEY, F.least(F.floor((F.abs(gx) + F.abs(gy)) / 8), F.lit(255)).cast("int").alias("v"))


def windowed_sum(px: DataFrame, v: Column, wc: int, hc: int) -> Column | DataFrame:
    rows = px.withColumn("_s", F.sum(v).over(_frame("x", wc, wc)))
    return rows.withColumn("_s", F.sum("_s").over(_frame("y", hc, hc)))


def windowed_mean(px: DataFrame, wc: int, hc: int) -> DataFrame:
    """Mean over (2 wc + 1) x (2 hc + 1), pixels outside counting as 0; rounded by adding 0.5, at most 255."""
    area = (2 * wc + 1) * (2 * hc + 1)
    return windowed_sum(px, F.col("v"), wc, hc).select(*KEY, F.least(F.floor(F.col("_s") / area + 0.5), F.lit(255)).cast("int").alias("v"))


def windowed_variance(px: DataFrame, wc: int, hc: int) -> DataFrame:
    """Mean square minus squared mean over the window, pixels outside counting as 0."""
    area = (2 * wc + 1) * (2 * hc + 1)
    one = windowed_sum(px, F.col("v"), wc, hc).withColumnRenamed("_s", "_a")
    both = windowed_sum(one, F.col("v") * F.col("v"), wc, hc)
    return both.select(*KEY, F.round(F.col("_s") / area - (F.col("_a") / area) * (F.col("_a") / area), 4).alias("var"))


def adaptive_threshold(px: DataFrame, wc: int, hc: int, c: int) -> DataFrame:
    """1 where v is below the mean of its window (cut at the border) minus c."""
    n = windowed_sum(windowed_sum(px, F.col("v"), wc, hc).withColumnRenamed("_s", "_a"), F.lit(1), wc, hc)
    return n.select(*KEY, F.when(F.col("v") < F.col("_a") / F.col("_s") - c, 1).otherwise(0).alias("v"))


def sauvola(px: DataFrame, half: int, k: float, r: float = 128.0) -> DataFrame:
    """1 where v is below m (1 + k (s / R - 1)), m and s over the window cut at the border."""
    a = windowed_sum(px, F.col("v"), half, half).withColumnRenamed("_s", "_a")
    b = windowed_sum(a, F.col("v") * F.col("v"), half, half).withColumnRenamed("_s", "_b")
    n = windowed_sum(b, F.lit(1), half, half)
    m = F.col("_a") / F.col("_s")
    s = F.sqrt(F.greatest(F.col("_b") / F.col("_s") - m * m, F.lit(0.0)))
    return n.select(*KEY, F.when(F.col("v") < F.round(m * (1 + k * (s / r - 1)), 9), 1).otherwise(0).alias("v"))


def rank_filter(px: DataFrame, width: int, height: int, rank: float) -> DataFrame:
    """The value at index floor(rank * (n - 1) + 0.5) of the window's sorted values; borders are replicated.

    Two windows: along rows a pixel gathers its neighbours, along columns these lists; no pixel is sent anywhere else.
    """
    n, wl, hl = width * height, width // 2, height // 2

    def gathered(c: str, axis: str, before: int, after: int) -> Column:
        w = _line(axis)
        all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first, last = F.first(c).over(all_), F.last(c).over(all_)
        return F.array(*(F.col(c) if k == 0 else F.coalesce(F.lag(c, -k).over(w), first) if k < 0 else F.coalesce(F.lead(c, k).over(w), last) for k in range(-before, after + 1)))

    rows = px.select(*KEY, gathered("v", "x", wl, width - 1 - wl).alias("r"))
    at = int(rank * (n - 1) + 0.5) + 1
    return rows.select(*KEY, gathered("r", "y", hl, height - 1 - hl).alias("a")).select(*KEY, F.element_at(F.sort_array(F.flatten("a")), at).alias("v"))


def dilate(px: DataFrame, width: int, height: int) -> DataFrame:
    """Largest value over a brick with its origin at (width // 2, height // 2); outside is 0. Two windows."""
    w, h = width // 2, height // 2
    rows = px.withColumn("v", F.max("v").over(_frame("x", width - 1 - w, w))) if width > 1 else px
    return rows.withColumn("v", F.max("v").over(_frame("y", height - 1 - h, h))) if height > 1 else rows


def erode(px: DataFrame, width: int, height: int, outside: int | None = 0) -> DataFrame:
    """Least value over a brick. outside: what lies beyond the border (0: binary erosion; None: nothing, as for gray)."""
    w, h = width // 2, height // 2
    rows = px
    for axis, size, mid in (("x", width, w), ("y", height, h)):
        if size > 1:
            f = _frame(axis, mid, size - 1 - mid)
            least = F.min("v").over(f)
            rows = rows.withColumn("v", least if outside is None else F.when(F.count(F.lit(1)).over(f) < size, F.least(least, F.lit(outside))).otherwise(least))
    return rows


def opened(px: DataFrame, width: int, height: int) -> DataFrame:
    return dilate(erode(px, width, height), width, height)


def closed(px: DataFrame, width: int, height: int) -> DataFrame:
    return erode(dilate(px, width, height), width, height)


def gray_opened(px: DataFrame, width: int, height: int) -> DataFrame:
    """Even sizes become odd; borders don't count."""
    w, h = width | 1, height | 1
    return dilate(erode(px, w, h, None), w, h)


def gray_closed(px: DataFrame, width: int, height: int) -> DataFrame:
    w, h = width | 1, height | 1
    return erode(dilate(px, w, h), w, h, None)


def _minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*KEY, F.col("v").alias("w")), KEY).select(*KEY, F.greatest(F.col("v") - F.col("w"), F.lit(0)).alias("v"))


def tophat(px: DataFrame, width: int, height: int, white: bool = True) -> DataFrame:
    """Gray value minus opening (white), or closing minus gray value (black)."""
    return _minus(px, gray_opened(px, width, height)) if white else _minus(gray_closed(px, width, height), px)


def gradient(px: DataFrame, width: int, height: int) -> DataFrame:
    """Gray dilation minus the image."""
    return _minus(dilate(px, width | 1, height | 1), px)


def hit_miss(px: DataFrame, hits: list[tuple[int, int]], misses: list[tuple[int, int]]) -> DataFrame:
    """1 where every hit (dy, dx) is 1 and every miss is 0 inside the raster; pixels outside fail both."""
    wants = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(w).alias("w")) for ds, w in ((hits, 1), (misses, 0)) for dy, dx in ds))
    sent = px.select("image_id", "y", "x", "v", F.explode(F.filter(wants, lambda o: o["w"] == F.col("v"))).alias("o")).select("image_id", (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"))
    full = sent.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(hits) + len(misses)).select(*KEY, F.lit(1).alias("m"))
    return px.join(full, KEY, "left").select(*KEY, F.coalesce("m", F.lit(0)).alias("v"))


def rank_reduce(px: DataFrame, level: int) -> DataFrame:
    """Half the size: 1 where at least `level` of the four pixels are 1; an odd last row or column is dropped."""
    size = px.groupBy("image_id").agg(F.floor((F.max("x") + 1) / 2).alias("w"), F.floor((F.max("y") + 1) / 2).alias("h"))
    half = px.groupBy("image_id", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x")).agg(F.sum("v").alias("s"))
    return half.join(size, "image_id").where("x < w AND y < h").select(*KEY, F.when(F.col("s") >= level, 1).otherwise(0).alias("v"))


def parse_sequence(text: str) -> list[tuple[str, int, int]]:
    """The steps of a morphological sequence: d, e, o, c with w.h; r with levels; x with a power of 2."""
    out = []
    for part in text.replace(" ", "").lower().split("+"):
        if m := re.fullmatch(r"([deoc])(\d+)\.(\d+)", part):
            if not int(m[2]) or not int(m[3]):
                raise ValueError(f"sizes are at least 1: {part}")
            out.append((m[1], int(m[2]), int(m[3])))
        elif m := re.fullmatch(r"r([0-4]{1,4})", part):
            out += [("r", int(c), 0) for c in m[1] if c != "0"]
        elif m := re.fullmatch(r"x(2|4|8|16)", part):
            out.append(("x", int(m[1]), 0))
        else:
            raise ValueError(f"not an operation: {part!r}")
    return out


def expand(px: DataFrame, n: int) -> DataFrame:
    """Every pixel as n x n pixels."""
    s = F.sequence(F.lit(0), F.lit(n - 1))
    return px.withColumn("_a", F.explode(s)).withColumn("_b", F.explode(s)).select("image_id", (F.col("y") * n + F.col("_a")).alias("y"), (F.col("x") * n + F.col("_b")).alias("x"), "v")


def sequence(px: DataFrame, text: str) -> DataFrame:
    """A morphological sequence such as 'o5.5 + e3.3', as one lazy plan."""
    ops = {"d": dilate, "e": erode, "o": opened, "c": closed, "r": lambda p, n, _: rank_reduce(p, n), "x": lambda p, n, _: expand(p, n)}
    return reduce(lambda p, s: ops[s[0]](p, s[1], s[2]), parse_sequence(text), px)


def gaussian(half_w: int, half_h: int, deviation: float) -> list[list[float]]:
    """A kernel of (2 half_w + 1) x (2 half_h + 1) whose middle is 1."""
    import math

    return [[math.exp(-(dx * dx + dy * dy) / (2 * deviation * deviation)) for dx in range(-half_w, half_w + 1)] for dy in range(-half_h, half_h + 1)]


def convolve(px: DataFrame, kernel: list[list[float]], normalise: bool = True, bits: int = 8) -> DataFrame:
    """Convolution with any kernel (turned by 180 degrees, its middle at size // 2), mirrored borders.

    The sum's absolute value is rounded by adding 0.5 and wraps at the depth. Two windows, along rows and then columns.
    """
    from pixelloom.operators.masks import bordered

    k = [row[::-1] for row in kernel[::-1]]
    total = sum(map(sum, k))
    if normalise and total:
        k = [[w / total for w in row] for row in k]
    sx, sy = len(k[0]), len(k)
    cx, cy = sx - 1 - sx // 2, sy - 1 - sy // 2
    rows = bordered(px, cx, sx - 1 - cx, cy, sy - 1 - cy, "mirrored", "mirrored")
    ahead = lambda c, n, w: F.lead(c, n).over(w) if n else F.col(c)
    x, y = _line("x"), _line("y")
    parts = [reduce(lambda a, b: a + b, [w * ahead("v", m, x) for m, w in enumerate(row)]).alias(f"r{j}") for j, row in enumerate(k)]
    rows = rows.select(*KEY, *parts).where("r0 IS NOT NULL")
    all_ = rows.select(*KEY, reduce(lambda a, b: a + b, [ahead(f"r{j}", j, y) for j in range(sy)]).alias("t")).where("t IS NOT NULL")
    # a margin so that halves are told apart alike everywhere
    return all_.select(*KEY, (F.floor(F.round(F.abs(F.col("t")), 6) + 0.5) % (1 << bits)).cast("int").alias("v"))


def separable(px: DataFrame, across: list[float], down: list[float], bits: int = 8) -> DataFrame:
    """Convolution with the product of a row and a column, normalised."""
    return convolve(px, [[a * b for a in across] for b in down], True, bits)
