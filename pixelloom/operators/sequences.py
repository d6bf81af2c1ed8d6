"""Numeric arrays (set_id, i, v): windows, ranks, histograms, runs, crossings, distances; run lengths of rasters.

Windows of bounded width run over chunks of CHUNK elements with the neighbours that they need; sums from the start add up
chunks first; ranks count equal values and then BINS parts of an array's range. So an array may be larger than a task. The
operators that look any distance back or ahead (runs, reversals, nearest, interpolation) take an array per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


CHUNK, BINS = 1 << 16, 1024


def _line():
    return Window.partitionBy("set_id").orderBy("i")


def _cut(na: DataFrame, before: int, after: int) -> DataFrame:
    """Each element in its chunk (_c), and in the next or last one where a window of theirs reaches it."""
    c, at = F.floor(F.col("i") / CHUNK), F.pmod("i", F.lit(CHUNK))
    return na.withColumn("_c", F.explode(F.array_compact(F.array(c, F.when(at >= CHUNK - before, c + 1), F.when(at < after, c - 1)))))


def _chunk():
    return Window.partitionBy("set_id", "_c").orderBy("i")


def _sides(own: Column) -> tuple[Column, Column]:
    """`own` of the last element at or before each that has one, and of the first at or after it.

    The second is a window in descending order, as Spark goes through a frame up to an array's end anew for each element.
    """
    last = F.last(own, ignorenulls=True)
    return tuple(last.over(Window.partitionBy("set_id").orderBy(i).rowsBetween(Window.unboundedPreceding, 0)) for i in (F.asc("i"), F.desc("i")))


def _own(df: DataFrame) -> DataFrame:
    """The elements of _cut in their own chunks."""
    return df.where(F.floor(F.col("i") / CHUNK) == F.col("_c")).drop("_c")


def _ranked(na: DataFrame) -> DataFrame:
    """Distinct values of each array with their number (k), the number of smaller ones (before) and of all (n)."""
    ends = na.groupBy("set_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    k = na.groupBy("set_id", "v").agg(F.count(F.lit(1)).alias("k")).join(ends, "set_id")
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS))).otherwise(0)
    k = k.select("set_id", "v", "k", "n", bin_.alias("b"))
    upto = Window.partitionBy("set_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    base = k.groupBy("set_id", "b").agg(F.sum("k").alias("s")).select("set_id", "b", F.coalesce(F.sum("s").over(upto), F.lit(0)).alias("base"))
    inner = Window.partitionBy("set_id", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    return k.join(base, ["set_id", "b"]).select("set_id", "v", "k", "n", (F.col("base") + F.coalesce(F.sum("k").over(inner), F.lit(0))).alias("before"))


def _mirrored(na: DataFrame, half: int) -> DataFrame:
    """With half mirrored elements at either end (the end element first)."""
    n = na.groupBy("set_id").agg((F.max("i") + 1).alias("n"))
    i = F.col("i")
    at = F.array_compact(F.array(i, F.when(i < half, -1 - i), F.when(i >= F.col("n") - half, 2 * F.col("n") - 1 - i)))
    return na.join(n, "set_id").select("set_id", "n", F.explode(at).alias("i"), "v")


def windowed_stats(na: DataFrame, half: int) -> DataFrame:
    """Mean, mean square and their difference over 2 half + 1 elements, with mirrored ends."""
    w = _chunk().rowsBetween(-half, half)
    m, s = F.avg("v").over(w), F.avg(F.col("v") * F.col("v")).over(w)
    got = _cut(_mirrored(na, half), half, half).select("set_id", "i", "n", "_c", F.round(m, 6).alias("mean"), F.round(s, 4).alias("mean_square"), F.round(s - m * m, 4).alias("var"))
    return _own(got).where("i >= 0 AND i < n").drop("n")


def windowed_median(na: DataFrame, half: int) -> DataFrame:
    """The middle of the sorted window, with mirrored ends."""
    w = _chunk().rowsBetween(-half, half)
    got = _cut(_mirrored(na, half), half, half).select("set_id", "i", "n", "_c", F.collect_list("v").over(w).alias("l"))
    return _own(got).where("i >= 0 AND i < n").select("set_id", "i", F.element_at(F.sort_array("l"), half + 1).alias("median"))


def extreme_filter(na: DataFrame, size: int, largest: bool) -> DataFrame:
    """1-D dilation or erosion; an even size becomes odd; ends are cut."""
    half = (size | 1) // 2
    return _own(_cut(na, half, half).withColumn("v", (F.max if largest else F.min)("v").over(_chunk().rowsBetween(-half, half))))


def partial_sums(na: DataFrame) -> DataFrame:
    c = na.withColumn("_c", F.floor(F.col("i") / CHUNK))
    upto = Window.partitionBy("set_id").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    base = c.groupBy("set_id", "_c").agg(F.sum("v").alias("s")).select("set_id", "_c", F.coalesce(F.sum("s").over(upto), F.lit(0.0)).alias("base"))
    inner = F.sum("v").over(_chunk().rowsBetween(Window.unboundedPreceding, 0))
    return c.withColumn("v", inner).join(base, ["set_id", "_c"]).select("set_id", "i", F.round(F.col("base") + F.col("v"), 4).alias("v"))


def deltas(na: DataFrame) -> DataFrame:
    """v[i] - v[i - 1]: one element less."""
    return _own(_cut(na, 1, 0).withColumn("v", F.round(F.col("v") - F.lag("v").over(_chunk()), 6))).where(F.col("v").isNotNull())


def crossings(na: DataFrame, t: float) -> DataFrame:
    """Interpolated places where the array passes strictly from one side of t to the other."""
    a, b = F.lag("v").over(_chunk()) - t, F.col("v") - t
    d = _own(_cut(na, 1, 0).select("set_id", "i", "_c", a.alias("a"), b.alias("b"))).where((F.col("a") * F.col("b")) < 0)
    return d.select("set_id", F.round(F.col("i") - 1 + F.abs(F.col("a")) / (F.abs(F.col("a")) + F.abs(F.col("b"))), 6).alias("at"))


def rank_value(na: DataFrame, fract: float) -> DataFrame:
    """The value at index floor(fract (n - 1) + 0.5) of the ascending order."""
    at = F.floor(F.lit(fract) * (F.col("n") - 1) + 0.5)
    return _ranked(na).where((F.col("before") <= at) & (at < F.col("before") + F.col("k"))).select("set_id", F.col("v").alias("rank_value"))


def mode(na: DataFrame) -> DataFrame:
    """The most frequent value; of equals the largest."""
    n = na.groupBy("set_id", "v").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("set_id").agg(F.max(F.struct("n", "v")).alias("m")).select("set_id", F.col("m.v").alias("mode"), F.col("m.n").alias("n"))


def histogram_auto(na: DataFrame, bins: int) -> DataFrame:
    """Equal bins between the extremes, the last one closed; empty bins are left out."""
    e = na.groupBy("set_id").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    size = (F.col("high") - F.col("low")) / bins
    at = F.when(size == 0, 0).otherwise(F.least(F.floor((F.col("v") - F.col("low")) / F.when(size == 0, 1.0).otherwise(size)), F.lit(bins - 1)))
    return na.join(e, "set_id").select("set_id", at.cast("int").alias("bin")).groupBy("set_id", "bin").agg(F.count(F.lit(1)).alias("n"))


def equal_population(na: DataFrame, k: int) -> DataFrame:
    """Means of k bins of the ascending order that hold floor(n (b + 1) / k) - floor(n b / k) elements."""
    n = F.col("n")

    def bin_of(r):
        """The largest b with floor(n b / k) <= r."""
        b = F.floor((r * k + k - 1) / n)
        return F.least(F.when(F.floor(n * b / k) <= r, b).otherwise(b - 1), F.lit(k - 1))

    # equal values may lie in several bins: of each, as many as its ranks say
    r = _ranked(na).select("set_id", "v", "n", "before", (F.col("before") + F.col("k")).alias("end"))
    r = r.select("*", F.explode(F.sequence(bin_of(F.col("before")), bin_of(F.col("end") - 1))).alias("b"))
    many = F.least(F.col("end"), F.floor(n * (F.col("b") + 1) / k)) - F.greatest(F.col("before"), F.floor(n * F.col("b") / k))
    r = r.select("set_id", F.col("b").cast("int").alias("bin"), "v", many.alias("many")).where("many > 0")
    return r.groupBy("set_id", "bin").agg(F.sum("many").alias("n"), F.round(F.sum(F.col("v") * F.col("many")) / F.sum("many"), 6).alias("mean"))


def simple_stats(na: DataFrame) -> DataFrame:
    """Extremes, mean and population variance."""
    m = F.avg("v")
    return na.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.round(m, 6).alias("mean"), F.round(F.avg(F.col("v") * F.col("v")) - m * m, 3).alias("var"), F.round(F.sum("v"), 3).alias("total"))


def mean_deviation(na: DataFrame) -> DataFrame:
    """Mean absolute deviation from the median (by the rank rule)."""
    m = rank_value(na, 0.5)
    return na.join(m, "set_id").groupBy("set_id").agg(F.round(F.avg(F.abs(F.col("v") - F.col("rank_value"))), 6).alias("mean_dev"))


def earth_mover(hist: DataFrame) -> DataFrame:
    """Earth mover's distance of every two histograms (set_id, i, n) over the same places, scaled to the first's mass.

    The sets are few (classes, event types); a set's row meets each other set's row of the same place.
    """
    w = Window.partitionBy("set_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("set_id")
    c = hist.select("set_id", "i", (F.sum("n").over(w) / F.sum("n").over(all_)).alias("c"))
    a, b = c.alias("a"), c.alias("b")
    return a.join(b, F.expr("a.i = b.i AND a.set_id < b.set_id")).groupBy(F.col("a.set_id").alias("set_a"), F.col("b.set_id").alias("set_b")).agg(F.round(F.sum(F.abs(F.col("a.c") - F.col("b.c"))), 6).alias("emd"))


def nonzero_runs(na: DataFrame, t: float) -> DataFrame:
    """Runs of elements above t: first, last and length."""
    on = na.withColumn("on", F.when(F.col("v") > t, 1).otherwise(0))
    g = on.withColumn("g", F.col("i") - F.sum("on").over(_line().rowsBetween(Window.unboundedPreceding, 0))).where("on = 1")
    return g.groupBy("set_id", "g").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count(F.lit(1)).alias("n")).drop("g")


def row_runs(px: DataFrame) -> DataFrame:
    """Runs of 1 in each row of a binary raster: image_id, y, x0, x1 (inclusive). Islands of x minus their number."""
    w = Window.partitionBy("image_id", "y").orderBy("x")
    on = px.where("v = 1").withColumn("g", F.col("x") - F.row_number().over(w))
    return on.groupBy("image_id", "y", "g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("g")


def longest_runs(px: DataFrame) -> DataFrame:
    """The longest run of 1 of each row that has any."""
    return row_runs(px).groupBy("image_id", "y").agg(F.max(F.col("x1") - F.col("x0") + 1).alias("longest"), F.count(F.lit(1)).alias("n_runs"))


def smoothed_pairs(na: DataFrame, half: int) -> DataFrame:
    """Windowed medians of even and odd places apart (left and right pages)."""
    side = na.withColumn("side", F.col("i") % 2)
    w = Window.partitionBy("set_id", "side").orderBy("i").rowsBetween(-half, half)
    return side.select("set_id", "i", F.element_at(F.array_sort(F.collect_list("v").over(w)), F.floor(F.count("v").over(w) / 2).cast("int") + 1).alias("median"))


def histogram_stats(na: DataFrame, width: float) -> DataFrame:
    """Of the histogram with bins of a width: mean and variance of the bins' places, the first place where half is reached, the first mode."""
    h = na.select("set_id", (F.floor(F.col("v") / width) * width).alias("at")).groupBy("set_id", "at").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("set_id")
    c = h.select("set_id", "at", "n", F.sum("n").over(w.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)).alias("c"), F.sum("n").over(w).alias("t"))
    m = F.sum(F.col("at") * F.col("n")) / F.sum("n")
    best = F.max(F.struct("n", (-F.col("at")).alias("m")))
    return c.groupBy("set_id").agg(F.round(m, 6).alias("mean"), F.round(F.sum(F.col("at") * F.col("at") * F.col("n")) / F.sum("n") - m * m, 4).alias("var"), F.min(F.when(F.col("c") * 2 >= F.col("t"), F.col("at"))).alias("median"), (-best["m"]).alias("mode"))


def reversals(na: DataFrame) -> DataFrame:
    """Local extrema: places where the sign of the difference changes."""
    d = na.select("set_id", "i", "v", F.signum(F.col("v") - F.lag("v").over(_line())).alias("s")).where("s <> 0")
    return d.select("set_id", "i", (F.lag("s").over(_line()) * F.col("s")).alias("p")).where("p < 0").groupBy("set_id").agg(F.count(F.lit(1)).alias("n_reversals"))


def nearest_model(na: DataFrame, has: float, most: int) -> DataFrame:
    """For each element the nearest element with v >= has, by place, within `most`; ties: the lower place.

    An as-of join in both directions by two windows.
    """
    before, after = _sides(F.when(F.col("v") >= has, F.col("i")))
    r = na.select("set_id", "i", before.alias("p"), after.alias("q"))
    near = F.when(F.col("q").isNull() | (F.col("i") - F.col("p") <= F.col("q") - F.col("i")), F.col("p")).otherwise(F.col("q"))
    return r.select("set_id", "i", F.when(F.abs(near - F.col("i")) <= most, near).alias("model"))


def peaks(na: DataFrame, half: int, least: float) -> DataFrame:
    """Elements at or above `least` that no element within half places exceeds; of equal ones the first."""
    w = _chunk()
    before, after = F.max("v").over(w.rowsBetween(-half, -1)), F.max("v").over(w.rowsBetween(1, half))
    p = _own(_cut(na, half, half).select("set_id", "i", "v", "_c", before.alias("b"), after.alias("a")))
    return p.where((F.col("v") >= least) & (F.col("b").isNull() | (F.col("v") > F.col("b"))) & (F.col("a").isNull() | (F.col("v") >= F.col("a")))).select("set_id", "i", "v")


def interpolated(na: DataFrame, step: int) -> DataFrame:
    """Every step-th element kept and the others replaced by the line between their kept neighbours."""
    before, after = _sides(F.when(F.col("i") % step == 0, F.struct("i", "v")))
    r = na.select("set_id", "i", before.alias("p"), after.alias("q"))
    t = (F.col("i") - F.col("p.i")) / (F.col("q.i") - F.col("p.i"))
    v = F.when(F.col("q.i").isNull() | (F.col("q.i") == F.col("p.i")), F.col("p.v")).otherwise(F.col("p.v") + t * (F.col("q.v") - F.col("p.v")))
    return r.select("set_id", "i", F.round(v, 6).alias("v"))
