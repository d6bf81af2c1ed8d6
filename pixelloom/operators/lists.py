"""Lists (set_id, i, and a value or the columns of a box): ranges, selections, order, joins, arithmetic and histograms.

A histogram is (set_id, bin, start, width, n) with all its bins.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The widths of the bins of make_histogram, in the order in which they are tried.
WIDTHS = [
    2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 20000, 50000, 100000, 200000, 500000,
    1000000, 2000000, 5000000, 10000000, 200000000, 50000000, 100000000,
]


def select_range(li: DataFrame, first: int, last: int) -> DataFrame:
    """The elements first to last, both included, counted anew."""
    return li.where(F.col("i").between(first, last)).withColumn("i", F.col("i") - first)


def every(li: DataFrame, step: int) -> DataFrame:
    """Each step-th element, counted anew."""
    return li.where(F.col("i") % step == 0).withColumn("i", F.floor(F.col("i") / step))


def indicator(na: DataFrame, t: float, relation: str) -> DataFrame:
    """1 where the value stands in the relation (<, >, <=, >=) to t, else 0."""
    return na.withColumn("v", F.expr(f"CASE WHEN v {relation} {float(t)}D THEN 1 ELSE 0 END"))


def chosen(li: DataFrame, flags: DataFrame, keep: bool = True) -> DataFrame:
    """The elements whose flag is 1 (keep False: all others)."""
    return li.join(flags.where("v = 1").select("set_id", "i"), ["set_id", "i"], "left_semi" if keep else "left_anti")


def ordered(na: DataFrame, descending: bool = False) -> DataFrame:
    """Values in order with their places and their former places; equal values stay in their order."""
    w = Window.partitionBy("set_id").orderBy(F.col("v").desc() if descending else F.col("v"), "i")
    return na.select("set_id", (F.row_number().over(w) - 1).alias("place"), "v", "i")


def interleaved(a: DataFrame, b: DataFrame) -> DataFrame:
    """a0, b0, a1, b1, ... as far as both go."""
    short = a.groupBy("set_id").agg(F.count(F.lit(1)).alias("na")).join(b.groupBy("set_id").agg(F.count(F.lit(1)).alias("nb")), "set_id").select("set_id", F.least("na", "nb").alias("n"))
    both = a.withColumn("o", F.lit(0)).unionByName(b.withColumn("o", F.lit(1)))
    out = both.join(short, "set_id").where("i < n").withColumn("i", F.col("i") * 2 + F.col("o"))
    return out.drop("o", "n")


def half(li: DataFrame, odd: bool) -> DataFrame:
    """The elements of even or odd places, counted anew."""
    return li.where(F.col("i") % 2 == int(odd)).withColumn("i", F.floor(F.col("i") / 2))


def appended(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, then b."""
    n = a.groupBy("set_id").agg((F.max("i") + 1).alias("n"))
    return a.unionByName(b.join(n, "set_id", "left").withColumn("i", F.col("i") + F.coalesce("n", F.lit(0))).drop("n"))


def reversed_(li: DataFrame) -> DataFrame:
    n = li.groupBy("set_id").agg(F.max("i").alias("n"))
    return li.join(n, "set_id").withColumn("i", F.col("n") - F.col("i")).drop("n")


def with_border(na: DataFrame, left: int, right: int, value: float) -> DataFrame:
    """So many more elements of one value at either end."""
    n = na.groupBy("set_id").agg((F.max("i") + 1).alias("n"))
    ends = F.concat(F.sequence(F.lit(0), F.lit(left)), F.transform(F.sequence(F.lit(0), F.lit(right)), lambda k: k + F.col("n").cast("int") + left))
    ends = F.filter(ends, lambda k: (k < left) | ((k >= F.col("n") + left) & (k < F.col("n") + left + right)))
    more = n.select("set_id", F.explode(ends).alias("i")).select("set_id", F.col("i").cast("long").alias("i"), F.lit(value).alias("v"))
    return na.withColumn("i", F.col("i") + left).unionByName(more)


def arithmetic(a: DataFrame, b: DataFrame, kind: str) -> DataFrame:
    """Element by element: 'add', 'subtract', 'multiply', 'divide'; of 0/1 arrays 'union', 'intersection', 'difference', 'exclusive'."""
    x, y = F.col("v"), F.col("w")
    on = lambda c: F.when(c, 1.0).otherwise(0.0)
    made: dict[str, Column] = {
        "add": x + y, "subtract": x - y, "multiply": x * y, "divide": x / y,
        "union": on((x == 1) | (y == 1)), "intersection": on((x == 1) & (y == 1)), "difference": on((x == 1) & (y != 1)), "exclusive": on(x != y),
    }
    return a.join(b.withColumnRenamed("v", "w"), ["set_id", "i"]).select("set_id", "i", F.round(made[kind], 6).alias("v"))


def slopes(na: DataFrame) -> DataFrame:
    """Half the difference of the neighbours; at the ends half that to the one neighbour."""
    w = Window.partitionBy("set_id").orderBy("i")
    before, after = F.coalesce(F.lag("v").over(w), F.col("v")), F.coalesce(F.lead("v").over(w), F.col("v"))
    return na.select("set_id", "i", F.round((after - before) * 0.5, 6).alias("v"))


def integral(na: DataFrame) -> DataFrame:
    """The trapezoid rule over the whole array: its sum without half of either end."""
    n = na.groupBy("set_id").agg(F.max("i").alias("last"))
    part = F.when((F.col("i") == 0) | (F.col("i") == F.col("last")), F.col("v") * 0.5).otherwise(F.col("v"))
    return na.join(n, "set_id").groupBy("set_id").agg(F.round(F.sum(part), 3).alias("area"))


def value_at(na: DataFrame, x: float, square: bool = False) -> DataFrame:
    """The value at a place between elements, from the line through two or the parabola through three of them."""
    k = int(x)
    n = na.groupBy("set_id").agg(F.max("i").alias("last"))
    near = na.join(n, "set_id").where((F.col("last") >= x) & F.col("i").between(k - 1, k + 2))
    at = lambda j: F.max(F.when(F.col("i") == j, F.col("v")))
    g = near.groupBy("set_id").agg(at(k - 1).alias("a"), at(k).alias("b"), at(k + 1).alias("c"), at(k + 2).alias("d"))
    t = x - k
    line = F.col("b") + t * (F.coalesce("c", "b") - F.col("b"))
    if not square:
        return g.select("set_id", F.round(line, 6).alias("v"))
    # from the three places k - 1, k, k + 1; at the start from k, k + 1, k + 2
    late = F.col("a").isNull()
    p, q, r = F.when(late, F.col("b")).otherwise(F.col("a")), F.when(late, F.col("c")).otherwise(F.col("b")), F.when(late, F.col("d")).otherwise(F.col("c"))
    u = F.when(late, F.lit(t - 1)).otherwise(F.lit(t))
    return g.select("set_id", F.round(p * u * (u - 1) / 2 - q * (u + 1) * (u - 1) + r * u * (u + 1) / 2, 6).alias("v"))


def _dense(counted: DataFrame, sizes: DataFrame) -> DataFrame:
    """counted (set_id, bin, n) with all bins of sizes (set_id, bins, start, width)."""
    every_bin = sizes.select("set_id", "start", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin"))
    return every_bin.join(counted, ["set_id", "bin"], "left").select("set_id", "bin", "start", "width", F.coalesce("n", F.lit(0)).alias("n"))


def make_histogram(na: DataFrame, most: int) -> DataFrame:
    """Bins of whole numbers: of width 1 if there are at most `most`, else of the first nice width that suits.

    Values are rounded by adding 0.5 and cutting; those beyond the bins, which are counted before their start is aligned,
    are not counted.
    """
    cut = lambda c: (F.col(c) + 0.5).cast("int")
    ends = na.groupBy("set_id").agg(F.min("v").alias("low"), F.max("v").alias("high")).select("set_id", cut("low").alias("low"), cut("high").alias("high"))
    span = F.col("high") - F.col("low") + 1
    nice = F.lit(None).cast("int")
    for w in reversed(WIDTHS):
        nice = F.when(span / most < w, w).otherwise(nice)
    sizes = ends.withColumn("width", F.when(span > most - 1, nice).otherwise(1)).where("width IS NOT NULL")
    trunc = lambda e: e.cast("int")  # toward zero
    low, width = F.col("low"), F.col("width")
    start = F.when(width == 1, low).when(low >= 0, width * trunc(low / width)).otherwise(width * trunc((low - width + 1) / width))
    sizes = sizes.select("set_id", (1 + trunc(span / width)).cast("long").alias("bins"), start.alias("start"), "width")
    at = trunc((cut("v") - F.col("start")) / F.col("width")).cast("long")
    counted = na.join(sizes, "set_id").select("set_id", at.alias("bin"), "bins").where("bin >= 0 AND bin < bins").groupBy("set_id", "bin").agg(F.count(F.lit(1)).alias("n"))
    return _dense(counted, sizes)


def make_histogram_clipped(na: DataFrame, width: float, most: float) -> DataFrame:
    """Bins of a width from 0 up to the smaller of `most` and the greatest value."""
    width = min(width, most)
    sizes = na.groupBy("set_id").agg(F.max("v").alias("high")).select("set_id", (F.floor(F.least(F.lit(most), F.col("high")) / width) + 1).alias("bins"), F.lit(0.0).alias("start"), F.lit(width).alias("width"))
    counted = na.join(sizes, "set_id").select("set_id", (F.col("v") / width).cast("long").alias("bin"), "bins").where("bin >= 0 AND bin < bins").groupBy("set_id", "bin").agg(F.count(F.lit(1)).alias("n"))
    return _dense(counted, sizes)


def make_histogram_auto(na: DataFrame, most: int) -> DataFrame:
    """Bins of single whole numbers where all values are whole and fewer than `most` apart, else `most` equal bins, the
    last one closed; values that are all equal make one bin of width 1.
    """
    e = na.groupBy("set_id").agg(F.min("v").alias("start"), F.max("v").alias("high"), F.max(F.when(F.col("v") == F.floor("v"), 0).otherwise(1)).alias("broken"))
    span = F.col("high") - F.col("start")
    whole = ((F.col("broken") == 0) & (span < most)) | (span == 0)
    sizes = e.select("set_id", F.when(whole, F.floor(span) + 1).otherwise(most).cast("long").alias("bins"), "start", F.when(whole, 1.0).otherwise(span / most).alias("width"))
    at = F.least(F.floor((F.col("v") - F.col("start")) / F.col("width")), F.col("bins") - 1)
    return _dense(na.join(sizes, "set_id").select("set_id", at.alias("bin")).groupBy("set_id", "bin").agg(F.count(F.lit(1)).alias("n")), sizes)


def _cumulated(hist: DataFrame) -> DataFrame:
    w = Window.partitionBy("set_id")
    return hist.select("*", (F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"), F.sum("n").over(w).alias("total"), F.count(F.lit(1)).over(w).alias("bins"))


def rank_of_value(hist: DataFrame, value: float) -> DataFrame:
    """The share of a histogram below a value, linear inside its bin."""
    at = (F.lit(value) - F.col("start")) / F.col("width")
    part = F.when(F.col("bin") < F.floor(at), F.col("n")).when(F.col("bin") == F.floor(at), (at - F.floor(at)) * F.col("n")).otherwise(0.0)
    return hist.groupBy("set_id").agg(F.round(F.greatest(F.lit(0.0), F.sum(part) / F.sum("n")), 6).alias("rank")).where("rank IS NOT NULL")


def value_of_rank(hist: DataFrame, rank: float) -> DataFrame:
    """The value at which a share of a histogram is reached, linear inside its bin."""
    c = _cumulated(hist).where((F.col("total") > 0) & (F.col("before") + F.col("n") >= F.col("total") * rank))
    b = c.groupBy("set_id").agg(F.min(F.struct("bin", "n", "before", "total", "start", "width")).alias("b"))
    fract = F.when(F.col("b.n") > 0, (F.col("b.total") * rank - F.col("b.before")) / F.col("b.n")).otherwise(0.0)
    return b.select("set_id", F.round(F.col("b.start") + F.col("b.width") * (F.col("b.bin") + fract), 4).alias("value"))


def split(hist: DataFrame, share: float) -> DataFrame:
    """Where a histogram (set_id, bin, n) falls in two: the least full bin among those around the best score that reach
    1 - share of it, plus 1 (at most 255); ties: the first.

    The score of a bin is the product of both sides' shares and the squared distance of their means.
    """
    w = Window.partitionBy("set_id")
    upto = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    s = hist.select("set_id", "bin", "n", F.sum("n").over(upto).alias("n1"), F.sum(F.col("n") * F.col("bin")).over(upto).alias("s1"), F.sum("n").over(w).alias("t"), F.sum(F.col("n") * F.col("bin")).over(w).alias("s"), F.count(F.lit(1)).over(w).alias("bins"))
    n2 = F.col("t") - F.col("n1")
    gap = (F.col("s") - F.col("s1")) / n2 - F.col("s1") / F.col("n1")
    score = F.when((F.col("n1") > 0) & (n2 > 0), F.col("n1") / F.col("t") * (n2 / F.col("t")) * gap * gap).otherwise(0.0)
    s = s.where("t > 0").select("set_id", "bin", "n", F.round(score, 6).alias("score"))
    best = s.groupBy("set_id").agg(F.max(F.struct("score", (-F.col("bin")).alias("m"))).alias("m")).select("set_id", F.col("m.score").alias("top"), (-F.col("m.m")).alias("at"))
    j = s.join(best, "set_id")
    low = F.col("score") < (1 - share) * F.col("top")
    ends = j.groupBy("set_id").agg(F.max(F.when(low & (F.col("bin") < F.col("at")), F.col("bin"))).alias("left"), F.min(F.when(low & (F.col("bin") > F.col("at")), F.col("bin"))).alias("right"))
    near = j.join(ends, "set_id").where((F.col("bin") > F.coalesce("left", F.lit(-1))) & (F.col("right").isNull() | (F.col("bin") < F.col("right"))))
    return near.groupBy("set_id").agg(F.min(F.struct("n", "bin")).alias("m")).select("set_id", F.least(F.lit(255), F.col("m.bin") + 1).alias("split"))


def extrema(na: DataFrame, delta: float) -> DataFrame:
    """Places and values of peaks and troughs that the array leaves by `delta` or more; the last candidate is not one.

    What counts depends on all that came before: a set is one task.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        v, out = pdf.v.tolist(), []
        up, loc = None, 0
        for i, x in enumerate(v):
            if up is None:
                if i and abs(x - v[0]) >= delta:
                    up, loc = x > v[0], i
            elif (x > v[loc]) if up else (x < v[loc]):
                loc = i
            elif abs(v[loc] - x) >= delta:
                out.append((loc, v[loc]))
                up, loc = not up, i
        return pd.DataFrame([(pdf.set_id.iloc[0], i, x) for i, x in out], columns=["set_id", "i", "v"])

    kind = na.schema["set_id"].dataType.simpleString()
    return na.select("set_id", "i", "v").groupBy("set_id").applyInPandas(walk, f"set_id {kind}, i long, v double")


def find_peaks(na: DataFrame, most: int, fract1: float, fract2: float) -> DataFrame:
    """The `most` largest peaks one after another: left end, place, right end and share of the sum of all.

    A peak reaches on while values stay above fract1 of its top or fall by more than fract2 of the one before; what it
    covers counts as 0 for the next. A set is one task.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        v = pdf.v.tolist()
        total, out = sum(v), []

        def reach(top: int, step: int) -> tuple[int, float]:
            last, taken, k = v[top], 0.0, top + step
            while 0 <= k < len(v):
                if v[k] == 0:
                    return k - step, taken
                if not (v[k] > fract1 * v[top] or last - v[k] > fract2 * last):
                    return k, taken
                taken, last, k = taken + v[k], v[k], k + step
            return k - step, taken

        for _ in range(most):
            if not total or not any(v):
                break
            top = v.index(max(v))
            (left, a), (right, b) = reach(top, -1), reach(top, 1)
            out.append((pdf.set_id.iloc[0], left, top, right, round((v[top] + a + b) / total, 6)))
            v[left : right + 1] = [0.0] * (right - left + 1)
        return pd.DataFrame(out, columns=["set_id", "left", "i", "right", "share"])

    kind = na.schema["set_id"].dataType.simpleString()
    return na.select("set_id", "i", "v").groupBy("set_id").applyInPandas(walk, f"set_id {kind}, left long, i long, right long, share double")
