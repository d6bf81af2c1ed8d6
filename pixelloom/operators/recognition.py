"""Composite queries: skew sweeps, correlation of rasters, leader classes."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.sources.scratch import scratch

#: Pixels of templates that are broadcast: some 16 bytes each.
SMALL = 1 << 18


def skew_scores(px: DataFrame, degrees: list[int]) -> DataFrame:
    """For each angle: the foreground sheared down by x tan(angle), and the sum of squared differences of row counts.

    Angles are a literal of the plan; foreground pixels are repeated once per angle and counted before the shuffle.
    """
    angles = F.array(*(F.struct(F.lit(d).alias("deg"), F.lit(math.tan(math.radians(d))).alias("t")) for d in degrees))
    on = px.where("v = 1").select("image_id", "y", "x", F.explode(angles).alias("a"))
    rows = on.groupBy("image_id", F.col("a.deg").alias("deg"), F.floor(F.col("y") + F.col("x") * F.col("a.t") + 0.5).alias("row")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("image_id", "deg").orderBy("row")
    gap = F.col("row") - F.lag("row").over(w)
    before = F.when(gap == 1, F.lag("n").over(w)).otherwise(0)
    after = F.when(F.lead("row").over(w) - F.col("row") == 1, 0).otherwise(F.col("n"))
    d = rows.select("image_id", "deg", ((F.col("n") - before) * (F.col("n") - before) + after * after).alias("d"))
    return d.groupBy("image_id", "deg").agg(F.sum("d").alias("score"))


def templates(small: DataFrame) -> DataFrame:
    """The rounded mean raster of each class."""
    return small.groupBy("label", "y", "x").agg(F.floor(F.avg("v") + 0.5).cast("int").alias("t"))


def best_template(small: DataFrame) -> DataFrame:
    """Each raster's class of least total absolute difference to the class means; ties: the lowest label.

    Sums are partial before the shuffle. Templates of up to SMALL pixels in all are sent to every task, so that rasters stay
    where they are; beyond that pixels and templates meet by place.
    """
    t = scratch(templates(small).withColumnRenamed("label", "cls"), "templates")
    t = F.broadcast(t) if t.count() <= SMALL else t
    d = small.select("image_id", "y", "x", "v").join(t, ["y", "x"]).groupBy("image_id", "cls").agg(F.sum(F.abs(F.col("v") - F.col("t"))).alias("d"))
    return d.groupBy("image_id").agg(F.min(F.struct("d", "cls")).alias("m")).select("image_id", F.col("m.cls").alias("cls"), F.col("m.d").alias("distance"))


def overlap_scores(small: DataFrame, t: int) -> DataFrame:
    """Each raster's binary overlap with its class template: and^2 / (n1 n2), Dice and Jaccard."""
    m = templates(small)
    j = small.join(m, ["label", "y", "x"]).select("image_id", F.when(F.col("v") < t, 1).otherwise(0).alias("a"), F.when(F.col("t") < t, 1).otherwise(0).alias("b"))
    s = j.groupBy("image_id").agg(F.sum(F.col("a") * F.col("b")).alias("both"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    both, na, nb = F.col("both"), F.col("na"), F.col("nb")
    safe = lambda n, d: F.round(F.when(d > 0, n / d).otherwise(0.0), 6)
    return s.select("image_id", safe(both * both * 1.0, na * nb).alias("score"), safe(both * 2.0, na + nb).alias("dice"), safe(both * 1.0, na + nb - both).alias("jaccard"))


def _leaders(bits: np.ndarray, n: np.ndarray, w: np.ndarray, h: np.ndarray, least: float, near: int) -> np.ndarray:
    """The number of each row's leader, by leader_classes' rule in the order of rows. bits: 0 or 1, n: their sums.

    Blocks of rows are held against all leaders before them by products of matrices, in single precision; what is near enough
    is then counted. Rows that no leader of an earlier block takes are gone through in order, by their matches in the block.
    """
    fit = max(1, (1 << 24) // max(1, bits.shape[1]))
    found = np.full(len(bits), -1)
    empty = np.flatnonzero(n == 0)  # they match one another only
    found[empty] = empty[:1]
    unit = lambda rows: bits[rows] / np.sqrt(n[rows, None], dtype=np.float32)

    def matches(rows: np.ndarray, of: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r, c = np.nonzero(units @ unit(of).T >= math.sqrt(least) - 1e-3)
        boxes = (np.abs(w[rows[r]] - w[of[c]]) <= near) & (np.abs(h[rows[r]] - h[of[c]]) <= near)
        r, c = r[boxes], c[boxes]
        ok = np.empty(len(r), bool)
        for k in range(0, len(r), fit):
            i, j = rows[r[k : k + fit]], of[c[k : k + fit]]
            both = (bits[i] & bits[j]).sum(1, dtype=np.int64)
            ok[k : k + fit] = both * both >= least * n[i] * n[j]
        return r[ok], c[ok]

    led = np.empty(len(bits), np.int64)
    many = 0
    step = min(2048, fit)
    for start in range(0, len(bits), step):
        rows = start + np.flatnonzero(found[start : start + step] < 0)
        units = unit(rows)
        for k in range(0, many, step):
            of = led[k : min(many, k + step)]
            r, c = matches(rows, of, units)
            r, first = np.unique(r, return_index=True)
            found[rows[r]] = of[c[first]]
            rows, units = np.delete(rows, r), np.delete(units, r, 0)
        r, c = matches(rows, rows, units)
        ends = np.searchsorted(r, np.arange(len(rows) + 1))
        for k, row in enumerate(rows):
            if found[row] < 0:
                took = rows[c[ends[k] : ends[k + 1]]]
                found[took[found[took] < 0]] = row
                found[row] = led[many] = row
                many += 1
    return found


def leader_classes(small: DataFrame, t: int, least: float, near: int = 2) -> DataFrame:
    """Leader clustering: a raster joins the first class whose leader it matches by and^2 / (n1 n2), else founds one.

    Only leaders of as many pixels whose foreground's bounding box differs by at most `near` either way are looked at. Rasters
    go in order of their ids, so widths that are linked by such steps make one task; its work is rasters times leaders.
    """
    on = F.when(F.col("v") < t, 1).otherwise(0).cast("int")
    x, y = F.when(on == 1, F.col("x")), F.when(on == 1, F.col("y"))
    side = lambda c: F.coalesce(F.max(c) - F.min(c) + 1, F.lit(0)).cast("long")
    bits = small.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", on.alias("b")))).alias("p"), side(x).alias("w"), side(y).alias("h"))
    bits = bits.select("image_id", "w", "h", F.size("p").alias("d"), F.array_join(F.transform("p", lambda e: e["b"].cast("string")), "").cast("binary").alias("bits"))
    order = Window.orderBy("w")  # over the distinct widths only
    steps = bits.select("w").distinct().select("w", F.when(F.col("w") - F.lag("w").over(order) > near, 1).otherwise(0).alias("s"))
    chains = steps.select("w", F.sum("s").over(order).alias("chain"))

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("image_id", ignore_index=True)
        bits = np.frombuffer(b"".join(pdf.bits), np.uint8).reshape(len(pdf), -1) & 1
        ids = pdf.image_id.to_numpy()
        return pd.DataFrame({"image_id": ids, "leader": ids[_leaders(bits, bits.sum(1, dtype=np.int64), pdf.w.to_numpy(), pdf.h.to_numpy(), least, near)]})

    return bits.join(chains, "w").groupBy("chain", "d").applyInPandas(lead, "image_id long, leader long")


def best_shift(a: DataFrame, b: DataFrame, most: int) -> DataFrame:
    """The shift (dy, dx) of b, at most `most` each way, with the largest and^2 / (n_a n_b); ties: the least dy, then dx.

    Foreground goes in cells, 64 columns of a row as the bits of one number. Cells of a are repeated once per dy, those of b
    also for the cells beside them that they reach, and meet in a sum, not in a join: nothing is sent to all tasks.
    """
    bit = F.expr("shiftleft(1L, cast(pmod(x, 64) AS INT))")
    side = lambda t, k: t.where("v = 1 AND image_id IS NOT NULL").select("image_id", "y", F.floor(F.col("x") / 64).alias("c"), *(bit.alias(n) if n == k else F.lit(0).cast("long").alias(n) for n in ("a", "b")))
    cells = side(a, "a").unionByName(side(b, "b")).groupBy("image_id", "y", "c").agg(F.bit_or("a").alias("a"), F.bit_or("b").alias("b"))
    shifts, beside = range(-most, most + 1), range(-((most + 63) // 64), (most + 63) // 64 + 1)
    moved = lambda c, n: F.shiftleft(c, n) if n >= 0 else F.shiftrightunsigned(c, -n)
    near = lambda o: 64 * o - most if o > 0 else 64 * o + most if o < 0 else 0
    # of b's cell o to the right of a's: its bits, where a shift brings any of them in
    parts = [F.when(moved(F.col("b"), near(o)) != 0 if abs(near(o)) < 64 and o * near(o) > 0 else F.col("b") != 0, F.struct((F.col("c") - o).alias("c"), F.lit(o).alias("o"), F.lit(0).cast("long").alias("a"), F.col("b").alias("b"))) for o in beside]
    own = F.when(F.col("a") != 0, F.struct("c", F.lit(0).alias("o"), "a", F.lit(0).cast("long").alias("b")))
    dys = F.array(*(F.struct(F.lit(0 if k == 0 else d).alias("up"), F.lit(d).alias("dy"), F.lit(k).alias("k")) for d in shifts for k in (0, 1)))
    sent = cells.select("image_id", "y", F.explode(F.array_compact(F.array(own, *parts))).alias("p")).withColumn("s", F.explode(dys))
    # a stays in its row, b moves down by dy
    sent = sent.where("(s.k = 0 AND p.a <> 0) OR (s.k = 1 AND p.b <> 0)").select("image_id", (F.col("y") + F.col("s.up")).alias("y"), "p.c", "s.dy", "p.o", "p.a", "p.b")
    met = sent.groupBy("image_id", "y", "c", "dy").agg(F.bit_or("a").alias("a"), *(F.bit_or(F.when(F.col("o") == o, F.col("b")).otherwise(0)).alias(f"b{k}") for k, o in enumerate(beside)))

    def both(dx: int) -> Column:
        at = [moved(F.col(f"b{k}"), dx + 64 * o) for k, o in enumerate(beside) if abs(dx + 64 * o) < 64]
        return F.sum(F.bit_count(F.col("a").bitwiseAND(reduce(Column.bitwiseOR, at))))

    whole = lambda c: F.sum(F.when(F.col("dy") == 0, F.bit_count(c)).otherwise(0))
    sums = met.groupBy("image_id", "dy").agg(*(both(dx).alias(f"n{k}") for k, dx in enumerate(shifts)), whole("a").alias("na"), whole(f"b{len(beside) // 2}").alias("nb"))
    each = F.greatest(*(F.struct(F.col(f"n{k}").alias("both"), (-F.col("dy")).alias("dy"), F.lit(-dx).alias("dx")) for k, dx in enumerate(shifts))) if most else F.struct(F.col("n0").alias("both"), F.col("dy"), F.lit(0).alias("dx"))
    best = sums.groupBy("image_id").agg(F.max(each).alias("m"), F.max("na").alias("na"), F.max("nb").alias("nb")).where("m.both > 0")
    return best.select("image_id", (-F.col("m.dy")).alias("dy"), (-F.col("m.dx")).alias("dx"), F.round(F.col("m.both") * F.col("m.both") / (F.col("na") * F.col("nb")), 6).alias("score"))


#: Below this best score an angle is not trusted; nor if the least score is not above this share of w * w * h;
#: an angle is worth turning by from 0.1 degrees and a confidence of 3.
LEAST_BEST, LEAST_SHARE, LEAST_ANGLE, LEAST_CONFIDENCE = 10000.0, 0.000002, 0.1, 3.0


def _sheared_scores(on: DataFrame, sizes: DataFrame, angles: DataFrame) -> DataFrame:
    """(image_id, k, score): for each angle (image_id, k, deg) the foreground moved down by x tan(angle), what leaves the
    raster going, and the sum of the squared differences of row counts away from the top and bottom.
    """
    moved = on.join(angles, "image_id").select("image_id", "k", F.floor(F.col("y") + F.col("x") * F.tan(F.radians("deg")) + 0.5).cast("int").alias("row"))
    n = moved.groupBy("image_id", "k", "row").agg(F.count(F.lit(1)).alias("n"))
    # a row's count meets itself and the next row, so a difference has both or one of them
    both = n.select("image_id", "k", F.explode(F.array(F.struct(F.col("row").alias("row"), F.col("n").alias("d")), F.struct((F.col("row") + 1).alias("row"), (-F.col("n")).alias("d")))).alias("e"), "row")
    both = both.join(sizes, "image_id").where("row >= 0 AND row < h")
    skip = F.greatest(F.lit(1), F.floor(F.least(F.floor(F.col("h") / 10), F.floor(F.col("w") * 0.05)) / 2))
    d = both.where((F.col("e.row") >= skip) & (F.col("e.row") < F.col("h") - skip)).groupBy("image_id", "k", "e.row").agg(F.sum("e.d").alias("d"))
    s = d.groupBy("image_id", "k").agg(F.sum(F.col("d") * F.col("d")).alias("score"))
    return angles.join(s, ["image_id", "k"], "left").select("image_id", "k", "deg", F.coalesce("score", F.lit(0)).cast("double").alias("score"))


def find_skew(px: DataFrame, reach: int = 7, least_step: float = 0.01) -> DataFrame:
    """Each binary raster's skew in degrees and the confidence in it: a sweep by whole degrees, then halving steps.

    A best angle at the end of the sweep gives 0 and 0. All rasters take each step together.
    """
    on = scratch(px.where("v = 1").select("image_id", "y", "x"), "foreground")
    sizes = scratch(px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")), "sizes")
    tries = lambda t, *degrees: t.select("image_id", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), d.alias("deg")) for k, d in enumerate(degrees)))).alias("e")).select("image_id", "e.k", "e.deg")
    sweep = _sheared_scores(on, sizes, tries(sizes, *(F.lit(float(d)) for d in range(-reach, reach + 1))))
    best = sweep.groupBy("image_id").agg(F.max(F.struct("score", (-F.col("k")).alias("m"), "deg")).alias("b")).select("image_id", F.col("b.deg").alias("centre"))
    now = scratch(best.where(F.abs("centre") < reach), "sweep")

    def scored(t: DataFrame, *degrees) -> DataFrame:
        s = _sheared_scores(on, sizes, tries(t, *degrees))
        return s.groupBy("image_id").agg(*(F.max(F.when(F.col("k") == k, F.col("score"))).alias(f"t{k}") for k in range(len(degrees))))

    c = F.col("centre")
    got = scored(now, c - 1.0, c, c + 1.0)
    state = scratch(now.join(got, "image_id").select("image_id", "centre", F.col("t0").alias("s0"), F.col("t1").alias("s2"), F.col("t2").alias("s4"), F.least("t0", "t1", "t2").alias("low")), "search")
    step = 0.5
    while step >= least_step:
        j = state.join(scored(state, c - step, c + step), "image_id")
        s1, s2, s3 = F.col("t0"), F.col("s2"), F.col("t1")
        # the best of the middle three: of equal ones the first
        pick = lambda a, b, e: F.when((s1 >= s2) & (s1 >= s3), a).when(s2 >= s3, b).otherwise(e)  # noqa: B023, E731
        made = j.select(
            "image_id", (c + pick(F.lit(-step), F.lit(0.0), F.lit(step))).alias("centre"), pick(F.col("s0"), s1, s2).alias("s0"), pick(s1, s2, s3).alias("s2"), pick(s2, s3, F.col("s4")).alias("s4"),
            F.least("low", s1, s3).alias("low"),
        )
        state = scratch(made, "search")
        step /= 2
    out = sizes.join(state, "image_id", "left")
    sure = (F.col("low") > F.lit(LEAST_SHARE) * F.col("w") * F.col("w") * F.col("h")) & (F.abs(c) <= reach - 1) & (F.col("s2") >= LEAST_BEST)
    return out.select("image_id", F.coalesce("centre", F.lit(0.0)).alias("angle"), F.when(sure, F.round(F.col("s2") / F.col("low"), 6)).otherwise(0.0).alias("confidence"))


def deskewed(px: DataFrame, fill: int = 0) -> DataFrame:
    """Binary rasters turned back by their skew about the middle, sampled, where it is large and sure enough."""
    from pixelloom.operators.geometry import _sized

    a = find_skew(px)
    turn = F.when((F.abs("angle") >= LEAST_ANGLE) & (F.col("confidence") >= LEAST_CONFIDENCE), F.radians("angle")).otherwise(0.0)
    z = _sized(px).join(a.select("image_id", turn.alias("t")), "image_id")
    cx, cy = F.floor(F.col("w") / 2), F.floor(F.col("h") / 2)
    dx, dy = F.col("x") - cx, F.col("y") - cy
    to = z.select("image_id", "y", "x", (cy + F.floor(dy * F.cos("t") - dx * F.sin("t") + 0.5)).cast("int").alias("ys"), (cx + F.floor(dx * F.cos("t") + dy * F.sin("t") + 0.5)).cast("int").alias("xs"))
    src = px.select("image_id", F.col("y").alias("ys"), F.col("x").alias("xs"), "v")
    return to.join(src, ["image_id", "ys", "xs"], "left").select("image_id", "y", "x", F.coalesce("v", F.lit(fill)).alias("v"))
