"""Box lists (set_id, i, x, y, w, h): selections by shape, distances, and arrangements whose steps depend on their order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["x", "y", "w", "h"]


def select_by_area(bx: DataFrame, area: int, relation: str) -> DataFrame:
    return bx.where(f"CAST(w AS BIGINT) * h {relation} {int(area)}")


def select_by_ratio(bx: DataFrame, ratio: float, relation: str) -> DataFrame:
    """By width over height; boxes without height go."""
    return bx.where(f"h > 0 AND CAST(w AS DOUBLE) / h {relation} {float(ratio)}D")


def intersecting(bx: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """Valid boxes that share area with a rectangle; touching is not sharing."""
    return bx.where(f"w > 0 AND h > 0 AND x < {x + w} AND x + w > {x} AND y < {y + h} AND y + h > {y}")


def separations(bx: DataFrame) -> DataFrame:
    """From each box to the next of its set: the overlap of their sides' projections, negative where there is a gap.

    A gap of no pixel between them counts as -1.
    """
    a = bx.where("w > 0 AND h > 0")
    b = a.select("set_id", (F.col("i") - 1).alias("i"), *(F.col(c).alias(f"{c}2") for c in COLUMNS))

    def lap(p: str, s: str) -> Column:
        shared = F.least(F.col(p) + F.col(s), F.col(f"{p}2") + F.col(f"{s}2")) - F.greatest(p, f"{p}2")
        return F.when(shared > 0, shared).otherwise(shared - 1)

    return a.join(b, ["set_id", "i"]).select("set_id", "i", lap("x", "w").alias("across"), lap("y", "h").alias("down"))


def nearest_by_side(bx: DataFrame, x: int, y: int) -> DataFrame:
    """For each set the valid boxes nearest to a point to its left, right, top and bottom, by the gap of their sides."""
    c = F.col
    gaps = {
        "left": F.when(c("x") + c("w") <= x, x - c("x") - c("w")), "right": F.when(c("x") >= x, c("x") - x),
        "top": F.when(c("y") + c("h") <= y, y - c("y") - c("h")), "bottom": F.when(c("y") >= y, c("y") - y),
    }
    best = [F.min(F.when(g.isNotNull(), F.struct(g.alias("gap"), c("i").alias("i")))).alias(k) for k, g in gaps.items()]
    g = bx.where("w > 0 AND h > 0").groupBy("set_id").agg(*best)
    return g.select("set_id", *(c(f"{k}.i").alias(k) for k in gaps))


def _per_set(bx: DataFrame, work, out: str, columns: list[str]) -> DataFrame:
    """work(list of (i, x, y, w, h) in order of i) of each set, which is one task."""
    kind = bx.schema["set_id"].dataType.simpleString()

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        got = work(pdf.sort_values("i")[["i", *COLUMNS]].to_numpy().tolist())
        return pd.DataFrame(got, columns=columns).assign(set_id=pdf.set_id.iloc[0])[["set_id", *columns]]

    return bx.select("set_id", "i", *COLUMNS).groupBy("set_id").applyInPandas(rows, f"set_id {kind}, {out}")


def _shared(a: list, b: list) -> int:
    w = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    h = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])
    return max(0, w) * max(0, h)


def _union(a: list, b: list) -> list:
    x, y = min(a[1], b[1]), min(a[2], b[2])
    return [a[0], x, y, max(a[1] + a[3], b[1] + b[3]) - x, max(a[2] + a[4], b[2] + b[4]) - y]


def handle_overlaps(bx: DataFrame, combine: bool, reach: int, least_overlap: float, most_ratio: float) -> DataFrame:
    """Of two boxes at most `reach` places apart (0: any), the smaller goes if the larger holds least_overlap of it and it has
    at most most_ratio of the larger's area; combine: the larger grows over it. A box that has gone is still met by those
    after it in its own turn.
    """

    def work(boxes: list) -> list:
        gone = [False] * len(boxes)
        for i in range(len(boxes)):
            if gone[i]:
                continue
            for j in range(i + 1, min(len(boxes), i + 1 + reach) if reach else len(boxes)):
                lap = 0 if gone[j] else _shared(boxes[i], boxes[j])
                if not lap:
                    continue
                areas = {k: boxes[k][3] * boxes[k][4] for k in (i, j)}
                small, large = (i, j) if areas[i] <= areas[j] else (j, i)
                if lap / areas[small] >= least_overlap and areas[small] / areas[large] <= most_ratio:
                    gone[small] = True
                    if combine:
                        boxes[large] = _union(boxes[large], boxes[small])
        return [b for b, g in zip(boxes, gone, strict=True) if not g]

    return _per_set(bx, work, "i long, x int, y int, w int, h int", ["i", *COLUMNS])


def _absorbed(eaters: list, eaten: list) -> None:
    for k, a in enumerate(eaters):
        if a is None:
            continue
        for j, b in enumerate(eaten):
            if b is not None and _shared(a, b) and a[3] * a[4] > b[3] * b[4]:
                eaters[k] = a = _union(a, b)
                eaten[j] = None


def _combined(boxes: list) -> list:
    """Overlapping boxes united until none overlap."""
    while True:
        out: list = []
        for b in boxes:
            for k, a in enumerate(out):
                if _shared(a, b):
                    out[k] = _union(a, b)
                    break
            else:
                out.append(b)
        if len(out) == len(boxes):
            return out
        boxes = out


def combine_pair(one: DataFrame, two: DataFrame) -> DataFrame:
    """Two lists of each set (part 0: the one of larger total area): each is combined, then larger boxes of either swallow
    overlapping smaller ones of the other, until the numbers of boxes stay. Counted anew.
    """
    kind = one.schema["set_id"].dataType.simpleString()
    both = one.select("set_id", "i", *COLUMNS, F.lit(0).alias("p")).unionByName(two.select("set_id", "i", *COLUMNS, F.lit(1).alias("p")))

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["p", "i"])
        lists = [pdf[pdf.p == k][["i", *COLUMNS]].to_numpy().tolist() for k in (0, 1)]
        if sum(b[3] * b[4] for b in lists[0]) < sum(b[3] * b[4] for b in lists[1]):
            lists.reverse()
        sizes = [len(v) for v in lists]
        while True:
            a, b = (_combined(v) for v in lists)
            _absorbed(a, b), _absorbed(b, a)
            lists = [[x for x in v if x is not None] for v in (a, b)]
            now = [len(v) for v in lists]
            if now == sizes:
                break
            sizes = now
        out = [(pdf.set_id.iloc[0], k, i, *b[1:]) for k, v in enumerate(lists) for i, b in enumerate(v)]
        return pd.DataFrame(out, columns=["set_id", "part", "i", *COLUMNS])

    return both.groupBy("set_id").applyInPandas(rows, f"set_id {kind}, part int, i long, x int, y int, w int, h int")


def rows_of(bx: DataFrame, gap_tall: int, gap_small: int, tall: int) -> DataFrame:
    """Boxes in rows from the top and, within a row, from the left: i, row, place.

    From left to right, boxes of height `tall` or more join the row whose extent they overlap most, a gap of gap_tall being
    allowed, or start one; then the smaller ones do with gap_small.
    """

    def work(boxes: list) -> list:
        rows: list[list] = []
        in_order = sorted(boxes, key=lambda b: b[1])
        for gap, some in ((gap_tall, [b for b in in_order if b[4] >= tall]), (gap_small, [b for b in in_order if b[4] < tall])):
            for b in some:
                laps = [min(b[2] + b[4], bottom) - max(b[2], top) for top, bottom in ((min(r[2] for r in row if r[3] > 0 and r[4] > 0), max(r[2] + r[4] for r in row if r[3] > 0 and r[4] > 0)) for row in rows)]
                best = max(range(len(laps)), key=lambda k: (laps[k], -k)) if laps else None
                if best is not None and laps[best] + gap >= 0:
                    rows[best].append(b)
                else:
                    rows.append([b])
        for row in rows:
            row.sort(key=lambda b: b[1])
        rows.sort(key=lambda row: row[0][2])
        return [(b[0], r, k) for r, row in enumerate(rows) for k, b in enumerate(row)]

    return _per_set(bx.where("w > 0 AND h > 0"), work, "i long, row int, place int", ["i", "row", "place"])
