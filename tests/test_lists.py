"""Lists and boxes whose steps depend on their order, and the skew search, against plain code."""

import random

import numpy as np
import pytest

from pixelloom.operators import boxsets, lists, recognition


def numa(spark, sets):
    return spark.createDataFrame([(k, i, float(x)) for k, v in sets.items() for i, x in enumerate(v)], "set_id string, i long, v double").repartition(3)


@pytest.fixture(scope="module")
def sets():
    rng = random.Random(3)
    return {"a": [rng.randint(0, 9) for _ in range(80)], "b": [rng.random() * 20 for _ in range(50)], "c": [5, 5, 5], "d": [1, 4]}


def test_extrema(spark, sets):
    got = {}
    for r in lists.extrema(numa(spark, sets), 4.0).collect():
        got.setdefault(r.set_id, []).append((r.i, r.v))
    for k, v in sets.items():
        first = next((i for i, x in enumerate(v) if abs(x - v[0]) >= 4), None)
        want = []
        if first is not None:
            sign = 1 if v[first] > v[0] else -1
            best, loc = v[first], first
            for i in range(first + 1, len(v)):
                if sign * v[i] > sign * best:
                    best, loc = v[i], i
                elif sign * (best - v[i]) >= 4:
                    want.append((loc, best))
                    sign, best, loc = -sign, v[i], i
        assert sorted(got.get(k, [])) == want


def test_find_peaks(spark, sets):
    got = {}
    for r in lists.find_peaks(numa(spark, sets), 3, 0.3, 0.2).collect():
        got.setdefault(r.set_id, []).append((r.left, r.i, r.right, r.share))
    for k, v in sets.items():
        v, total, want = [float(x) for x in v], sum(v), set()
        for _ in range(3):
            if not any(v):
                break
            top = int(np.argmax(v))
            ends, covered = [], v[top]
            for step in (-1, 1):
                last, at, end = v[top], top + step, None
                while 0 <= at < len(v) and end is None:
                    if v[at] == 0:
                        end = at - step
                    elif v[at] > 0.3 * v[top] or last - v[at] > 0.2 * last:
                        covered, last, at = covered + v[at], v[at], at + step
                    else:
                        end = at
                ends.append((0 if step < 0 else len(v) - 1) if end is None else end)
            want.add((ends[0], top, ends[1], round(covered / total, 6)))
            for i in range(ends[0], ends[1] + 1):
                v[i] = 0.0
        assert {(a, b, c) for a, b, c, _ in got[k]} == {(a, b, c) for a, b, c, _ in want}
        assert np.allclose(sorted(x[3] for x in got[k]), sorted(x[3] for x in want), atol=2e-6)


def lap(a, b):
    return max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))


def union(a, b):
    x, y = min(a[0], b[0]), min(a[1], b[1])
    return (x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y)


@pytest.fixture(scope="module")
def boxes():
    rng = random.Random(8)
    return [(rng.randint(0, 60), rng.randint(0, 60), rng.randint(1, 14), rng.randint(1, 14)) for _ in range(40)]


def frame(spark, boxes):
    return spark.createDataFrame([("s", i, *b) for i, b in enumerate(boxes)], "set_id string, i long, x int, y int, w int, h int")


@pytest.mark.parametrize("combine,reach", [(True, 0), (False, 0), (True, 6)])
def test_handle_overlaps(spark, boxes, combine, reach):
    now, gone = list(boxes), set()
    for i in range(len(now)):
        for j in range(i + 1, min(len(now), i + 1 + (reach or len(now)))):
            if i in gone and j == i + 1:
                break
            if j in gone or not lap(now[i], now[j]):
                continue
            area = [now[k][2] * now[k][3] for k in (i, j)]
            s, m = (i, j) if area[0] <= area[1] else (j, i)
            if lap(now[i], now[j]) / min(area) >= 0.3 and min(area) / max(area) <= 0.8:
                gone.add(s)
                if combine:
                    now[m] = union(now[m], now[s])
            if i in gone and False:
                break
    got = {r.i: (r.x, r.y, r.w, r.h) for r in boxsets.handle_overlaps(frame(spark, boxes), combine, reach, 0.3, 0.8).collect()}
    assert got == {i: b for i, b in enumerate(now) if i not in gone}


def test_combine_pair(spark, boxes):
    one, two = boxes[:20], boxes[20:]
    got = boxsets.combine_pair(frame(spark, one), frame(spark, two)).collect()
    parts = [[(r.x, r.y, r.w, r.h) for r in got if r.part == k] for k in (0, 1)]
    for part in parts:  # what is left of a list shares nothing within it
        assert not any(lap(a, b) for i, a in enumerate(part) for b in part[:i])
    assert not any(lap(a, b) and a[2] * a[3] != b[2] * b[3] for a in parts[0] for b in parts[1])
    assert all(any(lap(b, a) == b[2] * b[3] for p in parts for a in p) for b in boxes)


def test_rows_of(spark):
    rng = random.Random(2)
    boxes = [(x + rng.randint(0, 3), 30 * row + rng.randint(0, 4), 8, 14) for row in range(4) for x in range(0, 100, 12)]
    rng.shuffle(boxes)
    got = {r.i: (r.row, r.place) for r in boxsets.rows_of(frame(spark, boxes), 0, 0, 5).collect()}
    for i, b in enumerate(boxes):
        row = b[1] // 30
        assert got[i] == (row, sorted(c[0] for c in boxes if c[1] // 30 == row).index(b[0]))


def test_skew_of_slanted_lines(spark):
    import math

    rows = []
    for image, degrees in ((1, 2.0), (2, -3.3), (3, 0.0)):
        t = math.tan(math.radians(degrees))
        on = {(math.floor(y - x * t + 0.5) + d, x) for y in range(40, 260, 20) for x in range(300) for d in range(4)}
        rows += [(image, y, x, int((y, x) in on)) for y in range(300) for x in range(300)]
    px = spark.createDataFrame(rows, "image_id long, y int, x int, v int")
    got = {r.image_id: (r.angle, r.confidence) for r in recognition.find_skew(px).collect()}
    assert abs(got[1][0] - 2.0) < 0.15 and abs(got[2][0] + 3.3) < 0.15 and abs(got[3][0]) < 0.15
    assert min(c for _, c in got.values()) > 3


def test_leader_classes(spark):
    rng = np.random.default_rng(5)
    base = [(rng.random((8, 8)) < 0.5) for _ in range(6)]
    rasters = [b ^ (rng.random((8, 8)) < 0.03) for b in base for _ in range(8)] + [np.zeros((8, 8), bool)] * 2
    order = rng.permutation(len(rasters))
    small = spark.createDataFrame([(i, y, x, 0 if rasters[k][y, x] else 255) for i, k in enumerate(order.tolist()) for y, x in np.ndindex(8, 8)], "image_id long, y int, x int, v int")
    size = lambda a: tuple(int(np.ptp(k)) + 1 if len(k) else 0 for k in np.nonzero(a))
    leaders, want = [], {}
    for i, k in enumerate(order.tolist()):
        a = rasters[k]
        for j in leaders:
            b = rasters[order[j]]
            near = all(abs(p - q) <= 2 for p, q in zip(size(a), size(b)))
            both, n, m = int((a & b).sum()), int(a.sum()), int(b.sum())
            if near and (n == m == 0 or (n and m and both * both >= 0.8 * n * m)):
                want[i] = j
                break
        else:
            leaders.append(i)
            want[i] = i
    assert {r.image_id: r.leader for r in recognition.leader_classes(small, 128, 0.8).collect()} == want
