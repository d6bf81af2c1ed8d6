"""Floods, distances, dithering and thinning against plain code, pixel by pixel."""

import heapq

import numpy as np
import pytest
from test_operators import arrays, flood, table

from pixelloom.operators import floods

FOUR = [(-1, 0), (0, -1), (0, 1), (1, 0)]
EIGHT = FOUR + [(-1, -1), (-1, 1), (1, -1), (1, 1)]


@pytest.fixture(scope="module")
def grays():
    rng = np.random.default_rng(2)
    return [rng.integers(0, 256, (11, 9)), rng.integers(0, 4, (7, 12)) * 60, rng.integers(0, 256, (11, 9)), np.full((5, 5), 64)]


@pytest.fixture(scope="module")
def binaries():
    rng = np.random.default_rng(7)
    return [(rng.random((10, 10)) < 0.6).astype(int), (rng.random((13, 8)) < 0.8).astype(int), np.ones((7, 7), int), np.zeros((3, 4), int), np.ones((2, 5), int)]


def around(a, y, x, near):
    return [(y + dy, x + dx) for dy, dx in near if 0 <= y + dy < a.shape[0] and 0 <= x + dx < a.shape[1]]


def test_maze_costs(spark, grays):
    for gray, cost in zip(grays, arrays(floods.maze_costs(table(spark, *grays)))):
        best = {(0, 0): int(gray[0, 0])}
        heap = [(best[0, 0], 0, 0)]
        while heap:
            c, y, x = heapq.heappop(heap)
            for r, s in around(gray, y, x, FOUR):
                if c + gray[r, s] < best.get((r, s), 1 << 40):
                    best[r, s] = c + int(gray[r, s])
                    heapq.heappush(heap, (best[r, s], r, s))
        assert all(cost[k] == v for k, v in best.items()) and len(best) == cost.size


@pytest.mark.parametrize("near", [FOUR, EIGHT])
def test_watershed(spark, grays, near):
    for gray, got in zip(grays, arrays(floods.watershed(table(spark, *grays), len(near)))):
        label, heap, n = {}, [], 0
        for y, x in np.ndindex(gray.shape):
            v = [gray[k] for k in around(gray, y, x, near)]
            if gray[y, x] <= min(v) and gray[y, x] < max(v):
                n += 1
                label[y, x] = n
                heapq.heappush(heap, (gray[y, x], n, y, x))
        order = n
        while heap:
            _, _, y, x = heapq.heappop(heap)
            for k in around(gray, y, x, near):
                if k not in label:
                    label[k] = label[y, x]
                    order += 1
                    heapq.heappush(heap, (gray[k], order, *k))
        for y, x in np.ndindex(gray.shape):
            mine = label.get((y, x), 0)
            other = any(label.get(k, mine) != mine for k in around(gray, y, x, near))
            assert got[y, x] == (0 if other else mine)


@pytest.mark.parametrize("near,frame,bits", [(FOUR, False, 8), (EIGHT, False, 8), (FOUR, True, 8), (EIGHT, True, 16)])
def test_distance(spark, binaries, near, frame, bits):
    ring = 255 if bits == 8 else 65535
    for a, got in zip(binaries, arrays(floods.distance(table(spark, *binaries), len(near), frame, bits))):
        h, w = a.shape
        d = {(y, x): int(a[y, x]) for y, x in np.ndindex(h, w)}
        inner = [(y, x) for y, x in d if 0 < y < h - 1 and 0 < x < w - 1]
        if frame:
            d.update({k: ring for k in d if k not in inner})
        d.update({k: ring for k in inner if a[k]})
        for _ in range(h * w):
            d.update({k: min(d[k], min(d[n] for n in around(a, *k, near)) + 1) for k in inner if a[k]})
        if frame and h > 2 and w > 2:
            d = {(y, x): d[min(max(y, 1), h - 2), min(max(x, 1), w - 2)] for y, x in d}
        assert all(got[k] == v for k, v in d.items())


def test_dither(spark, grays):
    for gray, got in zip(grays, arrays(floods.dither(table(spark, *grays)))):
        v = gray.astype(int).copy()
        h, w = v.shape
        for y, x in np.ndindex(h, w):
            on = v[y, x] < 128
            assert got[y, x] == on
            e = v[y, x] if on else 255 - v[y, x]
            if e > 10:
                for dy, dx, part in ((0, 1, 3 * e // 8), (1, 0, 3 * e // 8), (1, 1, e // 4)):
                    if y + dy < h and x + dx < w:
                        v[y + dy, x + dx] = min(255, max(0, v[y + dy, x + dx] + (part if on else -part)))


@pytest.mark.parametrize("connectivity", [4, 8])
def test_thin(spark, binaries, connectivity):
    for a, got in zip(binaries, arrays(floods.thin(table(spark, *binaries), connectivity))):
        now = {k for k in np.ndindex(a.shape) if a[k]}
        while True:
            before = set(now)
            for quarter in range(4):
                gone = set()
                for name in floods.THINNING[connectivity]:
                    grid = np.rot90([[*row] for row in floods.PATTERNS[name].split("/")], -quarter)
                    want = [(dy - 1, dx - 1, c != "o") for dy, row in enumerate(grid) for dx, c in enumerate(row) if c != " "]
                    gone |= {(y, x) for y, x in now if all(((y + dy, x + dx) in now) == on for dy, dx, on in want)}
                now -= gone
            if now == before:
                break
        assert {k for k in np.ndindex(a.shape) if got[k]} == now
        assert flood(got, connectivity).max() == flood(a, connectivity).max()


@pytest.mark.parametrize("near", [FOUR, EIGHT])
def test_fills(spark, grays, near):
    rows = [(i, y, x, int(a[y, x]) // 2 * ((y + x) % 3 == 0), int(a[y, x])) for i, a in enumerate(grays) for y, x in np.ndindex(a.shape)]
    both = spark.createDataFrame(rows, "image_id long, y int, x int, v int, m int")
    for a, up in zip(grays, arrays(floods.fill_gray(both, len(near)))):
        v = {(y, x): int(a[y, x]) // 2 * ((y + x) % 3 == 0) for y, x in np.ndindex(a.shape)}
        for _ in range(a.size):
            after = {k: min(int(a[k]), max(v[k], *(v[n] for n in around(a, *k, near)))) for k in v}
            if after == v:
                break
            v = after
        assert all(up[k] == x for k, x in v.items())


def test_stacks_are_cut_between_images(spark, monkeypatch):
    rng = np.random.default_rng(1)
    many = [rng.integers(0, 9, (3, 3)) for _ in range(40)]
    monkeypatch.setattr(floods, "STACK_ROWS", 20)
    got = arrays(floods.per_image(table(spark, *many), lambda a: a + 1))
    assert all((g == a + 1).all() for g, a in zip(got, many))
