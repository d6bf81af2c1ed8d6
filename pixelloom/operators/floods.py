"""Operators whose steps depend on one another: floods, distances, mazes, dithering, thinning.

An image is in one task. Images of one size are worked on together, as a stack of arrays, and pixels that do not depend on
one another (a front of the scan) in one step, so the cost per pixel is that of array code.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Rows that are collected before a stack is worked on.
STACK_ROWS = 1 << 18
FOUR = ((-1, 0), (0, -1), (0, 1), (1, 0))
EIGHT = (*FOUR, (-1, -1), (-1, 1), (1, -1), (1, 1))
#: Dithering passes nothing on within this of black and white, and 3/8, 3/8 and 1/4 of the error beyond;
#: distances stop at 254 (8 bits) and 65534 (16 bits), a frame that counts as foreground starts at 255 and 65535.
CLIP, FAR, FRAME = 10, {8: 254, 16: 65534}, {8: 255, 16: 65535}
#: The hit-miss patterns of thinning, row by row ('x' foreground, 'o' background, 'C' the pixel, foreground).
PATTERNS = {
    "4_1": "  x/oCx/  x", "4_2": "  x/oCx/ o ", "4_3": " o /oCx/  x", "4_5": " ox/oCx/ o ", "4_6": " o /oCx/ ox",
    "8_2": " x /oCx/o  ", "8_3": "o  /oCx/ x ", "8_5": "o x/oCx/o  ", "8_6": "o  /oCx/o x",
}
THINNING = {4: ("4_1", "4_2", "4_3"), 8: ("8_2", "8_3", "8_5", "8_6")}


def per_image(px: DataFrame, work: Callable[..., np.ndarray], values: tuple[str, ...] = ("v",), kind: str = "int") -> DataFrame:
    """work on the rasters of px, given as stacks [image, y, x] of each of `values`; it returns the stack of the result."""

    def stacked(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ids, which = np.unique(pdf.image_id.to_numpy(), return_inverse=True)
        y, x = pdf.y.to_numpy(), pdf.x.to_numpy()
        h, w = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        np.maximum.at(h, which, y + 1)
        np.maximum.at(w, which, x + 1)
        for size in sorted({*zip(h.tolist(), w.tolist(), strict=True)}):
            mine = np.flatnonzero((h == size[0]) & (w == size[1]))
            place = np.full(len(ids), -1)
            place[mine] = np.arange(len(mine))
            on = place[which] >= 0
            stacks = []
            for c in values:
                a = np.zeros((len(mine), *size), np.int64)
                a[place[which[on]], y[on], x[on]] = pdf[c].to_numpy()[on]
                stacks.append(a)
            out = work(*stacks)
            k, p, q = (i.ravel() for i in np.indices(out.shape))
            yield pd.DataFrame({"image_id": ids[mine][k], "y": p.astype(np.int32), "x": q.astype(np.int32), "v": out.ravel()})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) >= STACK_ROWS:
                whole = pd.concat(held, ignore_index=True)
                ends = whole.image_id.to_numpy() == whole.image_id.iloc[-1]  # the last image may go on
                if not ends.all():
                    yield from stacked(whole[~ends])
                held = [whole[ends]]
        if held and sum(map(len, held)):
            yield from stacked(pd.concat(held, ignore_index=True))

    dealt = px.select("image_id", "y", "x", *values).repartition("image_id").sortWithinPartitions("image_id")
    return dealt.mapInPandas(rows, f"image_id long, y int, x int, v {kind}")


def _fronts(h: int, w: int, slope: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pixels by x + slope * y: in a raster scan none of a front depends on another of it (slope 2: with diagonals)."""
    y, x = np.divmod(np.arange(h * w), w)
    at = x + slope * y
    order = np.argsort(at, kind="stable")
    cuts = np.flatnonzero(np.diff(at[order])) + 1
    return [(y[p], x[p]) for p in np.split(order, cuts)]


def _around(a: np.ndarray, near: tuple, fill: int) -> list[np.ndarray]:
    """The neighbours' values of every pixel."""
    p = np.pad(a, ((0, 0), (1, 1), (1, 1)), constant_values=fill)
    h, w = a.shape[1:]
    return [p[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in near]


def _near(connectivity: int) -> tuple:
    return FOUR if connectivity == 4 else EIGHT


def _distance(a: np.ndarray, connectivity: int, frame: bool, bits: int) -> np.ndarray:
    far, ring = FAR[bits], FRAME[bits]
    d = (a != 0).astype(np.int64)
    h, w = a.shape[1:]
    if frame:
        d[:, [0, -1], :] = d[:, :, [0, -1]] = ring
    if h > 2 and w > 2:
        before = [o for o in _near(connectivity) if o < (0, 0)]
        fronts = _fronts(h - 2, w - 2, 2)
        for y, x in fronts:
            y, x = y + 1, x + 1
            least = np.minimum.reduce([d[:, y + dy, x + dx] for dy, dx in before])
            d[:, y, x] = np.where(d[:, y, x] > 0, np.minimum(least, far) + 1, 0)
        for y, x in reversed(fronts):
            y, x = y + 1, x + 1
            least = np.minimum.reduce([d[:, y - dy, x - dx] for dy, dx in before])
            d[:, y, x] = np.where(d[:, y, x] > 0, np.minimum(least + 1, d[:, y, x]), 0)
        if frame:
            d[:, 1:-1, 0], d[:, 1:-1, -1] = d[:, 1:-1, 1], d[:, 1:-1, -2]
            d[:, 0, :], d[:, -1, :] = d[:, 1, :], d[:, -2, :]
    return d


def distance(px: DataFrame, connectivity: int = 4, frame: bool = False, bits: int = 8) -> DataFrame:
    """Distance of the foreground's pixels to the background by steps of the connectivity.

    The outermost pixels keep 1 and 0. frame: what is outside counts as foreground, and the outermost pixels repeat their
    inner neighbours.
    """
    return per_image(px, lambda a: _distance(a, connectivity, frame, bits))


def _spread(a: np.ndarray, connectivity: int) -> np.ndarray:
    """Two scans; each pixel takes the value of the neighbour by which it is nearest to a seed."""
    border, most = 4, 0xFFFF
    v = np.pad(a, ((0, 0), (border, border), (border, border)))
    d = np.full(v.shape, most)
    d[:, border:-border, border:-border] = a == 0
    h, w = v.shape[1:]
    # of equal neighbours: left before up (4), the first in raster order (8); on the way back down before right (4), and
    # right, lower left, down, lower right (8)
    ahead = [(0, -1), (-1, 0)] if connectivity == 4 else [(-1, -1), (-1, 0), (-1, 1), (0, -1)]
    back = [(1, 0), (0, 1)] if connectivity == 4 else [(0, 1), (1, -1), (1, 0), (1, 1)]
    slope = 1 if connectivity == 4 else 2

    def pick(offsets: list, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.stack([d[:, y + dy, x + dx] for dy, dx in offsets])
        value = np.stack([v[:, y + dy, x + dx] for dy, dx in offsets])
        best = near.argmin(axis=0)[None]
        return np.take_along_axis(near, best, 0)[0], np.take_along_axis(value, best, 0)[0]

    # a lower edge has rows to its front only; its pixels stay out of the picture
    fronts = [(y + 1, x + 1) for y, x in _fronts(h - 2, w - 2, slope)]
    for y, x in fronts:
        least, value = pick(ahead, y, x)
        on = d[:, y, x] > 0
        d[:, y, x] = np.where(on, np.minimum(least, most - 1) + 1, 0)
        v[:, y, x] = np.where(on, value, v[:, y, x])
    for y, x in reversed(fronts):
        least, value = pick(back, y, x)
        on = (d[:, y, x] > 0) & (least + 1 < d[:, y, x])
        v[:, y, x] = np.where(on, value, v[:, y, x])
        d[:, y, x] = np.where(on, least + 1, d[:, y, x])
    return v[:, border:-border, border:-border]


def spread_seeds(px: DataFrame, connectivity: int = 4) -> DataFrame:
    """Every pixel of 0 takes the value of the nearest pixel that is not (Voronoi tesselation by two scans)."""
    return per_image(px, lambda a: _spread(a, connectivity))


def _settle(start: np.ndarray, step: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    while True:
        after = step(start)
        if (after == start).all():
            return after
        start = after


def fill_gray(both: DataFrame, connectivity: int = 4) -> DataFrame:
    """Reconstruction: the seed `v` grows under the mask `m` until nothing changes."""
    near = _near(connectivity)
    return per_image(both, lambda v, m: _settle(np.minimum(v, m), lambda c: np.minimum(m, np.maximum.reduce([c, *_around(c, near, 0)]))), ("v", "m"))


def fill_basins(both: DataFrame, connectivity: int = 4) -> DataFrame:
    """Inverse reconstruction: the seed `v` sinks onto the mask `m` until nothing changes."""
    near = _near(connectivity)
    top = 1 << 40
    return per_image(both, lambda v, m: _settle(np.maximum(v, m), lambda c: np.maximum(m, np.minimum.reduce([c, *_around(c, near, top)]))), ("v", "m"))


def maze_costs(px: DataFrame) -> DataFrame:
    """The least sum of pixel values on a 4-connected path from the top left pixel, both ends counting."""
    far = 1 << 40

    def work(a: np.ndarray) -> np.ndarray:
        start = np.full(a.shape, far)
        start[:, 0, 0] = a[:, 0, 0]
        return _settle(start, lambda c: np.minimum(c, a + np.minimum.reduce(_around(c, FOUR, far))))

    return per_image(px, work, kind="long")


def maze_steps(px: DataFrame) -> DataFrame:
    """Steps of the shortest 4-connected path through 0 from the top left pixel; -1 for walls and what can't be reached."""
    far = 1 << 40

    def work(a: np.ndarray) -> np.ndarray:
        start = np.full(a.shape, far)
        start[:, 0, 0] = np.where(a[:, 0, 0] == 0, 0, far)
        got = _settle(start, lambda c: np.where(a == 0, np.minimum(c, 1 + np.minimum.reduce(_around(c, FOUR, far))), far))
        return np.where(got >= far, -1, got)

    return per_image(px, work)


def _dither(a: np.ndarray, threshold: int) -> np.ndarray:
    b = np.pad(a, ((0, 0), (0, 1), (0, 1)))
    out = np.zeros_like(a)
    for y, x in _fronts(*a.shape[1:], 1):
        v = b[:, y, x]
        on = v < threshold
        out[:, y, x] = on
        error = np.where(on, v, 255 - v)
        error = np.where(error > CLIP, error, 0) * 1
        sign = np.where(on, 1, -1)
        # a pixel gets from the upper left, then from above, then from the left, and is clamped each time
        for dy, dx, part in ((1, 0, 3 * error // 8), (0, 1, 3 * error // 8), (1, 1, error // 4)):
            b[:, y + dy, x + dx] = np.clip(b[:, y + dy, x + dx] + sign * part, 0, 255)
    return out


def dither(px: DataFrame, threshold: int = 128) -> DataFrame:
    """Error diffusion to 1 (dark) and 0; pixels that have become near-black or near-white pass nothing on."""
    return per_image(px, lambda a: _dither(a, threshold))


def _hit_miss(a: np.ndarray, pattern: list[str]) -> np.ndarray:
    p = np.pad(a, ((0, 0), (1, 1), (1, 1)))
    h, w = a.shape[1:]
    out = np.ones_like(a)
    for dy, row in enumerate(pattern):
        for dx, c in enumerate(row):
            if c != " ":
                out &= p[:, dy : dy + h, dx : dx + w] ^ (c == "o")
    return out


def _thin(a: np.ndarray, connectivity: int, rounds: int) -> np.ndarray:
    a = a != 0
    turns = []
    for quarter in range(4):
        turns.append([["".join(r) for r in np.rot90(np.array([[*row] for row in PATTERNS[k].split("/")]), -quarter)] for k in THINNING[connectivity]])
    for _ in range(rounds):
        before = a
        for patterns in turns:
            a = a & ~np.logical_or.reduce([_hit_miss(a, p) for p in patterns])
        if (a == before).all():
            break
    return a.astype(np.int64)


def thin(px: DataFrame, connectivity: int = 8, rounds: int = 10000) -> DataFrame:
    """Foreground thinned by the hit-miss patterns of the connectivity in four turns a round, until nothing changes."""
    return per_image(px, lambda a: _thin(a, connectivity, rounds))


def _minima(a: np.ndarray, near: tuple) -> np.ndarray:
    """No neighbour is lower, and one is higher."""
    top = 1 << 40
    low = np.minimum.reduce(_around(a, near, top))
    high = np.maximum.reduce(_around(a, near, -1))
    alone = a.shape[1] == a.shape[2] == 1
    return (a <= low) & ((a < high) | alone)


def local_minima(px: DataFrame, connectivity: int = 8) -> DataFrame:
    """1 where no neighbour is lower and one is higher."""
    return per_image(px, lambda a: _minima(a, _near(connectivity)).astype(np.int64))


def local_maxima(px: DataFrame, connectivity: int = 8) -> DataFrame:
    """1 where no neighbour is higher and one is lower."""
    return per_image(px, lambda a: _minima(255 - a, _near(connectivity)).astype(np.int64))


def _watershed(a: np.ndarray, near: tuple) -> np.ndarray:
    h, w = a.shape
    label = np.zeros((h, w), np.int64)
    heap = []
    for k, (y, x) in enumerate(np.argwhere(_minima(a[None], near)[0]).tolist()):
        label[y, x] = k + 1
        heap.append((int(a[y, x]), k, y, x))
    n = len(heap)
    heapq.heapify(heap)
    while heap:
        _, _, y, x = heapq.heappop(heap)
        for dy, dx in near:
            r, s = y + dy, x + dx
            if 0 <= r < h and 0 <= s < w and not label[r, s]:
                label[r, s] = label[y, x]
                n += 1
                heapq.heappush(heap, (int(a[r, s]), n, r, s))
    edge = np.logical_or.reduce([(o != label[None]) & (o > 0) for o in _around(label[None], near, 0)])[0]
    return np.where(edge, 0, label)


def watershed(px: DataFrame, connectivity: int = 8) -> DataFrame:
    """Basins by flooding from the local minima, lowest pixels first and of equal ones the earlier reached.

    Basins count from 1 in raster order of their minima; a pixel beside another basin is 0.
    """
    return per_image(px, lambda a: np.stack([_watershed(x, _near(connectivity)) for x in a]))
