"""Operators that failed on larger tables: results against naive code, and what their plans must not have."""

import numpy as np

from pixelloom.operators import recognition, scaling, sequences


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def raster(spark, *arrays):
    return spark.createDataFrame([(i, y, x, int(a[y, x])) for i, a in enumerate(arrays) for y, x in np.ndindex(*a.shape)], "image_id long, y int, x int, v int")


def test_best_shift_over_cells(spark):
    rng = np.random.default_rng(3)
    pairs = [((rng.random(s) < p).astype(int), (rng.random(s) < p).astype(int)) for s, p in (((9, 150), 0.3), ((8, 8), 0.5), ((3, 64), 0.5), ((2, 65), 0.1))]
    pairs += [(np.roll(a, (1, -3), (0, 1)), a) for a, _ in pairs[:1]] + [(np.ones((4, 4), int), np.zeros((4, 4), int)), (np.eye(3, 130, 64, dtype=int), np.eye(3, 130, 62, dtype=int))]
    for most in (0, 3, 70):
        want = {}
        for i, (a, b) in enumerate(pairs):
            on = {tuple(p) for p in np.argwhere(b)}
            n = {(dy, dx): sum((y - dy, x - dx) in on for y, x in np.argwhere(a)) for dy in range(-min(most, 9), min(most, 9) + 1) for dx in range(-most, most + 1)}
            best = max(n, key=lambda k: (n[k], -k[0], -k[1]))
            if n[best]:
                want[i] = (*best, round(n[best] ** 2 / (int(a.sum()) * int(b.sum())), 6))
        got = recognition.best_shift(*(raster(spark, *t) for t in zip(*pairs)), most)
        assert {r.image_id: (r.dy, r.dx, r.score) for r in got.collect()} == want
        assert "Join" not in plan(got) and "Broadcast" not in plan(got)  # a join on shifted pixels was broadcast, 25 rows a pixel


def array(spark, v):
    return spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)] + [("b", 0, 1.0)], "set_id string, i long, v double")


def test_interpolated(spark):
    v = np.random.default_rng(1).random(1003)
    got = sequences.interpolated(array(spark, v), 5)
    kept = np.arange(0, 1003, 5)
    want = {("a", i): round(float(np.interp(i, kept, v[kept])), 6) for i in range(1003)} | {("b", 0): 1.0}
    assert {(r.set_id, r.i): r.v for r in got.collect()} == want
    assert "unboundedfollowing" not in plan(got)  # such a frame took the square of an array's length


def test_nearest_model(spark):
    v = np.random.default_rng(2).random(700)
    has = np.flatnonzero(v >= 0.95)
    near = [int(has[np.argmin(np.abs(has - i))]) for i in range(700)]
    got = sequences.nearest_model(array(spark, v), 0.95, 8)
    want = {("a", i): k if abs(k - i) <= 8 else None for i, k in enumerate(near)} | {("b", 0): 0}
    assert {(r.set_id, r.i): r.model for r in got.collect()} == want
    assert "unboundedfollowing" not in plan(got)


def scaled_sides(a, sx, sy):
    return max(1, int(a.shape[0] * sy + 0.5)), max(1, int(a.shape[1] * sx + 0.5))


def sources(n, t, k):
    """Of each target the start of its source, in single precision."""
    return [int(np.float32(k * n / t) * np.float32(p)) for p in range(t)]


def check_scaled(spark, operator, naive, cases, rasters):
    for sx, sy in cases:
        got = operator(raster(spark, *rasters), sx, sy)
        # the targets were made from a row a raster, so their pixels looked few and were sent to all tasks
        assert "Generate" not in plan(got).split("Join", 1)[1]
        want = {(i, y, x): v for i, a in enumerate(rasters) for (y, x), v in np.ndenumerate(naive(a, sx, sy))}
        rows = got.collect()
        assert len(rows) == len(want) and {(r.image_id, r.y, r.x): r.v for r in rows} == want


RASTERS = [np.random.default_rng(7).integers(0, 256, s) for s in ((37, 29), (5, 64), (3, 3), (1, 40), (2, 2), (1, 1))]


def test_scale_smooth(spark):
    def naive(a, sx, sy):
        size = max(2, int(1 / min(sx, sy) + 0.5))
        if min(a.shape) < size:
            return a[a.shape[0] // 2, a.shape[1] // 2].reshape(1, 1)
        th, tw = scaled_sides(a, sx, sy)
        ys, xs = ([min(s, n - size) for s in sources(n, t, 1)] for n, t in ((a.shape[0], th), (a.shape[1], tw)))
        return np.array([[a[y : y + size, x : x + size].sum() // size**2 for x in xs] for y in ys])

    check_scaled(spark, scaling.scale_smooth, naive, [(0.4, 0.3), (0.65, 0.65), (0.1, 0.6)], RASTERS)


def test_scale_linear(spark):
    def naive(a, sx, sy):
        out = np.full(scaled_sides(a, sx, sy), 128)
        for (y, py), (x, px) in ((p, q) for p in enumerate(sources(a.shape[0], out.shape[0], 16)) for q in enumerate(sources(a.shape[1], out.shape[1], 16))):
            for j, i in np.ndindex(2, 2):
                out[y, x] += (py % 16 if j else 16 - py % 16) * (px % 16 if i else 16 - px % 16) * a[min(py // 16 + j, a.shape[0] - 1), min(px // 16 + i, a.shape[1] - 1)]
        return out // 256

    check_scaled(spark, scaling.scale_linear, naive, [(1.3, 0.8), (0.75, 3.7), (12.5, 1.0)], RASTERS)


def test_many_leaders():
    """Several blocks, each against all leaders before it: a step of Python for each pair didn't end on larger tables."""
    rng = np.random.default_rng(9)
    bits = (rng.random((5000, 64)) < rng.choice([0.02, 0.1, 0.5], (5000, 1))).astype(np.uint8)
    bits[3000:4000] = bits[:1000] ^ (rng.random((1000, 64)) < 0.03)
    bits[4990:] = 0
    n, w, h = bits.sum(1, dtype=np.int64), rng.integers(6, 10, 5000), rng.integers(7, 9, 5000)
    w[n == 0] = h[n == 0] = 0
    led, want = [], []
    for i in range(5000):
        j = np.array(led, int)
        both = (bits[j] & bits[i]).sum(1, dtype=np.int64)
        ok = (abs(w[j] - w[i]) <= 2) & (abs(h[j] - h[i]) <= 2) & ((n[j] == 0) == (n[i] == 0)) & (both * both >= 0.8 * n[i] * n[j])
        want.append(led[int(ok.argmax())] if ok.any() else i)
        led += [i] if want[-1] == i else []
    assert 2048 < len(led) < 5000
    assert recognition._leaders(bits, n, w, h, 0.8, 2).tolist() == want
