"""Operators without SQL twins against naive code, formats, and invariants."""

import random

import numpy as np
import pytest

from pixelloom.operators import boxes, geometry, neighbourhood, pixels, recognition, regions, sequences
from pixelloom.sources import codecs, images


def table(spark, *arrays):
    return spark.createDataFrame([(i, y, x, int(a[y, x])) for i, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])], "image_id long, y int, x int, v int")


def arrays(df, col="v"):
    out = {}
    for r in df.collect():
        out.setdefault(r.image_id, {})[r.y, r.x] = r[col]
    return [np.array([[out[i].get((y, x), 0) for x in range(max(q for _, q in out[i]) + 1)] for y in range(max(p for p, _ in out[i]) + 1)]) for i in sorted(out)]


@pytest.fixture(scope="module")
def rasters():
    rng = np.random.default_rng(5)
    return [(rng.random((9, 13)) < 0.55).astype(int), (rng.random((12, 7)) < 0.4).astype(int), np.ones((3, 3), int), np.zeros((4, 2), int)]


def flood(a, connectivity):
    label, n = np.zeros(a.shape, int), 0
    near = [(-1, 0), (0, -1), (0, 1), (1, 0)] + ([(-1, -1), (-1, 1), (1, -1), (1, 1)] if connectivity == 8 else [])
    for y, x in np.ndindex(a.shape):
        if a[y, x] and not label[y, x]:
            n += 1
            todo = [(y, x)]
            label[y, x] = n
            while todo:
                p, q = todo.pop()
                for dy, dx in near:
                    r, s = p + dy, q + dx
                    if 0 <= r < a.shape[0] and 0 <= s < a.shape[1] and a[r, s] and not label[r, s]:
                        label[r, s] = n
                        todo.append((r, s))
    return label


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_fill_seed(spark, rasters, connectivity):
    px = table(spark, *rasters)
    got = {(r.image_id, r.y, r.x): r.label for r in regions.label_pixels(px, connectivity).collect()}
    want = {(i, y, x): int(v) for i, a in enumerate(rasters) for (y, x), v in np.ndenumerate(flood(a, connectivity)) if v}
    assert got == want
    for a, filled in zip(rasters, arrays(regions.fill_holes(px, connectivity))):
        back = flood(1 - a, connectivity)
        edge = {*back[0], *back[-1], *back[:, 0], *back[:, -1]} - {0}
        assert (filled == np.where((a == 1) | ~np.isin(back, [0, *edge]), 1, 0)).all()
    big = arrays(regions.select_components(px, 4, connectivity))
    for a, b in zip(rasters, big):
        label = flood(a, connectivity)
        assert (b == (np.bincount(label.ravel())[label] >= 4) * a).all()
    seeds = [a * (np.add.outer(range(a.shape[0]), range(a.shape[1])) % 5 == 0) for a in rasters]
    for a, s, f in zip(rasters, seeds, arrays(regions.seedfill(table(spark, *seeds), px, connectivity))):
        label = flood(a, connectivity)
        assert (f == np.isin(label, label[s == 1]) * a).all()


def test_morphology_invariants(spark, rasters):
    px = table(spark, *rasters)
    src, dil, ero, opened = (arrays(f) for f in (px, neighbourhood.dilate(px, 3, 3), neighbourhood.erode(px, 3, 3), neighbourhood.opened(px, 3, 3)))
    again = arrays(neighbourhood.opened(neighbourhood.opened(px, 3, 3), 3, 3))
    for a, d, e, o, p in zip(src, dil, ero, opened, again):
        assert (e <= a).all() and (a <= d).all() and (o <= a).all() and (o == p).all()
    low, mid, high = (arrays(neighbourhood.rank_filter(px, 3, 5, r)) for r in (0.0, 0.5, 1.0))
    for a, x, y, z in zip(src, low, mid, high):
        b = np.pad(a, ((2, 2), (1, 1)), mode="edge")
        w = np.sort(np.stack([b[j : j + a.shape[0], i : i + a.shape[1]] for j in range(5) for i in range(3)]), axis=0)
        assert (x == w[0]).all() and (y == w[7]).all() and (z == w[14]).all()


def test_sequence_language():
    assert neighbourhood.parse_sequence("D3.5 + e1.2+r12 + x4") == [("d", 3, 5), ("e", 1, 2), ("r", 1, 0), ("r", 2, 0), ("x", 4, 0)]
    for bad in ("", "d3", "b2", "x3", "o0.1", "d3.3 ++ e3.3"):
        with pytest.raises(ValueError):
            neighbourhood.parse_sequence(bad)


def test_geometry_round_trips(spark, rasters):
    px = table(spark, *rasters)
    same = sorted(px.collect())
    four = px
    for _ in range(4):
        four = geometry.turn(four, 1)
    assert sorted(four.select(px.columns).collect()) == same
    assert sorted(geometry.flip(geometry.flip(px, "x"), "x").select(px.columns).collect()) == same
    for a, b in zip(rasters, arrays(geometry.mirrored_border(px, 2))):
        assert (b == np.pad(a, 2, mode="symmetric")).all()


def test_pixels_reject_bad_parameters(spark, rasters):
    px = table(spark, *rasters)
    with pytest.raises(ValueError):
        pixels.multiply_constant(px, -1)
    with pytest.raises(ValueError):
        pixels.nearest_colour(px, [(0, 0, 0)] * 257)


def test_rank_rule(spark):
    na = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 10.0, 3.0, 2.0])], "set_id string, i long, v double")
    assert sequences.rank_value(na, 0.5).first().rank_value == 3.0
    assert sequences.mode(spark.createDataFrame([("a", 0, 2.0), ("a", 1, 5.0)], na.schema)).first().mode == 5.0


def test_box_overlaps_against_pairs(spark):
    rng = random.Random(4)
    rows = [(k % 3, k, rng.randrange(200), rng.randrange(200), rng.randrange(0, 150), rng.randrange(0, 90)) for k in range(90)]
    got = {(r.set_id, r.i, r.j): r.area for r in boxes.overlaps(spark.createDataFrame(rows, "set_id long, i long, x int, y int, w int, h int"), 32).collect()}
    want = {}
    for s, i, x, y, w, h in rows:
        for t, j, p, q, u, v in rows:
            a, b = min(x + w, p + u) - max(x, p), min(y + h, q + v) - max(y, q)
            if s == t and i < j and min(w, h, u, v) > 0 and a > 0 and b > 0:
                want[s, i, j] = a * b
    assert got == want


def test_box_lists(spark, tmp_path):
    rows = [(0, 0, 5, -6, 7, 8), (0, 1, 0, 0, 0, 0)]
    lines = images.box_lines(spark.createDataFrame(rows, "set_id long, i long, x int, y int, w int, h int")).orderBy("i").collect()
    assert lines[0].line == "\nBoxa Version 2\nNumber of boxes = 2"
    (tmp_path / "a.ba").write_text("\n".join(r.line for r in lines) + "\n")
    got = images.read_boxes(spark, str(tmp_path / "a.ba")).orderBy("i").collect()
    assert [(r.i, r.x, r.y, r.w, r.h) for r in got] == [x[1:] for x in rows]


@pytest.mark.parametrize("kind", ["pnm", "bmp", "png", "spix", "tiff"])
@pytest.mark.parametrize("depth", [1, 4, 8, 16])
def test_formats_gray(kind, depth):
    a = np.random.default_rng(depth).integers(0, 1 << depth, (5, 13))
    data = codecs.WRITERS[kind](a, depth)
    assert codecs.sniff(data) == kind
    if (kind, depth) == ("bmp", 16):
        a = a >> 8
    assert (codecs.read(data)[0] == a).all()


@pytest.mark.parametrize("kind", ["pnm", "bmp", "png", "spix", "tiff"])
def test_formats_colour(kind):
    a = np.random.default_rng(1).integers(0, 256, (6, 7, 3))
    assert (codecs.read(codecs.WRITERS[kind](a, 8))[0][:, :, :3] == a).all()


def test_pnm_text_comments_and_pam():
    assert codecs.read(b"P1\n# note\n3 2\n1 0 1\n011\n")[0].tolist() == [[1, 0, 1], [0, 1, 1]]
    assert codecs.read(b"P2 2 1 # x\n15\n3 12\n") [1] == 4
    a = np.arange(24).reshape(2, 3, 4)
    assert (codecs.read(codecs.write_pnm(a, 8))[0] == a).all()
    assert (codecs.read(codecs.write_pnm(a[:, :, 0], 8, text=True))[0] == a[:, :, 0]).all()
    assert codecs.sniff(b"GIF89a") == "gif" and codecs.sniff(b"RIFF....WEBP") == "webp" and codecs.sniff(b"") == "unknown"
    with pytest.raises(ValueError):
        codecs.read(b"\xff\xd8\xff")
    assert codecs._packbits(bytes([2, 1, 2, 3, 254, 9, 128])) == bytes([1, 2, 3, 9, 9, 9])
    assert max(map(len, codecs.base64_lines(bytes(100)).split("\n"))) == 72


def test_scan_files(spark, tmp_path):
    a = np.arange(12).reshape(3, 4)
    for k in ("png", "bmp"):
        (tmp_path / f"a.{k}").write_bytes(codecs.WRITERS[k](a, 8))
    files = images.scan(spark, str(tmp_path))
    assert {r.format for r in files.collect()} == {"png", "bmp"}
    assert {(r.width, r.height, r.depth) for r in images.headers(files).collect()} == {(4, 3, 8)}


def test_leaders(spark):
    rng = np.random.default_rng(7)
    base = [(rng.random((8, 8)) < 0.5).astype(int) for _ in range(3)]
    px = table(spark, *[b * 255 for b in base for _ in range(4)])
    got = {r.image_id: r.leader for r in recognition.leader_classes(px, 128, 0.9).collect()}
    assert got == {i: i // 4 * 4 for i in range(12)}


def test_combined_boxes_share_no_area(spark):
    rng = random.Random(11)
    rows = [(k % 2, k, rng.randrange(300), rng.randrange(300), rng.randrange(1, 60), rng.randrange(1, 60)) for k in range(120)]
    out = boxes.combined(spark.createDataFrame(rows, "set_id long, i long, x int, y int, w int, h int"))
    assert boxes.overlaps(out).count() == 0
    want = {}
    for s in (0, 1):
        group = [(x, y, x + w, y + h) for t, _, x, y, w, h in rows if t == s]
        done = False
        while not done:
            done = True
            for a in range(len(group)):
                for b in range(a):
                    p, q = group[a], group[b]
                    if min(p[2], q[2]) > max(p[0], q[0]) and min(p[3], q[3]) > max(p[1], q[1]):
                        group[b] = (min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3]))
                        del group[a]
                        done = False
                        break
                if not done:
                    break
        want[s] = sorted(group)
    got = {s: sorted((r.x, r.y, r.x + r.w, r.y + r.h) for r in out.collect() if r.set_id == s) for s in (0, 1)}
    assert got == want


def test_median_cut_covers_all_pixels(spark):
    from pixelloom.operators import enhance

    rng = np.random.default_rng(3)
    rgb = spark.createDataFrame([(0, 0, x, *map(int, rng.integers(0, 256, 3))) for x in range(400)], "image_id long, y int, x int, r int, g int, b int")
    got = enhance.median_cut(rgb, 8).collect()
    assert len(got) == 8 and sum(r.n for r in got) == 400 and max(r.n for r in got) < 100


def test_streaming_histogram_equals_batch(spark, tmp_path):
    from pixelloom.operators import aggregates
    from pixelloom.sources import derived
    from pixelloom.streaming import rasters

    sf = "/root/testdata/sf0.001"
    spark.read.parquet(f"{sf}/events.parquet").repartition(2).write.parquet(f"{tmp_path}/events")
    q = rasters.histogram_stream(spark, f"{tmp_path}/events").writeStream.outputMode("complete").format("memory").queryName("hist_stream").start()
    q.processAllAvailable()
    q.stop()
    batch = {r.v: r.n for r in aggregates.histogram(derived.gray(spark, sf)).collect() if r.n}
    assert {r.v: r.n for r in spark.table("hist_stream").collect()} == batch


@pytest.mark.parametrize("depth", [1, 4, 8])
def test_gif(depth):
    rng = np.random.default_rng(depth)
    for a in (rng.integers(0, 1 << depth, (70, 90)), np.zeros((40, 300), int), rng.integers(0, 1 << depth, (1, 1)), np.arange(9000).reshape(90, 100) // 40 % (1 << depth)):
        data = codecs.write_gif(a, depth)
        assert codecs.sniff(data) == "gif" and (codecs.read(data)[0] == a).all()
    c = rng.integers(0, 4, (20, 20, 3)) * 60
    assert (codecs.read(codecs.write_gif(c, 8))[0] == c).all()


def test_tiff_lzw_stream():
    # the example of the format's specification: clear, 7, 258, 8, 8, 258, 6, 6, end in codes of 9 bits
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    data = bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))
    assert codecs.lzw_decode(data) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_cubic_fit(spark):
    from pyspark.sql import functions as F

    from pixelloom.operators import points

    pt = spark.range(50).select(F.lit("a").alias("set_id"), F.col("id").cast("double").alias("x"), (0.5 * F.pow("id", F.lit(3.0)) - 2 * F.pow("id", F.lit(2.0)) + 7).alias("y"))
    r = points.cubic_fit(pt).first()
    assert (r.a, r.b) == (0.5, round(3 * 0.5 * 24.5 - 2, 2))


def test_hsv_round_trip(spark):
    from pyspark.sql import functions as F

    from pixelloom.functions import colour

    rng = np.random.default_rng(6)
    rgb = spark.createDataFrame([(0, 0, x, *map(int, c)) for x, c in enumerate(rng.integers(0, 256, (300, 3)))], "image_id long, y int, x int, r int, g int, b int")
    back = pixels.hsv(rgb).select("image_id", "y", "x", *(e.alias(n) for n, e in zip("pqs", colour.hsv_to_rgb(F.col("h"), F.col("s"), F.col("val")))))
    far = rgb.join(back, ["image_id", "y", "x"]).select(F.max(F.greatest(F.abs(F.col("r") - F.col("p")), F.abs(F.col("g") - F.col("q")), F.abs(F.col("b") - F.col("s"))))).first()[0]
    assert far <= 6
