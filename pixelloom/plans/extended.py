"""More registered queries: depths, masks and regions, borders, lists, histograms, boxes, scaling, colours and floods."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions.encoding import base64_lines as B64
from pixelloom.operators import boxsets as X
from pixelloom.operators import colours as K
from pixelloom.operators import depths as Q
from pixelloom.operators import floods as C
from pixelloom.operators import lists as L
from pixelloom.operators import masks as M
from pixelloom.operators import neighbourhood as N
from pixelloom.operators import pixels as P
from pixelloom.operators import points as T
from pixelloom.operators import recognition as R
from pixelloom.operators import regions as Y
from pixelloom.operators import scaling as S
from pixelloom.sources import derived as D
from pixelloom.sources import images as I

Query = Callable[[SparkSession, str], DataFrame]
g, g2, b1, rgb, sm, na, bx = D.gray, D.second, D.binary, D.colour, D.small, D.numa, D.boxes
V = "SELECT image_id, y, x, {} AS v FROM {}"


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arrays with whole numbers."""
    return na(spark, sf_dir).withColumn("v", F.floor("v").cast("double"))


def _opaque(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = rgb(spark, sf_dir)
    return c.withColumn("a", (F.col("r") + F.col("g")) % 256)


def small_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.threshold(sm(spark, sf_dir).drop("label"), 128)


def small_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small rasters as masks (m) and their bright spots as seeds (v)."""
    s = sm(spark, sf_dir)
    return s.select("image_id", "y", "x", F.col("v").alias("m"), F.when(F.col("v") >= 170, F.col("v") - 20).otherwise(0).alias("v"))


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small rasters with 0 but for a few seeds."""
    s = sm(spark, sf_dir).drop("label")
    return s.withColumn("v", F.when((F.col("v") * 7 + F.col("x") * 3 + F.col("y")) % 11 == 0, F.col("v")).otherwise(0))


QUERIES: dict[str, Query] = {
    # depths
    "depth_unpack_binary": lambda s, d: Q.unpacked(b1(s, d), 255, 0),
    "depth_2_to_8": lambda s, d: Q.looked_up(Q.top_bits(g(s, d), 2), [0, 90, 160, 255]),
    "depth_4_to_8": lambda s, d: Q.widened(Q.top_bits(g(s, d), 4), 4),
    "depth_8_to_16": lambda s, d: Q.to_16(g(s, d), 8),
    "depth_16_low_byte": lambda s, d: Q.from_16(Q.to_16(g(s, d), 3), "low"),
    "depth_16_clipped": lambda s, d: Q.from_16(Q.to_16(g(s, d), 1), "clip"),
    "depth_16_auto": lambda s, d: Q.from_16(Q.to_16(g(s, d), 4), "auto"),
    "depth_32_words": lambda s, d: Q.words(rgb(s, d)),
    "depth_32_to_16": lambda s, d: Q.from_32(Q.words(rgb(s, d)), "clip"),
    "levels_numbered": lambda s, d: Q.levels(g(s, d), 5, False),
    "levels_spread": lambda s, d: Q.levels(g(s, d), 7, True),
    "remove_alpha": lambda s, d: Q.over_white(_opaque(s, d)),
    "alpha_over_colour": lambda s, d: Q.over_colour(_opaque(s, d), (20, 200, 90)),
    "subpixel_rgb": lambda s, d: Q.subpixels(g(s, d), 2, True),
    "sample_by_factor": lambda s, d: Q.every(g(s, d), 3),
    "rgb_to_gray_min_boost": lambda s, d: Q.boosted(rgb(s, d), False),
    "rgb_to_gray_max_boost": lambda s, d: Q.boosted(rgb(s, d), True),
    "rgb_to_gray_saturation_boost": lambda s, d: Q.saturation_boosted(rgb(s, d), 170),
    # masks, regions, blends
    "set_rectangle": lambda s, d: M.set_rectangle(g(s, d), 10, 5, 30, 40, 255),
    "mask_of_value": lambda s, d: M.mask_of_value(g(s, d), 17),
    "mask_of_band": lambda s, d: M.mask_of_band(g(s, d), 40, 90),
    "mask_of_table": lambda s, d: M.mask_of_table(g(s, d), [int(v % 3 == 1) for v in range(256)]),
    "paint_through_mask": lambda s, d: M.paint_through(g(s, d), b1(s, d), 4, -2, 200),
    "blend_gray": lambda s, d: M.blend_gray(g(s, d), g2(s, d), 7, 3, 0.25),
    "blend_gray_inverse": lambda s, d: M.blend_gray(g(s, d), g2(s, d), 0, 0, 0.5, True),
    "blend_mask_inverse": lambda s, d: M.blend_mask(g(s, d), b1(s, d), 1, 1, 0.5, "inverse"),
    "blend_mask_white": lambda s, d: M.blend_mask(g(s, d), b1(s, d), 0, 0, 0.25, "white"),
    "histogram_in_rectangle": lambda s, d: M.histogram_in(g(s, d), 10, 5, 30, 40),
    "histogram_masked": lambda s, d: M.histogram_masked(g(s, d), b1(s, d), 2, 1),
    "histogram_tiled": lambda s, d: M.histogram_tiled(g(s, d), 3, 2),
    "colour_histogram": lambda s, d: M.colour_histogram(rgb(s, d)),
    "rank_masked": lambda s, d: M.rank_masked(g2(s, d), b1(s, d), 0, 0, 0.3),
    "row_stats": lambda s, d: M.line_stats(g(s, d), "y"),
    "column_stats": lambda s, d: M.line_stats(g(s, d), "x"),
    "row_differences": lambda s, d: M.line_differences(g(s, d), "y"),
    "rank_rows": lambda s, d: M.sorted_lines(g(s, d), "y"),
    "rank_columns": lambda s, d: M.sorted_lines(g(s, d), "x"),
    "count_in_rectangle": lambda s, d: M.count_in(g(s, d), 10, 5, 30, 40),
    "border_repeated": lambda s, d: M.bordered(g(s, d), 3, 2, 1, 4, "repeated", "repeated"),
    "border_continued": lambda s, d: M.bordered(g(s, d), 3, 2, 1, 4, "continued", "continued"),
    "border_mixed": lambda s, d: M.bordered(g(s, d), 3, 2, 1, 4, "mirrored", "repeated"),
    "border_constant": lambda s, d: M.framed(g(s, d), 3, 2, 1, 4, 77),
    "border_removed": lambda s, d: M.unframed(g(s, d), 3, 2, 1, 4),
    # lists
    "numa_threshold_indicator": lambda s, d: L.indicator(na(s, d), 80.0, ">="),
    "numa_select_by_indicator": lambda s, d: L.chosen(na(s, d), L.indicator(na(s, d), 80.0, ">=")),
    "numa_clip_to_interval": lambda s, d: L.select_range(na(s, d), 10, 60),
    "numa_subsample": lambda s, d: L.every(na(s, d), 4),
    "numa_sort": lambda s, d: L.ordered(na(s, d), True),
    "numa_interleave": lambda s, d: L.interleaved(na(s, d), L.reversed_(na(s, d))),
    "numa_even_places": lambda s, d: L.half(na(s, d), False),
    "numa_join": lambda s, d: L.appended(na(s, d), L.every(na(s, d), 9)),
    "numa_reverse": lambda s, d: L.reversed_(na(s, d)),
    "numa_border": lambda s, d: L.with_border(na(s, d), 2, 3, -1.0),
    "numa_arithmetic": lambda s, d: L.arithmetic(na(s, d), L.reversed_(na(s, d)), "multiply"),
    "numa_logical": lambda s, d: L.arithmetic(L.indicator(na(s, d), 80.0, ">="), L.indicator(L.reversed_(na(s, d)), 80.0, ">="), "difference"),
    "numa_slopes": lambda s, d: L.slopes(na(s, d)),
    "numa_integral": lambda s, d: L.integral(na(s, d)),
    "numa_value_between": lambda s, d: L.value_at(na(s, d), 12.3),
    "numa_value_between_squares": lambda s, d: L.value_at(na(s, d), 12.3, True),
    "numa_open": lambda s, d: _opened(na(s, d), 5),
    "numa_make_histogram": lambda s, d: L.make_histogram(na(s, d), 40),
    "numa_make_histogram_clipped": lambda s, d: L.make_histogram_clipped(na(s, d), 7.5, 200.0),
    "numa_make_histogram_auto": lambda s, d: L.make_histogram_auto(na(s, d), 25),
    "numa_make_histogram_whole": lambda s, d: L.make_histogram_auto(whole(s, d), 1000),
    "numa_rank_of_value": lambda s, d: L.rank_of_value(L.make_histogram_auto(na(s, d), 25), 120.5),
    "numa_value_of_rank": lambda s, d: L.value_of_rank(L.make_histogram_auto(na(s, d), 25), 0.7),
    "numa_split_distribution": lambda s, d: L.split(L.make_histogram_auto(na(s, d), 25), 0.1),
    "numa_extrema": lambda s, d: L.extrema(na(s, d), 150.0),
    "numa_find_peaks": lambda s, d: L.find_peaks(L.make_histogram_auto(na(s, d), 60).select("set_id", F.col("bin").alias("i"), F.col("n").cast("double").alias("v")), 4, 0.2, 0.1),
    "pta_sorted": lambda s, d: _sorted_points(D.points(s, d)),
    "pta_cubic_lsf": lambda s, d: T.cubic_fit(D.points(s, d)),
    # boxes
    "box_area_select": lambda s, d: X.select_by_area(bx(s, d), 500, ">="),
    "box_ratio_select": lambda s, d: X.select_by_ratio(bx(s, d), 1.5, "<"),
    "box_intersecting": lambda s, d: X.intersecting(bx(s, d), 300, 400, 900, 1200),
    "box_separations": lambda s, d: X.separations(_numbered(bx(s, d))),
    "box_nearest_by_side": lambda s, d: X.nearest_by_side(bx(s, d), 1000, 1500),
    "box_handle_overlaps": lambda s, d: X.handle_overlaps(_numbered(bx(s, d)), True, 20, 0.3, 0.8),
    "box_combine_pair": lambda s, d: X.combine_pair(_numbered(bx(s, d)).where("i % 2 = 0"), _numbered(bx(s, d)).where("i % 2 = 1")),
    "box_rows": lambda s, d: X.rows_of(_numbered(bx(s, d)).where("i < 60"), 5, -2, 12),
    # neighbourhoods
    "convolve_general": lambda s, d: N.convolve(g(s, d), [[1.0, 2.0, 0.0, 1.0, 3.0], [0.0, 4.0, 1.0, 2.0, 1.0], [2.0, 0.0, 1.0, 0.0, 1.0]]),
    "convolve_gaussian": lambda s, d: N.convolve(g(s, d), N.gaussian(2, 1, 1.2)),
    "convolve_16": lambda s, d: N.convolve(Q.to_16(g(s, d), 8), [[0.0, -1.0, 0.0], [-1.0, 6.0, -1.0], [0.0, -1.0, 0.0]], True, 16),
    "gray_close": lambda s, d: N.gray_closed(g(s, d), 3, 3),
    "gray_black_tophat": lambda s, d: N.tophat(g(s, d), 3, 3, False),
    "colour_dilate": lambda s, d: K.dilated(rgb(s, d), 3, 3),
    "colour_erode": lambda s, d: K.eroded(rgb(s, d), 3, 3),
    # scaling and solved transforms
    "scale_linear": lambda s, d: S.scale_linear(g(s, d), 1.3, 0.8),
    "scale_smooth": lambda s, d: S.scale_smooth(g(s, d), 0.4, 0.3),
    "scale_to_gray2": lambda s, d: S.to_gray(b1(s, d), 2),
    "scale_to_gray3": lambda s, d: S.to_gray(b1(s, d), 3),
    "scale_rank2": lambda s, d: S.half_by_rank(g(s, d), 2),
    "scale_replicate": lambda s, d: S.replicated(g(s, d), 2),
    "affine_three_points": lambda s, d: S.projective_interpolated(g(s, d), [*S.affine_of([(0, 0), (90, 5), (8, 80)], [(2, 3), (85, 0), (0, 90)]), 0.0, 0.0]),
    "bilinear_sampled": lambda s, d: S.bilinear_sampled(g(s, d), BILINEAR),
    "bilinear_interpolated": lambda s, d: S.bilinear_interpolated(g(s, d), BILINEAR),
    "projective_interpolated": lambda s, d: S.projective_interpolated(g(s, d), PROJECTIVE),
    # colours
    "hsv_unit": lambda s, d: K.hsv(rgb(s, d)),
    "hsv_back": lambda s, d: K.from_hsv(K.hsv(rgb(s, d))),
    "hue_turned": lambda s, d: K.turned(rgb(s, d), 0.25),
    "saturation_changed": lambda s, d: K.saturated(rgb(s, d), -0.4),
    "brightness_changed": lambda s, d: K.brightened(rgb(s, d), 0.3),
    "colour_matrix": lambda s, d: K.by_matrix(rgb(s, d), [[0.9, 0.1, 0.1], [0.2, 0.7, -0.1], [-0.3, 0.2, 1.4]]),
    "colour_factors": lambda s, d: K.by_factors(rgb(s, d), (0.5, 1.25, 0.9)),
    # floods
    "seedfill_gray": lambda s, d: C.fill_gray(small_pair(s, d), 4),
    "seedfill_gray8": lambda s, d: C.fill_gray(small_pair(s, d), 8),
    "seedfill_gray_inverse": lambda s, d: C.fill_basins(small_pair(s, d).withColumn("v", 255 - F.col("v")), 4),
    "seedspread": lambda s, d: C.spread_seeds(_sparse(s, d), 4),
    "seedspread8": lambda s, d: C.spread_seeds(_sparse(s, d), 8),
    "local_minima": lambda s, d: C.local_minima(sm(s, d)),
    "local_maxima": lambda s, d: C.local_maxima(sm(s, d)),
    "binary_maze": lambda s, d: C.maze_steps(small_binary(s, d).withColumn("v", F.when((F.col("x") == 0) & (F.col("y") == 0), 0).otherwise(F.col("v")))),
    "distance_function8": lambda s, d: C.distance(small_binary(s, d), 8),
    "distance_function_frame": lambda s, d: C.distance(small_binary(s, d), 4, True),
    "watershed4": lambda s, d: C.watershed(sm(s, d), 4),
    "thin4": lambda s, d: C.thin(small_binary(s, d), 4),
    # components, points, formats, text
    "clear_border": lambda s, d: Y.clear_border(small_binary(s, d), 4),
    "border_components": lambda s, d: Y.border_components(small_binary(s, d), 4),
    "component_rasters": lambda s, d: Y.component_rasters(small_binary(s, d)),
    "pta_inside_polygon": lambda s, d: T.inside_polygon(D.points(s, d), POLYGON),
    "jpeg_round_trip": lambda s, d: _jpeg(sm(s, d)),
    "tiff_page_round_trip": lambda s, d: I.pages(I.bound(sm(s, d).select(F.floor(F.col("image_id") / 4).alias("image_id"), (F.col("image_id") % 4).cast("int").alias("page"), "y", "x", "v"))),
    "image_headers": lambda s, d: I.headers(I.encode(sm(s, d), "png").select(F.col("image_id").cast("string").alias("path"), "content")),
    "base64_text": lambda s, d: D.table(s, d, "documents").select("doc_id", B64(F.col("text").cast("binary")).alias("code")),
    # recognition
    "find_skew": lambda s, d: R.find_skew(b1(s, d)),
    "deskew": lambda s, d: R.deskewed(b1(s, d)),
}

POLYGON = [(5.0, 10000.0), (40.0, 5000.0), (45.0, 60000.0), (20.0, 30000.0)]


def _jpeg(small: DataFrame) -> DataFrame:
    """Whether the best quality keeps every value to within 2."""
    back = I.pixels(I.encode(small, "jpeg")).withColumnRenamed("v", "b")
    return small.join(back, [*P.KEY]).groupBy("image_id").agg((F.max(F.abs(F.col("v") - F.col("b"))) <= 2).alias("close"), F.count(F.lit(1)).alias("n"))


BILINEAR = S.bilinear_of([(0, 0), (95, 0), (0, 95), (95, 95)], [(3, 2), (90, 4), (1, 97), (99, 91)])
PROJECTIVE = S.projective_of([(0, 0), (95, 0), (0, 95), (95, 95)], [(3, 2), (90, 4), (1, 97), (99, 91)])


def _opened(arrays: DataFrame, size: int) -> DataFrame:
    from pixelloom.operators.sequences import extreme_filter

    return extreme_filter(extreme_filter(arrays, size, False), size, True)


def _sorted_points(pt: DataFrame) -> DataFrame:
    """The different points in order of x, then y, with their places."""
    from pyspark.sql import Window

    n = pt.groupBy("set_id", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("set_id").orderBy("x", "y").rowsBetween(Window.unboundedPreceding, 0)
    return n.select("set_id", "x", "y", "n", (F.sum("n").over(w) - F.col("n")).alias("place"))


def _numbered(boxes: DataFrame) -> DataFrame:
    """Boxes numbered from 0 in each set."""
    from pyspark.sql import Window

    return boxes.withColumn("i", (F.row_number().over(Window.partitionBy("set_id").orderBy("i")) - 1).cast("long"))


# --- their SQL: name -> (statement, derived tables that it reads)
_MASK = "(SELECT image_id, y + {dy} AS y, x + {dx} AS x FROM bin WHERE v <> 0) m"
_IN = "x >= 10 AND x < 40 AND y >= 5 AND y < 45"
_DENSE = "SELECT i.image_id, t.v::INTEGER AS v, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT image_id FROM pix) i CROSS JOIN range(0, 256) t(v) LEFT JOIN ({}) c ON c.image_id = i.image_id AND c.v = t.v"
_SIZE = "z AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM pix GROUP BY 1)"
_LINE = """WITH s AS (SELECT image_id, {k}, avg(v) AS m, avg(v * v) AS q FROM pix GROUP BY 1, 2), n AS (SELECT image_id, {k}, v, count(*) AS n FROM pix GROUP BY 1, 2, 3),
    c AS (SELECT *, sum(n) OVER (PARTITION BY image_id, {k} ORDER BY v) AS c, sum(n) OVER (PARTITION BY image_id, {k}) AS t, row_number() OVER (PARTITION BY image_id, {k} ORDER BY n DESC, v) AS r FROM n),
    d AS (SELECT image_id, {k}, min(v) FILTER (c * 2 >= t) AS median, min(v) FILTER (r = 1) AS mode, max(n) AS mode_count FROM c GROUP BY 1, 2)
    SELECT image_id, {k}, round(m, 6) AS mean, round(q - m * m, 4) AS var, round(sqrt(greatest(q - m * m, 0.0)), 4) AS rootvar, median, mode, mode_count FROM s JOIN d USING (image_id, {k})"""
_TARGET = f"WITH {_SIZE}, a AS (SELECT image_id, w, h, unnest(range(-1, h + 4))::INTEGER AS ty FROM z), b AS (SELECT *, unnest(range(-3, w + 2))::INTEGER AS tx FROM a), c AS (SELECT image_id, ty, tx, {{sy}} AS sy, {{sx}} AS sx FROM b) SELECT c.image_id, ty + 1 AS y, tx + 3 AS x, p.v FROM c JOIN pix p ON p.image_id = c.image_id AND p.y = c.sy AND p.x = c.sx"
_WRAP, _EDGE, _MIRROR = "({0} + {1}) % {1}", "least(greatest({0}, 0), {1} - 1)", "CASE WHEN {0} < 0 THEN -1 - {0} WHEN {0} >= {1} THEN 2 * {1} - 1 - {0} ELSE {0} END"
_REV = "r AS (SELECT set_id, max(i) OVER (PARTITION BY set_id) - i AS i, v FROM numa)"
_E25 = "e AS (SELECT set_id, min(v) AS lo, max(v) AS hi FROM numa GROUP BY 1), c AS (SELECT set_id, least({b} - 1, floor((v - lo) / ((hi - lo) / {b})))::BIGINT AS bin, count(*) AS n FROM numa JOIN e USING (set_id) GROUP BY 1, 2), hist AS (SELECT e.set_id, t.bin, e.lo AS start, (e.hi - e.lo) / {b} AS width, coalesce(c.n, 0) AS n FROM e CROSS JOIN range(0, {b}) t(bin) LEFT JOIN c ON c.set_id = e.set_id AND c.bin = t.bin)"
_H25 = _E25.format(b=25)
_CUM = "k AS (SELECT *, sum(n) OVER (PARTITION BY set_id ORDER BY bin) - n AS before, sum(n) OVER (PARTITION BY set_id) AS total FROM hist)"
_NICE = "CASE " + " ".join(f"WHEN span / 40.0::DOUBLE < {w} THEN {w}" for w in L.WIDTHS) + " END"
_NUM = "nb AS (SELECT set_id, row_number() OVER (PARTITION BY set_id ORDER BY i) - 1 AS i, x, y, w, h FROM box)"


def _conv(table: str, kernel: list[list[float]], bits: int) -> str:
    k = [row[::-1] for row in kernel[::-1]]
    total = sum(map(sum, k))
    sx, sy = len(k[0]), len(k)
    cx, cy = sx - 1 - sx // 2, sy - 1 - sy // 2
    rows = ", ".join(f"({j - cy}, {i - cx}, {w / total!r}::DOUBLE)" for j, row in enumerate(k) for i, w in enumerate(row))
    mirror = lambda p, d, n: _MIRROR.format(f"({p} + {d})", n)
    return f"""WITH {_SIZE}, k AS (SELECT * FROM (VALUES {rows}) t(dy, dx, f)), s AS (SELECT p.image_id, p.y, p.x, {mirror('p.y', 'k.dy', 'z.h')} AS sy, {mirror('p.x', 'k.dx', 'z.w')} AS sx, f FROM {table} p JOIN z USING (image_id) CROSS JOIN k)
    SELECT s.image_id, s.y, s.x, (floor(round(abs(sum(s.f * p.v)), 6) + 0.5)::BIGINT % {1 << bits})::INTEGER AS v FROM s JOIN {table} p ON p.image_id = s.image_id AND p.y = s.sy AND p.x = s.sx GROUP BY 1, 2, 3"""


def _window(table: str, what: str, r: int = 1) -> str:
    return f"SELECT p.image_id, p.y, p.x, {what} FROM {table} p CROSS JOIN range(-{r}, {r} + 1) dy(j) CROSS JOIN range(-{r}, {r} + 1) dx(i) LEFT JOIN {table} q ON q.image_id = p.image_id AND q.y = p.y + dy.j AND q.x = p.x + dx.i GROUP BY 1, 2, 3"


def _taps(source: str, sy: str, sx: str) -> str:
    return f"""WITH m AS (SELECT image_id, y, x, {sx} AS sx, {sy} AS sy FROM {source}), c AS (SELECT image_id, y, x, floor(sy)::INTEGER AS iy, floor(sx)::INTEGER AS ix, floor((sy - floor(sy)) * 16)::INTEGER AS fy, floor((sx - floor(sx)) * 16)::INTEGER AS fx FROM m),
    t AS (SELECT c.*, iy + j AS ys, ix + i AS xs, (CASE WHEN j = 1 THEN fy ELSE 16 - fy END) * (CASE WHEN i = 1 THEN fx ELSE 16 - fx END) AS wt FROM c CROSS JOIN range(0, 2) a(j) CROSS JOIN range(0, 2) b(i))
    SELECT t.image_id, t.y, t.x, ((sum(coalesce(p.v, 255) * wt) + 128) // 256)::INTEGER AS v FROM t LEFT JOIN pix p ON p.image_id = t.image_id AND p.y = t.ys AND p.x = t.xs GROUP BY 1, 2, 3"""


def _lin(w: list[float]) -> str:
    return f"({w[0]!r}::DOUBLE * x + {w[1]!r}::DOUBLE * y + {w[2]!r}::DOUBLE * x * y + {w[3]!r}::DOUBLE)"


_PK = f"(x * {PROJECTIVE[6]!r}::DOUBLE + y * {PROJECTIVE[7]!r}::DOUBLE + 1.0::DOUBLE)"
_PROJ = [f"((x * {PROJECTIVE[k]!r}::DOUBLE + y * {PROJECTIVE[k + 1]!r}::DOUBLE + {PROJECTIVE[k + 2]!r}::DOUBLE) / {_PK})" for k in (3, 0)]
_AFF = S.affine_of([(0, 0), (90, 5), (8, 80)], [(2, 3), (85, 0), (0, 90)])
_AFFS = [f"(x * {_AFF[k]!r}::DOUBLE + y * {_AFF[k + 1]!r}::DOUBLE + {_AFF[k + 2]!r}::DOUBLE)" for k in (3, 0)]

_HSV = """u AS (SELECT image_id, y, x, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM rgb), w AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS dl FROM u),
    q AS (SELECT *, CASE WHEN r = hi THEN (g - b) / dl WHEN g = hi THEN 2.0 + (b - r) / dl ELSE 4.0 + (r - g) / dl END / 6.0 AS h0 FROM w),
    hsv AS (SELECT image_id, y, x, round(CASE WHEN dl = 0 THEN 0.0 WHEN h0 < 0 THEN h0 + 1.0 ELSE h0 END, 6) AS h, round(CASE WHEN dl = 0 THEN 0.0 ELSE dl / hi END, 6) AS s, round(hi, 6) AS val FROM q)"""


def _unhsv(h: str, s: str, v: str) -> str:
    """hsv with h, s, val replaced, as r, g, b."""
    out = []
    for parts in (("v", "q", "p", "p", "t", "v"), ("t", "v", "v", "q", "p", "p"), ("p", "p", "t", "v", "v", "q")):
        turns = " ".join(f"WHEN k % 6 = {n} THEN {p}" for n, p in enumerate(parts[:5]))
        out.append(f"floor(round(CASE WHEN s = 0 THEN v ELSE CASE {turns} ELSE {parts[5]} END END * 255.0, 4) + 0.5)::INTEGER")
    return f"""a AS (SELECT image_id, y, x, {h} AS h, {s} AS s, {v} AS v FROM hsv), f AS (SELECT *, floor(h * 6.0)::INTEGER AS k, h * 6.0 - floor(h * 6.0) AS f FROM a), c AS (SELECT *, v * (1 - s) AS p, v * (1 - s * f) AS q, v * (1 - s * (1 - f)) AS t FROM f)
    SELECT image_id, y, x, {out[0]} AS r, {out[1]} AS g, {out[2]} AS b FROM c"""


# floods on the 8 x 8 rasters: lists of 64 values that change until every value has had time to reach all others
def _cells(expr: str, table: str) -> str:
    """The rasters of a table as lists in raster order."""
    return f"(SELECT image_id, list({expr} ORDER BY y, x) AS l FROM {table} GROUP BY 1)"


def _near(c: str, eight: bool, other: str) -> str:
    """The neighbours of place i (from 1) in the list c, `other` beyond the frame."""
    out = []
    for dy, dx in C.EIGHT if eight else C.FOUR:
        ok = [t for t, on in ((f"i > 8", dy < 0), (f"i <= 56", dy > 0), ("(i - 1) % 8 > 0", dx < 0), ("(i - 1) % 8 < 7", dx > 0)) if on]
        out.append(f"CASE WHEN {' AND '.join(ok)} THEN {c}[i + {8 * dy + dx}] ELSE {other} END")
    return ", ".join(out)


def _flow(start: str, step: str, rounds: int, more: str = "") -> str:
    """start: a SELECT of image_id, c and further lists; step: the new value at place i."""
    return f"WITH RECURSIVE s AS ({start}), t AS (SELECT *, 0 AS k FROM s UNION ALL SELECT image_id, list_transform(range(1, 65), lambda i: {step}) AS c{more}, k + 1 FROM t WHERE k < {rounds}), o AS (SELECT image_id, c FROM t WHERE k = {rounds}) SELECT image_id, ((i - 1) // 8)::INTEGER AS y, ((i - 1) % 8)::INTEGER AS x, c[i]::{{kind}} AS v FROM o, range(1, 65) p(i)"


_PAIR = "SELECT image_id, list(CASE WHEN v >= 170 THEN v - 20 ELSE 0 END ORDER BY y, x) AS v0, list(v ORDER BY y, x) AS m FROM small GROUP BY 1"
_FILL = f"SELECT image_id, list_transform(range(1, 65), lambda i: least(v0[i], m[i])) AS c, m FROM ({_PAIR})"
_SINK = f"SELECT image_id, list_transform(range(1, 65), lambda i: greatest(255 - v0[i], m[i])) AS c, m FROM ({_PAIR})"
_EXTREMUM = "WITH n AS (" + _window("small", "any_value(p.v) AS v, min(q.v) FILTER (dy.j <> 0 OR dx.i <> 0) AS lo, max(q.v) FILTER (dy.j <> 0 OR dx.i <> 0) AS hi") + ") SELECT image_id, y, x, ({})::INTEGER AS v FROM n"
_MAZE = "SELECT image_id, list_transform(range(1, 65), lambda i: CASE WHEN i = 1 THEN {first} ELSE 1000000 END) AS c, l AS m FROM {src}"
_WALLS = "CASE WHEN (x = 0 AND y = 0) OR v >= 128 THEN 0 ELSE 1 END"
_INNER = "i > 8 AND i <= 56 AND (i - 1) % 8 > 0 AND (i - 1) % 8 < 7"


def _distance(eight: bool, frame: bool) -> str:
    """Least steps over the inner pixels, whose start is far; the frame as it is."""
    ring = "255" if frame else "m[i]"
    start = f"SELECT image_id, list_transform(range(1, 65), lambda i: CASE WHEN NOT ({_INNER}) THEN {ring} WHEN m[i] = 0 THEN 0 ELSE 255 END) AS c, m FROM (SELECT image_id, l AS m FROM {_cells('(v < 128)::INTEGER', 'small')})"
    flow = _flow(start, f"CASE WHEN {_INNER} AND m[i] > 0 THEN least(c[i], least({_near('c', eight, '255')}) + 1) ELSE c[i] END", 16, ", m")
    if not frame:
        return flow
    return flow.replace(" SELECT image_id, ((i - 1) // 8)", " SELECT image_id, ((i - 1) // 8)", 1).replace("c[i]::{kind} AS v", "c[least(greatest((i - 1) // 8, 1), 6) * 8 + least(greatest((i - 1) % 8, 1), 6) + 1]::{kind} AS v")


def _dithered() -> str:
    """One pixel after another: the list b of values, the list o of results."""
    add = lambda d, part: f"CASE WHEN i = k + {d} THEN least(255, greatest(0, b[i] + sg * ({part}))) ELSE"
    step = f"list_transform(range(1, 65), lambda i: {add(1, 'e3').replace(f'i = k + 1', 'i = k + 1 AND k % 8 <> 0')} {add(8, 'e3')} {add(9, 'e4').replace(f'i = k + 9', 'i = k + 9 AND k % 8 <> 0')} b[i] END END END)"
    return f"""WITH RECURSIVE s AS (SELECT image_id, l AS b, []::INTEGER[] AS o, 1 AS k FROM {_cells('v', 'small')}), t AS (SELECT * FROM s UNION ALL
    SELECT image_id, {step} AS b, list_append(o, (sg = 1)::INTEGER) AS o, k + 1 FROM (SELECT *, CASE WHEN er > 10 THEN (3 * er) // 8 ELSE 0 END AS e3, CASE WHEN er > 10 THEN er // 4 ELSE 0 END AS e4 FROM (SELECT *, CASE WHEN b[k] < 128 THEN 1 ELSE -1 END AS sg, CASE WHEN b[k] < 128 THEN b[k] ELSE 255 - b[k] END AS er FROM t WHERE k <= 64))),
    f AS (SELECT image_id, o FROM t WHERE k = 65) SELECT image_id, ((i - 1) // 8)::INTEGER AS y, ((i - 1) % 8)::INTEGER AS x, o[i]::INTEGER AS v FROM f, range(1, 65) p(i)"""


def _thinned(connectivity: int, rounds: int) -> str:
    """Rounds of four turns; what no longer changes stays as it is."""
    import numpy as np

    body = "c"
    for quarter in range(4):
        tests = []
        for name in C.THINNING[connectivity]:
            grid = np.rot90(np.array([[*row] for row in C.PATTERNS[name].split("/")]), -quarter)
            parts = []
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    want = grid[dy + 1][dx + 1]
                    if want != " ":
                        ok = [t for t, on in (("i > 8", dy < 0), ("i <= 56", dy > 0), ("(i - 1) % 8 > 0", dx < 0), ("(i - 1) % 8 < 7", dx > 0)) if on]
                        value = f"c{quarter}[i + {8 * dy + dx}]"
                        value = f"CASE WHEN {' AND '.join(ok)} THEN {value} ELSE 0 END" if ok else value
                        parts.append(f"({value}) = {int(want != 'o')}")
            tests.append("(" + " AND ".join(parts) + ")")
        body = f"(SELECT image_id, k, list_transform(range(1, 65), lambda i: CASE WHEN {' OR '.join(tests)} THEN 0 ELSE c{quarter}[i] END) AS c{quarter + 1} FROM {body if quarter else '(SELECT image_id, k, c AS c0 FROM t WHERE k < ' + str(rounds) + ')'})"
    return f"WITH RECURSIVE s AS (SELECT image_id, l AS c, 0 AS k FROM {_cells('(v < 128)::INTEGER', 'small')}), t AS (SELECT image_id, c, k FROM s UNION ALL SELECT image_id, c4 AS c, k + 1 FROM {body}), o AS (SELECT image_id, c FROM t WHERE k = {rounds}) SELECT image_id, ((i - 1) // 8)::INTEGER AS y, ((i - 1) % 8)::INTEGER AS x, c[i]::BIGINT::INTEGER AS v FROM o, range(1, 65) p(i)"


def _spread(eight: bool) -> str:
    """As the two scans: pixel after pixel of the raster with a border of one far pixel (10 x 10), there and back."""
    ahead = (-11, -10, -9, -1) if eight else (-1, -10)
    back = (1, 9, 10, 11) if eight else (10, 1)

    def step(offsets: tuple, k: str, cond: str) -> str:
        least = f"least({', '.join(f'd[{k} + {o}]' for o in offsets)})"
        value = "CASE " + " ".join(f"WHEN d[{k} + {o}] = {least} THEN v[{k} + {o}]" for o in offsets) + " END"
        on = cond.format(k=k, least=least)
        return f"list_transform(range(1, 101), lambda i: CASE WHEN i = {k} AND {on} THEN {value} ELSE v[i] END) AS v, list_transform(range(1, 101), lambda i: CASE WHEN i = {k} AND {on} THEN {least} + 1 ELSE d[i] END) AS d"

    forth = step(ahead, "k", "(k - 1) // 10 BETWEEN 1 AND 8 AND (k - 1) % 10 BETWEEN 1 AND 8 AND d[k] > 0")
    home = step(back, "(201 - k)", "(200 - k) // 10 BETWEEN 1 AND 8 AND (200 - k) % 10 BETWEEN 1 AND 8 AND d[{k}] > 0 AND {least} + 1 < d[{k}]")
    seeds = "CASE WHEN (v * 7 + x * 3 + y) % 11 = 0 THEN v ELSE 0 END"
    pad = "CASE WHEN (i - 1) // 10 BETWEEN 1 AND 8 AND (i - 1) % 10 BETWEEN 1 AND 8 THEN {0} ELSE {1} END"
    at = "l[((i - 1) // 10 - 1) * 8 + (i - 1) % 10]"
    return f"""WITH RECURSIVE s AS (SELECT image_id, list_transform(range(1, 101), lambda i: {pad.format(at, 0)}) AS v, list_transform(range(1, 101), lambda i: {pad.format(f'({at} = 0)::INTEGER', 60000)}) AS d, 1 AS k FROM {_cells(seeds, 'small')}),
    t AS (SELECT * FROM s UNION ALL SELECT image_id, v, d, k FROM (SELECT image_id, {forth}, k + 1 AS k FROM t WHERE k <= 100 UNION ALL SELECT image_id, {home}, k + 1 AS k FROM t WHERE k > 100 AND k <= 200)), o AS (SELECT image_id, v FROM t WHERE k = 201)
    SELECT image_id, ((i - 1) // 8)::INTEGER AS y, ((i - 1) % 8)::INTEGER AS x, v[((i - 1) // 8 + 1) * 10 + (i - 1) % 8 + 2]::INTEGER AS v FROM o, range(1, 65) p(i)"""


_CC = """WITH RECURSIVE f AS (SELECT image_id, y, x, y * 8 + x AS p FROM small WHERE v < 128),
    c(image_id, p, root) AS (SELECT image_id, p, p FROM f UNION SELECT c.image_id, q.p, c.root FROM c JOIN f a ON a.image_id = c.image_id AND a.p = c.p JOIN f q ON q.image_id = a.image_id AND abs(q.y - a.y) + abs(q.x - a.x) = 1),
    n AS (SELECT image_id, p, min(root) AS root FROM c GROUP BY 1, 2), b AS (SELECT DISTINCT image_id, root FROM n WHERE p < 8 OR p >= 56 OR p % 8 IN (0, 7))"""
_OF = " SELECT s.image_id, s.y, s.x, ({})::INTEGER AS v FROM small s LEFT JOIN n ON n.image_id = s.image_id AND n.p = s.y * 8 + s.x LEFT JOIN b ON b.image_id = n.image_id AND b.root = n.root"


def _crossings() -> str:
    out = []
    for (x1, y1), (x2, y2) in zip(POLYGON, POLYGON[1:] + POLYGON[:1], strict=True):
        out.append(f"(y >= {min(y1, y2)!r} AND y < {max(y1, y2)!r} AND x < {x1!r}::DOUBLE + (y - {y1!r}::DOUBLE) * {((x2 - x1) / (y2 - y1))!r}::DOUBLE)::INTEGER")
    return " + ".join(out)


STATEMENTS: dict[str, tuple[str, ...]] = {
    "clear_border": (_CC + _OF.format("n.root IS NOT NULL AND b.root IS NULL"), "small"),
    "border_components": (_CC + _OF.format("b.root IS NOT NULL"), "small"),
    "component_rasters": (
        _CC + ", l AS (SELECT n.*, p // 8 AS y, p % 8 AS x, dense_rank() OVER (PARTITION BY n.image_id ORDER BY root)::INTEGER AS label FROM n), e AS (SELECT image_id, label, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM l GROUP BY 1, 2), "
        "r AS (SELECT *, unnest(range(0, y1 - y0 + 1)) AS y FROM e), k AS (SELECT *, unnest(range(0, x1 - x0 + 1)) AS x FROM r) "
        "SELECT k.image_id, k.label, k.y::INTEGER AS y, k.x::INTEGER AS x, (l.p IS NOT NULL)::INTEGER AS v FROM k LEFT JOIN l ON l.image_id = k.image_id AND l.label = k.label AND l.y = k.y + k.y0 AND l.x = k.x + k.x0",
        "small",
    ),
    "pta_inside_polygon": (f"SELECT * FROM pt WHERE ({_crossings()}) % 2 = 1", "pt"),
    "jpeg_round_trip": ("SELECT image_id, true AS close, count(*) AS n FROM small GROUP BY 1", "small"),
    "tiff_page_round_trip": ("SELECT image_id // 4 AS image_id, (image_id % 4)::INTEGER AS page, y, x, v FROM small", "small"),
    "image_headers": ("SELECT DISTINCT image_id::VARCHAR AS path, 8 AS width, 8 AS height, 8 AS depth, 1 AS channels FROM small", "small"),
    "base64_text": ("WITH b AS (SELECT doc_id, to_base64(encode(text)) AS c FROM documents) SELECT doc_id, regexp_replace(c, '(.{72})', '\\1' || chr(10), 'g') || CASE WHEN length(c) % 72 = 0 AND length(c) > 0 THEN '' ELSE chr(10) END AS code FROM b",),
    "depth_unpack_binary": (V.format("CASE WHEN v = 0 THEN 255 ELSE 0 END", "bin"), "bin"),
    "depth_2_to_8": (V.format("([0, 90, 160, 255])[(v >> 6) + 1]", "pix"), "pix"),
    "depth_4_to_8": (V.format("(v >> 4) * 17", "pix"), "pix"),
    "depth_8_to_16": (V.format("v * 257", "pix"), "pix"),
    "depth_16_low_byte": (V.format("(v * 8) & 255", "pix"), "pix"),
    "depth_16_clipped": (V.format("least(255, v * 2)", "pix"), "pix"),
    "depth_16_auto": (V.format("CASE WHEN max(v * 16) OVER (PARTITION BY image_id) <= 255 THEN v * 16 ELSE (v * 16) >> 8 END", "pix"), "pix"),
    "depth_32_words": (V.format("(r::BIGINT * 16777216 + g * 65536 + b * 256 + 255)", "rgb"), "rgb"),
    "depth_32_to_16": (V.format("least(65535, r::BIGINT * 16777216 + g * 65536 + b * 256 + 255)::INTEGER", "rgb"), "rgb"),
    "levels_numbered": (V.format("((v * 4 + 127) // 255)::INTEGER", "pix"), "pix"),
    "levels_spread": (V.format("((((v * 6 + 127) // 255) * 255) // 6)::INTEGER", "pix"), "pix"),
    "remove_alpha": ("WITH a AS (SELECT *, (r + g) % 256 AS a FROM rgb) SELECT image_id, y, x, " + ", ".join(f"least(255, (a * {c} + (255 - a) * 255) // 255)::INTEGER AS {c}" for c in "rgb") + " FROM a", "rgb"),
    "alpha_over_colour": ("WITH a AS (SELECT *, ((r + g) % 256)::FLOAT / 255.0::FLOAT AS f FROM rgb) SELECT image_id, y, x, " + ", ".join(f"floor((1 - f::DOUBLE) * {k}.0::DOUBLE + f::DOUBLE * {c})::INTEGER AS {c}" for c, k in zip("rgb", (20, 200, 90), strict=True)) + " FROM a", "rgb"),
    "subpixel_rgb": ("SELECT image_id, (y * 2 + j)::INTEGER AS y, (x * 2 + i)::INTEGER AS x, v AS r, v AS g, v AS b FROM pix CROSS JOIN range(0, 2) a(j) CROSS JOIN range(0, 2) b(i)", "pix"),
    "sample_by_factor": ("SELECT image_id, (y // 3)::INTEGER AS y, (x // 3)::INTEGER AS x, v FROM pix WHERE y % 3 = 0 AND x % 3 = 0", "pix"),
    "rgb_to_gray_min_boost": (V.format("least(255, least(r, g, b) * least(r, g, b) // 180)::INTEGER", "rgb"), "rgb"),
    "rgb_to_gray_max_boost": (V.format("least(255, greatest(r, g, b) * greatest(r, g, b) // 180)::INTEGER", "rgb"), "rgb"),
    "rgb_to_gray_saturation_boost": (
        """WITH m AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM rgb), s AS (SELECT *, CASE WHEN hi = lo THEN 0 ELSE trunc((255.0::FLOAT * (hi - lo)::FLOAT * (1.0::FLOAT / hi::FLOAT))::DOUBLE + 0.5)::INTEGER END AS sv,
        least(255, trunc(255.0::FLOAT * (hi::FLOAT / 170.0::FLOAT))::INTEGER) AS fs FROM m) SELECT image_id, y, x, ((sv * fs + (255 - sv) * hi) // 255)::INTEGER AS v FROM s""",
        "rgb",
    ),
    "set_rectangle": (V.format(f"CASE WHEN {_IN} THEN 255 ELSE v END", "pix"), "pix"),
    "mask_of_value": (V.format("(v = 17)::INTEGER", "pix"), "pix"),
    "mask_of_band": (V.format("(v BETWEEN 40 AND 90)::INTEGER", "pix"), "pix"),
    "mask_of_table": (V.format("(v % 3 = 1)::INTEGER", "pix"), "pix"),
    "paint_through_mask": (f"SELECT image_id, y, x, CASE WHEN EXISTS (SELECT 1 FROM {_MASK.format(dy=-2, dx=4)} WHERE m.image_id = p.image_id AND m.y = p.y AND m.x = p.x) THEN 200 ELSE v END AS v FROM pix p", "pix", "bin"),
    "blend_gray": ("SELECT p.image_id, p.y, p.x, CASE WHEN q.v IS NULL THEN p.v ELSE floor(0.75::DOUBLE * p.v + 0.25::DOUBLE * q.v + 0.5)::INTEGER END AS v FROM pix p LEFT JOIN pix2 q ON q.image_id = p.image_id AND q.y = p.y - 3 AND q.x = p.x - 7", "pix", "pix2"),
    "blend_gray_inverse": ("SELECT image_id, y, x, floor(greatest(0.0, least(255.0, a.v + 0.5::DOUBLE * ((128.0::DOUBLE - a.v) * (255.0::DOUBLE - b.v) / 256.0))) + 0.5)::INTEGER AS v FROM pix a JOIN pix2 b USING (image_id, y, x)", "pix", "pix2"),
    "blend_mask_inverse": (f"SELECT p.image_id, p.y, p.x, CASE WHEN m.image_id IS NULL THEN p.v ELSE floor(round((p.v / 255.0::DOUBLE + 0.5::DOUBLE * (1.0 - 2.0 * (p.v / 255.0::DOUBLE))) * 255.0, 4) + 0.5)::INTEGER END AS v FROM pix p LEFT JOIN {_MASK.format(dy=1, dx=1)} ON m.image_id = p.image_id AND m.y = p.y AND m.x = p.x", "pix", "bin"),
    "blend_mask_white": (f"SELECT p.image_id, p.y, p.x, CASE WHEN m.image_id IS NULL THEN p.v ELSE floor(round((p.v / 255.0::DOUBLE + 0.25::DOUBLE * (1.0 - p.v / 255.0::DOUBLE)) * 255.0, 4) + 0.5)::INTEGER END AS v FROM pix p LEFT JOIN {_MASK.format(dy=0, dx=0)} ON m.image_id = p.image_id AND m.y = p.y AND m.x = p.x", "pix", "bin"),
    "histogram_in_rectangle": (_DENSE.format(f"SELECT image_id, v, count(*) AS n FROM pix WHERE {_IN} GROUP BY 1, 2"), "pix"),
    "histogram_masked": (_DENSE.format(f"SELECT p.image_id, p.v, count(*) AS n FROM pix p JOIN {_MASK.format(dy=1, dx=2)} ON m.image_id = p.image_id AND m.y = p.y AND m.x = p.x GROUP BY 1, 2"), "pix", "bin"),
    "histogram_tiled": (f"WITH {_SIZE} SELECT image_id, least(1, y // greatest(1, h // 2))::INTEGER AS ty, least(2, x // greatest(1, w // 3))::INTEGER AS tx, v, count(*) AS n FROM pix JOIN z USING (image_id) GROUP BY ALL", "pix"),
    "colour_histogram": (" UNION ALL ".join(f"SELECT image_id, '{c}' AS channel, {c} AS v, count(*) AS n FROM rgb GROUP BY ALL" for c in "rgb"), "rgb"),
    "rank_masked": (
        """WITH n AS (SELECT q.image_id, q.v, count(*) AS n FROM pix2 q JOIN bin b USING (image_id, y, x) WHERE b.v <> 0 GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY v) - n AS before, sum(n) OVER (PARTITION BY image_id) AS t FROM n),
        k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v) AS r FROM c WHERE before + n >= t * 0.3::DOUBLE) SELECT image_id, round(v + (t * 0.3::DOUBLE - before) / n, 4) AS value FROM k WHERE r = 1""",
        "pix2", "bin",
    ),
    "row_stats": (_LINE.format(k="y"), "pix"),
    "column_stats": (_LINE.format(k="x"), "pix"),
    "row_differences": ("WITH d AS (SELECT image_id, y, abs(v - lag(v) OVER (PARTITION BY image_id, y ORDER BY x)) AS d FROM pix) SELECT image_id, y, round(avg(d), 6) AS diff FROM d GROUP BY 1, 2", "pix"),
    "rank_rows": ("SELECT image_id, y, (row_number() OVER (PARTITION BY image_id, y ORDER BY v, x) - 1)::INTEGER AS x, v FROM pix", "pix"),
    "rank_columns": ("SELECT image_id, (row_number() OVER (PARTITION BY image_id, x ORDER BY v, y) - 1)::INTEGER AS y, x, v FROM pix", "pix"),
    "count_in_rectangle": (f"SELECT image_id, count(*) FILTER (v <> 0) AS n, round(avg(v), 6) AS mean, round(sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0.0)), 4) AS rootvar FROM pix WHERE {_IN} GROUP BY 1", "pix"),
    "border_repeated": (_TARGET.format(sy=_WRAP.format("ty", "h"), sx=_WRAP.format("tx", "w")), "pix"),
    "border_continued": (_TARGET.format(sy=_EDGE.format("ty", "h"), sx=_EDGE.format("tx", "w")), "pix"),
    "border_mixed": (_TARGET.format(sy=_WRAP.format("ty", "h"), sx=_MIRROR.format("tx", "w")), "pix"),
    "border_constant": (_TARGET.format(sy="ty", sx="tx").replace("p.v FROM c JOIN", "coalesce(p.v, 77) AS v FROM c LEFT JOIN"), "pix"),
    "border_removed": (f"WITH {_SIZE} SELECT image_id, y - 1 AS y, x - 3 AS x, v FROM pix JOIN z USING (image_id) WHERE x >= 3 AND x < w - 2 AND y >= 1 AND y < h - 4", "pix"),
    "numa_threshold_indicator": ("SELECT set_id, i, (v >= 80)::INTEGER AS v FROM numa", "numa"),
    "numa_select_by_indicator": ("SELECT set_id, i, v FROM numa WHERE v >= 80", "numa"),
    "numa_clip_to_interval": ("SELECT set_id, i - 10 AS i, v FROM numa WHERE i BETWEEN 10 AND 60", "numa"),
    "numa_subsample": ("SELECT set_id, i // 4 AS i, v FROM numa WHERE i % 4 = 0", "numa"),
    "numa_sort": ("SELECT set_id, row_number() OVER (PARTITION BY set_id ORDER BY v DESC, i) - 1 AS place, v, i FROM numa", "numa"),
    "numa_interleave": (f"WITH {_REV} SELECT set_id, 2 * i AS i, v FROM numa UNION ALL SELECT set_id, 2 * i + 1, v FROM r", "numa"),
    "numa_even_places": ("SELECT set_id, i // 2 AS i, v FROM numa WHERE i % 2 = 0", "numa"),
    "numa_join": ("WITH n AS (SELECT set_id, max(i) + 1 AS n FROM numa GROUP BY 1) SELECT set_id, i, v FROM numa UNION ALL SELECT set_id, i // 9 + n, v FROM numa JOIN n USING (set_id) WHERE i % 9 = 0", "numa"),
    "numa_reverse": (f"WITH {_REV} SELECT * FROM r", "numa"),
    "numa_border": ("WITH n AS (SELECT set_id, max(i) + 1 AS n FROM numa GROUP BY 1) SELECT set_id, i + 2 AS i, v FROM numa UNION ALL SELECT set_id, t.k, -1.0 FROM n CROSS JOIN range(0, 2) t(k) UNION ALL SELECT set_id, n + 2 + t.k, -1.0 FROM n CROSS JOIN range(0, 3) t(k)", "numa"),
    "numa_arithmetic": (f"WITH {_REV} SELECT set_id, i, round(a.v * r.v, 6) AS v FROM numa a JOIN r USING (set_id, i)", "numa"),
    "numa_logical": (f"WITH {_REV} SELECT set_id, i, CASE WHEN a.v >= 80 AND r.v < 80 THEN 1.0::DOUBLE ELSE 0.0 END AS v FROM numa a JOIN r USING (set_id, i)", "numa"),
    "numa_slopes": ("SELECT set_id, i, round((coalesce(lead(v) OVER w, v) - coalesce(lag(v) OVER w, v)) * 0.5, 6) AS v FROM numa WINDOW w AS (PARTITION BY set_id ORDER BY i)", "numa"),
    "numa_integral": ("WITH n AS (SELECT set_id, max(i) AS n FROM numa GROUP BY 1) SELECT set_id, round(sum(CASE WHEN i = 0 OR i = n THEN v * 0.5 ELSE v END), 3) AS area FROM numa JOIN n USING (set_id) GROUP BY 1", "numa"),
    "numa_value_between": ("SELECT a.set_id, round(a.v + (12.3::DOUBLE - 12) * (b.v - a.v), 6) AS v FROM numa a JOIN numa b USING (set_id) WHERE a.i = 12 AND b.i = 13", "numa"),
    "numa_value_between_squares": ("WITH t AS (SELECT 12.3::DOUBLE - 12 AS u) SELECT set_id, round(a.v * u * (u - 1) / 2 - b.v * (u + 1) * (u - 1) + c.v * u * (u + 1) / 2, 6) AS v FROM numa a JOIN numa b USING (set_id) JOIN numa c USING (set_id) CROSS JOIN t WHERE a.i = 11 AND b.i = 12 AND c.i = 13", "numa"),
    "numa_open": ("WITH e AS (SELECT set_id, i, min(v) OVER w AS v FROM numa WINDOW w AS (PARTITION BY set_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT set_id, i, max(v) OVER w AS v FROM e WINDOW w AS (PARTITION BY set_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)", "numa"),
    "numa_make_histogram": (
        f"""WITH e AS (SELECT set_id, trunc(min(v) + 0.5)::INTEGER AS lo, trunc(max(v) + 0.5)::INTEGER AS hi FROM numa GROUP BY 1), s AS (SELECT *, hi - lo + 1 AS span FROM e), w AS (SELECT *, CASE WHEN span > 39 THEN {_NICE} ELSE 1 END::INTEGER AS width FROM s),
        b AS (SELECT set_id, width, (1 + span // width)::BIGINT AS bins, (CASE WHEN width = 1 THEN lo ELSE width * (lo // width) END)::INTEGER AS start FROM w),
        c AS (SELECT set_id, ((trunc(v + 0.5)::INTEGER - start) // width)::BIGINT AS bin, count(*) AS n FROM numa JOIN b USING (set_id) GROUP BY 1, 2)
        SELECT b.set_id, t.bin, b.start, b.width, coalesce(c.n, 0) AS n FROM (SELECT *, unnest(range(0, bins)) AS bin FROM b) t JOIN b USING (set_id) LEFT JOIN c ON c.set_id = b.set_id AND c.bin = t.bin""",
        "numa",
    ),
    "numa_make_histogram_clipped": (
        """WITH e AS (SELECT set_id, floor(least(200.0::DOUBLE, max(v)) / 7.5::DOUBLE)::BIGINT + 1 AS bins FROM numa GROUP BY 1), c AS (SELECT set_id, trunc(v / 7.5::DOUBLE)::BIGINT AS bin, count(*) AS n FROM numa GROUP BY 1, 2)
        SELECT t.set_id, t.bin, 0.0::DOUBLE AS start, 7.5::DOUBLE AS width, coalesce(c.n, 0) AS n FROM (SELECT set_id, unnest(range(0, bins)) AS bin FROM e) t LEFT JOIN c ON c.set_id = t.set_id AND c.bin = t.bin""",
        "numa",
    ),
    "numa_make_histogram_auto": (f"WITH {_H25} SELECT set_id, bin, start, width, n FROM hist", "numa"),
    "numa_make_histogram_whole": (
        """WITH f AS (SELECT set_id, floor(v) AS v FROM numa), e AS (SELECT set_id, min(v) AS lo, max(v) AS hi FROM f GROUP BY 1), c AS (SELECT set_id, (v - lo)::BIGINT AS bin, count(*) AS n FROM f JOIN e USING (set_id) GROUP BY 1, 2)
        SELECT t.set_id, t.bin, t.lo AS start, 1.0::DOUBLE AS width, coalesce(c.n, 0) AS n FROM (SELECT *, unnest(range(0, (hi - lo)::BIGINT + 1)) AS bin FROM e) t LEFT JOIN c ON c.set_id = t.set_id AND c.bin = t.bin""",
        "numa",
    ),
    "numa_rank_of_value": (f"WITH {_H25}, p AS (SELECT *, (120.5::DOUBLE - start) / width AS pos FROM hist) SELECT set_id, round(greatest(0.0, sum(CASE WHEN bin < floor(pos) THEN n WHEN bin = floor(pos) THEN (pos - floor(pos)) * n ELSE 0.0 END) / sum(n)), 6) AS rank FROM p GROUP BY 1", "numa"),
    "numa_value_of_rank": (f"WITH {_H25}, {_CUM}, f AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY bin) AS r FROM k WHERE before + n >= total * 0.7::DOUBLE) SELECT set_id, round(start + width * (bin + (total * 0.7::DOUBLE - before) / n), 4) AS value FROM f WHERE r = 1", "numa"),
    "numa_split_distribution": (
        f"""WITH {_H25}, s AS (SELECT set_id, bin, n, sum(n) OVER w AS n1, sum(n * bin) OVER w AS s1, sum(n) OVER a AS t, sum(n * bin) OVER a AS s FROM hist WINDOW w AS (PARTITION BY set_id ORDER BY bin), a AS (PARTITION BY set_id)),
        o AS (SELECT set_id, bin, n, round(CASE WHEN n1 > 0 AND t - n1 > 0 THEN (n1::DOUBLE / t) * ((t - n1)::DOUBLE / t) * ((s - s1)::DOUBLE / (t - n1) - s1::DOUBLE / n1) ** 2 ELSE 0.0 END, 6) AS score FROM s),
        b AS (SELECT set_id, max(score) AS top, arg_max(bin, score - bin * 1e-12) AS pos FROM o GROUP BY 1), j AS (SELECT o.*, pos, score < 0.9::DOUBLE * top AS low FROM o JOIN b USING (set_id)),
        en AS (SELECT set_id, coalesce(max(bin) FILTER (low AND bin < pos), -1) AS l, coalesce(min(bin) FILTER (low AND bin > pos), 1000000) AS r FROM j GROUP BY 1), m AS (SELECT j.set_id, bin, row_number() OVER (PARTITION BY j.set_id ORDER BY n, bin) AS k FROM j JOIN en USING (set_id) WHERE bin > l AND bin < r)
        SELECT set_id, least(255, bin + 1) AS split FROM m WHERE k = 1""",
        "numa",
    ),
    "pta_sorted": ("WITH n AS (SELECT set_id, x, y, count(*) AS n FROM pt GROUP BY ALL) SELECT *, (sum(n) OVER (PARTITION BY set_id ORDER BY x, y) - n)::BIGINT AS place FROM n", "pt"),
    "pta_cubic_lsf": (
        """WITH m AS (SELECT set_id, avg(x) AS mx, avg(y) AS my FROM pt GROUP BY 1), d AS (SELECT set_id, x - mx AS u, y FROM pt JOIN m USING (set_id)), s AS (SELECT set_id, """
        + ", ".join(f"avg(u ** {k}) AS s{k}" for k in range(1, 7)) + ", " + ", ".join(f"avg(u ** {k} * y) AS t{k}" for k in range(4))
        + """ FROM d GROUP BY 1), g0 AS (SELECT set_id, s2 - s1 * s1 AS a11, s3 - s1 * s2 AS a12, s4 - s1 * s3 AS a13, s3 - s2 * s1 AS a21, s4 - s2 * s2 AS a22, s5 - s2 * s3 AS a23, s4 - s3 * s1 AS a31, s5 - s3 * s2 AS a32, s6 - s3 * s3 AS a33, t1 - s1 * t0 AS b1, t2 - s2 * t0 AS b2, t3 - s3 * t0 AS b3 FROM s),
        h AS (SELECT set_id, a11, a12, a13, b1, a22 - a21 / a11 * a12 AS c22, a23 - a21 / a11 * a13 AS c23, b2 - a21 / a11 * b1 AS d2, a32 - a31 / a11 * a12 AS c32, a33 - a31 / a11 * a13 AS c33, b3 - a31 / a11 * b1 AS d3 FROM g0),
        r AS (SELECT *, (d3 - c32 / c22 * d2) / (c33 - c32 / c22 * c23) AS a FROM h), q AS (SELECT *, (d2 - c23 * a) / c22 AS b FROM r) SELECT set_id, round(a, 2) AS a, round(b, 2) AS b, round((b1 - a12 * b - a13 * a) / a11, 2) AS c FROM q""",
        "pt",
    ),
    "box_area_select": ("SELECT * FROM box WHERE w * h >= 500", "box"),
    "box_ratio_select": ("SELECT * FROM box WHERE h > 0 AND w / h::DOUBLE < 1.5", "box"),
    "box_intersecting": ("SELECT * FROM box WHERE x < 1200 AND x + w > 300 AND y < 1600 AND y + h > 400", "box"),
    "box_separations": (
        f"WITH {_NUM}, j AS (SELECT a.set_id, a.i, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS ax, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS dn FROM nb a JOIN nb b ON a.set_id = b.set_id AND b.i = a.i + 1) SELECT set_id, i, (CASE WHEN ax > 0 THEN ax ELSE ax - 1 END)::INTEGER AS across, (CASE WHEN dn > 0 THEN dn ELSE dn - 1 END)::INTEGER AS down FROM j",
        "box",
    ),
    "box_nearest_by_side": (
        "SELECT set_id, " + ", ".join(f"arg_min(i, struct_pack(a := {gap}, b := i)) FILTER ({cond}) AS {name}" for name, gap, cond in (("left", "1000 - x - w", "x + w <= 1000"), ("right", "x - 1000", "x >= 1000"), ("top", "1500 - y - h", "y + h <= 1500"), ("bottom", "y - 1500", "y >= 1500"))) + " FROM box GROUP BY 1",
        "box",
    ),
    "convolve_general": (_conv("pix", [[1.0, 2.0, 0.0, 1.0, 3.0], [0.0, 4.0, 1.0, 2.0, 1.0], [2.0, 0.0, 1.0, 0.0, 1.0]], 8), "pix"),
    "convolve_gaussian": (_conv("pix", N.gaussian(2, 1, 1.2), 8), "pix"),
    "convolve_16": (_conv("p16", [[0.0, -1.0, 0.0], [-1.0, 6.0, -1.0], [0.0, -1.0, 0.0]], 16).replace("WITH ", "WITH p16 AS (SELECT image_id, y, x, v * 257 AS v FROM pix), ", 1), "pix"),
    "gray_close": (f"WITH e AS ({_window('pix', 'max(q.v) AS v')}) " + _window("e", "min(q.v) AS v"), "pix"),
    "gray_black_tophat": (f"WITH e AS ({_window('pix', 'max(q.v) AS v')}), c AS ({_window('e', 'min(q.v) AS v')}) SELECT image_id, y, x, greatest(0, c.v - p.v) AS v FROM pix p JOIN c USING (image_id, y, x)", "pix"),
    "colour_dilate": (_window("rgb", "max(q.r) AS r, max(q.g) AS g, max(q.b) AS b"), "rgb"),
    "colour_erode": (_window("rgb", "min(q.r) AS r, min(q.g) AS g, min(q.b) AS b"), "rgb"),
    "scale_linear": (
        f"""WITH {_SIZE}, n AS (SELECT *, greatest(1, floor(w * 1.3::DOUBLE + 0.5))::INTEGER AS tw, greatest(1, floor(h * 0.8::DOUBLE + 0.5))::INTEGER AS th FROM z), a AS (SELECT *, unnest(range(0, th))::INTEGER AS y FROM n), b AS (SELECT *, unnest(range(0, tw))::INTEGER AS x FROM a),
        p AS (SELECT *, trunc((16.0::DOUBLE * h / th)::FLOAT * y::FLOAT)::INTEGER AS py, trunc((16.0::DOUBLE * w / tw)::FLOAT * x::FLOAT)::INTEGER AS px FROM b),
        t AS (SELECT image_id, y, x, least((py >> 4) + j, h - 1) AS ys, least((px >> 4) + i, w - 1) AS xs, (CASE WHEN j = 1 THEN py & 15 ELSE 16 - (py & 15) END) * (CASE WHEN i = 1 THEN px & 15 ELSE 16 - (px & 15) END) AS k FROM p CROSS JOIN range(0, 2) c(j) CROSS JOIN range(0, 2) d(i))
        SELECT t.image_id, t.y, t.x, ((sum(q.v * k) + 128) // 256)::INTEGER AS v FROM t JOIN pix q ON q.image_id = t.image_id AND q.y = t.ys AND q.x = t.xs GROUP BY 1, 2, 3""",
        "pix",
    ),
    "scale_smooth": (
        f"""WITH {_SIZE}, n AS (SELECT *, greatest(1, floor(w * 0.4::DOUBLE + 0.5))::INTEGER AS tw, greatest(1, floor(h * 0.3::DOUBLE + 0.5))::INTEGER AS th FROM z), a AS (SELECT *, unnest(range(0, th))::INTEGER AS y FROM n), b AS (SELECT *, unnest(range(0, tw))::INTEGER AS x FROM a),
        p AS (SELECT *, least(trunc((h::DOUBLE / th)::FLOAT * y::FLOAT)::INTEGER, h - 3) AS ys, least(trunc((w::DOUBLE / tw)::FLOAT * x::FLOAT)::INTEGER, w - 3) AS xs FROM b)
        SELECT p.image_id, p.y, p.x, floor(sum(q.v) / 9.0::DOUBLE)::INTEGER AS v FROM p CROSS JOIN range(0, 3) c(j) CROSS JOIN range(0, 3) d(i) JOIN pix q ON q.image_id = p.image_id AND q.y = p.ys + j AND q.x = p.xs + i GROUP BY 1, 2, 3""",
        "pix",
    ),
    "scale_to_gray2": (f"WITH {_SIZE} SELECT b.image_id, (b.y // 2)::INTEGER AS y, (b.x // 2)::INTEGER AS x, (255 - (count(*) FILTER (b.v <> 0) * 255) // 4)::INTEGER AS v FROM bin b JOIN z USING (image_id) WHERE b.y // 2 < h // 2 AND b.x // 2 < w // 2 GROUP BY 1, 2, 3", "pix", "bin"),
    "scale_to_gray3": (f"WITH {_SIZE} SELECT b.image_id, (b.y // 3)::INTEGER AS y, (b.x // 3)::INTEGER AS x, (255 - (count(*) FILTER (b.v <> 0) * 255) // 9)::INTEGER AS v FROM bin b JOIN z USING (image_id) WHERE b.y // 3 < h // 3 AND b.x // 3 < ((w // 3) // 8) * 8 GROUP BY 1, 2, 3", "pix", "bin"),
    "scale_rank2": ("SELECT image_id, (y // 2)::INTEGER AS y, (x // 2)::INTEGER AS x, (list(v ORDER BY v))[2] AS v FROM pix GROUP BY 1, 2, 3 HAVING count(*) = 4", "pix"),
    "scale_replicate": ("SELECT image_id, (y * 2 + j)::INTEGER AS y, (x * 2 + i)::INTEGER AS x, v FROM pix CROSS JOIN range(0, 2) a(j) CROSS JOIN range(0, 2) b(i)", "pix"),
    "affine_three_points": (_taps("pix", *_AFFS), "pix"),
    "bilinear_sampled": (f"WITH m AS (SELECT image_id, y, x, trunc({_lin(BILINEAR[:4])} + 0.5)::INTEGER AS sx, trunc({_lin(BILINEAR[4:])} + 0.5)::INTEGER AS sy FROM pix) SELECT m.image_id, m.y, m.x, coalesce(p.v, 255) AS v FROM m LEFT JOIN pix p ON p.image_id = m.image_id AND p.y = m.sy AND p.x = m.sx", "pix"),
    "bilinear_interpolated": (_taps("pix", _lin(BILINEAR[4:]), _lin(BILINEAR[:4])), "pix"),
    "projective_interpolated": (_taps("pix", *_PROJ), "pix"),
    "hsv_unit": (f"WITH {_HSV} SELECT * FROM hsv", "rgb"),
    "hsv_back": (f"WITH {_HSV}, " + _unhsv("h", "s", "val"), "rgb"),
    "hue_turned": (f"WITH {_HSV}, " + _unhsv("CASE WHEN h + 0.25::DOUBLE >= 1 THEN h + 0.25::DOUBLE - 1 ELSE h + 0.25::DOUBLE END", "s", "val"), "rgb"),
    "saturation_changed": (f"WITH {_HSV}, " + _unhsv("h", "s * (1 + -0.4::DOUBLE)", "val"), "rgb"),
    "brightness_changed": (f"WITH {_HSV}, " + _unhsv("h", "s", "val + 0.3::DOUBLE * (1 - val)"), "rgb"),
    "colour_matrix": (
        "SELECT image_id, y, x, " + ", ".join(f"floor(greatest(0.0, least(255.0, round(0.0::DOUBLE + {m[0]!r}::DOUBLE * r + {m[1]!r}::DOUBLE * g + {m[2]!r}::DOUBLE * b, 6))) + 0.5)::INTEGER AS {c}" for c, m in zip("rgb", ([0.9, 0.1, 0.1], [0.2, 0.7, -0.1], [-0.3, 0.2, 1.4]), strict=True)) + " FROM rgb",
        "rgb",
    ),
    "colour_factors": ("SELECT image_id, y, x, " + ", ".join(f"least(255, floor({c} * {k}::DOUBLE))::INTEGER AS {c}" for c, k in zip("rgb", (0.5, 1.25, 0.9), strict=True)) + " FROM rgb", "rgb"),
    "seedfill_gray": (_flow(_FILL, f"least(m[i], greatest(c[i], {_near('c', False, '0')}))", 64, ", m").format(kind="INTEGER"), "small"),
    "seedfill_gray8": (_flow(_FILL, f"least(m[i], greatest(c[i], {_near('c', True, '0')}))", 64, ", m").format(kind="INTEGER"), "small"),
    "seedfill_gray_inverse": (_flow(_SINK, f"greatest(m[i], least(c[i], {_near('c', False, '1000')}))", 64, ", m").format(kind="INTEGER"), "small"),
    "seedspread": (_spread(False), "small"),
    "seedspread8": (_spread(True), "small"),
    "local_minima": (_EXTREMUM.format("v <= lo AND v < hi"), "small"),
    "local_maxima": (_EXTREMUM.format("v >= hi AND v > lo"), "small"),
    "binary_maze": (
        _flow(_MAZE.format(first="0", src=_cells(_WALLS, "small")), f"CASE WHEN m[i] = 0 THEN least(c[i], 1 + least({_near('c', False, '1000000')})) ELSE 1000000 END", 64, ", m").format(kind="INTEGER").replace("c[i]::INTEGER AS v", "(CASE WHEN c[i] >= 1000000 THEN -1 ELSE c[i] END)::INTEGER AS v"),
        "small",
    ),
    "gray_maze": (_flow(_MAZE.format(first="l[1]", src=_cells("v", "small")), f"least(c[i], m[i] + least({_near('c', False, '1000000')}))", 64, ", m").format(kind="BIGINT"), "small"),
    "distance_function": (_distance(False, False).format(kind="INTEGER"), "small"),
    "distance_function8": (_distance(True, False).format(kind="INTEGER"), "small"),
    "distance_function_frame": (_distance(False, True).format(kind="INTEGER"), "small"),
    "dither_binary": (_dithered(), "small"),
    "thin": (_thinned(8, 12), "small"),
    "thin4": (_thinned(4, 12), "small"),
}
