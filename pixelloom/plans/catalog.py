"""The library's registered queries, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pixelloom.functions import colour as K
from pixelloom.operators import aggregates as A
from pixelloom.operators import boxes as B
from pixelloom.operators import enhance as E
from pixelloom.operators import floods as FL
from pixelloom.operators import geometry as G
from pixelloom.operators import neighbourhood as N
from pixelloom.operators import pixels as P
from pixelloom.operators import points as T
from pixelloom.operators import recognition as R
from pixelloom.operators import regions as C
from pixelloom.operators import sequences as S
from pixelloom.operators import strings as W
from pixelloom.plans import extended as X
from pixelloom.sources import derived as D
from pixelloom.sources import images as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str = "", *tables: str) -> None:
    """sql: a SELECT; tables: the derived tables that it reads."""
    QUERIES[name] = query
    if sql:
        recursive = "RECURSIVE " if "RECURSIVE" in sql else ""
        sql = sql.replace("RECURSIVE", "")
        heads = [D.SQL[t] for t in tables]
        body = sql.strip()
        if body.upper().startswith("WITH"):
            heads.append(body[4:].strip())
            SQL[name] = f"WITH {recursive}" + ", ".join(heads)
        else:
            SQL[name] = f"WITH {recursive}" + ", ".join(heads) + " " + body if heads else body


PALETTE = [(0, 0, 0), (255, 255, 255), (200, 30, 30), (30, 200, 30), (30, 30, 200), (128, 128, 128)]
KERNEL = [[1.0, 2.0, 1.0], [0.0, 0.0, 0.0], [-1.0, -2.0, -1.0]]
GAMMA = P.gamma_curve(1.7)
g, g2, b1, rgb, sm = D.gray, D.second, D.binary, D.colour, D.small
JOIN = "pix a JOIN pix2 b USING (image_id, y, x)"


def _two(f):
    return lambda s, d: f(g(s, d), g2(s, d))


# per-pixel
_add("add_constant", lambda s, d: P.add_constant(g(s, d), 40), "SELECT image_id, y, x, least(255, greatest(0, v + 40))::INTEGER AS v FROM pix", "pix")
_add("multiply_constant", lambda s, d: P.multiply_constant(g(s, d), 1.5), "SELECT image_id, y, x, least(255, floor(v * 1.5::DOUBLE))::INTEGER AS v FROM pix", "pix")
_add("threshold_binary", lambda s, d: P.threshold(g(s, d), 76), "SELECT image_id, y, x, CASE WHEN v < 76 THEN 1 ELSE 0 END AS v FROM pix", "pix")
_add("quantise_levels", lambda s, d: P.quantise(g(s, d), [32, 64, 128, 200]), "SELECT image_id, y, x, (v >= 32)::INTEGER + (v >= 64)::INTEGER + (v >= 128)::INTEGER + (v >= 200)::INTEGER AS v FROM pix", "pix")
_add("tone_curve", lambda s, d: P.lookup(g(s, d), GAMMA), f"SELECT image_id, y, x, ({GAMMA})[v + 1]::INTEGER AS v FROM pix", "pix")
_add("rgb_to_gray_weights", lambda s, d: P.gray_weighted(rgb(s, d)), "SELECT image_id, y, x, least(255, floor(r * 0.3::DOUBLE + g * 0.5::DOUBLE + b * 0.2::DOUBLE + 0.5))::INTEGER AS v FROM rgb", "rgb")
_add("rgb_to_gray_shift", lambda s, d: P.gray_shifted(rgb(s, d)), "SELECT image_id, y, x, ((77 * r + 150 * g + 29 * b) >> 8)::INTEGER AS v FROM rgb", "rgb")
for _k, _e in (("min", "least(r, g, b)"), ("max", "greatest(r, g, b)"), ("diff", "greatest(r, g, b) - least(r, g, b)")):
    _add(f"rgb_to_gray_{_k}", lambda s, d, k=_k: P.gray_extreme(rgb(s, d), k), f"SELECT image_id, y, x, {_e} AS v FROM rgb", "rgb")
_add(
    "hsv_core",
    lambda s, d: P.hsv(rgb(s, d)),
    """WITH m AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS dl FROM rgb),
    t AS (SELECT *, CASE WHEN dl = 0 THEN 0.0::DOUBLE WHEN r = hi THEN (g - b)::DOUBLE / dl WHEN g = hi THEN 2 + (b - r)::DOUBLE / dl ELSE 4 + (r - g)::DOUBLE / dl END * 40 AS h0 FROM m),
    u AS (SELECT *, CASE WHEN h0 < 0 THEN h0 + 240 ELSE h0 END AS h1 FROM t)
    SELECT image_id, y, x, CASE WHEN dl = 0 OR h1 >= 239.5 THEN 0 ELSE floor(h1 + 0.5)::INTEGER END AS h, CASE WHEN dl = 0 THEN 0 ELSE floor(255.0::DOUBLE * dl / hi + 0.5)::INTEGER END AS s, hi AS val FROM u""",
    "rgb",
)
_add(
    "yuv",
    lambda s, d: P.yuv(rgb(s, d)),
    """SELECT image_id, y, x, floor((r * 65.738::DOUBLE + g * 129.057::DOUBLE + b * 25.064::DOUBLE) / 256.0 + 16 + 0.5)::INTEGER AS yy,
    floor((r * -37.945::DOUBLE + g * -74.494::DOUBLE + b * 112.439::DOUBLE) / 256.0 + 128 + 0.5)::INTEGER AS u, floor((r * 112.439::DOUBLE + g * -94.154::DOUBLE + b * -18.285::DOUBLE) / 256.0 + 128 + 0.5)::INTEGER AS v FROM rgb""",
    "rgb",
)
_far = ", ".join(f"{{'d': (r - {r}) * (r - {r}) + (g - {gg}) * (g - {gg}) + (b - {b}) * (b - {b}), 'i': {i}}}" for i, (r, gg, b) in enumerate(PALETTE))
_add("palette_nearest", lambda s, d: P.nearest_colour(rgb(s, d), PALETTE), f"SELECT image_id, y, x, (list_sort([{_far}])[1]).i::INTEGER AS v FROM rgb", "rgb")

# joins of two rasters
for _k, _e in (
    ("add", "least(255, a.v + b.v)"), ("subtract", "greatest(0, a.v - b.v)"), ("absdiff", "abs(a.v - b.v)"), ("min", "least(a.v, b.v)"), ("max", "greatest(a.v, b.v)"),
    ("and", "a.v & b.v"), ("or", "a.v | b.v"), ("xor", "xor(a.v, b.v)"), ("clear", "a.v & ~b.v"),
):
    _add(f"pixel_{_k}", lambda s, d, k=_k: P.combine(g(s, d), g2(s, d), k), f"SELECT image_id, y, x, ({_e})::INTEGER AS v FROM {JOIN}", "pix", "pix2")
_over = "CASE WHEN {} < 128 THEN (2 * a.v * b.v) // 255 ELSE 255 - (2 * (255 - a.v) * (255 - b.v)) // 255 END"
for _k, _e in (
    ("normal", "floor(a.v * 0.5::DOUBLE + b.v * 0.5::DOUBLE)"), ("multiply", "(a.v * b.v) // 255"), ("screen", "255 - ((255 - a.v) * (255 - b.v)) // 255"), ("overlay", _over.format("a.v")), ("hard_light", _over.format("b.v")),
):
    _add(f"blend_{_k}", lambda s, d, k=_k: P.blend(g(s, d), g2(s, d), k), f"SELECT image_id, y, x, ({_e})::INTEGER AS v FROM {JOIN}", "pix", "pix2")
_add("combine_masked", lambda s, d: P.combine_masked(g(s, d), g2(s, d), b1(s, d)), f"SELECT image_id, y, x, CASE WHEN m.v = 1 THEN b.v ELSE a.v END AS v FROM {JOIN} JOIN bin m USING (image_id, y, x)", "pix", "pix2", "bin")
_add(
    "compare_stats",
    _two(A.compare),
    f"""WITH j AS (SELECT image_id, a.v - b.v AS d FROM {JOIN}), m AS (SELECT image_id, count(*) FILTER (d <> 0) AS n_diff, max(abs(d)) AS max_diff, avg(abs(d)) AS ma, avg((d * d)::DOUBLE) AS mse FROM j GROUP BY 1)
    SELECT image_id, n_diff, max_diff, round(ma, 6) AS mean_abs, round(sqrt(mse), 6) AS rms, round(CASE WHEN mse = 0 THEN 1000.0 ELSE 10 * log10(65025.0 / mse) END, 6) AS psnr FROM m""",
    "pix", "pix2",
)
_add("masked_stats", lambda s, d: A.masked_stats(g2(s, d), b1(s, d)), "SELECT image_id, count(*) AS n, round(avg(v), 6) AS mean, min(v) AS low, max(v) AS high, round(var_pop(v), 4) AS var FROM pix2 p WHERE EXISTS (SELECT 1 FROM bin m WHERE m.v = 1 AND m.image_id = p.image_id AND m.y = p.y AND m.x = p.x) GROUP BY 1", "pix2", "bin")

# aggregates
_HIST = "h AS (SELECT i.image_id, t.v::INTEGER AS v, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT image_id FROM {0}) i CROSS JOIN range(0, 256) t(v) LEFT JOIN (SELECT image_id, v, count(*) AS n FROM {0} GROUP BY 1, 2) c ON c.image_id = i.image_id AND c.v = t.v)"
_add("gray_histogram", lambda s, d: A.histogram(g(s, d)), f"WITH {_HIST.format('pix')} SELECT image_id, v, n FROM h", "pix")
_add("small_histograms", lambda s, d: A.histogram(sm(s, d)), f"WITH {_HIST.format('small')} SELECT image_id, v, n FROM h", "small")
_OTSU = """{h}, c AS (SELECT image_id, v AS t, sum(n) OVER w AS nb, sum(v * n) OVER w AS sb, sum(n) OVER (PARTITION BY image_id) AS n, sum(v * n) OVER (PARTITION BY image_id) AS s FROM h WINDOW w AS (PARTITION BY image_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    o AS (SELECT image_id, t, round(CASE WHEN nb > 0 AND n - nb > 0 THEN (nb / n) * ((n - nb) / n) * (sb / nb - (s - sb) / (n - nb)) * (sb / nb - (s - sb) / (n - nb)) ELSE 0.0 END, 6) AS score FROM (SELECT image_id, t, nb::DOUBLE AS nb, sb::DOUBLE AS sb, n::DOUBLE AS n, s::DOUBLE AS s FROM c) WHERE t >= 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, t) AS k FROM o)"""
_add("otsu_threshold", lambda s, d: A.otsu(g(s, d)), "WITH " + _OTSU.format(h=_HIST.format("pix")) + " SELECT image_id, t, score FROM r WHERE k = 1", "pix")


def binarize_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, histogram, Otsu, binarise, foreground per row: the flagship."""
    from pyspark.sql import functions as F

    px = g(spark, sf_dir)
    t = A.otsu(px).select("image_id", "t")
    on = px.join(t, "image_id").withColumn("v", F.when(F.col("v") < F.col("t"), 1).otherwise(0))
    return A.profile(on, "y").select("image_id", "y", "n_fg")


_add("binarize_rowcount", binarize_rows, "WITH " + _OTSU.format(h=_HIST.format("pix")) + " SELECT p.image_id, p.y, count(*) FILTER (p.v < r.t) AS n_fg FROM pix p JOIN r ON r.image_id = p.image_id AND r.k = 1 GROUP BY 1, 2", "pix")
for _k in ("y", "x"):
    _add(f"profile_by_{_k}", lambda s, d, k=_k: A.profile(g(s, d), k), f"SELECT image_id, {_k}, count(*) FILTER (v <> 0) AS n_fg, round(avg(v), 6) AS mean, min(v) AS low, max(v) AS high FROM pix GROUP BY 1, 2", "pix")
_add("tile_stats", lambda s, d: A.tile_stats(g(s, d), 10, 15), "SELECT image_id, (y // 15)::INTEGER AS ty, (x // 10)::INTEGER AS tx, count(*) AS n, round(avg(v), 6) AS mean, round(avg(v * v) - avg(v) * avg(v), 4) AS var, min(v) AS low, max(v) AS high FROM pix GROUP BY 1, 2, 3", "pix")
_add(
    "quadtree_mean",
    lambda s, d: A.quadtree(g(s, d), 4),
    """WITH z AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM pix GROUP BY 1), q AS (SELECT p.image_id, l.level::INTEGER AS level, (1 << l.level) AS side, p.y, p.x, p.v, z.w, z.h FROM pix p JOIN z USING (image_id) CROSS JOIN range(0, 4) l(level)),
    c AS (SELECT image_id, level, greatest(0, (y * side + h - 2) // (h - 1) - 1)::INTEGER AS qy, greatest(0, (x * side + w - 2) // (w - 1) - 1)::INTEGER AS qx, v FROM q)
    SELECT image_id, level, qy, qx, count(*) AS n, round(avg(v), 6) AS mean, round(greatest(avg(v * v) - avg(v) * avg(v), 0.0), 4) AS var FROM c GROUP BY 1, 2, 3, 4""",
    "pix",
)
_add("max_location", lambda s, d: A.max_location(sm(s, d)), "WITH r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v DESC, y, x) AS k FROM small) SELECT image_id, v, CASE WHEN v = 0 THEN 4 ELSE y END AS y, CASE WHEN v = 0 THEN 4 ELSE x END AS x FROM r WHERE k = 1", "small")
_add("distinct_colors_topk", lambda s, d: A.top_colours(rgb(s, d), 20), "WITH n AS (SELECT image_id, r, g, b, count(*) AS n FROM rgb GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b)::INTEGER AS rank FROM n) SELECT * FROM k WHERE rank <= 20", "rgb")
_add("aligned_stats", lambda s, d: A.aligned_stats(sm(s, d)), "SELECT y, x, count(*) AS n, round(avg(v), 6) AS mean, min(v) AS low, max(v) AS high FROM small GROUP BY 1, 2", "small")

# neighbourhoods
_PAD = "z AS (SELECT image_id, max(x) AS mx, max(y) AS my FROM {0} GROUP BY 1), "
_add(
    "convolve3x3_mirror",
    lambda s, d: N.convolve3(g(s, d), KERNEL),
    "WITH "
    + _PAD.format("pix")
    + f"k AS (SELECT * FROM (VALUES {', '.join(f'({dy - 1}, {dx - 1}, {w}::DOUBLE)' for dy, r in enumerate(KERNEL) for dx, w in enumerate(r))}) t(dy, dx, w)), "
    "s AS (SELECT p.image_id, p.y, p.x, least(greatest(p.y + dy, 0), my) AS sy, least(greatest(p.x + dx, 0), mx) AS sx, w FROM pix p JOIN z USING (image_id) CROSS JOIN k) "
    "SELECT s.image_id, s.y, s.x, (floor(abs(sum(s.w * p.v)) + 0.5) % 256)::INTEGER AS v FROM s JOIN pix p ON p.image_id = s.image_id AND p.y = s.sy AND p.x = s.sx GROUP BY 1, 2, 3",
    "pix",
)
_SOBEL = [(-1, -1, -1, 1), (-1, 0, 0, 2), (-1, 1, 1, 1), (0, -1, -2, 0), (0, 1, 2, 0), (1, -1, -1, -1), (1, 0, 0, -2), (1, 1, 1, -1)]
_add(
    "sobel_edges",
    lambda s, d: N.gradient_edges(g(s, d)),
    "WITH " + _PAD.format("pix") + f"k AS (SELECT * FROM (VALUES {', '.join(map(str, _SOBEL))}) t(dy, dx, gx, gy)), "
    "s AS (SELECT p.image_id, p.y, p.x, least(greatest(p.y + dy, 0), my) AS sy, least(greatest(p.x + dx, 0), mx) AS sx, gx, gy FROM pix p JOIN z USING (image_id) CROSS JOIN k) "
    "SELECT s.image_id, s.y, s.x, least((abs(sum(s.gx * p.v)) + abs(sum(s.gy * p.v))) // 8, 255)::INTEGER AS v FROM s JOIN pix p ON p.image_id = s.image_id AND p.y = s.sy AND p.x = s.sx GROUP BY 1, 2, 3",
    "pix",
)
_BOX = "SELECT {0}.image_id, {0}.y, {0}.x, {1} FROM {0} {0} JOIN {0} q ON q.image_id = {0}.image_id AND q.y BETWEEN {0}.y - {3} AND {0}.y + {5} AND q.x BETWEEN {0}.x - {2} AND {0}.x + {4} GROUP BY 1, 2, 3"


def _win(table: str, value: str, l: int, t: int, r: int, b: int) -> str:  # noqa: E741
    """value aggregated over the window l, t, r, b around each pixel, by an equi-join on shifted places."""
    return f"SELECT p.image_id, p.y, p.x, {value} FROM {table} p CROSS JOIN range(-{t}, {b} + 1) dy(j) CROSS JOIN range(-{l}, {r} + 1) dx(i) LEFT JOIN {table} q ON q.image_id = p.image_id AND q.y = p.y + dy.j AND q.x = p.x + dx.i GROUP BY 1, 2, 3"


_add("windowed_mean_zero_border", lambda s, d: N.windowed_mean(g(s, d), 3, 2), _win("pix", "least(255, floor(sum(coalesce(q.v, 0)) / 35.0::DOUBLE + 0.5))::INTEGER AS v", 3, 2, 3, 2), "pix")
_add("windowed_variance", lambda s, d: N.windowed_variance(g(s, d), 1, 1), _win("pix", "round(sum(coalesce(q.v * q.v, 0)) / 9.0::DOUBLE - (sum(coalesce(q.v, 0)) / 9.0::DOUBLE) * (sum(coalesce(q.v, 0)) / 9.0::DOUBLE), 4) AS var", 1, 1, 1, 1), "pix")
_add("adaptive_threshold", lambda s, d: N.adaptive_threshold(g(s, d), 2, 2, 5), _win("pix", "CASE WHEN any_value(p.v) < avg(q.v) - 5 THEN 1 ELSE 0 END AS v", 2, 2, 2, 2), "pix")
_add("sauvola", lambda s, d: N.sauvola(g(s, d), 2, 0.34), "WITH m AS (" + _win("pix", "any_value(p.v) AS v, avg(q.v) AS m, sqrt(greatest(avg(q.v * q.v) - avg(q.v) * avg(q.v), 0.0)) AS s", 2, 2, 2, 2) + ") SELECT image_id, y, x, CASE WHEN v < round(m * (1 + 0.34::DOUBLE * (s / 128.0 - 1)), 9) THEN 1 ELSE 0 END AS v FROM m", "pix")
_add(
    "rank3x3_replicate",
    lambda s, d: N.rank_filter(g(s, d), 3, 3, 0.5),
    "WITH " + _PAD.format("pix") + "s AS (SELECT p.image_id, p.y, p.x, least(greatest(p.y + j, 0), my) AS sy, least(greatest(p.x + i, 0), mx) AS sx FROM pix p JOIN z USING (image_id) CROSS JOIN range(-1, 2) a(j) CROSS JOIN range(-1, 2) b(i)) "
    "SELECT s.image_id, s.y, s.x, (list(q.v ORDER BY q.v))[5] AS v FROM s JOIN pix q ON q.image_id = s.image_id AND q.y = s.sy AND q.x = s.sx GROUP BY 1, 2, 3",
    "pix",
)
_DIL = _win("bin", "max(coalesce(q.v, 0)) AS v", 1, 1, 1, 1)
_ERO = _win("bin", "min(coalesce(q.v, 0)) AS v", 1, 1, 1, 1)
_add("dilate_brick", lambda s, d: N.dilate(b1(s, d), 3, 3), _DIL, "bin")
_add("erode_brick", lambda s, d: N.erode(b1(s, d), 3, 3), _ERO, "bin")
_add("open_brick", lambda s, d: N.opened(b1(s, d), 3, 3), f"WITH e AS ({_ERO}) " + _win("e", "max(coalesce(q.v, 0)) AS v", 1, 1, 1, 1), "bin")
_add("close_brick", lambda s, d: N.closed(b1(s, d), 3, 3), f"WITH e AS ({_DIL}) " + _win("e", "min(coalesce(q.v, 0)) AS v", 1, 1, 1, 1), "bin")
_add("morph_sequence", lambda s, d: N.sequence(b1(s, d), "d3.1 + e1.3 + r2"), f"WITH a AS ({_win('bin', 'max(coalesce(q.v, 0)) AS v', 1, 0, 1, 0)}), e AS ({_win('a', 'min(coalesce(q.v, 0)) AS v', 0, 1, 0, 1)}) SELECT image_id, (y // 2)::INTEGER AS y, (x // 2)::INTEGER AS x, CASE WHEN sum(v) >= 2 THEN 1 ELSE 0 END AS v FROM e GROUP BY 1, 2, 3", "bin")
_add("gray_open", lambda s, d: N.gray_opened(g(s, d), 3, 3), f"WITH e AS ({_win('pix', 'min(q.v) AS v', 1, 1, 1, 1)}) " + _win("e", "max(q.v) AS v", 1, 1, 1, 1), "pix")
_add("gray_tophat", lambda s, d: N.tophat(g(s, d), 3, 3), f"WITH e AS ({_win('pix', 'min(q.v) AS v', 1, 1, 1, 1)}), o AS ({_win('e', 'max(q.v) AS v', 1, 1, 1, 1)}) SELECT image_id, y, x, greatest(0, p.v - o.v) AS v FROM pix p JOIN o USING (image_id, y, x)", "pix")
_add("gray_gradient", lambda s, d: N.gradient(g(s, d), 3, 3), f"WITH o AS ({_win('pix', 'max(q.v) AS v', 1, 1, 1, 1)}) SELECT image_id, y, x, greatest(0, o.v - p.v) AS v FROM pix p JOIN o USING (image_id, y, x)", "pix")
_add("hmt", lambda s, d: N.hit_miss(b1(s, d), [(0, 0), (0, 1)], [(-1, 0), (0, -1)]), "SELECT image_id, y, x, CASE WHEN v = 1 AND coalesce((SELECT q.v FROM bin q WHERE q.image_id = p.image_id AND q.y = p.y AND q.x = p.x + 1), 0) = 1 AND coalesce((SELECT q.v FROM bin q WHERE q.image_id = p.image_id AND q.y = p.y - 1 AND q.x = p.x), 1) = 0 AND coalesce((SELECT q.v FROM bin q WHERE q.image_id = p.image_id AND q.y = p.y AND q.x = p.x - 1), 1) = 0 THEN 1 ELSE 0 END AS v FROM bin p", "bin")
_add("rank_reduce2", lambda s, d: N.rank_reduce(b1(s, d), 2), "SELECT image_id, (y // 2)::INTEGER AS y, (x // 2)::INTEGER AS x, CASE WHEN sum(v) >= 2 THEN 1 ELSE 0 END AS v FROM bin GROUP BY 1, 2, 3", "bin")

# geometry
_SIZE = "z AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM pix GROUP BY 1)"
_add("rotate_orth90", lambda s, d: G.turn(g(s, d), 1), f"WITH {_SIZE} SELECT image_id, x AS y, h - 1 - y AS x, v FROM pix JOIN z USING (image_id)", "pix")
_add("rotate_orth180", lambda s, d: G.turn(g(s, d), 2), f"WITH {_SIZE} SELECT image_id, h - 1 - y AS y, w - 1 - x AS x, v FROM pix JOIN z USING (image_id)", "pix")
_add("flip_lr", lambda s, d: G.flip(g(s, d), "x"), f"WITH {_SIZE} SELECT image_id, y, w - 1 - x AS x, v FROM pix JOIN z USING (image_id)", "pix")
_add("translate", lambda s, d: G.translate(g(s, d), 7, -3, 255), "SELECT p.image_id, p.y, p.x, coalesce(q.v, 255) AS v FROM pix p LEFT JOIN pix q ON q.image_id = p.image_id AND q.y = p.y + 3 AND q.x = p.x - 7", "pix")
_add("affine_sampled", lambda s, d: G.affine_sampled(g(s, d), 0.9, 0.1, 2.0, -0.1, 0.95, 3.0), "WITH m AS (SELECT image_id, y, x, trunc(x * 0.9::DOUBLE + y * 0.1::DOUBLE + 2.0::DOUBLE + 0.5)::INTEGER AS sx, trunc(x * -0.1::DOUBLE + y * 0.95::DOUBLE + 3.0::DOUBLE + 0.5)::INTEGER AS sy FROM pix) SELECT m.image_id, m.y, m.x, coalesce(q.v, 255) AS v FROM m LEFT JOIN pix q ON q.image_id = m.image_id AND q.y = m.sy AND q.x = m.sx", "pix")
_add("shear_rows", lambda s, d: G.shear_rows(g(s, d), 0.05), f"WITH {_SIZE}, t AS (SELECT image_id, y, (x + floor((y - h // 2) * 0.05::DOUBLE + 0.5))::INTEGER AS tx, v FROM pix JOIN z USING (image_id)) SELECT p.image_id, p.y, p.x, coalesce(t.v, 0) AS v FROM pix p LEFT JOIN t ON t.image_id = p.image_id AND t.y = p.y AND t.tx = p.x", "pix")
_add("scale_areamap2", lambda s, d: G.half_by_mean(g(s, d)), "SELECT image_id, (y // 2)::INTEGER AS y, (x // 2)::INTEGER AS x, (sum(v) // 4)::INTEGER AS v FROM pix GROUP BY 1, 2, 3 HAVING count(*) = 4", "pix")
_add("scale_min_max", lambda s, d: G.reduce_extreme(g(s, d), 4, 2, True), "SELECT image_id, (y // 2)::INTEGER AS y, (x // 4)::INTEGER AS x, max(v) AS v FROM pix GROUP BY 1, 2, 3", "pix")
_add("crop_rectangle", lambda s, d: G.crop(g(s, d), 10, 3, 40, 30), "SELECT image_id, y - 3 AS y, x - 10 AS x, v FROM pix WHERE x >= 10 AND x < 50 AND y >= 3 AND y < 33", "pix")
_add("mirrored_border", lambda s, d: G.mirrored_border(g(s, d), 2), f"WITH {_SIZE}, b AS (SELECT image_id, unnest(range(-2, h + 2)) AS ty, w, h FROM z), c AS (SELECT image_id, ty, unnest(range(-2, w + 2)) AS tx, w, h FROM b), s AS (SELECT image_id, ty, tx, CASE WHEN ty < 0 THEN -1 - ty WHEN ty >= h THEN 2 * h - 1 - ty ELSE ty END AS sy, CASE WHEN tx < 0 THEN -1 - tx WHEN tx >= w THEN 2 * w - 1 - tx ELSE tx END AS sx FROM c) SELECT s.image_id, (ty + 2)::INTEGER AS y, (tx + 2)::INTEGER AS x, p.v FROM s JOIN pix p ON p.image_id = s.image_id AND p.y = sy AND p.x = sx", "pix")

# sequences
na = D.numa
_MIRROR = "n AS (SELECT set_id, max(i) + 1 AS n FROM numa GROUP BY 1), m AS (SELECT set_id, n, unnest([i] || CASE WHEN i < 3 THEN [-1 - i] ELSE [] END || CASE WHEN i >= n - 3 THEN [2 * n - 1 - i] ELSE [] END) AS i, v FROM numa JOIN n USING (set_id))"
_W3 = "WINDOW w AS (PARTITION BY set_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
_add("numa_windowed_stats", lambda s, d: S.windowed_stats(na(s, d), 3), f"WITH {_MIRROR}, k AS (SELECT set_id, i, n, avg(v) OVER w AS m, avg(v * v) OVER w AS s FROM m {_W3}) SELECT set_id, i, round(m, 6) AS mean, round(s, 4) AS mean_square, round(s - m * m, 4) AS var FROM k WHERE i >= 0 AND i < n", "numa")
_add("numa_windowed_median", lambda s, d: S.windowed_median(na(s, d), 3), f"WITH {_MIRROR}, k AS (SELECT set_id, i, n, list_sort(list(v) OVER w)[4] AS median FROM m {_W3}) SELECT set_id, i, median FROM k WHERE i >= 0 AND i < n", "numa")
for _k, _b in (("dilate", True), ("erode", False)):
    _add(f"numa_{_k}", lambda s, d, b=_b: S.extreme_filter(na(s, d), 6, b), f"SELECT set_id, i, {'max' if _b else 'min'}(v) OVER (PARTITION BY set_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS v FROM numa", "numa")
_add("numa_deltas", lambda s, d: S.deltas(na(s, d)), "WITH k AS (SELECT set_id, i, round(v - lag(v) OVER (PARTITION BY set_id ORDER BY i), 6) AS v FROM numa) SELECT * FROM k WHERE v IS NOT NULL", "numa")
_add("numa_partial_sums", lambda s, d: S.partial_sums(na(s, d)), "SELECT set_id, i, round(sum(v) OVER (PARTITION BY set_id ORDER BY i ROWS UNBOUNDED PRECEDING), 4) AS v FROM numa", "numa")
_add("numa_crossings", lambda s, d: S.crossings(na(s, d), 100.0), "WITH k AS (SELECT set_id, i, lag(v) OVER (PARTITION BY set_id ORDER BY i) - 100.0::DOUBLE AS a, v - 100.0::DOUBLE AS b FROM numa) SELECT set_id, round(i - 1 + abs(a) / (abs(a) + abs(b)), 6) AS at FROM k WHERE a * b < 0", "numa")
_RANK = "k AS (SELECT set_id, v, row_number() OVER (PARTITION BY set_id ORDER BY v, i) - 1 AS r, count(*) OVER (PARTITION BY set_id) AS n FROM numa)"
_add("numa_rank_value", lambda s, d: S.rank_value(na(s, d), 0.9), f"WITH {_RANK} SELECT set_id, v AS rank_value FROM k WHERE r = floor(0.9::DOUBLE * (n - 1) + 0.5)", "numa")
_add("numa_mean_deviation", lambda s, d: S.mean_deviation(na(s, d)), f"WITH {_RANK}, m AS (SELECT set_id, v AS m FROM k WHERE r = floor(0.5 * (n - 1) + 0.5)) SELECT set_id, round(avg(abs(v - m)), 6) AS mean_dev FROM numa JOIN m USING (set_id) GROUP BY 1", "numa")
_add("numa_mode", lambda s, d: S.mode(na(s, d)), "WITH c AS (SELECT set_id, v, count(*) AS n FROM numa GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY n DESC, v DESC) AS r FROM c) SELECT set_id, v AS mode, n FROM k WHERE r = 1", "numa")
_add("numa_histogram_auto", lambda s, d: S.histogram_auto(na(s, d), 25), "WITH e AS (SELECT set_id, min(v) AS lo, max(v) AS hi FROM numa GROUP BY 1) SELECT set_id, least(24, floor((v - lo) / ((hi - lo) / 25)))::INTEGER AS bin, count(*) AS n FROM numa JOIN e USING (set_id) GROUP BY 1, 2", "numa")
_add("numa_equal_population_bins", lambda s, d: S.equal_population(na(s, d), 7), f"WITH {_RANK}, b AS (SELECT k.set_id, t.b::INTEGER AS bin, k.v FROM k CROSS JOIN range(0, 7) t(b) WHERE k.r >= (k.n * t.b) // 7 AND k.r < (k.n * (t.b + 1)) // 7) SELECT set_id, bin, count(*) AS n, round(avg(v), 6) AS mean FROM b GROUP BY 1, 2", "numa")
_add("numa_simple_stats", lambda s, d: S.simple_stats(na(s, d)), "SELECT set_id, count(*) AS n, min(v) AS low, max(v) AS high, round(avg(v), 6) AS mean, round(avg(v * v) - avg(v) * avg(v), 3) AS var, round(sum(v), 3) AS total FROM numa GROUP BY 1", "numa")
_add("numa_nonzero_runs", lambda s, d: S.nonzero_runs(na(s, d), 50.0), "WITH o AS (SELECT set_id, i, i - row_number() OVER (PARTITION BY set_id ORDER BY i) AS g FROM numa WHERE v > 50.0) SELECT set_id, min(i) AS first, max(i) AS last, count(*) AS n FROM o GROUP BY set_id, g", "numa")
_add("numa_smoothed_pairs", lambda s, d: S.smoothed_pairs(na(s, d), 2), "WITH k AS (SELECT set_id, i, list_sort(list(v) OVER (PARTITION BY set_id, i % 2 ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS l FROM numa) SELECT set_id, i, l[len(l) // 2 + 1] AS median FROM k", "numa")


def _class_histograms(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    return A.histogram(sm(s, d).withColumn("image_id", F.col("label").cast("long"))).select(F.col("image_id").alias("set_id"), F.col("v").alias("i"), "n")


_add(
    "numa_emd",
    lambda s, d: S.earth_mover(_class_histograms(s, d)),
    "WITH cl AS (SELECT label::BIGINT AS image_id, v FROM small), " + _HIST.format("cl") + ", c AS (SELECT image_id, v, sum(n) OVER (PARTITION BY image_id ORDER BY v ROWS UNBOUNDED PRECEDING)::DOUBLE / sum(n) OVER (PARTITION BY image_id)::DOUBLE AS c FROM h) "
    "SELECT a.image_id AS set_a, b.image_id AS set_b, round(sum(abs(a.c - b.c)), 6) AS emd FROM c a JOIN c b ON a.v = b.v AND a.image_id < b.image_id GROUP BY 1, 2",
    "small",
)
_RUNS = "o AS (SELECT image_id, y, x, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM bin WHERE v = 1), r AS (SELECT image_id, y, min(x) AS x0, max(x) AS x1 FROM o GROUP BY image_id, y, g)"
_add("run_lengths", lambda s, d: S.row_runs(b1(s, d)), f"WITH {_RUNS} SELECT * FROM r", "bin")
_add("longest_runs", lambda s, d: S.longest_runs(b1(s, d)), f"WITH {_RUNS} SELECT image_id, y, max(x1 - x0 + 1) AS longest, count(*) AS n_runs FROM r GROUP BY 1, 2", "bin")

# points
_add("pta_linear_lsf", lambda s, d: T.linear_fit(D.points(s, d)), "SELECT set_id, count(*) AS n, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 2) AS intercept FROM pt GROUP BY 1", "pt")
_add("pta_origin_lsf", lambda s, d: T.origin_fit(D.points(s, d)), "SELECT set_id, round(sum(x * y) / sum(x * x), 4) AS slope FROM pt GROUP BY 1", "pt")
_add(
    "pta_quadratic_lsf",
    lambda s, d: T.quadratic_fit(D.points(s, d)),
    """WITH m AS (SELECT set_id, avg(x) AS mx, avg(y) AS my FROM pt GROUP BY 1), d AS (SELECT set_id, mx, my, x - mx AS u, y - my AS w FROM pt JOIN m USING (set_id)),
    s AS (SELECT set_id, mx, my, avg(u * u) AS s2, avg(u * u * u) AS s3, avg(u * u * u * u) AS s4, avg(u * w) AS t1, avg(u * u * w) AS t2 FROM d GROUP BY 1, 2, 3),
    q AS (SELECT *, (t2 * s2 - t1 * s3) / (s4 * s2 - s3 * s3 - s2 * s2 * s2) AS a FROM s), b AS (SELECT *, (t1 - a * s3) / s2 AS bu FROM q)
    SELECT set_id, round(a, 4) AS a, round(bu - 2 * a * mx, 2) AS b, round(my - a * s2 - bu * mx + a * mx * mx, 0) AS c FROM b""",
    "pt",
)
_add(
    "pta_noisy_lsf",
    lambda s, d: T.refit(D.points(s, d), 3.0),
    """WITH f AS (SELECT set_id, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM pt GROUP BY 1), e AS (SELECT set_id, x, y, round(abs(y - a * x - b), 4) AS e FROM pt JOIN f USING (set_id)),
    r AS (SELECT set_id, e, row_number() OVER (PARTITION BY set_id ORDER BY e) - 1 AS k, count(*) OVER (PARTITION BY set_id) AS n FROM e), m AS (SELECT set_id, e AS med FROM r WHERE k = floor((n - 1) * 0.5 + 0.5))
    SELECT set_id, count(*) AS n, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 2) AS intercept FROM e JOIN m USING (set_id) WHERE e.e <= 3.0 * m.med GROUP BY 1""",
    "pt",
)

# boxes
bx = D.boxes
_add("box_extent", lambda s, d: B.extent(bx(s, d)), "SELECT set_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM box GROUP BY 1", "box")
_add("box_coverage_approx", lambda s, d: B.coverage(bx(s, d), 2000, 3000), "SELECT set_id, round(least(sum(w::BIGINT * h) / 6000000.0::DOUBLE, 1.0), 6) AS coverage, count(*) AS n FROM box GROUP BY 1", "box")
_add("box_size_select", lambda s, d: B.select_by_size(bx(s, d), 30, 20, True, ">="), "SELECT * FROM box WHERE w >= 30 AND h >= 20", "box")
_add("box_overlap_join", lambda s, d: B.overlaps(bx(s, d)), "SELECT a.set_id, a.i, b.i AS j, ((least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)))::INTEGER AS area FROM box a JOIN box b ON a.set_id = b.set_id AND a.i < b.i AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h", "box")
_add("box_contained", lambda s, d: B.contained(bx(s, d), 300, 400, 900, 1200), "SELECT * FROM box WHERE x >= 300 AND y >= 400 AND x + w <= 1200 AND y + h <= 1600", "box")
_add("box_clipped", lambda s, d: B.clipped(bx(s, d), 300, 400, 900, 1200), "SELECT set_id, i, greatest(x, 300) AS x, greatest(y, 400) AS y, least(x + w, 1200) - greatest(x, 300) AS w, least(y + h, 1600) - greatest(y, 400) AS h FROM box WHERE x < 1200 AND x + w > 300 AND y < 1600 AND y + h > 400", "box")
_add("box_nearest_point", lambda s, d: B.nearest(bx(s, d), 1000, 1500), "WITH q AS (SELECT set_id, i, (2 * x + w - 2000)::BIGINT ** 2 + (2 * y + h - 3000)::BIGINT ** 2 AS d FROM box), k AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY d, i) AS r FROM q) SELECT set_id, i, round(sqrt(d / 4.0), 6) AS distance FROM k WHERE r = 1", "box")
_add("box_sort", lambda s, d: B.ranked(bx(s, d), "y", "x"), "SELECT *, (row_number() OVER (PARTITION BY set_id ORDER BY y, x, i) - 1)::INTEGER AS place FROM box", "box")
_add("box_size_histogram", lambda s, d: B.size_histogram(bx(s, d)), "SELECT set_id, w, h, count(*) AS n FROM box GROUP BY 1, 2, 3", "box")
_add("box_transform", lambda s, d: B.transformed(bx(s, d), 0.5, 1.25, 3, -2), "SELECT set_id, i, floor((x + 3) * 0.5::DOUBLE + 0.5)::INTEGER AS x, floor((y - 2) * 1.25::DOUBLE + 0.5)::INTEGER AS y, greatest(1, floor(w * 0.5::DOUBLE + 0.5)::INTEGER) AS w, greatest(1, floor(h * 1.25::DOUBLE + 0.5)::INTEGER) AS h FROM box", "box")

# strings
_odd = "o AS (SELECT set_id - 1 AS set_id, i, s FROM sarray WHERE set_id % 2 = 1), e AS (SELECT * FROM sarray WHERE set_id % 2 = 0)"


def _pairs(f):
    """f on each even document's words and those of the document after it."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from pyspark.sql import functions as F

        sa = D.strings(spark, sf_dir)
        return f(sa.where("set_id % 2 = 0"), sa.where("set_id % 2 = 1").withColumn("set_id", F.col("set_id") - 1))

    return query


_add("sarray_split_words", D.strings, "SELECT * FROM sarray", "sarray")
_add("sarray_unique", lambda s, d: W.unique(D.strings(s, d)), "SELECT set_id, s, min(i) AS first, count(*) AS n FROM sarray GROUP BY 1, 2", "sarray")
_add("sarray_intersection", _pairs(W.intersection), f"WITH {_odd} SELECT set_id, s, min(i) AS first FROM e WHERE EXISTS (SELECT 1 FROM o WHERE o.set_id = e.set_id AND o.s = e.s) GROUP BY 1, 2", "sarray")
_add("sarray_difference", _pairs(W.difference), f"WITH {_odd} SELECT set_id, s, min(i) AS first FROM e WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.set_id = e.set_id AND o.s = e.s) GROUP BY 1, 2", "sarray")
_add("sarray_union", _pairs(W.union), f"WITH {_odd}, b AS (SELECT set_id, s, 0 AS o, i FROM e UNION ALL SELECT set_id, s, 1, i FROM o), f AS (SELECT set_id, s, min(o * 1000000000::BIGINT + i) AS f FROM b GROUP BY 1, 2) SELECT set_id, s, (row_number() OVER (PARTITION BY set_id ORDER BY f) - 1)::INTEGER AS place FROM f", "sarray")
_add("sarray_join", lambda s, d: W.joined(D.strings(s, d), "_"), "SELECT set_id, string_agg(s, '_' ORDER BY i) AS text FROM sarray GROUP BY 1", "sarray")
_add("sarray_contains", lambda s, d: W.containing(D.strings(s, d), "tion"), "SELECT * FROM sarray WHERE contains(s, 'tion')", "sarray")

# regions: labels by a recursive closure on the small rasters
_CC = """WITH RECURSIVE f AS (SELECT image_id, y, x, y * 8 + x AS p FROM small WHERE v < 128),
    c(image_id, p, root) AS (SELECT image_id, p, p FROM f UNION SELECT c.image_id, q.p, c.root FROM c JOIN f a ON a.image_id = c.image_id AND a.p = c.p JOIN f q ON q.image_id = a.image_id AND abs(q.y - a.y) + abs(q.x - a.x) = 1),
    l AS (SELECT image_id, p, min(root) AS root FROM c GROUP BY 1, 2), n AS (SELECT *, dense_rank() OVER (PARTITION BY image_id ORDER BY root)::INTEGER AS label FROM l)"""
_small_bin = lambda s, d: P.threshold(sm(s, d).drop("label"), 128)
_add("conncomp_label_stats", lambda s, d: C.components(_small_bin(s, d)), _CC + " SELECT n.image_id, label, count(*) AS area, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM n JOIN f ON f.image_id = n.image_id AND f.p = n.p GROUP BY 1, 2", "small")
_add("conncomp_labels", lambda s, d: C.label_pixels(_small_bin(s, d)), _CC + " SELECT n.image_id, y, x, label FROM n JOIN f ON f.image_id = n.image_id AND f.p = n.p", "small")
_add("conncomp_raster", lambda s, d: C.components(_small_bin(s, d), 8), _CC.replace("abs(q.y - a.y) + abs(q.x - a.x) = 1", "greatest(abs(q.y - a.y), abs(q.x - a.x)) = 1") + " SELECT n.image_id, label, count(*) AS area, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM n JOIN f ON f.image_id = n.image_id AND f.p = n.p GROUP BY 1, 2", "small")
_MARKED = " SELECT s.image_id, s.y, s.x, {} AS v FROM small s LEFT JOIN n ON n.image_id = s.image_id AND n.p = s.y * 8 + s.x LEFT JOIN b ON b.image_id = n.image_id AND b.root = n.root"
_add("select_components", lambda s, d: C.select_components(_small_bin(s, d), 4), _CC + ", b AS (SELECT image_id, root FROM n GROUP BY 1, 2 HAVING count(*) >= 4)" + _MARKED.format("(b.root IS NOT NULL)::INTEGER"), "small")
_add("fill_holes", lambda s, d: C.fill_holes(_small_bin(s, d)), _CC.replace("v < 128", "v >= 128") + ", b AS (SELECT DISTINCT image_id, root FROM n WHERE p < 8 OR p >= 56 OR p % 8 IN (0, 7))" + _MARKED.format("(b.root IS NULL)::INTEGER"), "small")
_add("seedfill", lambda s, d: C.seedfill(N.erode(_small_bin(s, d), 2, 2), _small_bin(s, d)), _CC + ", b AS (SELECT DISTINCT n.image_id, n.root FROM n WHERE p >= 8 AND p % 8 > 0 AND (SELECT count(*) FROM f WHERE f.image_id = n.image_id AND f.p IN (n.p - 1, n.p - 8, n.p - 9)) = 3)" + _MARKED.format("(b.root IS NOT NULL)::INTEGER"), "small")
_add("distance_function", lambda s, d: FL.distance(_small_bin(s, d)))
_add("watershed", lambda s, d: FL.watershed(sm(s, d)))
_add("gray_maze", lambda s, d: FL.maze_costs(sm(s, d)))
_add("dither_binary", lambda s, d: FL.dither(sm(s, d)))
_add("thin", lambda s, d: FL.thin(_small_bin(s, d)))

# recognition
_DEG = list(range(-7, 8))
_TAN = ", ".join(f"({k}, {__import__('math').tan(__import__('math').radians(k))!r}::DOUBLE)" for k in _DEG)
_add(
    "skew_score_sweep",
    lambda s, d: R.skew_scores(b1(s, d), _DEG),
    f"""WITH a AS (SELECT * FROM (VALUES {_TAN}) t(deg, t)), n AS (SELECT image_id, deg, floor(y + x * t + 0.5)::BIGINT AS r, count(*) AS n FROM bin CROSS JOIN a WHERE v = 1 GROUP BY 1, 2, 3),
    e AS (SELECT image_id, deg, unnest(range(min(r), max(r) + 2)) AS r FROM n GROUP BY 1, 2), f AS (SELECT e.image_id, e.deg, e.r, coalesce(n.n, 0) AS n FROM e LEFT JOIN n USING (image_id, deg, r)),
    d AS (SELECT image_id, deg, n - coalesce(lag(n) OVER (PARTITION BY image_id, deg ORDER BY r), 0) AS d FROM f) SELECT image_id, deg, sum(d * d)::BIGINT AS score FROM d GROUP BY 1, 2""",
    "bin",
)
_TPL = "t AS (SELECT label, y, x, floor(avg(v) + 0.5)::INTEGER AS t FROM small GROUP BY 1, 2, 3)"
_add("template_match", lambda s, d: R.best_template(sm(s, d)), f"WITH {_TPL}, q AS (SELECT s.image_id, t.label AS cls, sum(abs(s.v - t.t))::BIGINT AS d FROM small s JOIN t USING (y, x) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY d, cls) AS r FROM q) SELECT image_id, cls, d AS distance FROM k WHERE r = 1", "small")
_add(
    "correlation_scores",
    lambda s, d: R.overlap_scores(sm(s, d), 128),
    f"""WITH {_TPL}, j AS (SELECT image_id, (v < 128)::INTEGER AS a, (t < 128)::INTEGER AS b FROM small JOIN t USING (label, y, x)), s AS (SELECT image_id, sum(a * b)::DOUBLE AS m, sum(a)::DOUBLE AS na, sum(b)::DOUBLE AS nb FROM j GROUP BY 1)
    SELECT image_id, round(CASE WHEN na * nb > 0 THEN m * m / (na * nb) ELSE 0.0 END, 6) AS score, round(CASE WHEN na + nb > 0 THEN m * 2 / (na + nb) ELSE 0.0 END, 6) AS dice, round(CASE WHEN na + nb - m > 0 THEN m / (na + nb - m) ELSE 0.0 END, 6) AS jaccard FROM s""",
    "small",
)
_add("jb_leader_classes", lambda s, d: R.leader_classes(sm(s, d), 128, 0.8))

# formats: encoded and decoded again
for _k in ("pnm", "bmp", "png", "gif", "spix", "tiff"):
    _add(f"roundtrip_{_k}", lambda s, d, k=_k: I.pixels(I.encode(sm(s, d), k)), "SELECT image_id, y, x, v FROM small", "small")
_add("box_lines", lambda s, d: I.box_lines(bx(s, d)), "SELECT set_id, i, '  Box[' || i || ']: x = ' || x || ', y = ' || y || ', w = ' || w || ', h = ' || h AS line FROM box UNION ALL SELECT set_id, -1, chr(10) || 'Boxa Version 2' || chr(10) || 'Number of boxes = ' || count(*) FROM box GROUP BY 1", "box")

# enhancement and colour
_CUM = "{h}, s AS (SELECT image_id, v, sum(n) OVER (PARTITION BY image_id ORDER BY v ROWS UNBOUNDED PRECEDING)::DOUBLE / sum(n) OVER (PARTITION BY image_id)::DOUBLE AS share FROM h)"
_add("equalise", lambda s, d: E.equalise(g(s, d)), "WITH " + _CUM.format(h=_HIST.format("pix")) + " SELECT p.image_id, p.y, p.x, floor(s.share * 255 + 0.5)::INTEGER AS v FROM pix p JOIN s USING (image_id, v)", "pix")
_add("contrast_stretch", lambda s, d: E.stretch(g(s, d), 0.05, 0.95), "WITH " + _CUM.format(h=_HIST.format("pix")) + ", e AS (SELECT image_id, min(v) FILTER (share >= 0.05::DOUBLE) AS lo, min(v) FILTER (share >= 0.95::DOUBLE) AS hi FROM s GROUP BY 1) SELECT image_id, y, x, greatest(0, least(255, floor((v - lo) * 255.0::DOUBLE / greatest(hi - lo, 1) + 0.5)))::INTEGER AS v FROM pix JOIN e USING (image_id)", "pix")
_add(
    "background_norm",
    lambda s, d: E.normalise_background(g(s, d), 10, 15, 60, 40, 200),
    """WITH a AS (SELECT *, y // 15 AS ty, x // 10 AS tx FROM pix), t AS (SELECT image_id, ty, tx, count(*) FILTER (v >= 60) AS n, sum(v) FILTER (v >= 60) AS s FROM a GROUP BY 1, 2, 3),
    b AS (SELECT image_id, ty, tx, CASE WHEN n >= 40 THEN floor(s::DOUBLE / n + 0.5)::INTEGER END AS bg FROM t),
    f AS (SELECT image_id, ty, tx, coalesce((SELECT arg_max(c.bg, c.ty) FROM b c WHERE c.image_id = b.image_id AND c.tx = b.tx AND c.ty <= b.ty AND c.bg IS NOT NULL), (SELECT arg_min(c.bg, c.ty) FROM b c WHERE c.image_id = b.image_id AND c.tx = b.tx AND c.ty > b.ty AND c.bg IS NOT NULL), 200) AS bg FROM b)
    SELECT image_id, y, x, least(255, (v * 200) // greatest(bg, 1))::INTEGER AS v FROM a JOIN f USING (image_id, ty, tx)""",
    "pix",
)
_MEAN2 = _win("pix", "any_value(p.v) AS v, floor(avg(q.v) + 0.5) AS m", 2, 2, 2, 2)
_add("block_mean", lambda s, d: E.block_mean(g(s, d), 2, 2), f"WITH m AS ({_MEAN2}) SELECT image_id, y, x, m::INTEGER AS v FROM m", "pix")
_add("unsharp_mask", lambda s, d: E.unsharp(g(s, d), 2, 0.5), f"WITH m AS ({_MEAN2}) SELECT image_id, y, x, greatest(0, least(255, floor(v + 0.5::DOUBLE * (v - m) + 0.5)))::INTEGER AS v FROM m", "pix")
_add("census_transform", lambda s, d: E.census(g(s, d), 2), f"WITH m AS ({_MEAN2}) SELECT image_id, y, x, (v > m)::INTEGER AS v FROM m", "pix")
_add(
    "bilateral",
    lambda s, d: E.bilateral(sm(s, d), 1, 1.5, 40.0, 4),
    """WITH s AS (SELECT p.image_id, p.y, p.x, p.v AS m, least(greatest(p.y + j, 0), 7) AS sy, least(greatest(p.x + i, 0), 7) AS sx, i, j FROM small p CROSS JOIN range(-1, 2) a(j) CROSS JOIN range(-1, 2) b(i)),
    k AS (SELECT s.image_id, s.y, s.x, q.v, exp(-(j * j + i * i)::DOUBLE / 4.5 - ((q.v - s.m) * (q.v - s.m))::DOUBLE / 3200.0) AS w FROM s JOIN small q ON q.image_id = s.image_id AND q.y = s.sy AND q.x = s.sx)
    SELECT image_id, y, x, least(255, floor(sum(w * v) / sum(w) + 0.5))::INTEGER AS v FROM k GROUP BY 1, 2, 3""",
    "small",
)
_OCT = " + ".join(f"((({c} >> {7 - k}) & 1) * {w * 8 ** (2 - k)})" for k in range(3) for c, w in (("r", 4), ("g", 2), ("b", 1)))
_add("octcube_quantise", lambda s, d: E.octcube_quantise(rgb(s, d), 3), f"WITH c AS (SELECT *, ({_OCT})::INTEGER AS cube FROM rgb), m AS (SELECT image_id, cube, floor(avg(r) + 0.5)::INTEGER AS qr, floor(avg(g) + 0.5)::INTEGER AS qg, floor(avg(b) + 0.5)::INTEGER AS qb FROM c GROUP BY 1, 2) SELECT image_id, y, x, cube, qr, qg, qb FROM c JOIN m USING (image_id, cube)", "rgb")
_add("median_cut", lambda s, d: E.median_cut(rgb(s, d), 16))


def _lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    r, gg, b = (F.col(c) for c in "rgb")
    parts = zip(("xx", "yy", "zz", "ll", "aa", "bb"), (*K.xyz(r, gg, b), *K.lab(r, gg, b)))
    return rgb(spark, sf_dir).select(*P.KEY, *(F.round(e, 4).alias(n) for n, e in parts))


_lin = "CASE WHEN {0} / 255.0::DOUBLE <= 0.04045 THEN {0} / 255.0::DOUBLE / 12.92 ELSE pow(({0} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"
_f = "CASE WHEN {0} > 216.0::DOUBLE / 24389 THEN cbrt({0}) ELSE ({0} * (24389.0::DOUBLE / 27) + 16) / 116 END"
_add(
    "xyz_lab",
    _lab,
    f"""WITH l AS (SELECT image_id, y, x, {_lin.format('r')} AS r, {_lin.format('g')} AS g, {_lin.format('b')} AS b FROM rgb),
    c AS (SELECT image_id, y, x, 0.4124::DOUBLE * r + 0.3576::DOUBLE * g + 0.1805::DOUBLE * b AS xx, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS yy, 0.0193::DOUBLE * r + 0.1192::DOUBLE * g + 0.9505::DOUBLE * b AS zz FROM l),
    n AS (SELECT *, xx / 0.95047::DOUBLE AS nx, zz / 1.08883::DOUBLE AS nz FROM c), f AS (SELECT *, {_f.format('nx')} AS fx, {_f.format('yy')} AS fy, {_f.format('nz')} AS fz FROM n)
    SELECT image_id, y, x, round(xx, 4) AS xx, round(yy, 4) AS yy, round(zz, 4) AS zz, round(116 * fy - 16, 4) AS ll, round(500 * (fx - fy), 4) AS aa, round(200 * (fy - fz), 4) AS bb FROM f""",
    "rgb",
)
_add("box_aligned_stats", lambda s, d: B.aligned_stats(bx(s, d)), "WITH e AS (SELECT set_id, 'x' AS side, x AS v FROM box UNION ALL SELECT set_id, 'y', y FROM box UNION ALL SELECT set_id, 'w', w FROM box UNION ALL SELECT set_id, 'h', h FROM box), r AS (SELECT *, row_number() OVER (PARTITION BY set_id, side ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY set_id, side) AS n FROM e) SELECT set_id, side, max(v) FILTER (k = floor((n - 1) * 0.5 + 0.5)) AS median, min(v) AS low, max(v) AS high FROM r GROUP BY 1, 2", "box")
_add("box_combine_overlaps", lambda s, d: B.combined(bx(s, d)))
_add("numa_histogram_stats", lambda s, d: S.histogram_stats(na(s, d), 5.0), "WITH h AS (SELECT set_id, floor(v / 5.0::DOUBLE) * 5.0::DOUBLE AS q, count(*) AS n FROM numa GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY set_id ORDER BY q) AS c, sum(n) OVER (PARTITION BY set_id) AS t FROM h) SELECT set_id, round((sum(q * n) / sum(n))::DOUBLE, 6) AS mean, round((sum(q * q * n) / sum(n) - (sum(q * n) / sum(n)) * (sum(q * n) / sum(n)))::DOUBLE, 4) AS var, min(q) FILTER (c * 2 >= t) AS median, (list(q ORDER BY n DESC, q))[1] AS mode FROM c GROUP BY 1", "numa")
_add("numa_reversals", lambda s, d: S.reversals(na(s, d)), "WITH a AS (SELECT set_id, i, sign(v - lag(v) OVER (PARTITION BY set_id ORDER BY i)) AS s FROM numa), b AS (SELECT set_id, i, lag(s) OVER (PARTITION BY set_id ORDER BY i) * s AS p FROM a WHERE s <> 0) SELECT set_id, count(*) AS n_reversals FROM b WHERE p < 0 GROUP BY 1", "numa")
_add("numa_nearest_model", lambda s, d: S.nearest_model(na(s, d), 300.0, 20), "WITH a AS (SELECT set_id, i, max(CASE WHEN v >= 300 THEN i END) OVER (PARTITION BY set_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS p, min(CASE WHEN v >= 300 THEN i END) OVER (PARTITION BY set_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM numa), b AS (SELECT set_id, i, CASE WHEN q IS NULL OR i - p <= q - i THEN p ELSE q END AS m FROM a) SELECT set_id, i, CASE WHEN abs(m - i) <= 20 THEN m END AS model FROM b", "numa")

# more geometry, points and arrays
_TAPS = """c AS (SELECT image_id, y, x, floor(sy)::INTEGER AS iy, floor(sx)::INTEGER AS ix, floor((sy - floor(sy)) * 16)::INTEGER AS fy, floor((sx - floor(sx)) * 16)::INTEGER AS fx FROM m),
    t AS (SELECT c.*, iy + j AS ys, ix + i AS xs, (CASE WHEN j = 1 THEN fy ELSE 16 - fy END) * (CASE WHEN i = 1 THEN fx ELSE 16 - fx END) AS wt FROM c CROSS JOIN range(0, 2) a(j) CROSS JOIN range(0, 2) b(i))
    SELECT t.image_id, t.y, t.x, ((sum(coalesce(p.v, 255) * wt) + 128) // 256)::INTEGER AS v FROM t LEFT JOIN pix p ON p.image_id = t.image_id AND p.y = t.ys AND p.x = t.xs GROUP BY 1, 2, 3"""
_add("affine_interpolated", lambda s, d: G.affine_interpolated(g(s, d), 0.9, 0.1, 2.0, -0.1, 0.95, 3.0), f"WITH m AS (SELECT image_id, y, x, x * 0.9::DOUBLE + y * 0.1::DOUBLE + 2.0::DOUBLE AS sx, x * -0.1::DOUBLE + y * 0.95::DOUBLE + 3.0::DOUBLE AS sy FROM pix), {_TAPS}", "pix")
_sin, _cos = (f"{getattr(__import__('math'), k)(0.3)!r}::DOUBLE" for k in ("sin", "cos"))
_add("rotate_sampled", lambda s, d: G.rotate_sampled(g(s, d), 0.3), f"WITH {_SIZE}, m AS (SELECT image_id, y, x, (h // 2 + floor((y - h // 2) * {_cos} - (x - w // 2) * {_sin} + 0.5))::INTEGER AS sy, (w // 2 + floor((x - w // 2) * {_cos} + (y - h // 2) * {_sin} + 0.5))::INTEGER AS sx FROM pix JOIN z USING (image_id)) SELECT m.image_id, m.y, m.x, coalesce(q.v, 255) AS v FROM m LEFT JOIN pix q ON q.image_id = m.image_id AND q.y = m.sy AND q.x = m.sx", "pix")
_PROJ = [0.95, 0.05, 1.0, 0.02, 0.9, 2.0, 0.0005, 0.0002]
_k = "(x * 0.0005::DOUBLE + y * 0.0002::DOUBLE + 1.0::DOUBLE)"
_add("projective_sampled", lambda s, d: G.projective_sampled(g(s, d), _PROJ), f"WITH m AS (SELECT image_id, y, x, trunc((x * 0.95::DOUBLE + y * 0.05::DOUBLE + 1.0::DOUBLE) / {_k} + 0.5)::INTEGER AS sx, trunc((x * 0.02::DOUBLE + y * 0.9::DOUBLE + 2.0::DOUBLE) / {_k} + 0.5)::INTEGER AS sy FROM pix) SELECT m.image_id, m.y, m.x, coalesce(q.v, 255) AS v FROM m LEFT JOIN pix q ON q.image_id = m.image_id AND q.y = m.sy AND q.x = m.sx", "pix")
_add("scale_sampled", lambda s, d: G.scale_sampled(g(s, d), 1.5, 0.75), f"WITH {_SIZE}, b AS (SELECT image_id, unnest(range(0, floor(h * 0.75 + 0.5)::INTEGER))::INTEGER AS y, w, h FROM z), c AS (SELECT image_id, y, unnest(range(0, floor(w * 1.5 + 0.5)::INTEGER))::INTEGER AS x, w, h FROM b) SELECT c.image_id, c.y, c.x, p.v FROM c JOIN pix p ON p.image_id = c.image_id AND p.y = least(floor(c.y / 0.75::DOUBLE), h - 1) AND p.x = least(floor(c.x / 1.5::DOUBLE), w - 1)", "pix")
_add("mirror_shift_match", lambda s, d: R.best_shift(_small_bin(s, d), N.dilate(_small_bin(s, d), 2, 1), 2), f"WITH bin8 AS (SELECT image_id, y, x, (v < 128)::INTEGER AS v FROM small), dil AS ({_win('bin8', 'max(coalesce(q.v, 0)) AS v', 0, 0, 1, 0)}), n AS (SELECT a.image_id, dy::INTEGER AS dy, dx::INTEGER AS dx, count(*) AS m FROM bin8 a CROSS JOIN range(-2, 3) s(dy) CROSS JOIN range(-2, 3) t(dx) JOIN dil b ON b.image_id = a.image_id AND b.y = a.y - dy AND b.x = a.x - dx WHERE a.v = 1 AND b.v = 1 GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY m DESC, dy, dx) AS r FROM n), u AS (SELECT image_id, sum(v)::DOUBLE AS na FROM bin8 GROUP BY 1), w AS (SELECT image_id, sum(v)::DOUBLE AS nb FROM dil GROUP BY 1) SELECT k.image_id, dy, dx, round(m * m / (na * nb), 6) AS score FROM k JOIN u USING (image_id) JOIN w USING (image_id) WHERE r = 1", "small")
_add("pta_select", lambda s, d: T.selected(D.points(s, d), 25.0, 40000.0, ">=", True), "SELECT * FROM pt WHERE x >= 25 AND y >= 40000", "pt")
_add("pta_moments", lambda s, d: T.moments(D.points(s, d)), "SELECT set_id, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, round(avg(x), 6) AS cx, round(avg(y), 4) AS cy FROM pt GROUP BY 1", "pt")
_add("numa_peaks", lambda s, d: S.peaks(na(s, d), 4, 200.0), "WITH k AS (SELECT set_id, i, v, max(v) OVER (PARTITION BY set_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS b, max(v) OVER (PARTITION BY set_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS a FROM numa) SELECT set_id, i, v FROM k WHERE v >= 200 AND (b IS NULL OR v > b) AND (a IS NULL OR v >= a)", "numa")
_add("numa_interpolated", lambda s, d: S.interpolated(na(s, d), 5), "WITH k AS (SELECT a.set_id, a.i, a.v, p.v AS pv, q.v AS qv, a.i % 5 AS r FROM numa a JOIN numa p ON p.set_id = a.set_id AND p.i = a.i - a.i % 5 LEFT JOIN numa q ON q.set_id = a.set_id AND q.i = a.i - a.i % 5 + 5) SELECT set_id, i, round(CASE WHEN r = 0 OR qv IS NULL THEN pv ELSE pv + (r::DOUBLE / 5) * (qv - pv) END, 6) AS v FROM k", "numa")


def _palette_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palette indices, then colours again by a join with the palette: a dictionary of at most 256 rows."""
    from pyspark.sql import functions as F

    index = P.nearest_colour(rgb(spark, sf_dir), PALETTE)
    palette = spark.createDataFrame([(i, *c) for i, c in enumerate(PALETTE)], "v int, r int, g int, b int")
    return index.join(F.broadcast(palette), "v").select(*P.KEY, "r", "g", "b")


_add("remove_colormap", _palette_round_trip, f"WITH m AS (SELECT *, (list_sort([{_far}])[1]).i AS v FROM rgb), p AS (SELECT * FROM (VALUES {', '.join(str((i, *c)) for i, c in enumerate(PALETTE))}) t(v, pr, pg, pb)) SELECT image_id, y, x, pr AS r, pg AS g, pb AS b FROM m JOIN p USING (v)", "rgb")

# the queries of the second part, some of which give a query above its SQL
for _name, _query in X.QUERIES.items():
    _add(_name, _query)
for _name, (_sql, *_tables) in X.STATEMENTS.items():
    _add(_name, QUERIES[_name], _sql, *_tables)
