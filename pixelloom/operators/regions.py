"""Connected components, fills and other iterative operators.

Components run on horizontal runs, not pixels: runs are nodes, touching runs of neighbouring rows are links, and the
links are joined by star steps, so an image may be larger than a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.operators.graph import connected
from pixelloom.operators.pixels import KEY
from pixelloom.operators.sequences import row_runs
from pixelloom.sources.scratch import scratch


def _touching(runs: DataFrame, connectivity: int) -> DataFrame:
    """Links between runs of neighbouring rows that touch, by a bucketed range join on the rows' x."""
    reach = 1 if connectivity == 8 else 0
    cell = 64
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))
    a = runs.select("image_id", "y", F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("run").alias("a")).withColumn("cell", cells(F.col("a0") - reach, F.col("a1") + reach))
    b = runs.select("image_id", (F.col("y") - 1).alias("y"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("run").alias("b")).withColumn("cell", cells(F.col("b0"), F.col("b1")))
    return a.join(b, ["image_id", "y", "cell"]).where((F.col("b0") <= F.col("a1") + reach) & (F.col("b1") >= F.col("a0") - reach)).select("image_id", "a", "b").distinct()


def labelled_runs(px: DataFrame, connectivity: int = 4) -> DataFrame:
    """Runs of a binary raster with their component: image_id, y, x0, x1, label.

    Labels count from 1 in the raster order of the components' first pixels.
    """
    runs = scratch(row_runs(px).withColumn("run", F.col("y").cast("long") * (1 << 31) + F.col("x0")), "runs")
    found = connected(_touching(runs, connectivity), "image_id").withColumnRenamed("node", "run")
    root = runs.select("image_id", "run").join(found, ["image_id", "run"], "left").select("image_id", "run", F.coalesce("root", "run").alias("root"))
    w = Window.partitionBy("image_id").orderBy("root")
    named = root.select("image_id", "root").distinct().withColumn("label", F.row_number().over(w))
    return runs.join(root, ["image_id", "run"]).join(named, ["image_id", "root"]).select("image_id", "y", "x0", "x1", "label")


def components(px: DataFrame, connectivity: int = 4) -> DataFrame:
    """Area and bounding box of each component."""
    g = labelled_runs(px, connectivity).groupBy("image_id", "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.min("x0").alias("x"), F.min("y").alias("y"), F.max("x1").alias("r"), F.max("y").alias("b"))
    return g.select("image_id", "label", "area", "x", "y", (F.col("r") - F.col("x") + 1).alias("w"), (F.col("b") - F.col("y") + 1).alias("h"))


def label_pixels(px: DataFrame, connectivity: int = 4) -> DataFrame:
    """Each foreground pixel with its component's label."""
    return labelled_runs(px, connectivity).select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "label")


def select_components(px: DataFrame, least_area: int, connectivity: int = 4) -> DataFrame:
    """The raster with only the components of at least so many pixels."""
    big = components(px, connectivity).where(F.col("area") >= least_area).select("image_id", "label")
    on = label_pixels(px, connectivity).join(big, ["image_id", "label"], "left_semi").select(*KEY, F.lit(1).alias("m"))
    return px.join(on, KEY, "left").select(*KEY, F.coalesce("m", F.lit(0)).alias("v"))


def fill_holes(px: DataFrame, connectivity: int = 4) -> DataFrame:
    """Background that does not reach the frame (by the given connectivity) becomes foreground."""
    back = px.withColumn("v", 1 - F.col("v"))
    size = px.groupBy("image_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    runs = scratch(labelled_runs(back, connectivity), "background")
    edge = runs.join(size, "image_id").where("x0 = 0 OR y = 0 OR x1 = mx OR y = my").select("image_id", "label").distinct()
    holes = runs.join(edge, ["image_id", "label"], "left_anti").select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), F.lit(1).alias("m"))
    return px.join(holes, KEY, "left").select(*KEY, F.greatest("v", F.coalesce("m", F.lit(0))).alias("v"))


def _on_border(px: DataFrame, connectivity: int, touching: bool) -> DataFrame:
    size = px.groupBy("image_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    runs = scratch(labelled_runs(px, connectivity), "runs")
    edge = runs.join(size, "image_id").where("x0 = 0 OR y = 0 OR x1 = mx OR y = my").select("image_id", "label").distinct()
    kept = runs.join(edge, ["image_id", "label"], "left_semi" if touching else "left_anti").select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), F.lit(1).alias("m"))
    return px.join(kept, KEY, "left").select(*KEY, F.coalesce("m", F.lit(0)).alias("v"))


def border_components(px: DataFrame, connectivity: int = 8) -> DataFrame:
    """Only the components that touch the frame."""
    return _on_border(px, connectivity, True)


def clear_border(px: DataFrame, connectivity: int = 8) -> DataFrame:
    """Only the components that do not touch the frame."""
    return _on_border(px, connectivity, False)


def component_rasters(px: DataFrame, connectivity: int = 4) -> DataFrame:
    """The pixels of each component within its own bounding box: image_id, label, y, x, v."""
    box = components(px, connectivity).select("image_id", "label", F.col("x").alias("x0"), F.col("y").alias("y0"), "w", "h")
    rows = box.select("*", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"))
    cells = rows.select("image_id", "label", "x0", "y0", "y", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))
    on = label_pixels(px, connectivity).select("image_id", "label", F.col("y").alias("py"), F.col("x").alias("px"))
    at = cells.withColumn("py", F.col("y") + F.col("y0")).withColumn("px", F.col("x") + F.col("x0"))
    return at.join(on.withColumn("m", F.lit(1)), ["image_id", "label", "py", "px"], "left").select("image_id", "label", "y", "x", F.coalesce("m", F.lit(0)).alias("v"))


def seedfill(seed: DataFrame, mask: DataFrame, connectivity: int = 4) -> DataFrame:
    """The mask's components that hold a seed pixel."""
    runs = scratch(labelled_runs(mask, connectivity), "mask-runs")
    pixels = runs.select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "label")
    hit = pixels.join(seed.where("v = 1").select(*KEY), KEY, "left_semi").select("image_id", "label").distinct()
    on = pixels.join(hit, ["image_id", "label"], "left_semi").select(*KEY, F.lit(1).alias("m"))
    return mask.join(on, KEY, "left").select(*KEY, F.coalesce("m", F.lit(0)).alias("v"))
