"""Rasters, boxes, arrays and strings derived from the plain tables, and their SQL twins.

pixel: image_id, y, x, v. box: set_id, i, x, y, w, h. numa: set_id, i, v. sarray: set_id, i, s.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place() -> list:
    i = F.col("event_id")
    return [F.lit(0).cast("long").alias("image_id"), F.floor(i / WIDTH).cast("int").alias("y"), (i % WIDTH).cast("int").alias("x")]


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One gray raster, 100 wide: the events' values."""
    return table(spark, sf_dir, "events").select(*_place(), F.least(F.lit(255), F.floor("value")).cast("int").alias("v"))


def second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another raster of the same size."""
    v = F.least(F.lit(255), F.floor("value")).cast("long")
    return table(spark, sf_dir, "events").select(*_place(), ((v * 3 + F.col("event_id")) % 256).cast("int").alias("v"))


def binary(spark: SparkSession, sf_dir: str, threshold: int = 60) -> DataFrame:
    """A binary raster: 1 where the gray value is below the threshold."""
    return gray(spark, sf_dir).withColumn("v", F.when(F.col("v") < threshold, 1).otherwise(0))


def colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A colour raster: image_id, y, x, r, g, b."""
    r = F.least(F.lit(255), F.floor("value")).cast("int")
    return table(spark, sf_dir, "events").select(*_place(), r.alias("r"), (F.col("event_id") * 7 % 256).cast("int").alias("g"), (F.col("user_id") * 13 % 256).cast("int").alias("b"))


def small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 rasters, one per vector, with a class label."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("image_id"), "label", F.posexplode("embedding").alias("p", "val"))
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("val").cast("double") + 0.5) * 256))).cast("int")
    return e.select("image_id", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).alias("x"), v.alias("v"), "label")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    h = 1 + F.floor("o_totalprice").cast("long") % 40
    return o.select((c % 50).alias("set_id"), k.alias("i"), (k * 37 % 2000).cast("int").alias("x"), (k * 91 % 3000).cast("int").alias("y"), (1 + c % 60).cast("int").alias("w"), h.cast("int").alias("h"))


def numa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric arrays, one per event type, in order of time."""
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("set_id"), (F.row_number().over(w) - 1).cast("long").alias("i"), F.col("value").alias("v"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("set_id"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String arrays: the words of each document."""
    words = F.array_remove(F.split("text", r"[ \n\t]+"), "")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("set_id"), F.posexplode(words).alias("i", "s"))


SQL = {
    "pix": "pix AS (SELECT 0::BIGINT AS image_id, (event_id // 100)::INTEGER AS y, (event_id % 100)::INTEGER AS x, least(255, floor(value))::INTEGER AS v FROM events)",
    "pix2": "pix2 AS (SELECT 0::BIGINT AS image_id, (event_id // 100)::INTEGER AS y, (event_id % 100)::INTEGER AS x, ((least(255, floor(value))::BIGINT * 3 + event_id) % 256)::INTEGER AS v FROM events)",
    "bin": "bin AS (SELECT 0::BIGINT AS image_id, (event_id // 100)::INTEGER AS y, (event_id % 100)::INTEGER AS x, CASE WHEN floor(value) < 60 THEN 1 ELSE 0 END AS v FROM events)",
    "rgb": "rgb AS (SELECT 0::BIGINT AS image_id, (event_id // 100)::INTEGER AS y, (event_id % 100)::INTEGER AS x, least(255, floor(value))::INTEGER AS r, (event_id * 7 % 256)::INTEGER AS g, (user_id * 13 % 256)::INTEGER AS b FROM events)",
    "small": "small AS (SELECT vec_id::BIGINT AS image_id, ((i - 1) // 8)::INTEGER AS y, ((i - 1) % 8)::INTEGER AS x, greatest(0, least(255, floor((embedding[i]::DOUBLE + 0.5) * 256)))::INTEGER AS v, label FROM embeddings, range(1, 65) t(i))",
    "box": "box AS (SELECT o_custkey % 50 AS set_id, o_orderkey AS i, (o_orderkey * 37 % 2000)::INTEGER AS x, (o_orderkey * 91 % 3000)::INTEGER AS y, (1 + o_custkey % 60)::INTEGER AS w, (1 + floor(o_totalprice)::BIGINT % 40)::INTEGER AS h FROM orders)",
    "numa": "numa AS (SELECT event_type AS set_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, value AS v FROM events)",
    "pt": "pt AS (SELECT l_returnflag AS set_id, l_quantity AS x, l_extendedprice AS y FROM lineitem)",
    "sarray": "sarray AS (SELECT doc_id AS set_id, (u.i - 1)::INTEGER AS i, u.s AS s FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \\n\\t]+'), lambda w: w <> '') AS l FROM documents) d, unnest(list_transform(d.l, lambda w, k: {'i': k, 's': w})) q(u))",
}
