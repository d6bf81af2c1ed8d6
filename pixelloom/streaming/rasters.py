"""Structured Streaming: aggregates of rasters that arrive as files. Optional: batch plans are the main path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def histogram_stream(spark: SparkSession, path: str, width: int = 100) -> DataFrame:
    """The gray histogram of events read as pixels, updated as files arrive."""
    schema = spark.read.parquet(path).schema
    ev = spark.readStream.schema(schema).parquet(path)
    return ev.select(F.least(F.lit(255), F.floor("value")).cast("int").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))


def windowed_means(spark: SparkSession, path: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mean value per event type and window of time, with a watermark for late rows."""
    schema = spark.read.parquet(path).schema
    ev = spark.readStream.schema(schema).parquet(path).withWatermark("ts", late)
    return ev.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
