"""Images as tables: files to pixels and back, and box lists in text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.sources import codecs


def scan(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Image files, undecoded: path, length, content, format. Only columns that are used are read."""
    kind = F.pandas_udf(lambda s: s.map(codecs.sniff), "string")
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", "content", kind("content").alias("format"))


def headers(files: DataFrame) -> DataFrame:
    """path, width, height, depth and channels of each file, from its header alone."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [codecs.header(x) for x in b.content]
            yield pd.DataFrame(found, columns=["width", "height", "depth", "channels"]).assign(path=b.path.to_numpy())[["path", "width", "height", "depth", "channels"]]

    return files.select("path", "content").mapInPandas(rows, "path string, width int, height int, depth int, channels int")


def pixels(files: DataFrame, id_col: str = "image_id") -> DataFrame:
    """Gray pixels (image_id, y, x, v) of encoded images (image_id, content); colour is averaged by (r + 2 g + b) / 4."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, content in zip(b[id_col], b.content):
                a, _ = codecs.read(content)
                if a.ndim == 3:
                    a = (a[:, :, 0].astype(int) + 2 * a[:, :, 1].astype(int) + a[:, :, 2]) // 4
                y, x = np.divmod(np.arange(a.size), a.shape[1])
                yield pd.DataFrame({"image_id": i, "y": y.astype(np.int32), "x": x.astype(np.int32), "v": a.ravel().astype(np.int32)})

    return files.select(id_col, "content").mapInPandas(rows, "image_id long, y int, x int, v int")


def pages(files: DataFrame, id_col: str = "image_id") -> DataFrame:
    """A row of gray pixels (image_id, page, y, x, v) for every page of TIFF files (image_id, content)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, content in zip(b[id_col], b.content):
                for page in range(codecs.tiff_pages(content)):
                    a, _ = codecs.read_tiff(content, page)
                    y, x = np.divmod(np.arange(a.size), a.shape[1])
                    yield pd.DataFrame({"image_id": i, "page": page, "y": y.astype(np.int32), "x": x.astype(np.int32), "v": a.ravel().astype(np.int32)})

    return files.select(id_col, "content").mapInPandas(rows, "image_id long, page int, y int, x int, v int")


def bound(px: DataFrame) -> DataFrame:
    """One TIFF of all pages of an image: image_id, content, from (image_id, page, y, x, v). A file is one task's work."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        made = []
        for _, p in pdf.groupby("page"):
            a = np.zeros((int(p.y.max()) + 1, int(p.x.max()) + 1), np.int64)
            a[p.y, p.x] = p.v
            made.append((a, 8))
        return pd.DataFrame({"image_id": [pdf.image_id.iloc[0]], "content": [codecs.write_tiff_pages(made)]})

    return px.select("image_id", "page", "y", "x", "v").groupBy("image_id").applyInPandas(one, "image_id long, content binary")


def encode(px: DataFrame, kind: str, depth: int = 8) -> DataFrame:
    """One encoded file per raster: image_id, content. A raster is one task's work, as its file is one value."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(pdf.y.max()) + 1, int(pdf.x.max()) + 1), np.int64)
        a[pdf.y, pdf.x] = pdf.v
        return pd.DataFrame({"image_id": [pdf.image_id.iloc[0]], "content": [codecs.WRITERS[kind](a, depth)]})

    return px.select("image_id", "y", "x", "v").groupBy("image_id").applyInPandas(one, "image_id long, content binary")


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Box lists: lines 'Box[i]: x = X, y = Y, w = W, h = H'; other lines are ignored. path, i, x, y, w, h."""
    pattern = r"Box\[(\d+)\]: x = (-?\d+), y = (-?\d+), w = (-?\d+), h = (-?\d+)"
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), "value").where(F.col("value").rlike(pattern))
    return lines.select("path", *(F.regexp_extract("value", pattern, k + 1).cast("int").alias(n) for k, n in enumerate(("i", "x", "y", "w", "h"))))


def box_lines(bx: DataFrame) -> DataFrame:
    """The text of each set's box list: set_id, i, line (the header has i = -1)."""
    rows = bx.select("set_id", "i", F.format_string("  Box[%d]: x = %d, y = %d, w = %d, h = %d", "i", "x", "y", "w", "h").alias("line"))
    head = bx.groupBy("set_id").agg(F.count(F.lit(1)).alias("n")).select("set_id", F.lit(-1).cast("long").alias("i"), F.format_string("\nBoxa Version 2\nNumber of boxes = %d", "n").alias("line"))
    return head.unionByName(rows.withColumn("i", F.col("i").cast("long")))
