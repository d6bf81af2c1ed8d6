"""Sums of long arrays over all partitions of a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def summed(df: DataFrame, produce, size: int) -> np.ndarray:
    """The sum over partitions of the array of `size` numbers that produce(batches) gives for each (or None).

    Arrays travel in blocks, those of zeros not at all, and each block is added up in one task.
    """
    block = 8192

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = produce(batches)
        if x is not None:
            at = np.flatnonzero(x.reshape(-1, 1).any(axis=1)) if len(x) else []
            ks = np.unique(np.asarray(at, np.int64) // block)
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array([x[k * block : (k + 1) * block].astype(np.float64).tobytes() for k in ks], pa.binary())], names=["k", "x"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = np.frombuffer(x.as_buffer(), np.float64)
                total[k] = total[k] + v if k in total else v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["k", "x"])

    out = np.zeros(size)
    for k, x in df.mapInArrow(rows, "k long, x binary").repartition("k").mapInArrow(add, "k long, x binary").collect():
        v = np.frombuffer(x, np.float64)
        out[k * block : k * block + len(v)] += v
    return out
