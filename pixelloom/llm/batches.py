"""Texts in stable batches, and look-ups of their keys in other tasks.

A batch is a few megabytes of texts in one compressed row of a kept table. A batch sends sorted keys, cut by `bucket`,
to the tasks that hold each bucket; these answer with one value per key, and answers are joined to the batch again.
Both ways a row carries many keys, so the cost per key is that of array code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.tables import keep
from pixelloom.llm.words import slices

BATCH_BYTES = 4 << 20
#: So many batches' keys meet in a bucket, on average.
BATCHES_PER_BUCKET = 4


def pack(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """A kept table (batch, blob) of all rows' ids and texts, and a number of buckets that fits its size."""
    from pyspark import TaskContext

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for k, b in enumerate(slices(batches, "text", BATCH_BYTES)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                out.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([base + k], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch", "blob"])

    # small row groups: a task reads few of these large rows at a time
    packed = keep(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(rows, "batch long, blob binary"), "batches", block=8 << 20)
    return packed, max(24, -(-packed.count() // BATCHES_PER_BUCKET))


def unpack(blob: bytes) -> pa.RecordBatch:
    """The ids and texts of a batch."""
    table = pa.ipc.open_stream(blob).read_all().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema)


def by_bucket(order_key: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has keys, with their places in their order."""
    bucket = (order_key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    first = np.flatnonzero(np.diff(sorted_, prepend=-1))
    for a, e in zip(first, [*first[1:], len(order)], strict=True):
        yield int(sorted_[a]), order[a:e]


def ask(batched: DataFrame, send: Callable, answer: Callable, columns: list[str], name: str) -> DataFrame:
    """Answers to each batch: a kept table (batch, answers array<struct<bucket, data>>).

    batched: the batches, with `columns` for send. send(row as dict) yields (bucket, payload bytes).
    answer(list of payloads of one bucket) gives one bytes for each payload.
    """

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(k)[i] for k, c in enumerate(columns)}
                got = list(send(row))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([row["batch"].as_py()] * len(got), pa.int64()), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary())], names=["batch", "bucket", "data"])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                data = answer([d for _, d in held])
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in held], pa.int64()), pa.array([owner] * len(held), pa.int64()), pa.array(data, pa.binary())], names=["batch", "bucket", "data"])

        for b in batches:
            batch, bucket, data = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            for i, x in enumerate(bucket):
                if x != owner:
                    yield from flush()
                    owner, held = x, []
                held.append((batch[i], data[i].as_py()))
        yield from flush()

    schema = "batch long, bucket long, data binary"
    sent = batched.select(*columns).mapInArrow(out, schema)
    answered = sent.repartition("bucket").sortWithinPartitions("bucket", "batch").mapInArrow(back, schema)
    return keep(answered.groupBy("batch").agg(F.collect_list(F.struct("bucket", "data")).alias("answers")), name)


def answers_of(value) -> dict[int, bytes]:
    """The answers of the buckets that gave one."""
    return {x["bucket"]: x["data"] for x in value.as_py() or ()}
