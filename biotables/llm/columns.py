"""Arrow helpers shared by the operators: text buffers as arrays, batches of rows as one binary value."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biotables.session import configure, scratch_path

#: raw text bytes per packed batch
BATCH_BYTES = 1 << 20
#: a batch number is its slot, then this many bits for the task's turn and the batch's place
SLOT_BITS = 40


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offsets of its rows; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        wide, kind = np.int32, pa.binary()
    else:
        wide, kind = np.int64, pa.large_binary()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"")
    _, where, data = column.buffers()
    if len(column) == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def as_binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from concatenated bytes and row offsets."""
    if len(data) < 2**31:
        return pa.Array.from_buffers(
            pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
        )
    wide = pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    )
    return wide


def pack(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload).read_next_batch()


def cut_points(sizes: np.ndarray, most: int) -> list[int]:
    """Row positions that cut rows into runs of at most ``most`` bytes, one row at least."""
    points, filled = [0], 0
    for i, size in enumerate(sizes.tolist()):
        if filled and filled + size > most:
            points.append(i)
            filled = 0
        filled += size
    return [*points, len(sizes)] if len(sizes) else [0]


def slots(spark: SparkSession, count: int) -> list[int]:
    """One number for each bucket of a table that is bucketed into ``count`` by a number."""
    found = (
        spark.range(16 * count).select(F.col("id").cast("int").alias("slot"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(count)).alias("bucket"))
        .groupBy("bucket").agg(F.min("slot").alias("slot"))
    )
    return sorted(r["slot"] for r in found.collect())


def packed_batches(docs: DataFrame, text: str, label: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Rows of ``docs`` in packed batches, as a bucketed table in the shared folder: slot, batch, raw, payload.

    The write happens in scan order, without a shuffle: a task writes all its batches under one slot, and
    the table is bucketed by slot. Batch numbers are stable from then on, so later stages send short
    messages to a batch, and joins with them (``with_answers``) move the messages only, never the texts.
    One payload is an Arrow batch of whole rows; a text longer than ``batch_bytes`` has a batch of its own.
    """
    spark = docs.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slot_of = slots(spark, count)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, place = divmod(TaskContext.get().partitionId(), len(slot_of))
        slot, number = slot_of[place], turn << 24
        for rows in parts:
            sizes = np.diff(text_bytes(rows.column(text))[1])
            points = cut_points(sizes, batch_bytes)
            for a, b in zip(points, points[1:]):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([slot], pa.int32()),
                        pa.array([(slot << SLOT_BITS) + number], pa.int64()),
                        pa.array([int(sizes[a:b].sum())], pa.int64()),
                        pa.array([pack(rows.slice(a, b - a))], pa.binary()),
                    ],
                    ["slot", "batch", "raw", "payload"],
                )
                number += 1

    name = f"packed_{label}_{uuid.uuid4().hex}"
    made = docs.mapInArrow(cut, "slot int, batch long, raw long, payload binary")
    made.write.format("parquet").option("path", scratch_path(spark, label)).option("compression", "uncompressed").bucketBy(count, "slot").saveAsTable(name)
    atexit.register(_forget, spark, name)
    return spark.table(name)


def _forget(spark: SparkSession, name: str) -> None:
    """The catalog entry goes with the driver's Python; the files go with the run folder."""
    if spark.sparkContext._jsc is not None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def with_answers(batches: DataFrame, answers: DataFrame, *fields: str) -> DataFrame:
    """batch, payload, answers: every batch with the list of its answers (null if none).

    The answers go to the slots of their batches; the batches stay in the buckets they lie in.
    """
    spark = batches.sparkSession
    # the slot alone may place both sides of the join
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = (
        answers.withColumn("slot", F.shiftright("batch", SLOT_BITS).cast("int"))
        .repartition(count, "slot")
        .groupBy("slot", "batch")
        .agg(F.collect_list(F.struct(*fields)).alias("answers"))
    )
    joined = batches.select("slot", "batch", "payload").join(grouped.hint("merge"), ["slot", "batch"], "left")
    return joined.select("batch", "payload", "answers")


def bucket_count(batches: DataFrame, bytes_each: int = 32 << 20) -> int:
    """Buckets so that each stands for about ``bytes_each`` raw bytes of text."""
    raw = batches.agg(F.sum("raw")).first()[0] or 0
    return max(int(batches.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(raw // bytes_each) + 1)
