"""Distances between all pairs of samples, worked off in block pairs.

The result has one row per pair, so the work is quadratic in the number of samples by
definition, but neither the disk nor the memory is: samples are packed into blocks, which are
stored once, and a task reads blocks of both sides again instead of getting copies of them through a
shuffle. A block has a bounded number of samples and of cells. One sample above the bound of cells is
several slices of its features; slices meet where their features overlap, and the task that has both blocks
adds them up, so no part of a pair is written either.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from biotables.operators.reshape import dense_index
from biotables.session import materialize, task_count

# cells of a slice; more than the pairs that two blocks give
CELLS_PER_TASK = 400_000
EXPAND = 2_000_000  # products held at a time
DENSE_GAIN = 8  # a dense cell costs about this much less than an expanded one
#: share of the pairs of two blocks that must have a product for a whole matrix of them
FILLED = 1 / 16
#: blocks and cells of one side that a task holds, on average
BLOCKS_HELD = 16
CELLS_HELD = 1_000_000
#: range of feature codes
FIRST, LAST = -(1 << 63), (1 << 63) - 1


# ---------------------------------------------------------------- blocks


class _Packer:
    """Cells that come by sample, and within it by feature, to one row for each block or slice of a block."""

    def __init__(self, number: int, block: int, most: int):
        self.number, self.block, self.most = number, block, most
        self.open([], [], [])

    def open(self, ids: list, totals: list[float], parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.ids, self.totals, self.low = ids, totals, FIRST
        self.parts = [(0, codes, x) for codes, x in parts]  # place of the sample, features, values
        self.cells = sum(len(codes) for codes, _ in parts)

    def row(self, high: int) -> dict:
        codes = np.concatenate([np.zeros(0, np.int64), *(p[1] for p in self.parts)])
        x = np.concatenate([np.zeros(0), *(p[2] for p in self.parts)])
        rows = np.repeat(np.array([p[0] for p in self.parts], np.int32), [len(p[1]) for p in self.parts])
        order = np.argsort(codes, kind="stable")
        features, first = np.unique(codes[order], return_index=True)
        return {
            "block": self.number, "lo": self.low, "hi": high, "whole": (self.low, high) == (FIRST, LAST), "cells": len(codes),
            "ids": list(self.ids), "totals": np.array(self.totals, float).tobytes(), "features": features.tobytes(),
            "sizes": np.diff(np.append(first, len(codes))).astype(np.int64).tobytes(), "rows": rows[order].tobytes(), "x": x[order].tobytes(),
        }

    def close(self) -> Iterator[dict]:
        if self.ids:
            yield self.row(LAST)
            self.number += 1
        self.open([], [], [])

    def add(self, sample: object, codes: np.ndarray, x: np.ndarray, total: float) -> Iterator[dict]:
        """Some cells of a sample; ``total`` also holds those without a feature."""
        if not self.ids or sample != self.ids[-1]:
            if len(self.ids) >= self.block or self.cells >= self.most or self.low != FIRST:  # a block in slices is one sample
                yield from self.close()
            self.ids.append(sample)
            self.totals.append(0.0)
        self.totals[-1] += total
        place = len(self.ids) - 1
        self.parts.append((place, codes, x))
        self.cells += len(codes)
        if self.cells >= self.most and place:  # the sample that goes beyond the bound opens the next block
            mine = [p[1:] for p in self.parts if p[0] == place]
            total = self.totals.pop()
            self.ids.pop()
            self.parts = [p for p in self.parts if p[0] != place]
            yield from self.close()
            self.open([sample], [total], mine)
        if self.cells >= self.most and len(self.parts[-1][1]) and self.parts[-1][1][-1] < LAST:
            high = int(self.parts[-1][1][-1])
            yield self.row(high)
            self.low, self.parts, self.cells = high + 1, [], 0


def _coded(cells: DataFrame) -> DataFrame:
    """``sample, feature, x`` with whole numbers for features, NULL where there is none."""
    if isinstance(cells.schema["feature"].dataType, IntegralType):
        return cells.withColumn("feature", F.col("feature").cast("bigint"))
    cells = materialize(cells, "cells")
    names = materialize(dense_index(cells.select("feature").dropna().distinct(), ["feature"], "code"), "features")
    return cells.join(names, "feature", "left").select("sample", F.col("code").alias("feature"), "x")


def packed_blocks(cells: DataFrame, square: bool, block: int) -> DataFrame:
    """Stored blocks of at most ``block`` samples from ``sample, feature, x``, one row per sample and feature.

    ``totals`` are sums of x, or of its squares. Rows without a sample take no part; rows without a feature count in the totals only.
    """
    most = CELLS_PER_TASK

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, schema = _Packer(TaskContext.get().partitionId() << 33, block, most), None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, features = batch.column(0), batch.column(1)
            schema = schema or pa.schema(
                [("block", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("whole", pa.bool_()), ("cells", pa.int64()), ("ids", pa.list_(ids.type))]
                + [(name, pa.binary()) for name in ("totals", "features", "sizes", "rows", "x")]
            )
            known = np.asarray(features.is_valid())
            codes = np.asarray(features.fill_null(0)).astype(np.int64)
            x = np.asarray(batch.column(2).cast(pa.float64()).fill_null(0.0))
            sums = np.concatenate([[0.0], np.cumsum(x * x if square else x)])
            other = np.asarray(pc.not_equal(ids.slice(1), ids.slice(0, batch.num_rows - 1)))
            starts = np.concatenate([[0], np.flatnonzero(other) + 1, [batch.num_rows]])
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                use = slice(a, b) if known[a:b].all() else a + np.flatnonzero(known[a:b])
                for row in packer.add(ids[a].as_py(), codes[use], x[use], sums[b] - sums[a]):
                    yield pa.RecordBatch.from_pylist([row], schema)
        for row in packer.close():
            yield pa.RecordBatch.from_pylist([row], schema)

    id_type = cells.schema["sample"].dataType.simpleString()
    # one shuffle for everything: cells of a sample come together in the order of their features
    by_sample = _coded(cells.filter(F.col("sample").isNotNull())).repartition("sample").sortWithinPartitions("sample", "feature")
    packed = by_sample.select("sample", "feature", "x").mapInArrow(
        pack,
        f"block bigint, lo bigint, hi bigint, whole boolean, cells bigint, ids array<{id_type}>, totals binary, features binary, sizes binary, rows binary, x binary",
    )
    return materialize(packed, "blocks")


def block_pairs(packed: DataFrame, cells: str = "cells") -> DataFrame:
    """Every two blocks, ``a_`` and ``b_`` columns, each pair once and in order of the left one; ``packed`` is a stored table.

    A partition is dealt once and read by every task that needs it, so that nothing is written per pair.
    """
    spark = packed.sparkSession
    n, size = packed.agg(F.count(F.lit(1)), F.coalesce(F.sum(cells), F.lit(0))).first()
    parts = max(1, min(n, math.ceil(math.sqrt(2 * task_count(spark)))), math.ceil(n / BLOCKS_HELD), math.ceil(size / CELLS_HELD))
    dealt = packed.repartition(parts, "block").sortWithinPartitions("block", "lo")
    a, b = (dealt.select([F.col(c).alias(side + c) for c in packed.columns]) for side in ("a_", "b_"))
    overlap = (F.col("a_lo") <= F.col("b_hi")) & (F.col("b_lo") <= F.col("a_hi"))
    return a.hint("shuffle_replicate_nl").join(b, (F.col("a_block") <= F.col("b_block")) & overlap)


# ---------------------------------------------------------------- pairs of blocks


class Side:
    """A block, or a slice of one: ids, totals, and cells sorted by feature."""

    def __init__(self, batch: pa.RecordBatch, row: int, side: str):
        value = lambda name: batch.column(side + name)[row]
        array = lambda name, kind: np.frombuffer(value(name).as_buffer(), kind)
        self.block, self.whole, self.last = value("block").as_py(), value("whole").as_py(), value("hi").as_py() == LAST
        self.ids, self.totals = value("ids").values, array("totals", np.float64)
        self.features, self.sizes = array("features", np.int64), array("sizes", np.int64)
        self.rows, self.x = array("rows", np.int32), array("x", np.float64)
        self.first = np.cumsum(self.sizes) - self.sizes

    def cells(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among ``at`` and index of every cell of the features at the places ``at``."""
        n = self.sizes[at]
        own = np.repeat(np.arange(len(at)), n)
        return own, self.first[at][own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)

    def matrix(self, at: np.ndarray) -> np.ndarray:
        column, cell = self.cells(at)
        out = np.zeros((len(self.ids), len(at)))
        out[self.rows[cell], column] = self.x[cell]
        return out


def _common(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Places of the features that both have."""
    if not len(a.features) or not len(b.features):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(a.features, b.features), len(a.features) - 1)
    in_b = np.flatnonzero(a.features[at] == b.features)
    return at[in_b], in_b


def _expanded(a: Side, b: Side, at_a: np.ndarray, at_b: np.ndarray, combine: np.ufunc) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Number of the pair in the matrix and product, for every two cells of the same feature."""
    own, cell = a.cells(at_a)
    partners = b.sizes[at_b][own]
    done = np.cumsum(partners)
    start = 0
    while start < len(partners):
        base = done[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(done, base + EXPAND, side="right")))
        n = partners[start:stop]
        at = np.repeat(np.arange(start, stop), n)
        other = b.first[at_b][own[at]] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        yield a.rows[cell[at]].astype(np.int64) * len(b.ids) + b.rows[other], combine(a.x[cell[at]], b.x[other])
        start = stop


def shared_matrix(a: Side, b: Side, combine: np.ufunc) -> np.ndarray:
    """Sum over features of ``combine(x_a, x_b)`` for every row of one block and the other.

    Features that are common in both blocks go through a dense matrix, rare ones through
    the few cells they have; both add to one block matrix.
    """
    shape = (len(a.ids), len(b.ids))
    out = np.zeros(shape)
    at_a, at_b = _common(a, b)
    dense = a.sizes[at_a] * b.sizes[at_b] * DENSE_GAIN >= shape[0] * shape[1]
    if dense.any():
        left, right = a.matrix(at_a[dense]), b.matrix(at_b[dense])
        for i, row in enumerate(left):
            out[i] = combine(row, right).sum(axis=1)
    flat = out.reshape(-1)
    for pair, product in _expanded(a, b, at_a[~dense], at_b[~dense], combine):
        flat += np.bincount(pair, weights=product, minlength=out.size)
    return out


def shared_pairs(a: Side, b: Side, combine: np.ufunc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of one block, rows of the other and their sum, for the pairs that share something."""
    at_a, at_b = _common(a, b)
    size = len(a.ids) * len(b.ids)
    if (a.sizes[at_a] * b.sizes[at_b]).sum() >= min(size * FILLED, EXPAND):
        return nonzero(shared_matrix(a, b, combine))
    found = [*_expanded(a, b, at_a, at_b, combine)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    pair, product = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(pair, kind="stable")
    pair, product = pair[order], product[order]
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    i, j = np.divmod(pair[first], len(b.ids))
    return i, j, np.add.reduceat(product, first)


def nonzero(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, j = np.nonzero(matrix)
    return i, j, matrix[i, j]


def matched(batches: Iterator[pa.RecordBatch], combine: np.ufunc, sparse: bool) -> Iterator[tuple]:
    """``a, b, found`` for every two blocks of :func:`block_pairs`; ``found`` is a matrix, or as :func:`shared_pairs` has it.

    A block in slices meets the other one several times in one task; its sums are given when the next left block comes.
    """
    waiting: dict[int, list] = {}
    left = None
    ready = lambda w: (w[0], w[1], nonzero(w[2]) if sparse else w[2])
    for batch in batches:
        for row in range(batch.num_rows):
            a, b = Side(batch, row, "a_"), Side(batch, row, "b_")
            if a.block != left:
                yield from map(ready, waiting.values())
                waiting, left = {}, a.block
            if a.whole and b.whole:
                yield a, b, (shared_pairs if sparse else shared_matrix)(a, b, combine)
                continue
            if b.block not in waiting:
                waiting[b.block] = [a, b, np.zeros((len(a.ids), len(b.ids)))]
            state = waiting[b.block]
            state[2] += shared_matrix(a, b, combine)
            # totals are whole in the last slice
            state[0], state[1] = a if a.last else state[0], b if b.last else state[1]
    yield from map(ready, waiting.values())


def pair_rows(a: pa.Array, b: pa.Array, i: np.ndarray, j: np.ndarray, dist: np.ndarray) -> pa.RecordBatch:
    """``id_a, id_b, dist`` with the smaller id first; pairs of one id are left out."""
    a, b = a.take(pa.array(i)), b.take(pa.array(j))
    in_order = pc.less(a, b)
    out = pa.RecordBatch.from_arrays([pc.if_else(in_order, a, b), pc.if_else(in_order, b, a), pa.array(dist)], ["id_a", "id_b", "dist"])
    return out.filter(pc.not_equal(a, b))


def _all_pairs(counts: DataFrame, combine: np.ufunc, square: bool, block: int, measure: Callable) -> DataFrame:
    """``id_a, id_b, dist`` from the summed measure and both sample totals of every pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, shared in matched(batches, combine, sparse=False):
            dist = measure(shared, a.totals[:, None] + b.totals[None])
            i, j = np.nonzero(np.triu(np.ones(dist.shape, bool), 1) if a.block == b.block else np.ones(dist.shape, bool))
            yield pair_rows(a.ids, b.ids, i, j, dist[i, j])

    # the cells of a sample come together first, so that summing and packing take one shuffle
    cells = counts.repartition("sample").groupBy("sample", "feature").agg(F.sum("count").cast("double").alias("x"))
    kind = counts.schema["sample"].dataType.simpleString()
    return block_pairs(packed_blocks(cells, square, block)).mapInArrow(run, f"id_a {kind}, id_b {kind}, dist double")


def bray_curtis(counts: DataFrame, block: int = 512) -> DataFrame:
    """Bray-Curtis dissimilarity ``(id_a, id_b, dist)`` with ``id_a < id_b``."""
    return _all_pairs(counts.filter(F.col("count") > 0), np.minimum, False, block, lambda shared, size: 1 - 2 * shared / size)


def euclidean(counts: DataFrame, block: int = 512) -> DataFrame:
    """Euclidean distance of count profiles ``(id_a, id_b, dist)`` with ``id_a < id_b``."""
    return _all_pairs(counts, np.multiply, True, block, lambda shared, size: np.sqrt(np.maximum(size - 2 * shared, 0.0)))


def vector_distances(df: DataFrame, key: str, vector: str, block: int = 512) -> DataFrame:
    """Euclidean distance between all pairs of array rows."""
    key_type = df.schema[key].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 33, []

        def packed(part: pa.Table) -> pa.RecordBatch:
            x = np.stack(part.column(1).to_pandas().to_numpy()).astype(float)
            # floats where they hold the same numbers
            narrow = x.astype(np.float32)
            x = narrow if (narrow == x).all() else x
            ids = part.column(0).combine_chunks()
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            values = [number, FIRST, LAST, x.size, x.shape[1], x.tobytes()]
            return pa.RecordBatch.from_arrays([ids, *(pa.array([v]) for v in values)], ["ids", "block", "lo", "hi", "cells", "width", "x"])

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= block:
                rows = pa.Table.from_batches(held)
                yield packed(rows.slice(0, block))
                number, held = number + 1, rows.slice(block).to_batches()
        if sum(b.num_rows for b in held):
            yield packed(pa.Table.from_batches(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(batch: pa.RecordBatch, row: int, name: str) -> tuple[pa.Array, np.ndarray]:
            ids, raw = batch.column(f"{name}ids")[row].values, batch.column(f"{name}x")[row].as_buffer()
            width = batch.column(f"{name}width")[row].as_py()
            kind = np.float32 if raw.size == 4 * len(ids) * width else np.float64
            return ids, np.frombuffer(raw, kind).reshape(len(ids), width).astype(float)

        for batch in batches:
            for k in range(batch.num_rows):
                (ids_a, a), (ids_b, b) = side(batch, k, "a_"), side(batch, k, "b_")
                square = np.stack([((row - b) ** 2).sum(axis=1) for row in a])
                same = batch.column("a_block")[k].as_py() == batch.column("b_block")[k].as_py()
                i, j = np.nonzero(np.triu(np.ones(square.shape, bool), 1) if same else np.ones(square.shape, bool))
                yield pair_rows(ids_a, ids_b, i, j, np.sqrt(square[i, j]))

    # blocks are cut from the partitions as they are: no row is shuffled
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("vec")).filter(F.col("id").isNotNull())
    packed = rows.mapInArrow(pack, f"ids array<{key_type}>, block bigint, lo bigint, hi bigint, cells bigint, width bigint, x binary")
    return block_pairs(materialize(packed, "vectors")).mapInArrow(run, f"id_a {key_type}, id_b {key_type}, dist double")
