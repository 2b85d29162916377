"""Bray-Curtis neighbours: all pairs below a limit, and the k nearest samples.

``within`` has two ways. Rare first: in one global order of features, rare ones in front, each sample
keeps the shortest head behind which less than ``(1 - d) / (1 + d)`` of its total is left; a pair below the limit ``d`` shares a feature of
both heads. Only heads are joined, so a feature found everywhere is met by the samples that hardly hold anything rarer. Totals: the
smaller one is at least that share of the larger one. This writes a row for every cell of every pair that meets, so it is taken only
while few pairs meet. Otherwise the packed blocks of ``distance`` are held against each other, which writes nothing per pair.

``nearest`` goes through the same blocks. A task keeps the k nearest of each sample it has seen, and those alone are written.

Results are exact. No sample has to fit in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from biotables.operators.distance import LAST, block_pairs, matched, packed_blocks, pair_rows
from biotables.operators.totals import running_total, value_bucket
from biotables.session import materialize

#: features of one frequency are put in order by so many hash slots
SLOTS = 1024
#: share of a total from which heads are worth their cost: below it they hold nearly everything
HEADS_SHARE = 0.25
#: pairs a sample may meet through heads, on average, before blocks are taken
MEETINGS = 8
#: samples of a block; sums of few pairs are kept sparse, so blocks may be large
ROWS = 2048


def _cells(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored positive cells ``sample, feature, x`` and the totals of the samples."""
    cells = counts.groupBy("sample", "feature").agg(F.sum("count").alias("x")).filter("x > 0")
    cells = materialize(cells, "near-cells")
    totals = materialize(cells.groupBy("sample").agg(F.sum("x").alias("total")), "near-totals")
    return cells, totals


def _distances(pairs: DataFrame, cells: DataFrame, totals: DataFrame) -> DataFrame:
    """``a, b`` to ``a, b, dist``; pairs that share nothing are left out."""
    left = cells.select(F.col("sample").alias("a"), "feature", F.col("x").alias("x_a"))
    right = cells.select(F.col("sample").alias("b"), "feature", F.col("x").alias("x_b"))
    shared = (
        pairs.join(left, "a").join(right, ["b", "feature"]).groupBy("a", "b").agg(F.sum(F.least("x_a", "x_b")).alias("shared"))
    )
    size = lambda name: totals.select(F.col("sample").alias(name), F.col("total").alias(f"total_{name}"))
    sized = shared.join(size("a"), "a").join(size("b"), "b")
    return sized.select("a", "b", (1 - 2 * F.col("shared").cast("double") / (F.col("total_a") + F.col("total_b"))).alias("dist"))


def heads(cells: DataFrame, totals: DataFrame, limit: float) -> DataFrame:
    """``sample, feature, total`` of the rare-first heads that a pair below ``limit`` must share."""
    share = (1 - limit) / (1 + limit)
    found = cells.groupBy("feature").agg(F.count(F.lit(1)).alias("samples"))
    # any total order does, if it is the same for all samples: frequency class, then hash
    place = value_bucket("samples", 1) * SLOTS + F.pmod(F.xxhash64("feature"), F.lit(SLOTS))
    placed = cells.join(found.select("feature", place.cast("bigint").alias("place")), "feature")
    passed = running_total(placed, ["sample"], "place", ["feature"], "x", "upto", total="total")
    left = F.col("total") - F.col("upto") + F.col("x")
    return passed.filter(left >= F.col("total") * share * (1 - 1e-12)).select("sample", "feature", "total")


def _packed(counts: DataFrame, block: int = 0) -> DataFrame:
    cells = counts.repartition("sample").groupBy("sample", "feature").agg(F.sum("count").alias("x")).filter("x > 0")
    return packed_blocks(cells.withColumn("x", F.col("x").cast("double")), False, max(block, ROWS))


def _few_meet(met: DataFrame, totals: DataFrame) -> bool:
    per_feature = met.groupBy("feature").agg(F.count(F.lit(1)).cast("double").alias("n"))
    meetings = per_feature.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))).first()[0]
    return meetings <= MEETINGS * totals.count()


def bray_curtis_within(counts: DataFrame, limit: float) -> DataFrame:
    """``id_a, id_b, dist`` of all pairs with ``dist <= limit``; ``limit`` is below 1, ``id_a < id_b``."""
    if not 0 <= limit < 1:
        raise ValueError("the limit has to be in [0, 1): at 1 every pair is within it")
    if (1 - limit) / (1 + limit) >= HEADS_SHARE:
        cells, totals = _cells(counts)
        met = materialize(heads(cells, totals, limit), "near-heads")
        if _few_meet(met, totals):
            return _within_heads(met, cells, totals, limit)
        counts = cells.withColumnRenamed("x", "count")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, (i, j, shared) in matched(batches, np.minimum, sparse=True):
            dist = 1 - 2 * shared / (a.totals[i] + b.totals[j])
            keep = (dist <= limit) & ((i < j) | (a.block != b.block))
            if keep.any():
                yield pair_rows(a.ids, b.ids, i[keep], j[keep], dist[keep])

    kind = counts.schema["sample"].dataType.simpleString()
    return block_pairs(_packed(counts)).mapInArrow(run, f"id_a {kind}, id_b {kind}, dist double")


def _within_heads(met: DataFrame, cells: DataFrame, totals: DataFrame, limit: float) -> DataFrame:
    left = met.select(F.col("sample").alias("a"), "feature", F.col("total").alias("total_a"))
    right = met.select(F.col("sample").alias("b"), "feature", F.col("total").alias("total_b"))
    near = F.least("total_a", "total_b") >= F.greatest("total_a", "total_b") * ((1 - limit) / (1 + limit)) * (1 - 1e-12)
    pairs = left.join(right, "feature").filter((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    return _distances(pairs, cells, totals).filter(F.col("dist") <= limit).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), "dist")


class _Nearest:
    """The ``k`` nearest found so far for each of ``n`` samples, ties to the smaller id."""

    def __init__(self, k: int, n: int):
        self.k, self.bound = k, np.full(n, np.inf)
        self.kept: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.fresh = 0

    def add(self, rows: np.ndarray, dist: np.ndarray, ids: pa.Array, at: np.ndarray) -> None:
        near = np.flatnonzero(dist <= self.bound[rows])
        if len(near):
            self.kept.append((rows[near], dist[near], ids.take(pa.array(at[near]))))
            self.fresh += len(near)
        if self.fresh > 10_000 + len(self.bound) * self.k:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
        if not self.kept:
            return None
        rows, dist = (np.concatenate([x[c] for x in self.kept]) for c in (0, 1))
        ids = pa.concat_arrays([x[2] for x in self.kept])
        order = np.lexsort((dist, rows))
        place = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
        last = order[place == self.k - 1]
        self.bound[rows[last]] = dist[last]
        order = order[dist[order] <= self.bound[rows[order]]]  # with all that tie with the last
        if (np.bincount(rows[order]) > self.k).any():
            rank = np.unique(np.array(ids.take(pa.array(order)).to_pylist()), return_inverse=True)[1]
            order = order[np.lexsort((rank, dist[order], rows[order]))]
            order = order[np.arange(len(order)) - np.searchsorted(rows[order], rows[order]) < self.k]
        self.kept, self.fresh = [(rows[order], dist[order], ids.take(pa.array(order)))], 0
        return self.kept[0]


def nearest_samples(counts: DataFrame, k: int, block: int = 64) -> DataFrame:
    """``sample, rank, neighbour, dist``: the ``k`` nearest other samples, ties to the smaller id.

    ``block`` samples at least are held against others at a time.
    """
    packed = _packed(counts, block)
    kind = counts.schema["sample"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[pa.Array, _Nearest]] = {}

        def of(side) -> _Nearest:
            return best.setdefault(side.block, (side.ids, _Nearest(k, len(side.ids))))[1]

        def given(number: int) -> Iterator[pa.RecordBatch]:
            ids, found = best.pop(number)
            if rest := found.settle():
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rest[0])), rest[2], pa.array(rest[1])], ["a", "b", "dist"])

        left = None
        for a, b, (i, j, shared) in matched(batches, np.minimum, sparse=True):
            if left is not None and left != a.block and left in best:
                yield from given(left)
            left = a.block
            dist = 1 - 2 * shared / (a.totals[i] + b.totals[j])
            if a.block == b.block:  # both directions are there
                i, j, dist = (x[i != j] for x in (i, j, dist))
            else:
                of(b).add(j, dist, a.ids, i)
            of(a).add(i, dist, b.ids, j)
        for number in list(best):
            yield from given(number)

    place = W.partitionBy("a").orderBy("dist", "b")
    met = block_pairs(packed).mapInArrow(run, f"a {kind}, b {kind}, dist double")
    found = materialize(met.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).drop("rank"), "near-found")

    # samples with fewer than k relatives go on with those they share nothing with, smallest ids first
    samples = packed.filter(F.col("hi") == LAST).select(F.explode("ids").alias("a"))
    few = samples.join(found.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a", "left").filter(F.coalesce("n", F.lit(0)) < k).select("a")
    ids = samples.select(F.col("a").alias("b")).orderBy("b").limit(2 * k + 1)
    spare = few.join(F.broadcast(ids), F.col("a") != F.col("b")).join(found.select("a", "b"), ["a", "b"], "left_anti")
    every = found.unionByName(spare.withColumn("dist", F.lit(1.0)))
    return (
        every.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
        .select(F.col("a").alias("sample"), "rank", F.col("b").alias("neighbour"), "dist")
    )
