"""Approximate nearest neighbours by inner product: inverted lists, rotated column blocks, adaptive dimension scan.

Vectors are scaled by the greatest length and lifted by one component to unit length, so that the largest
inner product is the smallest distance. A seeded random rotation spreads the variance evenly over the
dimensions. Centroids are fitted on a bounded sample; every vector goes to the list of its nearest
centroid. Blocks hold the rows of neighbouring lists with their rotated components dimension by
dimension (column blocks). A query scans its probed lists: after each block of dimensions the partial distance is held against the
distance of its k-th best so far by a hypothesis test, and candidates whose distance is larger beyond doubt are abandoned. Those that
survive all dimensions are scored on the original vectors in double precision.

How many lists a query probes is measured, not guessed: for a bounded sample of queries the exact answer
over all rows is computed, and the smallest number of lists with the wanted recall is taken.

How it spreads: list sizes and a plan of blocks (a few thousand numbers) are all that the driver sees
besides the samples. A list longer than a block is cut into several, so one vector in a third of all rows is spread over
tasks; queries are packed by their own list, and a pack is sent only to blocks that hold a list it probes.

Defined cases: vectors that are null, empty, of length zero or hold null or non-finite components, and
rows with a null id, take no part; shorter vectors are read as filled up with zeros; rows with the
query's own id are its own; of several query rows with one id the largest vector counts; equal scores go
by the smaller id; a query probes on until it has met k other rows, so it returns all candidates if
there are fewer; an empty table gives no rows; other columns are left out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biotables.llm.columns import table
from biotables.session import materialize

K = 20
EVERY = 20
SEED = 7
#: recall that the number of probed lists is chosen for, on at most so many sample queries
RECALL = 0.97
CALIBRATION = 256
#: rows that centroids are fitted on: at most so many numbers in all
SAMPLE_VALUES = 1 << 22
#: lists are four times the root of the rows, at most so many
MOST_LISTS = 4096
ROUNDS = 6
#: rows in a block of the index, queries in a pack
BLOCK = 4096
PACK = 1024
#: dimensions between two tests
STEP = 16
#: candidates are abandoned beyond so many standard deviations
EPSILON = 2.5
#: sample rows that give first bounds
BOUND_ROWS = 2048
#: pairs that one step compares
PAIRS = 1 << 18
#: rows that are held against all centroids at a time
ROWS = 1024


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x, norm of the rows that take part; float vectors stay floats."""
    kind = vectors.schema[vector_col].dataType.simpleString()
    x = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    whole = F.expr("forall(x, a -> a is not null and not isnan(a) and abs(a) < double('infinity'))")
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
        .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & whole)
        .withColumn("norm", F.expr("sqrt(aggregate(x, 0D, (s, a) -> s + double(a) * double(a)))"))
        .where("norm > 0")
    )


def dense(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix of doubles, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    out = np.zeros((len(column), width))
    out[np.arange(width) < size[:, None]] = np.asarray(column.flatten())
    return out


def orthogonal(width: int, seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))[0]


class Space:
    """Turns vectors into rotated unit vectors with one more component."""

    def __init__(self, width: int, longest: float, seed: int = SEED):
        self.width, self.longest, self.turn = width, longest or 1.0, orthogonal(width + 1, seed)

    def lift(self, x: np.ndarray) -> np.ndarray:
        scaled = x / self.longest
        rest = np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1)))
        return np.column_stack([scaled, rest]) @ self.turn

    def lift_query(self, q: np.ndarray) -> np.ndarray:
        unit = q / np.sqrt((q * q).sum(axis=1))[:, None]
        return np.column_stack([unit, np.zeros(len(q))]) @ self.turn


def nearest(lifted: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """List of each row, a few rows at a time: the scores of all rows would be rows times lists numbers."""
    if not len(centres):
        return np.zeros(len(lifted), np.int64)
    parts = [(lifted[a : a + ROWS] @ centres.T).argmax(axis=1) for a in range(0, len(lifted), ROWS)]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Spherical k-means of unit vectors, in an order in which neighbours stand near each other."""
    distinct = np.unique(sample, axis=0)
    pick = np.random.default_rng(seed).permutation(len(distinct))[:lists]
    found = distinct[np.sort(pick)].copy()
    if not len(found):
        return found
    for _ in range(rounds):
        own = nearest(distinct, found)
        order = np.argsort(own, kind="stable")
        have, first = np.unique(own[order], return_index=True)
        mean = np.add.reduceat(distinct[order], first)
        long = np.sqrt((mean * mean).sum(axis=1))
        found[have[long > 0]] = (mean / np.maximum(long, 1e-300)[:, None])[long > 0]
    # along a chain of the main directions, so that a block holds lists that are near each other
    if len(found) > 2:
        axes = np.linalg.svd(found - found.mean(axis=0), full_matrices=False)[2][:2]
        flat = found @ axes.T
        found = found[np.lexsort((flat[:, -1], np.round(8 * np.argsort(np.argsort(flat[:, 0])) / len(found))))]
    return found


def dealt(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First block and number of blocks of each list: short lists share a block, long ones have several."""
    first, count = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    block, filled = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if filled and filled + size > most:
            block, filled = block + 1, 0
        first[i], count[i] = block, max(1, -(-size // most))
        filled += size
        if count[i] > 1:
            block, filled = block + count[i], 0
    return first, count, block + 1


def with_block(rows: DataFrame, first: np.ndarray, count: np.ndarray) -> DataFrame:
    """Adds ``block``; rows of a long list are dealt over its blocks by a hash of the row."""
    spark = rows.sparkSession
    plan = spark.createDataFrame([(i, int(a), int(n)) for i, (a, n) in enumerate(zip(first, count))], "list int, first int, count int")
    turn = F.xxhash64("vec_id", F.monotonically_increasing_id())
    return (
        rows.withColumn("turn", turn).join(plan, "list")
        .withColumn("block", (F.col("first") + F.pmod("turn", F.col("count"))).cast("int")).drop("first", "count", "turn")
    )


def least_scores(lifted: np.ndarray, centres: np.ndarray, sizes: np.ndarray, own: np.ndarray, probes: int, k: int) -> np.ndarray:
    """Least centroid score of the lists that each query probes; ``own`` rows do not count as met."""
    score = lifted @ centres.T
    order = np.argsort(-score, axis=1, kind="stable")
    met = np.cumsum(sizes[order], axis=1)
    enough = (met < (k + own)[:, None]).sum(axis=1)
    last = np.minimum(np.maximum(enough, probes - 1), score.shape[1] - 1)
    # the same product is formed again in other shapes, where it may round otherwise
    return np.take_along_axis(score, order, axis=1)[np.arange(len(score)), last] - 1e-9


class Best:
    """The k best (score, id) of each query, ties to the smaller id; ``bound`` rises as they come in."""

    def __init__(self, k: int, bound: np.ndarray):
        self.k, self.bound = k, bound.copy()
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.kept.append((query, ids, score))
        self.waiting += len(query)
        if self.waiting > len(self.bound) * self.k:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, ids, score = (np.concatenate(x) for x in zip(*self.kept)) if self.kept else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        last = query[rank == self.k - 1]
        self.bound[last] = np.maximum(self.bound[last], score[rank == self.k - 1])
        keep = rank < self.k
        self.kept, self.waiting = [(query[keep], ids[keep], score[keep])], 0
        return self.kept[0]


def scan_list(
    best: Best, asked: np.ndarray, queries: np.ndarray, turned: np.ndarray, lengths: np.ndarray, own: np.ndarray,
    vectors: np.ndarray, ids: np.ndarray, columns: np.ndarray, longest: float, step: int, epsilon: float,
) -> int:
    """Scan one list for the queries ``asked``; returns how many dimensions of how many pairs were read.

    ``columns`` holds the rotated vectors dimension by dimension. Distances are between unit vectors, so a score s
    is the distance 2 - 2 s / (length of the query * greatest length).
    """
    dimensions, read = len(columns), 0
    width = max(1, PAIRS // max(1, len(asked)))
    for a in range(0, columns.shape[1], width):
        here = columns[:, a : a + width]
        limit = np.maximum(0, 2 - 2 * best.bound[asked] / (lengths[asked] * longest))
        query, row, partial = None, None, None
        for d in range(0, dimensions, step):
            end = min(d + step, dimensions)
            if query is None:  # all pairs: one product of the first column block
                q, x = turned[asked, d:end], here[d:end]
                dist = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=0)[None] - 2 * (q @ x)
                read += dist.size * (end - d)
            else:
                gap = here[d:end, row] - turned[query, d:end].T
                partial += (gap * gap).sum(axis=0)
                read += len(row) * (end - d)
            # after a random rotation the share of the first components in the whole has a beta distribution: if
            # even a share of epsilon deviations above its mean leaves the whole too large, the candidate goes
            spread = np.sqrt(2 * end * (dimensions - end) / (dimensions**2 * (dimensions + 2)))
            doubt = min(1.0, end / dimensions + epsilon * spread)
            if query is None:
                at, row = np.nonzero(dist <= (limit * doubt)[:, None] + 1e-5)
                query, partial = asked[at], dist[at, row]
            else:
                most = np.maximum(0, 2 - 2 * best.bound[query] / (lengths[query] * longest))
                stay = partial <= most * doubt + 1e-5
                query, row, partial = query[stay], row[stay], partial[stay]
            if not len(query):
                break
        if len(query):
            other = own[query] != ids[a + row]
            query, row = query[other], a + row[other]
            score = (queries[query] * vectors[row]).sum(axis=1)
            good = score >= best.bound[query]
            best.add(query[good], ids[row[good]], score[good])
    return read


def packed(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def originals(x: np.ndarray) -> bytes:
    """Floats where they hold the same numbers, doubles otherwise."""
    narrow = x.astype(np.float32)
    return packed(narrow) if (narrow == x).all() else packed(x)


def from_originals(raw: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * rows * width else np.float64).reshape(rows, width).astype(np.float64)


class Index:
    """Inverted lists over all rows; ``search`` answers queries that are rows of the same table."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None, block: int = BLOCK, seed: int = SEED):
        rows = usable(vectors, id_col, vector_col)
        facts = rows.agg(F.count("*"), F.max(F.size("x")), F.max("norm")).first()
        self.spark = vectors.sparkSession
        self.total, self.width, longest = int(facts[0]), int(facts[1] or 1), float(facts[2] or 1.0)
        self.space = Space(self.width, longest, seed)
        sample = self._sampled(rows, max(1, SAMPLE_VALUES // self.width), seed)
        lifted = dense(sample.column("x"), self.width)
        # the rows that give first bounds stay, the others only fit the centroids
        self.sample_ids = np.asarray(sample.column("vec_id")).astype(np.int64)[:BOUND_ROWS]
        self.sample = lifted[:BOUND_ROWS].copy()
        del sample
        lifted = self.space.lift(lifted) if len(lifted) else np.zeros((0, self.width + 1))
        wanted = lists or min(MOST_LISTS, int(4 * np.sqrt(self.total)) + 1)
        self.centres = centroids(lifted, wanted, seed=seed)
        self.sample_list = nearest(lifted[:BOUND_ROWS], self.centres)
        del lifted
        self.rows = materialize(self._assigned(rows), "ann-lists")
        self.sizes = np.zeros(max(1, len(self.centres)), np.int64)
        for r in self.rows.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
            self.sizes[r["list"]] = r["n"]
        self.first, self.count, self.block_count = dealt(self.sizes, block)
        self.blocks = materialize(self._blocks(), "ann-blocks")

    def _sampled(self, rows: DataFrame, most: int, seed: int) -> pa.Table:
        """The ``most`` rows with the smallest hashes of their ids. Rows far above them are left out before the sort, which is one task."""
        turn = F.xxhash64(F.col("vec_id"), F.lit(seed))
        taken = lambda of: of.orderBy(turn, "vec_id").limit(most).select("vec_id", "x").toArrow()
        if self.total > 4 * most:
            found = taken(rows.where(turn < F.lit(-(1 << 63) + (1 << 65) * most // self.total)))
            if found.num_rows == most:  # ids that come often may leave fewer
                return found
        return taken(rows)

    def _assigned(self, rows: DataFrame) -> DataFrame:
        space, centres, width = self.space, self.centres, self.width

        def assign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                lists = np.zeros(part.num_rows, np.int64)
                for a in range(0, part.num_rows, ROWS):
                    lists[a : a + ROWS] = nearest(space.lift(dense(part.column(1).slice(a, ROWS), width)), centres)
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), *part.columns], ["list", "vec_id", "x"])

        kind = rows.schema["x"].dataType.simpleString()
        return rows.select("vec_id", "x").mapInArrow(assign, f"list int, vec_id long, x {kind}")

    def _blocks(self) -> DataFrame:
        """block, rows, lists, ids, vectors, columns: lists in order, vectors as given and turned, dimension by dimension."""
        space, width = self.space, self.width

        def pack(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("list", kind="stable")
            x = dense(pa.array(group["x"].tolist(), pa.list_(pa.float64())), width)
            return pd.DataFrame(
                {
                    "block": [int(group["block"].iloc[0])], "rows": [len(x)], "lists": [packed(group["list"].to_numpy(np.int32))],
                    "ids": [packed(group["vec_id"].to_numpy(np.int64))], "vectors": [originals(x)],
                    "columns": [packed(space.lift(x).T.astype(np.float32))],
                }
            )

        return with_block(self.rows, self.first, self.count).groupBy("block").applyInPandas(
            pack, "block int, rows int, lists binary, ids binary, vectors binary, columns binary"
        )

    def calibrate(self, asked: DataFrame, k: int, recall: float, most: int = CALIBRATION) -> int:
        """Lists to probe for the wanted recall: exact answers over all rows for a sample of at most ``most`` queries."""
        space, width = self.space, self.width
        sample = asked.orderBy(F.xxhash64(F.col("vec_id"), F.lit(1)), "vec_id").limit(most).select("vec_id", "x").toArrow()
        ids, q = np.asarray(sample.column("vec_id")).astype(np.int64), dense(sample.column("x"), width)
        if not len(ids):
            return 1

        def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(k, np.full(len(ids), -np.inf))
            place = []
            for part in parts:
                for a in range(0, part.num_rows, 1024):
                    piece = part.slice(a, 1024)
                    score = q @ dense(piece.column(2), width).T
                    score[ids[:, None] == np.asarray(piece.column(1))[None]] = -np.inf
                    query, row = np.nonzero(score > best.bound[:, None])
                    # the place of the row in this task stands for its id until the end
                    best.add(query, sum(map(len, place)) + row, score[query, row])
                    place.append(np.asarray(piece.column(0)))
            query, row, score = best.settle()
            lists = np.concatenate([*place, np.zeros(0, np.int64)]).astype(np.int64)[row]
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(lists), pa.array(score)], ["query", "list", "score"])

        found = self.rows.mapInArrow(scan, "query long, list long, score double")
        top = Window.partitionBy("query").orderBy(F.desc("score"), "list")
        exact = found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query", "list").collect()
        if not exact:
            return 1
        query, lists = (np.array(x) for x in zip(*exact))
        score = space.lift_query(q) @ self.centres.T
        place = np.argsort(np.argsort(-score, axis=1, kind="stable"), axis=1)[query, lists]
        return int(np.sort(place)[min(len(place) - 1, int(np.ceil(recall * len(place))))]) + 1

    def search(
        self, k: int = K, every: int = EVERY, recall: float = RECALL, probes: int | None = None, pack_rows: int = PACK, step: int = STEP, epsilon: float = EPSILON
    ) -> DataFrame:
        """query_id, rank, vec_id, score: the ``k`` nearest found for each row whose id is divisible by ``every``."""
        asked = (
            self.rows.where(F.pmod("vec_id", F.lit(every)) == 0)
            .groupBy("vec_id").agg(F.max(F.struct("x", "list")).alias("most"), F.count(F.lit(1)).alias("own"))
            .select("vec_id", "most.x", "most.list", "own")
        )
        asked = materialize(asked, "ann-queries")
        self.probes = probes or self.calibrate(asked, k, recall)
        sizes = np.zeros(len(self.sizes), np.int64)
        for r in asked.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
            sizes[r["list"]] = r["n"]
        first, count, _ = dealt(sizes, pack_rows)
        packs = materialize(self._packs(with_block(asked, first, count), k), "ann-packs")
        space, centres, width = self.space, self.centres, self.width

        def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for row in part.to_pylist():
                    own, q = np.frombuffer(row["query_ids"], np.int64), from_originals(row["queries"], row["n"], width)
                    least, bound = np.frombuffer(row["least"]), np.frombuffer(row["bound"])
                    lists, ids = np.frombuffer(row["lists"], np.int32), np.frombuffer(row["ids"], np.int64)
                    x = from_originals(row["vectors"], row["rows"], width)
                    columns = np.frombuffer(row["columns"], np.float32).reshape(width + 1, row["rows"])
                    turned = space.lift_query(q)
                    narrow, lengths = turned.astype(np.float32), np.sqrt((q * q).sum(axis=1))
                    best = Best(k, bound)
                    starts = np.flatnonzero(np.diff(lists, prepend=-1))
                    probes_here = turned @ centres[lists[starts]].T >= least[:, None]
                    # the list most queries are near to comes first: it lifts their bounds
                    for i in np.argsort(-probes_here.sum(axis=0), kind="stable"):
                        a, b = starts[i], starts[i + 1] if i + 1 < len(starts) else len(lists)
                        on = np.flatnonzero(probes_here[:, i])
                        if len(on):
                            scan_list(best, on, q, narrow, lengths, own, x[a:b], ids[a:b], columns[:, a:b], space.longest, step, epsilon)
                    query, found, score = best.settle()
                    yield pa.RecordBatch.from_arrays([pa.array(own[query]), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

        units = packs.withColumn("block", F.explode("blocks")).drop("blocks").join(self.blocks, "block")
        found = units.mapInArrow(scan, "query_id long, vec_id long, score double")
        place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def _packs(self, asked: DataFrame, k: int) -> DataFrame:
        """Queries packed by their own list, with what they probe, a first bound from sample rows, and the blocks they need."""
        space, centres, width, probes = self.space, self.centres, self.width, self.probes
        ids, x, lists = self.sample_ids, self.sample, self.sample_list
        first, count, list_sizes = self.first, self.count, self.sizes

        def pack(group: pd.DataFrame) -> pd.DataFrame:
            own = group["vec_id"].to_numpy(np.int64)
            q = dense(pa.array(group["x"].tolist(), pa.list_(pa.float64())), width)
            lifted = space.lift_query(q)
            least = least_scores(lifted, centres, list_sizes, group["own"].to_numpy(np.int64), probes, k)
            open_ = lifted @ centres.T >= least[:, None]
            score = np.where(open_[:, lists] & (own[:, None] != ids[None]), q @ x.T, -np.inf)
            bound = np.full(len(q), -np.inf)
            if len(ids) >= k:
                kth = np.partition(score, -k, axis=1)[:, -k]
                bound = np.where(np.isfinite(kth), kth - 1e-9 * np.abs(kth), kth)
            need = np.flatnonzero(open_.any(axis=0))
            blocks = np.unique(np.concatenate([np.arange(first[i], first[i] + count[i]) for i in need]))
            return pd.DataFrame(
                {
                    "n": [len(q)], "query_ids": [packed(own)], "queries": [originals(q)], "least": [packed(least)],
                    "bound": [packed(bound)], "blocks": [blocks.astype(np.int32).tolist()],
                }
            )

        return asked.groupBy("block").applyInPandas(pack, "n int, query_ids binary, queries binary, least binary, bound binary, blocks array<int>")


def neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: build the index over all rows and search it."""
    return Index(vectors, id_col, vector_col).search(k, every, recall)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours(table(spark, folder, "embeddings"))


#: the answer is an approximation; tests and README hold its recall against brute force
ORACLE_SQL = None
