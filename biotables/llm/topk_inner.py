"""Exact top-k by inner product: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Components become integers, so every score is exact. Vectors are sorted by length over the whole table
and packed into blocks. Each block of queries meets each block of vectors in one call: blocks whose
longest vector cannot reach the tenth score so far are left out whole; within a block, the first
components of the rotation (those with most of the sum of squares) give a partial sum, the lengths of the rest
bound what can still come, and only pairs beyond the tenth score are computed. First bounds come
from the longest vectors of all; they only steer the pruning.

Defined cases: vectors that are null or hold null or non-finite components, and rows with a null id, take
no part; empty vectors score 0; shorter vectors are read as filled up with zeros; candidates with the
query's own id are its own row; of several query rows with one id the largest vector counts; an empty
table gives no rows; other columns are left out. Scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biotables.llm.columns import table
from biotables.session import materialize

K = 10
SCALE = 1024
EVERY = 100
#: vectors per block; first bounds come from one block of the longest
BLOCK = 2048
QUERY_BLOCK = 1024
#: vectors compared between two updates of the bounds
STEP = 512


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, v (integers), norm."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    whole = F.expr("forall(x, a -> a is not null and not isnan(a) and abs(a) < double('infinity'))")
    return (
        rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & whole)
        .withColumn("v", F.transform("x", lambda a: F.floor(a * F.lit(float(scale))).cast("long")))
        .select("vec_id", "v", F.expr("sqrt(aggregate(v, 0D, (s, a) -> s + double(a) * double(a)))").alias("norm"))
    )


def dense(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < size[:, None]] = np.asarray(column.flatten())
    return out


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all vectors, largest first, from sums of products (width x width numbers)."""

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for part in parts:
            x = dense(part.column(0), width).astype(np.float64)
            total += x.T @ x
        at = np.arange(width * width)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel())], ["cell", "total"])

    cells = rows.select("v").mapInArrow(add, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect()
    gram = np.zeros(width * width)
    for cell, total in cells:
        gram[cell] = total
    gram = np.nan_to_num(gram).reshape(width, width)
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1]


class Best:
    """The k best (score, id) of each query, ties to the smaller id."""

    def __init__(self, queries: int, k: int, bound: np.ndarray):
        self.k, self.bound = k, bound.copy()
        self.query, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.queries = queries

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query, ids, score = (np.concatenate(x) for x in ((self.query, query), (self.id, ids), (self.score, score)))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        first = np.searchsorted(query, np.arange(self.queries))
        rank = np.arange(len(query)) - first[query]
        keep = rank < self.k
        self.query, self.id, self.score = query[keep], ids[keep], score[keep]
        full = self.query[rank[keep] == self.k - 1]
        self.bound[full] = np.maximum(self.bound[full], self.score[rank[keep] == self.k - 1])


def search(queries: np.ndarray, query_ids: np.ndarray, bound: np.ndarray, vectors: np.ndarray, ids: np.ndarray, turn: np.ndarray, k: int) -> Best:
    """Best of one block for each query; ``vectors`` by descending length, ``bound``: scores below it do not count."""
    best = Best(len(queries), k, bound)
    width = queries.shape[1]
    head = max(1, width // 4)
    q, x = queries.astype(np.float64), vectors.astype(np.float64)
    exact_in_float = np.abs(q).sum(axis=1).max(initial=0) * np.abs(x).max(initial=0) < 2.0**52
    q_turned, x_turned = q @ turn, x @ turn
    q_norm, x_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    q_rest, x_rest = (np.sqrt((a[:, head:] ** 2).sum(axis=1)) for a in (q_turned, x_turned))
    for a in range(0, len(vectors), STEP):
        s = slice(a, a + STEP)
        # rounding of the rotation, with room to spare
        slack = 1e-9 * (1 + q_norm * x_norm[s].max(initial=0))
        alive = np.flatnonzero(q_norm * x_norm[s].max(initial=0) + slack >= best.bound)
        if not len(alive):
            break
        upper = q_turned[alive, :head] @ x_turned[s, :head].T + q_rest[alive, None] * x_rest[None, s]
        hit = upper + slack[alive, None] >= best.bound[alive, None]
        hit &= query_ids[alive, None] != ids[None, s]
        if not hit.any():
            continue
        if exact_in_float:
            score = (q[alive] @ x[s].T).astype(np.int64)
        else:
            score = queries[alive] @ vectors[s].T
        hit &= score >= best.bound[alive, None]
        row, col = np.nonzero(hit)
        best.add(alive[row], ids[s][col], score[row, col])
    return best


def top_k(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY, scale: int = SCALE
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all rows for each row whose id is divisible by ``every``."""
    rows = materialize(integer_vectors(vectors, id_col, vector_col, scale), "vectors")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.max("v").alias("v"))
    facts = rows.agg(F.count("*"), F.max(F.size("v")), F.sum((F.pmod("vec_id", F.lit(every)) == 0).cast("long"))).first()
    total, width, wanted = (int(x or 0) for x in facts)
    width = max(1, width)
    turn = rotation(rows, width)
    query_blocks = wanted // QUERY_BLOCK + 1
    low = float(np.iinfo(np.int64).min)

    asked = (
        asked.withColumn("query_block", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int"))
        .groupBy("query_block").agg(F.collect_list(F.struct("vec_id", "v")).alias("queries"))
    )
    longest = rows.orderBy(F.desc("norm"), "vec_id").limit(BLOCK).agg(F.collect_list(F.struct("vec_id", "v")).alias("vectors"))
    first = longest.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def matrix(value: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        rows_ = value.values
        return np.asarray(rows_.field("vec_id")), dense(rows_.field("v"), width)

    def bounds(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for block, q, x in zip(part.column(0), part.column(1), part.column(2)):
                query_ids, q_ = matrix(q)
                ids, x_ = matrix(x)
                order = np.argsort(-(x_.astype(np.float64) ** 2).sum(axis=1), kind="stable")
                found = search(q_, query_ids, np.full(len(q_), low), x_[order], ids[order], turn, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.as_py()], pa.int32()), pa.array([q.as_py()], part.schema.field(1).type), pa.array([found.bound.tolist()], pa.list_(pa.float64()))],
                    ["query_block", "queries", "bound"],
                )

    kind = "array<struct<vec_id:bigint,v:array<bigint>>>"
    known = materialize(
        asked.join(first, "query_block").select("query_block", "queries", "vectors").mapInArrow(bounds, f"query_block int, queries {kind}, bound array<double>"),
        "query-blocks",
    )

    def blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a in range(0, part.num_rows, BLOCK):
                piece = part.slice(a, BLOCK)
                packed = pa.StructArray.from_arrays([piece.column(0), piece.column(1)], ["vec_id", "v"])
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), packed)], ["vectors"]
                )

    # a task gets whole blocks; the id splits vectors of one length
    count = min(total // BLOCK + 1, 4 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = rows.repartitionByRange(count, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    dealt = (
        sorted_.select("vec_id", "v").mapInArrow(blocks, f"vectors {kind}")
        .withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    )

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for q, bound, x in zip(part.column(0), part.column(1), part.column(2)):
                query_ids, q_ = matrix(q)
                ids, x_ = matrix(x)
                found = search(q_, query_ids, np.asarray(bound.values), x_, ids, turn, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query_ids[found.query]), pa.array(found.id), pa.array(found.score)], ["query_id", "vec_id", "score"]
                )

    pairs = dealt.join(known, "query_block").select("queries", "bound", "vectors").mapInArrow(score, "query_id long, vec_id long, score long")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"))


ORACLE_SQL = """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id,
        CAST(list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
    ), r AS (
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
