"""Importance resampling towards a target: hashed n-gram features, bucket gains, Gumbel top-k.

The CRC of a feature is an XOR of contributions: a byte adds a value that depends on the byte and on its
distance from the end of the feature, and the length adds a constant. The values are precomputed
(``position_table``); the features of a batch of texts are spans of one byte stream, and
``bitwise_xor.reduceat`` folds each span. Spans longer than the table are folded blockwise: the CRC of
what came before is moved on by the block's length, which is the same table applied to its four bytes.

Work is two scans of the texts: one adds up a count for each bucket (a fixed number of buckets, one
vector for each task), one adds the gains of a document's features. The draw is the head of a global
order (``operators.order``), so neither the scores nor the drawn rows meet in one task.

Defined cases: a null or empty text has no features and weight 0; a document with fewer than ``least``
words is scored but not drawn; a null doc_id has a null score and is not drawn; rows that repeat an id
are rows of their own, ordered by their number of features on equal scores; an empty table gives no
rows; without target texts the gains come from the corpus alone; other columns are left out of the
result, so clashing names cannot matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biotables.llm.columns import cut_points, table, text_bytes
from biotables.operators.order import with_position
from biotables.session import materialize

BUCKETS = 10_000
RUNS = 3
LEAST_WORDS = 20
SHARE = (5, 100)
SEED = 42
#: distances from the end that the table holds; longer spans are folded in blocks of so many bytes
DISTANCES = 128
#: bytes of text that one step turns into features
STEP_BYTES = 1 << 19

POLYNOMIAL = 0xEDB88320


@lru_cache(maxsize=2)
def position_table(distances: int = DISTANCES) -> np.ndarray:
    """``table[d, b]``: what byte ``b`` with ``d`` bytes behind it adds to the CRC register (started at zero)."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1)
    out = np.empty((distances, 256), np.uint32)
    out[0] = step
    for d in range(1, distances):
        out[d] = step[out[d - 1] & 0xFF] ^ (out[d - 1] >> 8)
    return out


@lru_cache(maxsize=2)
def length_constants(distances: int = DISTANCES) -> np.ndarray:
    """The all-ones start register moved on by 0 to ``distances`` bytes, final complement included."""
    step, value = position_table(distances)[0], 0xFFFFFFFF
    out = []
    for _ in range(distances + 1):
        out.append(value ^ 0xFFFFFFFF)
        value = int(step[value & 0xFF]) ^ (value >> 8)
    return np.array(out, np.uint32)


def moved_on(register: np.ndarray, by: np.ndarray, distances: int = DISTANCES) -> np.ndarray:
    """Registers after ``by`` zero bytes each (at most ``distances``): the table, applied to the register's own bytes.

    A register's first byte counts as one with ``by - 1`` bytes behind it; bytes that lie beyond the block
    only shift.
    """
    table_ = position_table(distances)
    out = np.zeros(len(register), np.uint32)
    for k in range(4):
        byte = (register >> np.uint32(8 * k)) & np.uint32(0xFF)
        inside = by > k
        out ^= np.where(inside, table_[np.where(inside, by - 1 - k, 0), byte], byte << (8 * np.maximum(k - by, 0)).astype(np.uint32))
    return out


def span_registers(data: np.ndarray, start: np.ndarray, end: np.ndarray, distances: int) -> np.ndarray:
    """XOR of the contributions of each span of at most ``distances`` bytes; spans are not empty."""
    size = end - start
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0)
    # distance from the end falls by one from byte to byte
    left = np.repeat(ends, size) - 1 - at
    byte = data[np.repeat(end, size) - 1 - left]
    values = position_table(distances).ravel()[left * 256 + byte]
    return np.bitwise_xor.reduceat(values, ends - size)


def span_crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray, distances: int = DISTANCES) -> np.ndarray:
    """CRC-32 of ``data[start:end]`` for arrays of spans that are not empty."""
    if not len(start):
        return np.zeros(0, np.uint32)
    size = end - start
    first = (size - 1) % distances + 1  # the odd block comes first, so that all others are full
    constants = length_constants(distances)
    register = span_registers(data, start, start + first, distances) ^ constants[first] ^ np.uint32(0xFFFFFFFF)
    long, done = np.flatnonzero(size > first), first.copy()
    while len(long):
        here = start[long] + done[long]
        block = np.full(len(long), distances)
        register[long] = moved_on(register[long], block, distances) ^ span_registers(data, here, here + distances, distances)
        done[long] += distances
        long = long[done[long] < size[long]]
    return register ^ np.uint32(0xFFFFFFFF)


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """A-Z lower-cased, and which bytes belong to words: digits, letters and everything beyond ASCII."""
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 32
    word = np.zeros(256, bool)
    word[0x30:0x3A] = word[0x61:0x7B] = word[0x80:] = True
    return lower, word


def word_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts, each with one space behind it: bytes, where words start and end, the text of each."""
    closed = pc.binary_join_element_wise(texts.cast(pa.large_binary()).fill_null(b""), pa.scalar(b"\0", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    raw, where = text_bytes(closed)
    lower, word = letters()
    raw = lower[raw]
    inside = word[raw]
    behind = np.zeros(len(raw), bool)
    behind[1:] = inside[:-1]
    behind &= ~inside  # the byte behind a word; it stands for the space
    kept = inside | behind
    raw[behind] = 0x20
    data = raw[kept]
    end = np.flatnonzero(behind[kept])
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    owner = np.searchsorted(where, np.flatnonzero(behind), side="right") - 1
    return data, start, end, owner


def feature_buckets(texts: pa.Array, runs: int, buckets: int, seen: int = 0, distances: int = DISTANCES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For run lengths 1, 2 ... the bucket and the text of each feature that does not end in the first ``seen`` words."""
    data, start, end, owner = word_stream(texts)
    for run in range(1, runs + 1):
        first = np.arange(max(seen - run + 1, 0), max(len(start) - run + 1, 0))
        first = first[owner[first] == owner[first + run - 1]]
        crc = span_crc32(data, start[first], end[first + run - 1], distances)
        yield (crc % np.uint32(buckets)).astype(np.int64), owner[first]


def windows(raw: np.ndarray, runs: int, most: int) -> Iterator[tuple[pa.Array, int]]:
    """A long text in parts of about ``most`` bytes, cut between words; each part repeats the last words of the one before."""
    lower, word = letters()
    at, head, seen = 0, b"", 0
    while at < len(raw):
        end = at + most
        while end < len(raw):  # on to the end of the word
            gap = np.flatnonzero(~word[lower[raw[end : end + 4096]]])
            if len(gap):
                end += int(gap[0])
                break
            end += 4096
        part = pa.array([head + raw[at:end].tobytes()], pa.large_binary())
        yield part, seen
        data, start, *_ = word_stream(part)
        seen = min(runs - 1, len(start))
        head, at = (data[start[-seen] :].tobytes() if seen else b""), end


def steps(rows: pa.RecordBatch, column: int, runs: int, most: int = STEP_BYTES) -> Iterator[tuple[int, pa.Array, int]]:
    """Texts in steps of about ``most`` bytes: row of the first text, the texts, words of it that were seen before."""
    raw, where = text_bytes(rows.column(column))
    points = cut_points(np.diff(where), most)
    for a, b in zip(points, points[1:]):
        if where[b] - where[a] > most:  # one long text, maybe behind empty ones
            yield from ((b - 1, part, seen) for part, seen in windows(raw[where[a] : where[b]], runs, most))
        else:
            yield a, rows.column(column).slice(a, b - a), 0


def bucket_counts(
    texts: DataFrame, text_col: str = "text", runs: int = RUNS, buckets: int = BUCKETS, step_bytes: int = STEP_BYTES
) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket (only those that have any)."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for rows in parts:
            for _, part, seen in steps(rows, 0, runs, step_bytes):
                for bucket, _ in feature_buckets(part, runs, buckets, seen):
                    total += np.bincount(bucket, minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(total[full])], ["bucket", "n"])

    return texts.select(F.col(text_col).cast("string")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket in thousandths; the counts that reach the driver are one row for each bucket."""
    spark = corpus.sparkSession
    both = (
        spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
        .join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
        .select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t")).collect()
    )
    s, t = np.zeros(buckets), np.zeros(buckets)
    for row in both:
        s[row["bucket"]], t[row["bucket"]] = row["s"], row["t"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(
    docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS, step_bytes: int = STEP_BYTES
) -> DataFrame:
    """doc_id, n_words, n_features, weight: the gains of all features of each text, added up."""
    buckets, kind = len(gains), docs.schema[id_col].dataType.simpleString()

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            words, features, weight = (np.zeros(rows.num_rows, np.int64) for _ in range(3))
            for first, part, seen in steps(rows, 1, runs, step_bytes):
                here = slice(first, first + len(part))
                for run, (bucket, owner) in enumerate(feature_buckets(part, runs, buckets, seen), start=1):
                    count = np.bincount(owner, minlength=len(part))
                    features[here] += count
                    if run == 1:
                        words[here] += count
                    if len(owner):  # owners rise, so each text is one run
                        new = np.flatnonzero(np.diff(owner, prepend=-1))
                        weight[first + owner[new]] += np.add.reduceat(gains[bucket], new)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(words), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"]
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        add, f"doc_id {kind}, n_words long, n_features long, weight long"
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    runs: int = RUNS,
    buckets: int = BUCKETS,
    least: int = LEAST_WORDS,
    share: tuple[int, int] = SHARE,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: every document; rank is null where it is not drawn.

    ``share`` of the documents with at least ``least`` words are drawn without replacement, in proportion
    to exp(weight / 1000): the highest weights after Gumbel noise from a hash of seed and id.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, runs, buckets), bucket_counts(target, text_col, runs, buckets), buckets)
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((hashed + 0.5) / F.lit(4294967296.0))))
    scored = weights(docs, gains, id_col, text_col, runs).withColumn("score", (F.col("weight") + noise).cast("long"))
    scored = scored.withColumn("__may", F.coalesce((F.col("n_words") >= least) & F.col("score").isNotNull(), F.lit(False)))
    scored = materialize(scored, "scored")  # else the range borders are sampled by another scan of the texts
    placed = with_position(scored, F.desc("__may"), F.desc("score"), F.asc("doc_id"), F.asc("n_features"), name="rank")
    drawn = placed.where("__may").count() * share[0] // share[1]
    return placed.withColumn("rank", F.when(F.col("__may") & (F.col("rank") <= drawn), F.col("rank")).cast("long")).select(
        "doc_id", "n_words", "n_features", "weight", "score", "rank"
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    out = resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE_SQL = r"""
    WITH steps AS (
      SELECT list(c ORDER BY i) AS crc_of FROM (
        SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])),
          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))
    ), texts AS (
      SELECT 0 AS target, doc_id AS id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), text FROM benchmark
    ), words AS (
      SELECT target, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
    ), runs AS (
      SELECT target, id, array_to_string(w[p:p + n - 1], ' ') AS f
      FROM (SELECT target, id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM words, (VALUES (1), (2), (3)) r(n))
    ), hex_of AS (
      SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM runs)
    ), bucket_of AS (
      SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT,
          list_transform(generate_series(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
        lambda c, b: xor(crc_of[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
      FROM hex_of, steps
    ), placed AS (
      SELECT target, id, bucket FROM runs JOIN bucket_of USING (f)
    ), counts AS (
      SELECT bucket, count(*) FILTER (target = 0) AS s, count(*) FILTER (target = 1) AS t FROM placed GROUP BY bucket
    ), gains AS (
      SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (S_all + 10000) / (CAST(s + 1 AS DOUBLE) * (T_all + 10000)))) AS BIGINT) AS gain
      FROM counts, (SELECT sum(s) AS S_all, sum(t) AS T_all FROM counts)
    ), added AS (
      SELECT id AS doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight
      FROM placed JOIN gains USING (bucket) WHERE target = 0 GROUP BY id
    ), scored AS (
      SELECT w.id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('42:' || w.id), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
      FROM words w LEFT JOIN added a ON a.doc_id = w.id WHERE target = 0
    ), ranked AS (
      SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
        count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored
    )
    SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
      CAST(CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS BIGINT) AS rank FROM ranked"""
