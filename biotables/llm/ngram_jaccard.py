"""N-gram Jaccard join: which documents share at least three quarters of their word shingles.

1. Documents are packed into batches; ``exchange.shared_keys`` counts the documents of every shingle.
2. Shingles are ordered by that count, rare ones first. Two documents that link share one of the first
   n - ceil(3n/4) + 1 shingles of each. Documents whose first shingles are all their own link with
   nothing; that is most of them. Equal sets of a batch are reduced to the smallest id.
3. Documents that share a first shingle are candidates of each other; the connected components of this
   relation are the blocks. A block above ``UNIT`` documents is dealt into parts, and each pair of
   parts is a unit of its own.
4. In a unit, tokens are hashed into ``GROUPS`` groups and the group counts of each set are a point of an
   R-tree. The overlap of a set with any set below a node is at most the sum of the coordinate minima of
   its point and the node's largest coordinates; below the overlap that the threshold asks for, the node
   is left out. What passes is verified on the sets, unless both are already connected.
5. The components of the links are the result.

Defined cases: null and empty texts have no shingles and link with nothing; texts with fewer words than a
shingle have one, the whole sequence; rows with equal ids are one node; rows with a null id get a null
component and link with nothing; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biotables.llm.columns import bucket_count, packed_batches, table, text_bytes, unpack, with_answers
from biotables.llm.components import components
from biotables.llm.exchange import classes_of, shared_keys
from biotables.session import materialize

WORDS = 5
#: threshold as a fraction: intersection / union >= 75 / 100
PART, WHOLE = 75, 100
GROUPS = 64
NODE = 16
UNIT = 4000
BUCKET_BYTES = 32 << 20

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
LETTER = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def placed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash (A-Z lower-cased) and first byte of every word."""
    inside = ~SPACE[data]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, U), np.zeros(0, np.int64)
    breaks = np.zeros(len(data) + 1, bool)
    breaks[offsets] = True
    opens = np.empty(len(at), bool)
    opens[0] = True
    opens[1:] = (at[1:] != at[:-1] + 1) | breaks[at[1:]]
    first = np.flatnonzero(opens)
    size = np.diff(np.append(first, len(at)))
    power = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, U))
    place = np.arange(len(at)) - np.repeat(first, size)
    total = np.add.reduceat(LETTER[LOWER[data[at]]] * power[place], first)
    return mix(total + size.astype(U)), at[first]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the first word of each row, one more at the end."""
    hashes, begin = placed_words(data, offsets)
    return hashes, np.searchsorted(begin, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle keys, sorted by row and key, and the first of each row, one more at the end."""
    hashes, first = word_hashes(data, offsets)
    count = np.diff(first)
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    n = len(hashes) - words + 1
    if n > 0:
        key = hashes[words - 1 :].copy()
        for k in range(words - 2, -1, -1):
            key = mix(hashes[k : k + n] + mix(key))
        row = np.searchsorted(first, np.arange(n), "right") - 1
        ok = np.arange(n) + words <= first[row + 1]
        rows.append(row[ok])
        keys.append(key[ok])
    for row in np.flatnonzero((count > 0) & (count < words)):
        key = np.array([count[row]], U)
        for k in range(first[row], first[row + 1]):
            key = mix(hashes[k : k + 1] + mix(key))
        rows.append(np.array([row]))
        keys.append(key)
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    return keys[new], np.searchsorted(rows[new], np.arange(len(offsets)))


class CountTree:
    """R-tree over group-count vectors, bulk-loaded by size; asks for sets that can reach the threshold."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        counts = np.stack([np.bincount((s >> U(58)).astype(np.int64), minlength=GROUPS) for s in sets]).astype(np.int32)
        # neighbours in the order are of like size and shape
        self.order = np.lexsort((counts[:, 2], counts[:, 1], counts[:, 0], self.size))
        self.counts = counts
        self.levels = [(counts[self.order], self.size[self.order], self.size[self.order])]
        while len(self.levels[-1][0]) > NODE:
            most, small, large = self.levels[-1]
            cuts = np.arange(0, len(most), NODE)
            self.levels.append((np.maximum.reduceat(most, cuts), np.minimum.reduceat(small, cuts), np.maximum.reduceat(large, cuts)))

    def ask(self, i: int) -> np.ndarray:
        """Sets that may link with set ``i``, the likeliest first."""
        own, n = self.counts[i], int(self.size[i])
        alive = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            most, small, large = (x[alive] for x in self.levels[depth])
            bound = np.minimum(most, own).sum(axis=1)
            least = np.maximum(small, -(-PART * n // WHOLE))
            ok = ((WHOLE + PART) * bound >= PART * (n + least)) & (WHOLE * large >= PART * n) & (PART * small <= WHOLE * n)
            alive, bound = alive[ok], bound[ok]
            if depth:
                below = len(self.levels[depth - 1][0])
                alive = (alive[:, None] * NODE + np.arange(NODE)).ravel()
                alive = alive[alive < below]
        return self.order[alive[np.argsort(-bound, kind="stable")]]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return WHOLE * both >= PART * (len(a) + len(b) - both)


def joined(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what links connect: a spanning forest of the unit, as pairs of ids.

    With ``side``, pairs of the same side are left to the unit of that side.
    """
    tree = CountTree(sets)
    label = np.arange(len(ids))
    out = []
    for i in range(len(ids)):
        ask = tree.ask(i)
        if side is not None:
            ask = ask[side[ask] != side[i]]
        # what is connected already needs no look at the sets
        while len(ask := ask[label[ask] != label[i]]):
            j, ask = int(ask[0]), ask[1:]
            if linked(sets[i], sets[j]):
                label[label == label[j]] = label[i]
                out.append((int(ids[i]), int(ids[j])))
    return out


def members(batches: DataFrame, id_col: str, text_col: str, unit: int, bucket_bytes: int) -> DataFrame:
    """batch, row (place in the batch), doc_id, n_shingles, component_id of all rows of packed batches."""
    spark = batches.sparkSession
    buckets = bucket_count(batches, bucket_bytes)

    def keys_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        keys, first = shingles(*text_bytes(part.column(text_col)))
        return keys, np.repeat(np.arange(len(first) - 1), np.diff(first))

    def choose(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for batch, payload, answers in zip(part.column(0).to_pylist(), part.column(1), part.column(2)):
                rows = unpack(payload.as_py())
                keys, first = shingles(*text_bytes(rows.column(text_col)))
                count = np.diff(first)
                doc = np.repeat(np.arange(len(count)), count)
                classes = classes_of(keys, answers.as_py(), buckets)
                order = np.lexsort((keys, classes, doc))
                rank = np.arange(len(keys)) - first[doc]
                n = count[doc]
                early = (rank < n + (-PART * n // WHOLE) + 1) & (classes[order] > 0)
                early_keys, early_doc = keys[order][early], doc[early]
                cut = np.searchsorted(early_doc, np.arange(len(count) + 1))
                ids = rows.column(id_col).cast(pa.int64()).to_pylist()
                tokens: list = [None] * len(count)
                reps: list = [None] * len(count)
                same: dict[bytes, list[int]] = {}
                for i in np.flatnonzero(np.diff(cut)).tolist():
                    if ids[i] is not None:
                        same.setdefault(keys[first[i] : first[i + 1]].tobytes(), []).append(i)
                for members in same.values():
                    rep = min(members, key=lambda i: ids[i])
                    tokens[rep] = early_keys[cut[rep] : cut[rep + 1]].view(np.int64)
                    for i in members:
                        reps[i] = ids[rep]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), batch), pa.int64()), pa.array(np.arange(len(ids)), pa.int64()),
                        pa.array(ids, pa.int64()), pa.array(count, pa.int64()), pa.array(reps, pa.int64()),
                        pa.array(tokens, pa.list_(pa.int64())),
                    ],
                    ["batch", "row", "doc_id", "n", "rep", "tokens"],
                )

    shared = shared_keys(batches, keys_of, buckets)
    chosen = materialize(
        with_answers(batches, shared, "bucket", "payload")
        .mapInArrow(choose, "batch long, row long, doc_id long, n long, rep long, tokens array<long>"),
        "chosen",
    )

    # candidates: a star around the smallest document of each early shingle
    early = chosen.where("tokens is not null").select("doc_id", F.explode("tokens").alias("token"))
    hubs = early.groupBy("token").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("other")).where("hub < other")
    pairs = early.join(hubs.select("token", "hub"), "token").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    blocks = components(pairs)

    parts = blocks.groupBy("component").agg(F.ceil(F.count("*") / unit).cast("int").alias("parts"))
    units = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1) * 4
    placed = (
        chosen.where("tokens is not null").select("batch", "row", "doc_id")
        .join(blocks.join(parts, "component").select(F.col("id").alias("doc_id"), F.col("component").alias("block"), "parts"), "doc_id")
        .withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
        .withColumn("with", F.explode(F.expr("sequence(0, parts - 1)")))
        .withColumn("a", F.least("part", "with")).withColumn("b", F.greatest("part", "with"))
        .withColumn("unit", F.when(F.col("parts") == 1, F.pmod(F.xxhash64("block"), F.lit(units))).otherwise(F.xxhash64("block", "a", "b")))
        .select("batch", "row", "unit", "block", "a", "b", "part")
    )

    def sets_of(parts_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingle sets of the placed rows, one for each unit they belong to."""
        for part in parts_:
            for payload, answers in zip(part.column(0), part.column(1)):
                asked = answers.as_py()
                if not asked:
                    continue
                wanted = sorted({a["row"] for a in asked})
                rows = unpack(payload.as_py()).take(pa.array(wanted))
                keys, first = shingles(*text_bytes(rows.column(text_col)))
                ids = rows.column(id_col).cast(pa.int64()).to_pylist()
                at = {row: i for i, row in enumerate(wanted)}
                places = [at[a["row"]] for a in asked]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([a[k] for a in asked], t) for k, t in (("unit", pa.int64()), ("block", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("part", pa.int32()))),
                        pa.array([ids[i] for i in places], pa.int64()),
                        pa.array([keys[first[i] : first[i + 1]].tobytes() for i in places], pa.binary()),
                    ],
                    ["unit", "block", "a", "b", "part", "doc_id", "keys"],
                )

    dealt = (
        with_answers(batches, placed, "row", "unit", "block", "a", "b", "part").select("payload", "answers")
        .mapInArrow(sets_of, "unit long, block long, a int, b int, part int, doc_id long, keys binary")
    )

    def link(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, a, b), some in group.groupby(["block", "a", "b"], sort=False):
            some = some.sort_values("doc_id", kind="stable")
            sets = [np.frombuffer(k, U) for k in some["keys"]]
            out += joined(some["doc_id"].to_numpy(), sets, some["part"].to_numpy() if a != b else None)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    links = dealt.groupBy("unit").applyInPandas(link, "a long, b long")
    copies = chosen.where("rep is not null").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(links.union(copies))
    return (
        chosen.select("batch", "row", "doc_id", F.col("n").alias("n_shingles"))
        .join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .select("batch", "row", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    batches = packed_batches(docs.select(id_col, text_col), text_col, "shingles")
    return members(batches, id_col, text_col, unit, bucket_bytes).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their component, or a null id, with all their columns.

    The batches learn which of their rows go; the texts do not move.
    """
    batches = packed_batches(docs, text_col, "shingles")
    gone = members(batches, id_col, text_col, unit, bucket_bytes).where("component_id <> doc_id").select("batch", "row")

    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for payload, answers in zip(part.column(0), part.column(1)):
                rows = unpack(payload.as_py())
                stays = np.ones(rows.num_rows, bool)
                stays[[a["row"] for a in answers.as_py() or []]] = False
                yield rows.filter(pa.array(stays))

    return with_answers(batches, gone, "row").select("payload", "answers").mapInArrow(keep, docs.schema)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"))


ORACLE_SQL = r"""
    WITH RECURSIVE w AS MATERIALIZED (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
      FROM documents
    ), s AS MATERIALIZED (
      SELECT DISTINCT doc_id, md5_number(s) AS s FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w)
    ), n AS MATERIALIZED (
      SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
    ), pair AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
    ), link AS MATERIALIZED (
      SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
    ), both_ways AS MATERIALIZED (
      SELECT a, b FROM link UNION ALL SELECT b, a FROM link
    ), reach(a, b) AS (
      SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
    ), least AS (
      SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a
    )
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
    FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)"""
