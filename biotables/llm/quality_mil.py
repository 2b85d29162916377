"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of ``PASSAGE`` bytes. Every passage is encoded: byte and byte-pair
frequencies, how far its words repeat, its length, then one tanh layer. Gated attention (tanh times sigmoid) gives each passage a weight
within its document; the weighted mean of the encodings is the document, which one logistic unit
scores. All weights are learned from document labels only.

Fitting uses a bounded sample: at most ``train_docs`` labelled documents, taken in hash order of the id,
at most ``train_passages`` passages of each, evenly spread. Scoring reads every passage of every text.

Defined cases: null text is empty; an empty text is one empty passage and gets a score; repeated rows
are scored alike; labels other than 0 and 1 and null ids are not learned from; a document with several
labels counts by the larger; without any labels all scores are 0.5. Other columns are carried along;
those named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biotables.llm.columns import cut_points, table, text_bytes
from biotables.llm.ngram_jaccard import placed_words

PASSAGE = 512
PAIRS = 256
SHAPE = 3
FEATURES = 256 + PAIRS + SHAPE
#: bytes that every passage is read as if it had more of, so that a few letters say little
CALM = 64
HIDDEN, GATE = 32, 16
TRAIN_DOCS = 3000
TRAIN_PASSAGES = 32
#: passes over the sample, and gradient steps at least
EPOCHS, STEPS = 12, 600
#: bytes turned into features at once
WORK_BYTES = 2 << 20


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and the first passage of each document (one more at the end)."""
    size = np.diff(offsets)
    count = np.maximum(1, -(-size // PASSAGE))
    first = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(size)), size)
    passage = first[doc] + (np.arange(len(data)) - offsets[doc]) // PASSAGE
    total = int(first[-1])
    single = np.bincount(passage * 256 + data, minlength=total * 256).reshape(total, 256)
    wide = data.astype(np.int64)
    same = passage[1:] == passage[:-1]
    pair = ((wide[:-1] * 157 + wide[1:] * 31) % PAIRS)[same]
    double = np.bincount(passage[:-1][same] * PAIRS + pair, minlength=total * PAIRS).reshape(total, PAIRS)
    n = single.sum(axis=1, dtype=np.float32)
    x = np.concatenate([single, double], axis=1).astype(np.float32) / (n + CALM)[:, None]
    return np.concatenate([np.sqrt(x), shape(data, offsets, passage, total), np.sqrt(n / PASSAGE)[:, None]], axis=1), first


def shape(data: np.ndarray, offsets: np.ndarray, passage: np.ndarray, total: int) -> np.ndarray:
    """Share of words that repeat the word before, and share of different words, of each passage."""
    word, begin = placed_words(data, offsets)
    of = passage[begin]
    words = np.bincount(of, minlength=total)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((word, of))
    new = np.ones(len(word), bool)
    new[1:] = (word[order][1:] != word[order][:-1]) | (of[order][1:] != of[order][:-1])
    most = np.maximum(1, words)
    return np.stack([np.bincount(of[again], minlength=total) / most, np.bincount(of[order][new], minlength=total) / most], axis=1).astype(np.float32)


@dataclass
class Model:
    """Weights of encoder, gated attention and classifier."""

    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    d: np.ndarray

    @staticmethod
    def start(seed: int = 7) -> Model:
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        return Model(draw(FEATURES, HIDDEN) * 3, np.zeros(HIDDEN, np.float32), draw(HIDDEN, GATE), draw(HIDDEN, GATE), draw(GATE), draw(HIDDEN), np.zeros(1, np.float32))

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        at = first[:-1]
        bag = np.repeat(np.arange(len(at)), np.diff(first))
        h = np.tanh(x @ self.w + self.b)
        t, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        e = (t * g) @ self.a
        e = np.exp(e - np.maximum.reduceat(e, at)[bag])
        weight = e / np.add.reduceat(e, at)[bag]
        z = np.add.reduceat(weight[:, None] * h, at, axis=0)
        score = 1 / (1 + np.exp(-np.clip(z @ self.c + self.d, -30, 30)))
        return {"x": x, "at": at, "bag": bag, "h": h, "t": t, "g": g, "weight": weight, "z": z, "score": score}

    def gradients(self, s: dict[str, np.ndarray], y: np.ndarray) -> list[np.ndarray]:
        err = ((s["score"] - y) / len(y)).astype(np.float32)
        dz = err[:, None] * self.c
        dh = s["weight"][:, None] * dz[s["bag"]]
        # softmax within each bag
        dweight = (s["h"] * dz[s["bag"]]).sum(axis=1)
        mean = np.add.reduceat(s["weight"] * dweight, s["at"])
        de = s["weight"] * (dweight - mean[s["bag"]])
        dt = de[:, None] * self.a * s["g"] * (1 - s["t"] ** 2)
        dg = de[:, None] * self.a * s["t"] * s["g"] * (1 - s["g"])
        dh += dt @ self.v.T + dg @ self.u.T
        dp = dh * (1 - s["h"] ** 2)
        return [s["x"].T @ dp, dp.sum(axis=0), s["h"].T @ dt, s["h"].T @ dg, (s["t"] * s["g"]).T @ de, s["z"].T @ err, err.sum(keepdims=True)]

    def parts(self) -> list[np.ndarray]:
        return [self.w, self.b, self.v, self.u, self.a, self.c, self.d]


def fit(bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Adam over small groups of bags; the same bags in the same order give the same model."""
    model = Model.start(seed)
    if not len(y):
        model.c[:] = 0
        return model
    r = np.random.default_rng(seed)
    m, v = ([np.zeros_like(p) for p in model.parts()] for _ in range(2))
    step = 0
    for _ in range(max(epochs, -(-STEPS * 32 // len(y)))):
        order = r.permutation(len(y))
        for a in range(0, len(y), 32):
            pick = order[a : a + 32]
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in pick])])
            grads = model.gradients(model.forward(np.concatenate([bags[i] for i in pick]), first), y[pick])
            step += 1
            for p, g, mean, square in zip(model.parts(), grads, m, v):
                mean += 0.1 * (g - mean)
                square += 0.001 * (g * g - square)
                p -= (0.003 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def pieces(rows: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with their feature rows."""
    points = cut_points(np.diff(text_bytes(rows.column(text))[1]), WORK_BYTES)
    for a, b in zip(points, points[1:]):
        part = rows.slice(a, b - a)
        yield (part, *features(*text_bytes(part.column(text))))


def held_out(id_: Column) -> Column:
    """True for ids that are kept from learning: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(id_.cast("string")) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    train_docs: int = TRAIN_DOCS, train_passages: int = TRAIN_PASSAGES, seed: int = 7,
) -> Model:
    """Model from labelled documents that are not held out; see the sample bounds above."""
    picked = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
        .groupBy("id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(train_docs)
    )
    # at most train_docs rows of two numbers
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part, x, first in pieces(batch, "text"):
                bags = []
                for a, b in zip(first, first[1:]):
                    pick = np.unique(np.linspace(a, b - 1, min(b - a, train_passages)).astype(np.int64))
                    bags.append(np.round(x[pick] * 255).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(bags, pa.binary())], ["id", "label", "bag"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.select("id", "text", "label").mapInArrow(encode, f"id {kind}, label int, bag binary").collect()
    found.sort(key=lambda r: (str(r["id"]), bytes(r["bag"])))
    bags = [np.frombuffer(r["bag"], np.uint8).reshape(-1, FEATURES).astype(np.float32) / 255 for r in found]
    return fit(bags, np.array([r["label"] for r in found], np.float32), seed=seed)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score: the probability of label 1."""
    docs = docs.drop("score")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part, x, first in pieces(batch, text_col):
                found = model.forward(x, first)["score"].astype(np.float64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], [*part.schema.names, "score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kept}, score double")


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = train(docs, table(spark, folder, "labels"))
    # the score leaves the texts behind: only the id goes on
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


#: a learned model; tests hold it against labels that it has not seen
ORACLE_SQL = None
