"""LM scoring by masked pseudo-likelihood with a bidirectional window network.

Every word is hidden in turn and predicted from the ``SIDE`` words before and after it; the sum of the
log-probabilities scores the document. The network (numpy) embeds the context words, has one tanh layer,
and predicts in two steps: the class of an entry, then the entry within its class. A third step is the share of
the word among the words of its entry, so the sum is a log-probability of words.

What it learns comes from all documents: the most frequent words have an entry of their own (share 1), the rest share
hashed entries. A word that all texts hold n times has the share n / (N + 1) of an entry whose words they hold N times;
what is left, 1 / (N + 1), is for words that no text holds. N is a fixed array. The counts of all words stay a Spark table:
the ``frequent`` most frequent words (a bound, counted in whole classes of counts) travel with the scoring pass, which stores
every other distinct word of a text with its score; those words meet their counts in a join.

Training runs in ``ROUNDS`` of growing shares of the texts, each text in one of them. Texts are cut into pieces of ``PIECE``
words that carry ``SIDE`` words beyond their borders; equal pieces are one row with a weight. A hash of the piece decides its
round and its unit (about ``UNIT_WORDS`` words, so units grow in number with the input); a unit goes through its pieces in
hash order from the model of the round before, and the models and step sizes of all units are averaged by their
words in two levels. Nothing of it depends on how the rows are partitioned, but for rounding.

Defined cases: null text is empty; an empty text has 0 words and log-probability 0; places outside the
text are a symbol of their own, so a single word is predicted from four of them; repeated rows are scored
alike; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biotables.llm.columns import cut_points, table, text_bytes
from biotables.llm.ngram_jaccard import U, mix, word_hashes
from biotables.session import materialize, task_count

SIDE = 2
SHIFTS = (*range(-SIDE, 0), *range(1, SIDE + 1))
CLASSES, PER_CLASS = 64, 64
ENTRIES = CLASSES * PER_CLASS
OWN = ENTRIES // 2  # entries of one word each
SHARED = ENTRIES - OWN  # a power of two
OUTSIDE = ENTRIES  # context symbol beyond the text
WIDTH, HIDDEN = 8, 16
RATE, GROUP = 0.05, 8192
ROWS = 1024  # words whose layers are worked on at once; results do not depend on it, but for rounding
LEAST_GROUP = 512  # a step takes an eighth of the words seen so far, within these two bounds
ROUNDS = (1, 4, 16)  # sixteenths of the texts that have been used after each round
PIECE, UNIT_WORDS, SLAB = 1 << 14, 1 << 21, 1 << 17
FREQUENT = 1 << 18
BLOCK = 1 << 12  # weights in one message
WORK_BYTES = 1 << 20


@dataclass
class Vocabulary:
    """Hashes of the ``OWN`` most frequent words, most frequent first; words of each shared entry in all texts; hashes of
    frequent words in order and their counts; the table of the other words with theirs (word, n); words of all texts."""

    own: np.ndarray
    totals: np.ndarray
    frequent: np.ndarray
    times: np.ndarray
    counts: DataFrame
    words: int

    def logs(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithm of the count of each word, 0 if it is not a frequent one; and whether it is."""
        if not len(self.frequent):
            return np.zeros(len(hashes)), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
        found = self.frequent[at] == hashes
        return np.where(found, np.log(self.times[at]), 0.0), found

    def __len__(self) -> int:
        return len(self.own)


def vocabulary(docs: DataFrame, text_col: str = "text", frequent: int = FREQUENT) -> Vocabulary:
    """Word counts of all texts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            # counts of a batch are added up before they leave it
            found = [np.unique(word_hashes(data, offsets)[0], return_counts=True) for _, data, offsets in grouped(rows, 0)]
            if not found:
                continue
            word, place = np.unique(np.concatenate([w for w, _ in found]), return_inverse=True)
            count = np.bincount(place, weights=np.concatenate([n for _, n in found]), minlength=len(word))
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(count.astype(np.int64))], ["word", "n"])

    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "word-counts")
    top = counts.orderBy(F.desc("n"), "word").limit(OWN).collect()
    own = np.array([r["word"] for r in top], np.int64).view(U)
    totals = np.zeros(SHARED, np.int64)
    for entry, n in counts.groupBy(F.col("word").bitwiseAND(F.lit(SHARED - 1)).alias("entry")).agg(F.sum("n")).collect():
        totals[entry] = n
    np.subtract.at(totals, (own % U(SHARED)).astype(np.int64), np.array([r["n"] for r in top], np.int64))
    # whole classes of counts, from the highest, as long as they hold no more than the bound
    level = F.floor(8 * F.log2("n"))
    sizes = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n")).collect()
    held, lowest = 0, None
    for r in sorted(sizes, key=lambda r: -r["level"]):
        held += r["size"]
        if held > frequent:
            break
        lowest = r["level"]
    chosen = counts.where(level >= lowest if lowest is not None else F.lit(False)).toArrow()
    word, times = chosen.column("word").to_numpy().view(U), chosen.column("n").to_numpy()
    order = np.argsort(word)
    rest = counts.where(level < lowest) if lowest is not None else counts
    return Vocabulary(own, totals, word[order], times[order], rest, int(sum(r["n"] for r in sizes)))


class Network:
    """Weights of the window network."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.standard_normal(shape) * 0.2).astype(np.float32)
        self.parts = [
            draw(ENTRIES + 1, WIDTH), draw(2 * SIDE * WIDTH, HIDDEN), np.zeros(HIDDEN, np.float32),
            draw(HIDDEN, CLASSES), np.zeros(CLASSES, np.float32),
            draw(CLASSES, HIDDEN, PER_CLASS), np.zeros((CLASSES, PER_CLASS), np.float32),
        ]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    @staticmethod
    def of(flat: np.ndarray) -> Network:
        made, at = Network(), 0
        for i, p in enumerate(made.parts):
            made.parts[i] = flat[at : at + p.size].reshape(p.shape).astype(np.float32)
            at += p.size
        return made

    def hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embedded context words, and the tanh layer with a column of ones for the biases of what follows."""
        embed, w, b = self.parts[:3]
        x = np.take(embed, context, axis=0).reshape(len(context), -1)
        h = np.ones((len(x), HIDDEN + 1), np.float32)
        h[:, :-1] = np.tanh(x @ w + b)
        return x, h

    def layers(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the classes and of the entries within each, the biases as last row."""
        wc, bc, ww, bw = self.parts[3:]
        return np.concatenate([wc, bc[None]]), np.concatenate([ww, bw[:, None]], axis=1)

    @staticmethod
    def exponentials(z: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Picked value of each row of ``z``, and the sum of the exponentials, which overwrite ``z``; large rows are shifted."""
        if z.max(initial=0) > 60:
            z -= z.max(axis=1, keepdims=True)
        chosen = z[np.arange(len(z)), pick]
        np.exp(z, out=z)
        return chosen, z @ np.ones(z.shape[1], z.dtype)

    @staticmethod
    def errors(z: np.ndarray, pick: np.ndarray, weight: np.ndarray) -> None:
        """Turn the rows of ``z`` into the weighted gradient of their loss."""
        total = Network.exponentials(z, pick)[1]
        z *= (weight / total)[:, None]
        z[np.arange(len(z)), pick] -= weight

    @staticmethod
    def runs(group: np.ndarray) -> list[tuple[int, int, int]]:
        """Class, first row and end of each run of a class."""
        edges = np.flatnonzero(group[1:] != group[:-1]) + 1
        starts = [0, *edges.tolist()]
        return list(zip(group[starts].tolist(), starts, [*starts[1:], len(group)]))

    def log_prob(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Log-probability of each word; words must be sorted by class."""
        outer, within = self.layers()
        out = np.empty(len(word), np.float32)
        for a in range(0, len(word), ROWS):
            some = word[a : a + ROWS]
            group, inner = some // PER_CLASS, some % PER_CLASS
            h = self.hidden(context[a : a + ROWS])[1]
            z = h @ outer
            chosen, total = self.exponentials(z, group)
            value = chosen - np.log(total)
            for c, i, j in self.runs(group):
                np.matmul(h[i:j], within[c], out=z[i:j])
            chosen, total = self.exponentials(z, inner)
            out[a : a + ROWS] = value + chosen - np.log(total)
        return out

    def step(self, context: np.ndarray, word: np.ndarray, weight: np.ndarray, square: list[np.ndarray]) -> None:
        """One adaptive gradient step; words must be sorted by class, and count ``weight`` times."""
        grads = self.gradients(context, word, weight)
        for p, g, q in zip(self.parts, grads, square):
            q += g * g
            p -= RATE * g / (np.sqrt(q) + 1e-6)

    def gradients(self, context: np.ndarray, word: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Gradient of the weighted loss of all words for each part; words must be sorted by class."""
        embed, w, b = self.parts[:3]
        outer, within = self.layers()
        dw, db, d_outer, d_within = np.zeros_like(w), np.zeros_like(b), np.zeros_like(outer), np.zeros_like(within)
        dx = np.empty((len(word), 2 * SIDE * WIDTH), np.float32)
        for a in range(0, len(word), ROWS):
            some, heavy = word[a : a + ROWS], weight[a : a + ROWS]
            group, inner = some // PER_CLASS, some % PER_CLASS
            x, h = self.hidden(context[a : a + ROWS])
            z = h @ outer
            self.errors(z, group, heavy)
            d_outer += h.T @ z
            dh = z @ outer.T
            cuts = self.runs(group)
            for c, i, j in cuts:
                np.matmul(h[i:j], within[c], out=z[i:j])
            self.errors(z, inner, heavy)
            for c, i, j in cuts:
                d_within[c] += h[i:j].T @ z[i:j]
                dh[i:j] += z[i:j] @ within[c].T
            h, dh = h[:, :-1], dh[:, :-1]
            dz = dh * (1 - h * h)
            dw += x.T @ dz
            db += dz.sum(axis=0)
            np.matmul(dz, w.T, out=dx[a : a + ROWS])
        flat = context.ravel().astype(np.intp)
        by_column = np.ascontiguousarray(dx.reshape(-1, WIDTH).T)
        d_embed = np.stack([np.bincount(flat, weights=d, minlength=len(embed)) for d in by_column], axis=1).astype(np.float32)
        return [d_embed, dw, db, d_outer[:-1], d_outer[-1], d_within[:, :-1], d_within[:, -1]]


def places(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Rank of each frequent word; the others share the places from ``OWN`` on."""
    order = np.argsort(known)
    rank = np.zeros(len(hashes), np.int64)
    found = np.zeros(len(hashes), bool)
    if len(known):
        at = np.minimum(np.searchsorted(known[order], hashes), len(known) - 1)
        found = known[order][at] == hashes
        rank = order[at]
    return np.where(found, rank, OWN + (hashes % U(SHARED)).astype(np.int64))


def entry_at(place: np.ndarray) -> np.ndarray:
    """Vocabulary entry of a place: frequent words are spread over the classes by rank."""
    return (place % CLASSES * PER_CLASS + place // CLASSES).astype("<u2")


def entries(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Vocabulary entry of each word, looked up once for equal words."""
    different, at = np.unique(hashes, return_inverse=True)
    return entry_at(places(different, known))[at]


def of_words(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context entries of every word, and its row; ``first`` is the first word of each row."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(len(word)) + SIDE * (row + 1)
    line = np.full(len(word) + SIDE * len(first), OUTSIDE, "<u2")
    line[at] = word
    return np.stack([line[at + shift] for shift in SHIFTS], axis=1), row


def learn(net: Network, context: np.ndarray, word: np.ndarray, weight: np.ndarray, square: list[np.ndarray], seen: int) -> None:
    """Steps over the words in a fixed random order; ``seen`` words went into the model before."""
    order = np.random.default_rng(seen).permutation(len(word))
    a = 0
    while a < len(order):
        some = order[a : a + min(GROUP, max(LEAST_GROUP, (seen + a) // 8))]
        a += len(some)
        some = some[np.argsort(word[some], kind="stable")]
        net.step(np.take(context, some, axis=0), word[some], weight[some], square)


def grouped(rows: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    points = cut_points(np.diff(text_bytes(rows.column(column))[1]), WORK_BYTES)
    for a, b in zip(points, points[1:]):
        part = rows.slice(a, b - a)
        yield (part, *text_bytes(part.column(column)))


def pieces(docs: DataFrame, known: np.ndarray, text_col: str = "text") -> DataFrame:
    """words, n: every different piece of the texts as entries of two bytes, and how often it occurs."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for _, data, offsets in grouped(batch, 0):
                hashes, first = word_hashes(data, offsets)
                word = entries(hashes, known)
                edge = np.full(SIDE, OUTSIDE, "<u2")
                out = []
                for a, b in zip(first, first[1:]):
                    if a < b:
                        row = np.concatenate([edge, word[a:b], edge])
                        out += [row[k : k + PIECE + 2 * SIDE].tobytes() for k in range(0, b - a, PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["words"])

    cut = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "words binary")
    return cut.groupBy("words").agg(F.count(F.lit(1)).alias("n"))


def of_pieces(words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context entries, entry and weight of every word of the pieces."""
    many = np.array([len(w) // 2 for w in words])
    flat = np.frombuffer(b"".join(words), "<u2")
    ends = np.cumsum(many)
    at = np.concatenate([np.arange(e - m + SIDE, e - SIDE) for e, m in zip(ends, many)])
    context = np.stack([flat[at + shift] for shift in SHIFTS], axis=1)
    return context, flat[at], np.repeat(counts.astype(np.float32), many - 2 * SIDE)


def sums(blocks: DataFrame, *keys: str) -> DataFrame:
    """Messages (block, payload) added up for each group of keys."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(p, np.float64) for p in group["payload"]], axis=0)
        return pd.DataFrame({"block": group["block"].iloc[:1], "payload": [total.tobytes()]})

    return blocks.groupBy(*keys).applyInPandas(add, "block int, payload binary")


def one_round(rows: DataFrame, units: int, state: np.ndarray, seen: int) -> np.ndarray:
    """Weights and squares after the units of a round (unit, at, words, n), and the words of them all."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(state) // 2
        total, unit, held, counts, filled = None, None, [], [], 0
        net, square, used, weighed = None, None, 0, 0.0

        def work() -> None:
            nonlocal held, counts, filled, used, weighed
            if held:
                context, word, weight = of_pieces(held, np.array(counts))
                learn(net, context, word, weight, square, seen + used)
                used, weighed = used + len(word), weighed + float(weight.sum(dtype=np.float64))
            held, counts, filled = [], [], 0

        def close() -> None:
            nonlocal total
            work()
            if unit is not None:
                now = np.concatenate([net.flat(), *(q.ravel() for q in square), np.ones(1)]).astype(np.float64) * weighed
                total = now if total is None else total + now

        for batch in parts:
            for u, words, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if u != unit:
                    close()
                    unit, net, used, weighed = u, Network.of(state[:size]), 0, 0.0
                    square = Network.of(state[size:]).parts
                held.append(words.as_py())
                counts.append(n)
                filled += len(held[-1]) // 2
                if filled >= SLAB:
                    work()
        close()
        if total is not None:
            cut = range(0, len(total), BLOCK)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(len(cut)), pa.int32()), pa.array(np.full(len(cut), unit % 64), pa.int32()),
                    pa.array([total[k : k + BLOCK].tobytes() for k in cut], pa.binary()),
                ],
                ["block", "part", "payload"],
            )

    # steps cost much for few bytes, so partitions of the same number are not merged by size
    placed = rows.repartition(task_count(rows.sparkSession, units), "unit").sortWithinPartitions("unit", "at", "words").select("unit", "words", "n")
    sent = placed.mapInArrow(run, "block int, part int, payload binary")
    # a fixed number of blocks, whatever the input
    found = sorted(sums(sums(sent, "block", "part"), "block").collect())
    return np.concatenate([np.frombuffer(r["payload"], np.float64) for r in found]) if found else np.zeros(0)


def train(docs: DataFrame, text_col: str = "text") -> tuple[Vocabulary, Network]:
    """Vocabulary and network from all documents."""
    known = vocabulary(docs, text_col)
    at = F.xxhash64("words")
    turn = F.pmod(at, F.lit(ROUNDS[-1]))
    number = F.lit(0)
    for r, end in enumerate(ROUNDS[:-1], 1):
        number = F.when(turn >= end, r).otherwise(number)
    rows = materialize(pieces(docs, known.own, text_col).select("words", "n", at.alias("at"), number.alias("round")), "pieces")
    size = F.sum(F.expr(f"length(words) div 2 - {2 * SIDE}")).alias("words")
    sizes = {r["round"]: r["words"] for r in rows.groupBy("round").agg(size).collect()}
    start = Network()
    state = np.concatenate([start.flat(), *(np.full(p.size, 1e-3, np.float32) for p in start.parts)])
    seen = 0
    for r in range(len(ROUNDS)):
        if sizes.get(r):
            units = -(-sizes[r] // UNIT_WORDS)
            some = rows.where(F.col("round") == r).withColumn("unit", F.pmod(F.shiftright("at", 8), F.lit(units)).cast("int"))
            found = one_round(some, units, state, seen)
            state = (found[:-1] / found[-1]).astype(np.float32)
            seen += sizes[r] // units
    return known, Network.of(state[: len(state) // 2])


def rare_words(word: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, pa.Array]:
    """A number for each row that depends on its words alone (0 without words); the different words of each row and how
    often it has them, in one of the rows of a number only."""
    key = np.zeros(rows, U)
    np.add.at(key, row, mix(word))
    lead = np.zeros(rows, bool)
    lead[np.unique(key, return_index=True)[1]] = True
    word, row = word[lead[row]], row[lead[row]]
    order = np.lexsort((word, row))
    word, row = word[order], row[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    held = pa.StructArray.from_arrays(
        [pa.array(word[at].view(np.int64)), pa.array(np.diff(np.append(at, len(word))).astype(np.int32))], ["word", "times"]
    )
    return key.view(np.int64), pa.ListArray.from_arrays(pa.array(np.searchsorted(row[at], np.arange(rows + 1)).astype(np.int32)), held)


def shares(scored: DataFrame, known: Vocabulary) -> DataFrame:
    """key, log_counts: sum of the logarithms of the counts of all words that are not frequent, once for equal texts."""
    met = scored.select("key", F.posexplode("rare").alias("place", "held")).select("key", "place", "held.word", "held.times")
    # a count of one adds nothing
    met = met.join(known.counts.where("n > 1"), "word", "left")
    copies = F.count(F.when(F.col("place") == 0, 1))
    return met.groupBy("key").agg((F.sum(F.expr("times * ln(coalesce(n, 1))")) / copies).alias("log_counts"))


def score(docs: DataFrame, known: Vocabulary, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_prob (sum over all words) of every row. The texts are read once, and what is found is stored."""
    rest = np.log1p(known.totals)
    light = Vocabulary(known.own, known.totals, known.frequent, known.times, None, known.words)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part, data, offsets in grouped(batch, 1):
                hashes, first = word_hashes(data, offsets)
                different, at = np.unique(hashes, return_inverse=True)
                place = places(different, light.own)
                shared = place >= OWN
                logs, found = light.logs(different)
                share = np.where(shared, logs - rest[np.maximum(place - OWN, 0)], 0.0)
                word = entry_at(place)[at]
                context, row = of_words(word, first)
                value = share[at]
                for a in range(0, len(word), SLAB):
                    s = a + np.argsort(word[a : a + SLAB], kind="stable")
                    value[s] += net.log_prob(np.take(context, s, axis=0), word[s])
                rare = np.flatnonzero((shared & ~found)[at])
                n = part.num_rows
                key, held = rare_words(hashes[rare], row[rare], n)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(np.bincount(row, minlength=n).astype(np.int64)),
                        pa.array(np.bincount(row, weights=value, minlength=n).astype(np.float64)), pa.array(key), held,
                    ],
                    ["doc_id", "n_words", "log_prob", "key", "rare"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = "n_words long, log_prob double, key long, rare array<struct<word: long, times: int>>"
    scored = materialize(rows.mapInArrow(run, f"doc_id {kind}, {found}"), "scored")
    return scored.drop("rare").join(shares(scored, known), "key", "left").select(
        "doc_id", "n_words", (F.col("log_prob") + F.coalesce("log_counts", F.lit(0.0))).alias("log_prob")
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    known, net = train(docs)
    return score(docs, known, net).withColumn("log_prob_per_word", F.expr("log_prob / nullif(n_words, 0)"))


#: a learned model; tests hold scores against a plain loop and against shuffled texts
ORACLE_SQL = None
