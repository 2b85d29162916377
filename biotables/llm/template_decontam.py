"""Benchmark decontamination by template canonicalisation.

Words become typed placeholders or stay as they are in lower case: words with a digit are numbers,
capitalised words inside a sentence are names, unit words right after a number are units. Windows of
``WINDOW`` words of the resulting templates are hashed; document windows meet benchmark windows in a hash
join, so a question with other numbers, names or units still meets its original. Matches of one document row on one
alignment (document position minus item position) are put in order. An item is found in a document where ``HITS``
windows that follow each other on an alignment (13 words), or the one or few windows of an item of fewer words, are consistent: every
value behind the placeholders of the item has one value in the document. A value that differs outside these windows
does no harm. Windows of the plain lower-cased words (runs of Unicode letters and digits; one character each in scripts
without spaces) are matched beside the templates, so a copy word for word is found whatever its words, its case, its
punctuation and its line breaks are. ``whole`` tells whether the values of a whole alignment map one to one; ``found_items`` has these only.

Before the join a bitmap of fixed size (``BITS`` bits, whatever the benchmark's size) drops the windows that no
item can have; the join itself leaves Spark the choice between broadcast and shuffle by size.

Defined cases: null and empty texts match nothing; items with fewer words than a window have one
window, the whole item; items of fewer than ``LEAST`` words are not looked for, as clean texts hold them by chance; templates with fewer
than half their words unreplaced are not used, so an item of placeholders alone is found only in a copy; items or rows with equal ids count as one, but every text is judged by itself; rows with a null id and items with
a null id take no part; an empty benchmark leaves all documents clean. Other columns do not matter.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biotables.llm.columns import cut_points, table, text_bytes
from biotables.llm.ngram_jaccard import LETTER, LOWER, U, mix
from biotables.session import materialize

WINDOW = 8
HITS = 6
LEAST = 5  # words of an item
BITS = 22
WORK_BYTES = 1 << 20

#: fixed values: unit words that are replaced after a number
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons pound pounds "
    "ounce ounces ml l liter liters litre litres second seconds minute minutes hour hours day days week weeks month months "
    "year years meter meters metre metres kilometer kilometers kilometre kilometres degree degrees percent dollar dollars "
    "euro euros cent cents mph watt watts volt volts joule joules newton newtons"
).split()

LITERAL, NUMBER, NAME, UNIT = range(4)
HOLDER = mix(np.arange(4, dtype=U) * U(0x9E3779B97F4A7C15) + U(99))
DIGIT, UPPER, WORD, STOP = (np.zeros(256, bool) for _ in range(4))
DIGIT[0x30:0x3A] = True
UPPER[0x41:0x5B] = True
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = True
STOP[[*b".!?:\n\r|"]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind and lower-case hash of every word, and the first word of each row (one more at the end)."""
    inside = WORD[data]
    if len(data) > 2:
        # a point or comma between digits belongs to the number
        mark = ((data[1:-1] == 0x2E) | (data[1:-1] == 0x2C)) & DIGIT[data[:-2]] & DIGIT[data[2:]]
        inside[1:-1] |= mark
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.int8), np.zeros(0, U), np.zeros(len(offsets), np.int64)
    breaks = np.zeros(len(data) + 1, bool)
    breaks[offsets] = True
    opens = np.empty(len(at), bool)
    opens[0] = True
    opens[1:] = (at[1:] != at[:-1] + 1) | breaks[at[1:]]
    first = np.flatnonzero(opens)
    size = np.diff(np.append(first, len(at)))
    power = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, U))
    place = np.arange(len(at)) - np.repeat(first, size)
    letters = data[at]
    raw = mix(np.add.reduceat(LETTER[LOWER[letters]] * power[place], first) + size.astype(U))
    digit = np.maximum.reduceat(DIGIT[letters], first)
    begin, row_first = at[first], np.searchsorted(at[first], offsets)
    # capital letter, then a letter that is not one: C3 80 to C3 9E are the capitals of Latin-1
    after = np.append(data, [0, 0])
    latin = (data[begin] == 0xC3) & (after[begin + 1] >= 0x80) & (after[begin + 1] <= 0x9E)
    second = np.where(latin, after[begin + 2], after[begin + 1])
    capital = (UPPER[data[begin]] | latin) & (size > 1 + latin) & WORD[second] & ~UPPER[second]
    stops = np.concatenate([[0], np.cumsum(STOP[data])])
    end = at[first + size - 1] + 1
    starts_sentence = np.ones(len(first), bool)
    starts_sentence[1:] = stops[begin[1:]] > stops[end[:-1]]
    starts_sentence[row_first[:-1][row_first[:-1] < len(first)]] = True
    kind = np.where(digit, NUMBER, np.where(capital & ~starts_sentence, NAME, LITERAL)).astype(np.int8)
    follows = np.zeros(len(first), bool)
    follows[1:] = digit[:-1]
    follows[row_first[:-1][row_first[:-1] < len(first)]] = False
    at_unit = np.minimum(np.searchsorted(UNIT_HASHES, raw), max(0, len(UNIT_HASHES) - 1))
    if len(UNIT_HASHES):
        kind[follows & (kind == LITERAL) & (UNIT_HASHES[at_unit] == raw)] = UNIT
    return kind, raw, row_first


UNIT_HASHES = np.zeros(0, U)
UNIT_HASHES = np.sort(
    np.concatenate([words(np.frombuffer(u.encode(), np.uint8), np.array([0, len(u)]))[1] for u in UNITS])
)


#: scripts that put no spaces between words, as ranges of code points: Thai, Lao, Tibetan, Burmese, Khmer, kana, ideographs
SPACELESS = (
    (0x0E00, 0x0EFF), (0x0F00, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF),
)


@cache
def letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every code point: whether it belongs to a word, whether it is a word alone, and its lower-case form (its own if that is longer)."""
    lower = np.arange(0x110000, dtype=np.uint32)
    inside = np.zeros(0x110000, bool)
    for i in range(0x40000):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        inside[i] = c.isalnum() or unicodedata.category(c)[0] == "M"
        if len(c.lower()) == 1:
            lower[i] = ord(c.lower())
    alone = np.zeros(0x110000, bool)
    for a, b in SPACELESS:
        alone[a : b + 1] = inside[a : b + 1]
    return inside, alone, lower


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every plain word and the first word of each row (one more at the end)."""
    try:
        code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    except UnicodeDecodeError:
        rows = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(offsets, offsets[1:])]
        code = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])
    inside, alone, lower = letters()
    at = np.flatnonzero(inside[code])
    if not len(at):
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    single = alone[code[at]]
    breaks = np.zeros(len(code) + 1, bool)
    breaks[offsets] = True
    opens = np.ones(len(at), bool)
    opens[1:] = (at[1:] != at[:-1] + 1) | breaks[at[1:]] | single[1:] | single[:-1]
    first = np.flatnonzero(opens)
    size = np.diff(np.append(first, len(at)))
    power = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, U))
    place = np.arange(len(at)) - np.repeat(first, size)
    return mix(np.add.reduceat(mix(lower[code[at]].astype(U) + U(1)) * power[place], first) + size.astype(U)), np.searchsorted(at[first], offsets)


def windows(kind: np.ndarray, raw: np.ndarray, first: np.ndarray, size: int, plain_words: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template hash, row and first word of each usable window of ``size`` words."""
    n = len(kind) - size + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = np.where(kind == LITERAL, raw, HOLDER[kind])
    key = np.full(n, size + plain_words * 1000, U)
    for k in range(size):
        key = mix(word[k : k + n] + mix(key))
    plain = np.concatenate([[0], np.cumsum(kind == LITERAL)])
    row = np.searchsorted(first, np.arange(n), "right") - 1
    at = np.flatnonzero((np.arange(n) + size <= first[row + 1]) & (2 * (plain[size:] - plain[:-size]) >= size))
    return key[at], row[at], at


def text_keys(raw: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A number for each row that depends on its words and their places."""
    place = np.arange(len(raw)) - np.repeat(first[:-1], np.diff(first))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(raw + mix(place.astype(U))), dtype=U)])
    return (sums[first[1:]] - sums[first[:-1]]).view(np.int64)


def slots(kind: np.ndarray, raw: np.ndarray, at: np.ndarray, size: int) -> list[list[int]]:
    """Hashes of the words behind the placeholders of each window, in order."""
    spots = at[:, None] + np.arange(size)
    held = kind[spots] != LITERAL
    flat = (raw[spots] ^ HOLDER[kind[spots]]).view(np.int64)
    return [flat[i][held[i]].tolist() if held[i].any() else [] for i in range(len(at))]


def both_kinds(column: pa.Array) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray]]:
    """Words of the templates, then plain words: whether plain, kind, hash, and the first word of each row."""
    data, offsets = text_bytes(column)
    yield (False, *words(data, offsets))
    raw, first = plain_words(data, offsets)
    yield True, np.full(len(raw), LITERAL, np.int8), raw, first


def item_windows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """window, size, plain, item_id, item_key, item_at, item_slots, of (windows of all words of the item)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            ids = rows.column(0).to_pylist()
            for plain, kind, raw, first in both_kinds(rows.column(1)):
                count, texts = np.diff(first), text_keys(raw, first)
                for size in range(LEAST, WINDOW + 1):
                    key, row, at = windows(kind, raw, first, size, plain)
                    own = (count[row] == size) | ((size == WINDOW) & (count[row] > size))
                    key, row, at = key[own], row[own], at[own]
                    if len(key):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(key.view(np.int64)), pa.array(np.full(len(key), size), pa.int32()), pa.array(np.full(len(key), plain)),
                                pa.array([ids[r] for r in row], pa.int64()), pa.array(texts[row]), pa.array(at - first[row], pa.int32()),
                                pa.array(slots(kind, raw, at, size), pa.list_(pa.int64())), pa.array(count[row] - size + 1, pa.int32()),
                            ],
                            ["window", "size", "plain", "item_id", "item_key", "item_at", "item_slots", "of"],
                        )

    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return rows.where("item_id is not null and text is not null").mapInArrow(
        run, "window long, size int, plain boolean, item_id long, item_key long, item_at int, item_slots array<long>, of int"
    )


def possible(items: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Bitmap over the high bits of the window hashes (2^BITS bits at most), and the window sizes that occur."""
    bit = F.shiftrightunsigned("window", 64 - BITS)
    cells = items.select(F.shiftright(bit, 5).cast("int").alias("cell"), F.expr(f"shiftleft(1L, int(shiftrightunsigned(window, {64 - BITS}) & 31))").alias("bit"))
    bitmap = np.zeros(1 << (BITS - 5), np.uint32)
    for cell, value in cells.groupBy("cell").agg(F.bit_or("bit")).collect():
        bitmap[cell] = value
    return bitmap, sorted(r[0] for r in items.select("size").distinct().collect())


def document_windows(docs: DataFrame, bitmap: np.ndarray, sizes: list[int], id_col: str, text_col: str) -> DataFrame:
    """window, doc_id, doc_key, doc_at, doc_slots of the windows that an item may have."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            points = cut_points(np.diff(text_bytes(rows.column(1))[1]), WORK_BYTES)
            for a, b in zip(points, points[1:]):
                part = rows.slice(a, b - a)
                ids = np.asarray(part.column(0))
                for plain, kind, raw, first in both_kinds(part.column(1)):
                    texts = text_keys(raw, first)
                    for size in sizes:
                        key, row, at = windows(kind, raw, first, size, plain)
                        place = key >> U(64 - BITS)
                        hit = (bitmap[(place >> U(5)).astype(np.int64)] >> (place & U(31)).astype(np.uint32)) & 1 == 1
                        key, row, at = key[hit], row[hit], at[hit]
                        if len(key):
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array(key.view(np.int64)), pa.array(ids[row]), pa.array(texts[row]), pa.array(at - first[row], pa.int64()),
                                    pa.array(slots(kind, raw, at, size), pa.list_(pa.int64())),
                                ],
                                ["window", "doc_id", "doc_key", "doc_at", "doc_slots"],
                            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.where("doc_id is not null and text is not null").mapInArrow(
        run, "window long, doc_id long, doc_key long, doc_at long, doc_slots array<long>"
    )


def matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", hits: int = HITS
) -> DataFrame:
    """doc_id, item_id, windows, of, exact, whole: items of which a document holds a passage.

    exact is false where placeholders differ in every passage; whole is true where the templates of a whole alignment
    map one to one, or all windows of the item are there word for word.
    """
    items = materialize(item_windows(benchmark, item_col, item_text), "items")
    bitmap, sizes = possible(items)
    met = document_windows(docs, bitmap, sizes, id_col, text_col).join(items, "window")
    # an alignment has at most as many windows as its item
    aligned = met.groupBy("plain", "doc_id", "doc_key", "item_id", "item_key", (F.col("doc_at") - F.col("item_at")).alias("shift")).agg(
        F.array_sort(F.collect_set(F.struct("item_at", F.arrays_zip(F.col("item_slots").alias("i"), F.col("doc_slots").alias("d")).alias("pairs")))).alias("met"),
        F.max("of").alias("of"),
    )
    # plain words have to stand in a row
    starts = "filter(sequence(0, greatest(size(met) - need, 0)), k -> not plain or met[k + need - 1].item_at - met[k].item_at = need - 1)"
    runs = F.expr(f"transform({starts}, k -> array_distinct(flatten(slice(met, k + 1, need).pairs)))")
    one_to_one = (F.size("pairs") == F.size(F.array_distinct("pairs.i"))) & (F.size("pairs") == F.size(F.array_distinct("pairs.d")))
    return (
        aligned.withColumn("need", F.least(F.lit(hits), F.col("of"))).where("size(met) >= need")
        .withColumn("runs", runs).withColumn("runs", F.expr("filter(runs, p -> size(p) = size(array_distinct(p.i)))")).where("size(runs) > 0")
        .withColumn("pairs", F.expr("array_distinct(flatten(met.pairs))"))
        .groupBy("doc_id", "item_id")
        .agg(
            F.max(F.size("met")).alias("windows"), F.max("of").alias("of"),
            F.max(F.expr("exists(runs, r -> forall(r, p -> p.i = p.d))")).alias("exact"), F.max(F.when(F.col("plain"), F.size("met") == F.col("of")).otherwise(one_to_one)).alias("whole"),
        )
    )


def found_items(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", hits: int = HITS
) -> DataFrame:
    """The matches where the values of a whole alignment map one to one."""
    return matches(docs, benchmark, id_col, text_col, item_col, item_text, hits).where("whole").drop("whole")


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = matches(docs, table(spark, folder, "benchmark"))
    by_doc = found.groupBy("doc_id").agg(
        F.count("*").alias("n_items"), F.min("item_id").alias("first_item"), F.max("windows").alias("most_windows")
    )
    return docs.select("doc_id").join(by_doc, "doc_id", "left").select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        "first_item",
        F.coalesce("most_windows", F.lit(0)).alias("most_windows"),
    )


#: words and placeholders are cut on bytes; tests compare with a plain loop
ORACLE_SQL = None
