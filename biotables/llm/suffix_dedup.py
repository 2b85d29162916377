"""Suffix-array dedup by bucket-pointer refinement.

A byte goes if it lies in a string of ``length`` bytes that also starts in a document with a smaller id.
So each start needs its class (equal strings of ``length`` bytes) and the smallest id of that class.

1. Rows are packed into batches in the shared folder (``columns.packed_batches``).
2. Every window of ``length`` bytes has one anchor, its 24-byte gram with the smallest hash; equal windows
   have equal anchors. ``exchange.shared_keys`` finds the anchors that two or more documents hold. All
   other windows are unique to their document and need no sorting.
3. The windows of a shared anchor travel as one fragment to the bucket of that anchor. Equal fragments of
   a batch are first reduced to their smallest document; the rest of them is already known to go.
   Anchors of more than ``HOT`` documents send windows instead of fragments, dealt by the whole window, so
   a passage that a third of all documents hold is spread by what stands around it.
4. A bucket sorts its suffixes up to ``length`` bytes: first buckets of 8-byte grams, then every suffix in
   a bucket of several is sorted on the bucket pointer of the suffix 8 later, which yields buckets of 16
   bytes, whose pointers refine the next pass, up to ``length``.
5. The starts to remove go back to the batches, which cut the bytes out.

Defined cases: null text is empty; texts shorter than ``length`` stay; rows with equal ids do not remove
each other's bytes; a row with a null id keeps its text and removes none; an empty table gives no rows.
Extra columns are carried along unless they have the name of a result column, whose place they lose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from biotables.llm.columns import as_binary, bucket_count, packed_batches, table, text_bytes, unpack, with_answers
from biotables.llm.exchange import bucket_of, classes_of, count_class, shared_keys

LENGTH = 50
GRAM = 24
FIRST = 8
#: anchors in more documents than this are dealt by window
HOT = 200_000
#: windows looked at in one pass over a text
PASS = 1 << 20
#: bytes sorted at once in a bucket; cut between anchors only
SORT_BYTES = 2 << 20

U = np.uint64
RESULT = ["n_bytes", "n_removed", "n_spans", "spans", "kept"]


def mix(x: np.ndarray) -> np.ndarray:
    x = x * U(0x9E3779B97F4A7C15)
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


def grams8(data: np.ndarray) -> np.ndarray:
    """Each run of eight bytes as one number."""
    x = data.astype(U)
    x = x[:-1] | (x[1:] << U(8))
    x = x[:-2] | (x[2:] << U(16))
    return x[:-4] | (x[4:] << U(32))


def grams24(data: np.ndarray) -> np.ndarray:
    h = mix(grams8(data))
    return mix(h[:-16] + mix(h[8:-8] ^ U(7)) + mix(h[16:] ^ U(13)))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def window_anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor position of each window start, and the key of each gram position."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    anchors, keys = [], []
    for a in range(0, n, PASS):
        b = min(n, a + PASS)
        h = grams24(data[a : b + length - 1])
        ranked = (h & ~U((1 << 21) - 1)) | np.arange(len(h), dtype=U)
        anchors.append((sliding_min(ranked, length - GRAM + 1) & U((1 << 21) - 1)).astype(np.int64) + a)
        keys.append(mix(h if b == n else h[: b - a]))
    return np.concatenate(anchors), np.concatenate(keys)


def valid_starts(offsets: np.ndarray, size: int, length: int) -> np.ndarray:
    """True where a window lies within one document."""
    ok = np.ones(max(0, size - length + 1), bool)
    bad = (offsets[1:, None] - np.arange(1, length)).ravel()
    ok[bad[(bad >= 0) & (bad < len(ok))]] = False
    return ok


def anchor_keys(text: str, length: int):
    def keys_of(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_bytes(rows.column(text))
        anchors, keys = window_anchors(data, length)
        at = anchors[valid_starts(offsets, len(data), length)]
        at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
        return keys[at], np.searchsorted(offsets, at, "right")

    return keys_of


def bucket_pointers(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Bucket of each start: equal numbers for equal strings of ``length`` bytes, in sorted order.

    Bucket pointers of 8-byte grams are refined by sorting on the pointer at a later offset. Only
    suffixes that share their bucket are sorted again; a pass reads the pointers its predecessor left.
    """
    steps, known = [], FIRST
    while known < length:
        steps.append(min(known, length - known))
        known += steps[-1]
    # suffixes needed at each level: those of the next level, and where their later offset points
    mask = np.zeros(len(data), bool)
    mask[starts] = True
    needed = [np.flatnonzero(mask)]
    for step in reversed(steps):
        mask[step:] |= mask[:-step].copy()
        needed.append(np.flatnonzero(mask))
    level = needed.pop()
    grams = grams8(data)[level]
    order = np.argsort(grams)
    grams = grams[order]
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    pointer = np.zeros(len(data), np.int64)
    pointer[level[order]] = np.flatnonzero(new)[np.cumsum(new) - 1]
    del grams, order, new
    for step in steps:
        level = needed.pop()
        own = pointer[level]
        at = level[np.bincount(own)[own] > 1]
        if not len(at):
            break
        own, later = pointer[at], pointer[at + step]
        order = np.argsort((own << 32) | later)
        own, later = own[order], later[order]
        new_bucket = np.ones(len(own), bool)
        new_bucket[1:] = own[1:] != own[:-1]
        new = new_bucket.copy()
        new[1:] |= later[1:] != later[:-1]
        first, sub = np.flatnonzero(new_bucket), np.flatnonzero(new)
        # the sub-bucket keeps its place within the old bucket
        place = sub - first[np.cumsum(new_bucket)[sub] - 1]
        pointer[at[order]] = own + place[np.cumsum(new) - 1]
    return pointer[starts]


def equal_fragments(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Equal numbers for equal byte strings."""
    most = int(size.max())
    padded = np.concatenate([data, np.zeros(most, np.uint8)])
    rows = padded[start[:, None] + np.arange(most)]
    rows[np.arange(most) >= size[:, None]] = 0
    rows = np.ascontiguousarray(np.concatenate([rows, size.astype(">u2").view(np.uint8).reshape(-1, 2)], axis=1))
    return np.unique(rows.view(f"V{most + 2}").ravel(), return_inverse=True)[1]


def larger_than_least(classes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """True where a class holds a smaller id."""
    if not len(classes):
        return np.zeros(0, bool)
    order = np.argsort(classes, kind="stable")
    sorted_ = classes[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    least = np.repeat(np.minimum.reduceat(ids[order], first), np.diff(np.append(first, len(order))))
    out = np.empty(len(order), bool)
    out[order] = ids[order] > least
    return out


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of many ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def pack_arrays(*arrays: np.ndarray) -> bytes:
    head = np.array([len(a) for a in arrays], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack_arrays(payload: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    out, at = [], 8 * len(kinds)
    for size, kind in zip(np.frombuffer(raw, "<i8", len(kinds)), kinds):
        out.append(np.frombuffer(raw, kind, size, at))
        at += int(size) * np.dtype(kind).itemsize
    return out


FRAGMENTS = ("<u8", "<i8", "<i4", "<i4", "u1")  # key, document, first window, windows, bytes
RUNS = ("<i4", "<i4")  # first window, windows


def fragments(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, usable: np.ndarray, shared, buckets: int, length: int, hot: int):
    """Runs of windows to remove already, and fragments to sort: (starts, counts), (key, id, start, count)."""
    anchors, keys = window_anchors(data, length)
    valid = valid_starts(offsets, len(data), length)
    at = np.flatnonzero(valid)
    anchor = anchors[at]
    new = np.concatenate([[True], anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start, key = at[first], keys[anchor[first]]
    doc = np.searchsorted(offsets, start, "right") - 1
    # offsets repeat at empty rows; the last of them is the row that holds the byte
    found = classes_of(key, shared, buckets)
    some = (found > 0) & usable[doc]
    start, count, key, doc, found = start[some], count[some], key[some], doc[some], found[some]
    if not len(start):
        none = np.zeros(0, np.int64)
        return (none, none), (np.zeros(0, U), none, none, none)
    split = found > count_class(np.array([hot]))[0]
    if split.any():
        one = spread(start[split], count[split])
        own = grams24(data)
        window = mix(own[one] + mix(own[one + (length - GRAM) // 2] ^ U(3)) + mix(own[one + length - GRAM] ^ U(5)))
        doc = np.concatenate([doc[~split], np.repeat(doc[split], count[split])])
        start = np.concatenate([start[~split], one])
        count = np.concatenate([count[~split], np.ones(len(one), np.int64)])
        key = np.concatenate([key[~split], window])
    id_ = ids[doc]
    # equal fragments of this batch: only those of the smallest document are sent
    gone = larger_than_least(equal_fragments(data, start, count + length - 1), id_)
    return (start[gone], count[gone]), (key[~gone], id_[~gone], start[~gone], count[~gone])


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT, bucket_bytes: int = 16 << 20,
    in_place: bool = False,
) -> DataFrame:
    """Rows of ``docs`` with n_bytes, n_removed, n_spans, spans (start and end of each, in turn) and kept (bytes).

    With ``in_place``, rows of ``docs`` with the text replaced by what is left; there a character goes if any of its bytes does.
    """
    if not GRAM + 1 < length <= 4096:
        raise ValueError("length must lie between 26 and 4096 bytes")
    docs = docs if in_place else docs.drop(*RESULT)
    batches = packed_batches(docs, text_col, "suffix")
    buckets = bucket_count(batches, bucket_bytes)
    shared = shared_keys(batches, anchor_keys(text_col, length), buckets)

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for batch, payload, answers in zip(part.column(0).to_pylist(), part.column(1), part.column(2)):
                rows = unpack(payload.as_py())
                data, offsets = text_bytes(rows.column(text_col))
                column = rows.column(id_col).cast(pa.int64())
                usable = np.asarray(column.is_valid())
                ids = column.fill_null(0).to_numpy(zero_copy_only=False)
                known, rest = fragments(data, offsets, ids, usable, answers.as_py(), buckets, length, hot)
                out = [(batch % buckets, True, pack_arrays(*(x.astype("<i4") for x in known)))] if len(known[0]) else []
                key, id_, start, count = rest
                order = np.argsort(key, kind="stable")
                key, id_, start, count = key[order], id_[order], start[order], count[order]
                edges = np.searchsorted(bucket_of(key, buckets), np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(edges)):
                    s = slice(edges[b], edges[b + 1])
                    raw = data[spread(start[s], count[s] + length - 1)]
                    out.append((b, False, pack_arrays(key[s].astype("<u8"), id_[s].astype("<i8"), start[s].astype("<i4"), count[s].astype("<i4"), raw)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in out], pa.int32()),
                        pa.array([batch] * len(out), pa.int64()),
                        pa.array([x[1] for x in out], pa.bool_()),
                        pa.array([x[2] for x in out], pa.binary()),
                    ],
                    ["bucket", "batch", "known", "payload"],
                )

    def refine(group: pd.DataFrame) -> pd.DataFrame:
        ready = group[group["known"]]
        out = list(zip(ready["batch"], ready["payload"]))
        group = group[~group["known"]]
        if len(group):
            read = [unpack_arrays(p, *FRAGMENTS) for p in group["payload"]]
            owner = np.repeat(group["batch"].to_numpy(), [len(r[0]) for r in read])
            key, id_, start, count, data = (np.concatenate(x) for x in zip(*read))
            del read
            size = count.astype(np.int64) + length - 1
            begin = np.cumsum(size) - size
            order = np.argsort(key, kind="stable")
            new_key = np.concatenate([[True], key[order][1:] != key[order][:-1]])
            piece = np.cumsum(size[order]) // SORT_BYTES
            # a piece starts with a new key
            piece = piece[np.flatnonzero(new_key)][np.cumsum(new_key) - 1]
            for part in np.split(order, np.flatnonzero(np.diff(piece)) + 1):
                # equal fragments of different batches: all but those of the smallest document go
                larger = larger_than_least(equal_fragments(data, begin[part], size[part]), id_[part])
                left = part[~larger]
                own = data[spread(begin[left], size[left])]
                at = np.cumsum(size[left]) - size[left]
                windows, of = spread(at, count[left]), np.repeat(np.arange(len(left)), count[left])
                sorted_gone = larger_than_least(bucket_pointers(own, windows, length), id_[left][of])
                # windows of all fragments again, in the order of part
                of = np.repeat(np.arange(len(part)), count[part])
                inner = spread(np.zeros(len(part), np.int64), count[part])
                gone = larger[of]
                gone[~gone] = sorted_gone
                # runs of windows to remove, within a fragment
                opens = gone & ~np.concatenate([[False], gone[:-1] & (of[1:] == of[:-1])])
                closes = gone & ~np.concatenate([gone[1:] & (of[1:] == of[:-1]), [False]])
                opens, closes = np.flatnonzero(opens), np.flatnonzero(closes)
                batch, first = owner[part][of[opens]], start[part][of[opens]] + inner[opens]
                by = np.argsort(batch, kind="stable")
                batch, first, many = batch[by], first[by], (closes - opens + 1)[by]
                cuts = np.flatnonzero(np.concatenate([[True], batch[1:] != batch[:-1]])) if len(batch) else []
                for a, b in zip(cuts, [*cuts[1:], len(batch)]):
                    out.append((batch[a], pack_arrays(first[a:b].astype("<i4"), many[a:b].astype("<i4"))))
        return pd.DataFrame(out, columns=["batch", "payload"])

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for payload, runs in zip(part.column(0), part.column(1)):
                rows = unpack(payload.as_py())
                data, offsets = text_bytes(rows.column(text_col))
                edge = np.zeros(len(data) + 1, np.int32)
                for run in runs.as_py() or []:
                    first, many = unpack_arrays(run["payload"], *RUNS)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + many + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                if in_place:
                    if len(data):
                        leads = (data & 0xC0) != 0x80
                        gone = np.maximum.reduceat(gone, np.flatnonzero(leads))[np.cumsum(leads) - 1]
                    left = as_binary(data[~gone], offsets - np.concatenate([[0], np.cumsum(gone)])[offsets])
                    place = rows.schema.get_field_index(text_col)
                    kept_text = pc.if_else(rows.column(place).is_null(), pa.scalar(None, pa.string()), left.cast(pa.string()))
                    yield rows.set_column(place, rows.schema.field(place), kept_text.cast(rows.schema.field(place).type))
                    continue
                begins = np.zeros(len(data) + 1, bool)
                begins[offsets[:-1]] = True
                begins = begins[:-1]
                opens = np.flatnonzero(gone & (begins | ~np.concatenate([[False], gone[:-1]])))
                closes = np.flatnonzero(gone & (np.append(begins[1:], True) | ~np.concatenate([gone[1:], [False]]))) + 1
                before = np.concatenate([[0], np.cumsum(gone)])[offsets]
                spans_before = np.searchsorted(opens, offsets)
                base = np.repeat(offsets[:-1], np.diff(spans_before))
                spans = np.stack([opens - base, closes - base], axis=1).ravel().astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        *rows.columns,
                        pa.array(np.diff(offsets), pa.int64()),
                        pa.array(np.diff(before), pa.int64()),
                        pa.array(np.diff(spans_before), pa.int64()),
                        pa.ListArray.from_arrays(pa.array((2 * spans_before).astype(np.int32)), pa.array(spans)),
                        as_binary(data[~gone], offsets - before),
                    ],
                    [*rows.schema.names, *RESULT],
                )

    work = with_answers(batches, shared, "bucket", "payload")
    sent = work.mapInArrow(send, "bucket int, batch long, known boolean, payload binary")
    runs = sent.groupBy("bucket").applyInPandas(refine, "batch long, payload binary")
    result = docs.schema
    if not in_place:
        result = StructType([*docs.schema, *StructType.fromDDL("n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary")])
    return with_answers(batches, runs, "payload").select("payload", "answers").mapInArrow(cut, result)


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def oracle(length: int = LENGTH) -> str:
    """DuckDB SQL: hex digits of the bytes, every window, smallest document per window."""
    return f"""
    WITH d AS MATERIALIZED (
      SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
    ), w AS MATERIALIZED (
      SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, {2 * length})) AS s
      FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - {length - 1})) AS p FROM d WHERE length(h) >= {2 * length})
    ), least AS (
      SELECT s, min(doc_id) AS doc FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)
    ), hit AS MATERIALIZED (
      SELECT w.doc_id, w.p FROM w JOIN least USING (s) WHERE w.doc_id > least.doc
    ), run AS (
      SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= {length} THEN 0 ELSE 1 END AS opens FROM hit
    ), span AS (
      SELECT doc_id, min(p) AS a, max(p) + {length} AS b
      FROM (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM run) GROUP BY doc_id, k
    ), gap AS (
      SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span
    ), cut AS (
      SELECT g.doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last,
        string_agg(substr(d.h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
      FROM gap g JOIN d USING (doc_id) GROUP BY g.doc_id
    )
    SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
      sha256(from_hex(coalesce(kept || substr(d.h, 2 * last + 1), d.h))) AS kept_sha256
    FROM d LEFT JOIN cut USING (doc_id)"""


ORACLE_SQL = oracle()
