"""Which keys occur in more than one document: a counted exchange of packed keys.

Each packed batch sends its distinct 64-bit keys, cut into buckets by their high bits, five bytes a key.
A bucket adds up the documents of each key and answers every batch with its keys that two or more
documents hold, and how many, as a class. Keys of one document only (most keys) get no answer.
A key that sits in a third of all rows costs one entry per batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from biotables.llm.columns import unpack

LOW = np.uint64((1 << 40) - 1)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each key; rises with the key, so that sorted keys have sorted buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def five_bytes(keys: np.ndarray) -> np.ndarray:
    return (keys & LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]


def from_five(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :5] = raw
    return wide.view("<u8").ravel()


def distinct_counts(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the number of distinct documents of each."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new_key = np.ones(len(keys), bool)
    new_key[1:] = keys[1:] != keys[:-1]
    new_doc = new_key.copy()
    new_doc[1:] |= docs[1:] != docs[:-1]
    starts = np.flatnonzero(new_key)
    return keys[starts], np.add.reduceat(new_doc.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)


def count_class(documents: np.ndarray) -> np.ndarray:
    """Four classes for each doubling; 0 stands for one document."""
    return np.minimum(255, np.floor(4 * np.log2(np.maximum(documents, 1)))).astype(np.uint8)


def shared_keys(batches: DataFrame, keys_of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], buckets: int) -> DataFrame:
    """Answers: batch, bucket and payload, for ``columns.with_answers``.

    ``keys_of`` gives keys and the document (a row number) of each for one batch of rows.
    """

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            for batch, payload in zip(rows.column(0).to_pylist(), rows.column(1)):
                keys, count = distinct_counts(*keys_of(unpack(payload.as_py())))
                place = bucket_of(keys, buckets)
                edges = np.searchsorted(place, np.arange(buckets + 1))
                low, many = five_bytes(keys), count > 1
                out = []
                for b in np.flatnonzero(np.diff(edges)):
                    part = slice(edges[b], edges[b + 1])
                    some = many[part]
                    out.append(
                        np.uint32((~some).sum()).tobytes()
                        + low[part][~some].tobytes()
                        + low[part][some].tobytes()
                        + count[part][some].astype("<u4").tobytes()
                    )
                full = np.flatnonzero(np.diff(edges))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array(np.full(len(full), batch), pa.int64()), pa.array(out, pa.binary())],
                    ["bucket", "batch", "payload"],
                )

    def add_up(group: pd.DataFrame) -> pd.DataFrame:
        keys, counts, size = [], [], []
        for payload in group["payload"]:
            raw = np.frombuffer(payload, np.uint8)
            single = int(raw[:4].view("<u4")[0])
            multi = (len(raw) - 4 - 5 * single) // 9
            keys.append(from_five(raw[4 : 4 + 5 * (single + multi)].reshape(-1, 5)))
            counts += [np.ones(single, np.int64), np.frombuffer(payload, "<u4", multi, 4 + 5 * (single + multi)).astype(np.int64)]
            size.append(single + multi)
        all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
        _, inverse = np.unique(all_keys, return_inverse=True)
        total = np.bincount(inverse, weights=all_counts).astype(np.int64)[inverse]
        ends = np.cumsum(size)
        batches_, out = [], []
        for batch, a, b in zip(group["batch"], ends - size, ends):
            some = np.flatnonzero(total[a:b] > 1) + a
            if len(some):
                answer = np.empty((len(some), 6), np.uint8)
                answer[:, :5] = five_bytes(all_keys[some])
                answer[:, 5] = count_class(total[some])
                batches_.append(batch)
                out.append(answer.tobytes())
        return pd.DataFrame({"batch": batches_, "bucket": int(group["bucket"].iloc[0]), "payload": out})

    sent = batches.select("batch", "payload").mapInArrow(send, "bucket int, batch long, payload binary")
    return sent.groupBy("bucket").applyInPandas(add_up, "batch long, bucket int, payload binary")


def classes_of(keys: np.ndarray, shared: list[dict] | None, buckets: int) -> np.ndarray:
    """Class of each key from the answers a batch got; 0 for keys of one document."""
    if not shared or not len(keys):
        return np.zeros(len(keys), np.uint8)
    known, classes = [], []
    for answer in shared:
        raw = np.frombuffer(answer["payload"], np.uint8).reshape(-1, 6)
        known.append((np.uint64(answer["bucket"]) << np.uint64(40)) | from_five(raw[:, :5]))
        classes.append(raw[:, 5])
    known, classes = np.concatenate(known), np.concatenate(classes)
    order = np.argsort(known)
    known, classes = known[order], classes[order]
    asked = (bucket_of(keys, buckets) << np.uint64(40)) | (keys & LOW)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where(known[at] == asked, classes[at], 0)
