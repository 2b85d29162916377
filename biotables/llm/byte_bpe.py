"""Byte-level BPE: encode whole texts with the tokenizers library, decode ids through the byte table.

A rank file (base64 token, rank per line) is the vocabulary. Every byte has one printable character
(the byte table); a token is a string of such characters. The merges follow from the ranks: the parts
of a token are what merging with smaller ranks leaves of it.

Defined cases: a null text is empty; an empty text has no ids; repeated rows and null ids stay rows of
their own; special tokens are ordinary text; other columns of the input are left out of the result, so
clashing names cannot matter. Ids that lie outside the vocabulary decode to nothing.
"""

from __future__ import annotations

import base64
import os
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biotables.llm.columns import as_binary, cut_points, table, text_bytes

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

#: texts go to the encoder in groups of at most so many bytes
GROUP_BYTES = 1 << 19
#: pieces of text in each of the two generations that a task remembers
REMEMBERED = 150_000
#: a space next to other white space
UNEVEN_SPACE = re.compile(r"\s\x20|\x20\s")


def byte_table() -> list[str]:
    """The printable character of each byte: itself where it prints, else the next one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def parts_of(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts whose merge makes ``token``, or None if its bytes do not merge to it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        pairs = [ranks.get(a + b, rank) for a, b in zip(parts, parts[1:])]
        least = min(pairs)
        if least >= rank:
            return None
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, letters = read_ranks(path), byte_table()
    name = lambda token: "".join(letters[b] for b in token)
    merges = [m for token, rank in sorted(ranks.items(), key=lambda x: x[1]) if len(token) > 1 and (m := parts_of(token, rank, ranks))]
    model = models.BPE({name(t): r for t, r in ranks.items()}, [(name(a), name(b)) for a, b in merges])
    made = Tokenizer(model)
    made.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    return made


@lru_cache(maxsize=4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens one after another, and where each id's bytes start."""
    ranks = read_ranks(path)
    most = max(ranks.values()) + 1
    by_id = [b""] * most
    for token, rank in ranks.items():
        by_id[rank] = token
    return np.frombuffer(b"".join(by_id), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in by_id])])


def uint32_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    made = array("I", ids)
    if made.itemsize != 4 or sys.byteorder != "little":
        return np.array(ids, "<u4").tobytes()
    return made.tobytes()


class PieceEncoder:
    """Ids of whole texts; each different piece between spaces is encoded once while it is remembered.

    The pattern starts a new match at every space that stands between two other characters, if neither
    is white space, so such a text may be cut before its spaces. Texts with a space next to other white
    space are encoded in one piece.
    """

    def __init__(self, ranks: str, pattern: str, most: int = REMEMBERED):
        self.tool, self.most = encoder(ranks, pattern), most
        # two generations: what is used again moves from the old one to the new one
        self.known, self.old = {}, {}

    def plain(self, texts: list[str]) -> list[bytes]:
        return [uint32_bytes(e.ids) for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [None if UNEVEN_SPACE.search(t) else t.split(" ") for t in texts]
        later = set().union(*(c[1:] for c in cut if c)).difference(self.known)
        if len(self.known) + len(later) > self.most:
            self.known, self.old = {}, self.known
            later = set().union(*(c[1:] for c in cut if c))
        again = later.intersection(self.old)
        self.known.update((p, self.old[p]) for p in again)
        new = list(later.difference(again))
        self.known.update(zip(new, self.plain([" " + p for p in new])))
        heads = iter(self.plain([t if c is None else c[0] for t, c in zip(texts, cut)]))
        return [next(heads) if c is None else next(heads) + b"".join(map(self.known.__getitem__, c[1:])) for c in cut]


@lru_cache(maxsize=4)
def piece_encoder(ranks: str, pattern: str) -> PieceEncoder:
    return PieceEncoder(ranks, pattern)


Batches = Iterator[pa.RecordBatch]


def encode_batches(parts: Batches, ranks: str, pattern: str, offsets: bool) -> Batches:
    """Batches of (id, text) to batches of (doc_id, ids) and offsets, if asked for."""
    for rows in parts:
        points = cut_points(np.diff(text_bytes(rows.column(1))[1]), GROUP_BYTES)
        for a, b in zip(points, points[1:]):
            group = [t or "" for t in rows.column(1).slice(a, b - a).to_pylist()]
            out = [rows.column(0).slice(a, b - a)]
            if offsets:
                found = encoder(ranks, pattern).encode_batch(group, add_special_tokens=False)
                out.append(pa.array([uint32_bytes(e.ids) for e in found], pa.binary()))
                out.append(pa.array([uint32_bytes([o[0] for o in e.offsets]) for e in found], pa.binary()))
            else:
                out.append(pa.array(piece_encoder(ranks, pattern).encode(group), pa.binary()))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "offsets"][: len(out)])


def decode_batches(parts: Batches, ranks: str) -> Batches:
    """Adds the bytes behind the ids of the second column."""
    raw, start = token_bytes(ranks)
    size = np.diff(start)
    for rows in parts:
        points = cut_points(np.diff(text_bytes(rows.column(1))[1]), GROUP_BYTES)
        for a, b in zip(points, points[1:]):
            part = rows.slice(a, b - a)
            data, where = text_bytes(part.column(1))
            ids = np.frombuffer(data.tobytes(), "<u4").astype(np.int64)
            known = ids < len(size)
            ids = np.where(known, ids, 0)
            long = np.where(known, size[ids], 0)
            ends = np.concatenate([[0], np.cumsum(long)])
            # byte j of the result is byte j of its token
            spread = np.repeat(start[ids] - ends[:-1], long) + np.arange(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [*part.columns, as_binary(raw[spread], ends[where // 4])], [*part.schema.names, "decoded"]
            )


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), kind


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, pattern: str = PATTERN, offsets: bool = True
) -> DataFrame:
    """Ids of every whole text: doc_id, ids (little-endian unsigned 32-bit) and, if asked for, offsets.

    ``offsets`` holds the first character of each token as little-endian unsigned 32-bit numbers; a
    character cut over several tokens is the first character of each of them.
    """
    rows, kind = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(
        lambda parts: encode_batches(parts, ranks, pattern, offsets), f"doc_id {kind}, ids binary" + ", offsets binary" * offsets
    )


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Adds ``decoded`` to ``doc_id, ids``: the bytes behind the ids.

    Bytes, not text: a token may end inside a character, and only the whole sequence is sure to be text.
    """
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(lambda parts: decode_batches(parts, ranks), f"{kept}, decoded binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """doc_id, ids, decoded: ``decode(encode(...))`` in one Python pass."""
    rows, kind = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(
        lambda parts: decode_batches(encode_batches(parts, ranks, pattern, False), ranks), f"doc_id {kind}, ids binary, decoded binary"
    )


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    return round_trip(docs, id_col, text_col, ranks).select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return digests(table(spark, folder, "documents"))


#: the merges are a loop over a vocabulary file; tests compare with the tiktoken library
ORACLE_SQL = None
