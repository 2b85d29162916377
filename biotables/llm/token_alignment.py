"""Alignment of two tokenizers over the same bytes: an associative monoid of fragments.

A stretch of bytes with the tokens of both sides that end in it is a fragment: an open prefix (tokens up to
the first place where tokens of both sides end), closed groups, and an open suffix (tokens behind the last such place).
Two neighbours compose: the suffix of the left and the prefix of the right join, and close one more
group if the right one has such a place at all. Composition is associative, so fragments of one text may be composed in any tree.

* Texts of ordinary length are composed of words. Where a space stands between a character that is no space and
  one that is no white space, both tokenizers start anew, so a word's fragment is closed on both sides;
  each different word of a batch is tokenized once and texts are lists of word numbers.
* Texts beyond ``long_bytes`` are cut there into pieces for tokenizing on different tasks; each piece gives
  fragments of fixed byte ranges, whatever tokens cross their borders, and a tree of rounds composes
  ``FAN`` neighbours a time over Spark tasks. What a round closes is written out; only open ends travel on.

Links are the pairs of an A and a B token whose bytes overlap: one for each stretch between two
neighbouring token ends of either side. Their counts over all texts are summed by pair (ids on both sides, so the table is
bounded by the vocabularies), and every batch gets the counts of its own pairs back through a join.

Defined cases: a null or empty text, or one whose tokens do not give back the bytes of space + text, has no tokens; a text
that is not valid UTF-8 neither; special tokens inside texts are plain text; repeated rows and null ids stay
rows of their own; an empty table gives no rows; other columns are left out of the result.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biotables.llm.byte_bpe import byte_table, uint32_bytes
from biotables.llm.columns import SLOT_BITS, _forget, pack, slots, table, text_bytes, unpack, with_answers
from biotables.session import materialize, scratch_path

SIDE_A = public_tokenizers.path("byte_bpe_50k.json")
SIDE_B = public_tokenizers.path("piece_bpe_32k.model")

#: texts beyond so many bytes are spread over tasks
LONG_BYTES = 4 << 20
#: bytes of a piece that one task tokenizes, and of a fragment of a long text
PIECE_BYTES = 1 << 20
FRAGMENT_BYTES = 1 << 16
#: neighbours that one step of the tree composes
FAN = 32
#: text bytes in a batch
BATCH_BYTES = 2 << 20
#: words in each of the two generations that a task remembers
REMEMBERED = 100_000

#: a space next to another space, to other white space, or at the end: words are not simply what stands between spaces
UNEVEN = re.compile(r"\x20(?:\s|\Z)")


def words_of(text: str) -> list[str]:
    """space + text, cut before each space that stands behind a character other than a space and before one that is no white space."""
    parts = text.split(" ")
    if not UNEVEN.search(" " + text):
        return parts
    out = [parts[0]]
    for before, part in zip(parts, parts[1:]):
        if part and before and not part[0].isspace():
            out.append(part)
        else:
            out[-1] += " " + part
    return out


class Stretch:
    """Both tokenizations of one run of bytes: for each byte, whether a token of a side ends with it."""

    def __init__(self, tool: Sides, a: np.ndarray, b: np.ndarray):
        self.end_a, self.end_b = np.cumsum(tool.a_size[a]) - 1, np.cumsum(tool.b_size[b]) - 1
        size = int(max(self.end_a[-1] if len(a) else -1, self.end_b[-1] if len(b) else -1)) + 1
        self.is_a, self.is_b = np.zeros(size, bool), np.zeros(size, bool)
        self.is_a[self.end_a], self.is_b[self.end_b] = True, True
        self.is_common = self.is_a & self.is_b


class Sides:
    """Both tokenizers with the bytes of every id; words are given without their leading space."""

    def __init__(self, side_a: str, side_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        import sentencepiece
        import tiktoken

        self.b = sentencepiece.SentencePieceProcessor(model_file=side_b)
        with open(side_a) as file:
            made = json.load(file)
        vocabulary = made["model"]["vocab"] | {t["content"]: t["id"] for t in made.get("added_tokens") or []}
        byte_of = {c: b for b, c in enumerate(byte_table())}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        # words may be cut only if no piece reaches over a word's start, and if A cuts there as well
        before = made.get("pre_tokenizer") or {}
        self.cuts = (
            not any(re.search("[^▁]▁", p) for p in pieces)
            and made.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        )
        # where ids rise in the order of the merges, they are the ranks that the faster library reads
        ids = made["model"]["vocab"]
        merged = [ids.get("".join(m), -1) for m in (x.split(" ") if isinstance(x, str) else x for x in made["model"]["merges"])]
        ranked = len(merged) + 256 == len(ids) and merged == sorted(merged) and min(merged, default=256) >= 256
        self.fast = self.a = None
        if self.cuts and ranked:
            ranks = {self.a_bytes[i]: i for i in ids.values()}
            self.fast = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        else:
            from tokenizers import Tokenizer

            self.a = Tokenizer.from_file(side_a)
            self.a.encode_special_tokens = True
        names = [str(i).encode() for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.digits = np.frombuffer(b"".join(names), np.uint8), np.concatenate([[0], np.cumsum([len(n) for n in names])])
        self.known: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def words(self, text: str) -> list[str]:
        return words_of(text) if self.cuts else [text]

    def encode_a(self, text: str) -> list[int]:
        return self.fast.encode_ordinary(text) if self.fast else self.a.encode(text, add_special_tokens=False).ids

    def one(self, word: str) -> tuple:
        """Ids of both sides (packed) and the groups as text, or None if the bytes do not come back."""
        a, b, raw = self.encode_a(" " + word), self.b.encode(word), b" " + word.encode()
        if not (b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))):
            return b"", b"", None
        return self.several([word], np.array(a, np.int64), np.array(b, np.int64), np.array([len(raw)]))[0]

    def several(self, words: list[str], a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> list[tuple]:
        """Tokens of words that stand one after another, cut into the fragments of the words."""
        f = Stretch(self, a, b)
        word_end = np.cumsum(sizes)
        at_a, at_b = (np.concatenate([[0], np.cumsum(m)[word_end - 1]]) for m in (f.is_a, f.is_b))
        said, ends = self.said(f, a, b, word_end)
        cut = np.concatenate([[0], ends])
        raw_a, raw_b = uint32_bytes(a.tolist()), uint32_bytes(b.tolist())
        cut, at_a, at_b = cut.tolist(), (4 * at_a).tolist(), (4 * at_b).tolist()
        return [(raw_a[at_a[i] : at_a[i + 1]], raw_b[at_b[i] : at_b[i + 1]], said[cut[i] : cut[i + 1]]) for i in range(len(words))]

    def said(self, f: Stretch, a: np.ndarray, b: np.ndarray, word_end: np.ndarray) -> tuple[bytes, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3`` for every word, one after another, and where each word's text ends."""
        common_a, common_b = f.is_common[f.end_a], f.is_common[f.end_b]
        group_a, group_b = (np.cumsum(c) - c for c in (common_a, common_b))
        before_b = np.concatenate([[0], np.flatnonzero(common_b) + 1])  # B tokens in earlier groups
        upto_a = np.flatnonzero(common_a) + 1
        place_a, place_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + upto_a[group_b]
        ids, mark = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
        ids[place_a], ids[place_b] = a, b
        mark[place_a] = np.where(common_a, ord("|"), ord(","))
        mark[place_b] = np.where(common_b, ord(";"), ord(","))
        last = np.zeros(len(f.is_a), bool)
        last[word_end - 1] = True
        mark[place_b[last[f.end_b]]] = 0
        digits, start = self.digits
        size = np.diff(start)[ids]
        long = size + (mark > 0)
        ends = np.cumsum(long)
        spread = np.repeat(start[ids] - (ends - long), long) + np.arange(ends[-1])
        out = digits[np.minimum(spread, len(digits) - 1)]
        out[ends[mark > 0] - 1] = mark[mark > 0]
        return out.tobytes(), ends[place_b[last[f.end_b]]]

    def group_text(self, a: bytes, b: bytes) -> bytes:
        """One group as text."""
        return b"|".join(",".join(map(str, np.frombuffer(x, "<u4").tolist())).encode() for x in (a, b))

    def encode(self, words: list[str], most: int = 4096) -> dict[str, tuple]:
        """Fragments of different words. Words with no space in them are tokenized many at a time: both sides start anew at each."""
        simple = [w for w in words if self.cuts and w and " " not in w and "▁" not in w and not w[0].isspace()]
        out: dict[str, tuple] = {}
        for i in range(0, len(simple), most):
            group = simple[i : i + most]
            text = " ".join(group)
            a, b = np.array(self.encode_a(" " + text), np.int64), np.array(self.b.encode(text), np.int64)
            sizes = np.fromiter((len(w.encode()) + 1 for w in group), np.int64, len(group))
            whole = b"".join(map(self.a_bytes.__getitem__, a.tolist())) == b"".join(map(self.b_bytes.__getitem__, b.tolist())) == b" " + text.encode()
            if whole and (Stretch(self, a, b).is_common[np.cumsum(sizes) - 1]).all():
                out.update(zip(group, self.several(group, a, b, sizes)))
        out.update((w, self.one(w)) for w in words if w not in out)
        return out

    def look_up(self, words: set[str], most: int = REMEMBERED) -> dict[str, tuple]:
        """Fragments of different words; those of earlier batches are remembered."""
        new = words.difference(self.known)
        if len(self.known) + len(new) > most:
            self.known, self.old = {}, self.known
            new = words
        again = new.intersection(self.old)
        self.known.update((w, self.old[w]) for w in again)
        self.known.update(self.encode(list(new.difference(again))))
        return self.known


@lru_cache(maxsize=2)
def sides(side_a: str, side_b: str) -> Sides:
    return Sides(side_a, side_b)


def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a binary column of 32-bit ids, and how many each row has."""
    data, where = text_bytes(column)
    return np.frombuffer(data.tobytes(), "<u4").astype(np.int64), np.diff(where) // 4


class Fragments(Stretch):
    """Closed fragments one after another: groups and links of each.

    Both sides of a fragment have the same bytes, so the ends of all fragments agree as well.
    """

    def __init__(self, tool: Sides, a: pa.Array, b: pa.Array):
        (ids_a, self.n_a), (ids_b, self.n_b) = ids_of(a), ids_of(b)
        super().__init__(tool, ids_a, ids_b)
        self.a, self.b = ids_a, ids_b
        stretch = np.flatnonzero(self.is_a | self.is_b)
        common = np.flatnonzero(self.is_common)
        # the token over a byte is the one after all that end before it
        over_a, over_b = (np.cumsum(m) - m for m in (self.is_a, self.is_b))
        self.link_a, self.link_b = ids_a[over_a[stretch]], ids_b[over_b[stretch]]
        last = np.concatenate([[0], np.cumsum(tool.a_size[ids_a])])[np.cumsum(self.n_a)]
        self.owner = np.searchsorted(last, stretch + 1)
        self.n_links = np.bincount(self.owner, minlength=len(last))
        self.n_groups = np.bincount(np.searchsorted(last, common + 1), minlength=len(last))
        # tokens of each group, for the groups as such
        self.group_a, self.group_b = (np.diff(np.cumsum(m)[common], prepend=0) for m in (self.is_a, self.is_b))


ROWS = [("doc_id", None), ("doc", pa.int64()), ("place", pa.int64()), ("valid", pa.bool_()), ("words", pa.binary()), ("said", pa.binary())]


def payload_of(words: dict[str, int], found: list[tuple], rows: pa.RecordBatch) -> bytes:
    """Different fragments, and rows of numbers of them, as one value."""
    table_ = pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], ["a", "b"])
    head = pack(table_)
    return len(head).to_bytes(8, "little") + head + pack(rows)


def opened(payload: bytes) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    size = int.from_bytes(payload[:8], "little")
    return unpack(payload[8 : 8 + size]), unpack(payload[8 + size :])


def batch_of(tool: Sides, ids: pa.Array, texts: list[str | None]) -> bytes:
    """Texts of ordinary length: their words' fragments, composed to the whole."""
    cut = [tool.words(t) if t else [] for t in texts]
    different = set().union(*cut)
    known = tool.look_up(different)
    number = {w: i for i, w in enumerate(different)}
    said = [known[w][2] for w in number]
    bad = {w for w, x in zip(number, said) if x is None}
    valid = [bool(c) and not (bad and not bad.isdisjoint(c)) for c in cut]
    kept, digest = [], []
    for words, good in zip(cut, valid):
        numbers = list(map(number.__getitem__, words)) if good else []
        kept.append(uint32_bytes(numbers))
        digest.append(hashlib.sha256(b";".join(map(said.__getitem__, numbers))).hexdigest().encode() if good else b"")
    nothing = pa.nulls(len(texts), pa.int64())
    rows = pa.RecordBatch.from_arrays(
        [ids, nothing, nothing, pa.array(valid), pa.array(kept, pa.binary()), pa.array(digest, pa.binary())], [n for n, _ in ROWS]
    )
    return payload_of(number, [known[w] for w in number], rows)


def readable(raw: bytes | None) -> str | None:
    try:
        return None if raw is None else raw.decode()
    except UnicodeDecodeError:
        return None


def stored_batches(made: DataFrame, label: str) -> DataFrame:
    """slot, batch, payload as a table bucketed by slot, written in scan order."""
    spark, name = made.sparkSession, f"aligned_{label}_{uuid.uuid4().hex}"
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made.write.format("parquet").option("path", scratch_path(spark, label)).option("compression", "uncompressed").bucketBy(count, "slot").saveAsTable(name)
    atexit.register(_forget, spark, name)
    return spark.table(name)


def numbered(slot_of: list[int]) -> Iterator[tuple[int, int]]:
    """Slot and number of the batches of this task."""
    turn, place = divmod(TaskContext.get().partitionId(), len(slot_of))
    number = (slot_of[place] << SLOT_BITS) + (turn << 24)
    while True:
        yield slot_of[place], number
        number += 1


BATCHES = "slot int, batch long, payload binary"


def batch_row(where: tuple[int, int], payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([where[0]], pa.int32()), pa.array([where[1]], pa.int64()), pa.array([payload], pa.binary())], ["slot", "batch", "payload"])


def short_batches(docs: DataFrame, side_a: str, side_b: str, batch_bytes: int) -> DataFrame:
    """``doc_id, raw`` to batches."""
    spark = docs.sparkSession
    slot_of = slots(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, places = sides(side_a, side_b), numbered(slot_of)
        ids, texts, size = [], [], 0
        for part in parts:
            ids_here = part.column(0)
            for i, raw in enumerate(part.column(1)):
                ids.append(ids_here.slice(i, 1))
                raw = raw.as_py()
                texts.append(readable(raw))
                size += len(raw or b"")
                if size >= batch_bytes:
                    yield batch_row(next(places), batch_of(tool, pa.concat_arrays(ids), texts))
                    ids, texts, size = [], [], 0
        if ids:
            yield batch_row(next(places), batch_of(tool, pa.concat_arrays(ids), texts))

    return stored_batches(docs.mapInArrow(make, BATCHES), "short")


# long texts -------------------------------------------------------------------------------------


def pieces_of(text: str, tool: Sides, most: int) -> Iterator[str]:
    """Words of a long text in runs of about ``most`` characters; each run stands for a space and itself."""
    run, size = [], 0
    for word in tool.words(text):
        run.append(word)
        size += len(word) + 1
        if size >= most:
            yield " ".join(run)
            run, size = [], 0
    if run:
        yield " ".join(run)


def fragments_of(tool: Sides, a: np.ndarray, b: np.ndarray, most: int) -> Iterator[dict]:
    """Tokens of one piece as fragments of ``most`` bytes each: ids of prefix, closed groups and suffix.

    A token belongs to the fragment in which it ends, so tokens may cross into a fragment.
    """
    end_a, end_b = np.cumsum(tool.a_size[a]), np.cumsum(tool.b_size[b])
    common = np.intersect1d(end_a, end_b)
    for low in range(0, int(end_a[-1]), most):
        high = low + most
        here = common[np.searchsorted(common, low, "right") : np.searchsorted(common, high, "right")]
        cut_a, cut_b = (np.searchsorted(e, [low, high], "right") for e in (end_a, end_b))
        if not len(here):
            yield {"cut": False, "head_a": a[slice(*cut_a)], "head_b": b[slice(*cut_b)]}
            continue
        inner_a, inner_b = (np.searchsorted(e, here, "right") for e in (end_a, end_b))
        yield {
            "cut": True, "head_a": a[cut_a[0] : inner_a[0]], "head_b": b[cut_b[0] : inner_b[0]],
            "tail_a": a[inner_a[-1] : cut_a[1]], "tail_b": b[inner_b[-1] : cut_b[1]],
            "groups": [(a[i:j], b[k:l]) for i, j, k, l in zip(inner_a, inner_a[1:], inner_b, inner_b[1:])],
        }


def packed_ids(ids: np.ndarray | None) -> bytes:
    return b"" if ids is None else np.asarray(ids).astype("<u4").tobytes()


#: one row of the tree: an open fragment (kind 0) or closed groups (kind 1); heads, tails and groups are packed ids
TREE = "doc long, doc_id {kind}, place long, kind int, valid boolean, cut boolean, head_a binary, head_b binary, tail_a binary, tail_b binary, groups binary"


def packed_groups(groups: list[tuple]) -> bytes:
    """Groups of packed ids as one Arrow value."""
    return pack(pa.RecordBatch.from_arrays([pa.array([packed_ids(g[0]) if not isinstance(g[0], bytes) else g[0] for g in groups], pa.binary()), pa.array([packed_ids(g[1]) if not isinstance(g[1], bytes) else g[1] for g in groups], pa.binary())], ["a", "b"]))


def compose(rows: list[dict]) -> tuple[dict, list[tuple[int, tuple[bytes, bytes]]]]:
    """Fold neighbouring fragments into one; also the groups that closed on the way, each with the place where it closed."""
    whole, closed = dict(rows[0]), []
    for right in rows[1:]:
        whole["valid"] = whole["valid"] and right["valid"]
        if not whole["cut"]:  # nothing has closed yet: the prefix goes on
            whole |= {"head_a": whole["head_a"] + right["head_a"], "head_b": whole["head_b"] + right["head_b"]}
            whole |= {k: right[k] for k in ("cut", "tail_a", "tail_b")}
        elif not right["cut"]:  # the suffix goes on
            whole |= {"tail_a": whole["tail_a"] + right["head_a"], "tail_b": whole["tail_b"] + right["head_b"]}
        else:
            closed.append((right["place"], (whole["tail_a"] + right["head_a"], whole["tail_b"] + right["head_b"])))
            whole |= {"tail_a": right["tail_a"], "tail_b": right["tail_b"]}
    return whole, closed


def long_groups(docs: DataFrame, kind: str, side_a: str, side_b: str, piece: int, fragment: int, fan: int) -> DataFrame:
    """doc, doc_id, place, valid, groups: the closed groups of all long texts, in the order of ``place`` within ``doc``."""
    spark = docs.sparkSession
    schema = TREE.format(kind=kind)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = sides(side_a, side_b)
        for part in parts:
            for i, raw in enumerate(part.column(2)):
                text = readable(raw.as_py())
                for place, run in enumerate(pieces_of(text, tool, piece) if text is not None else [None]):
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).slice(i, 1), part.column(1).slice(i, 1), pa.array([place], pa.int64()), pa.array([run], pa.large_string())],
                        ["doc", "doc_id", "place", "run"],
                    )

    keyed = docs.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "raw")
    pieces = materialize(keyed.mapInArrow(cut, f"doc long, doc_id {kind}, place long, run string"), "pieces")
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def tokens(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = sides(side_a, side_b)
        names = [f.split(" ")[0] for f in schema.split(", ")]
        for part in parts:
            for i in range(part.num_rows):
                run, place = part.column(3)[i].as_py(), part.column(2)[i].as_py() << 24
                ids: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
                valid = run is not None
                if valid:
                    words = tool.words(run)
                    known = tool.look_up(set(words))
                    valid = all(known[w][2] is not None for w in words)
                    if valid:
                        ids = tuple(np.frombuffer(b"".join(known[w][s] for w in words), "<u4").astype(np.int64) for s in (0, 1))
                made = list(fragments_of(tool, *ids, fragment)) if valid else [{"cut": False}]
                out = []
                for n, f in enumerate(made):
                    row = [place + 2 * n, 0, valid, f["cut"], *(packed_ids(f.get(k)) for k in ("head_a", "head_b", "tail_a", "tail_b")), None]
                    out.append(row)
                    if f.get("groups"):
                        out.append([place + 2 * n + 1, 1, valid, None, None, None, None, None, packed_groups(f["groups"])])
                columns = list(zip(*out))
                types = [pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([part.column(c).slice(i, 1)] * len(out)) for c in (0, 1)] + [pa.array(c, t) for c, t in zip(columns, types)], names
                )

    spread = pieces.repartition(width, "doc", "place")
    level = materialize(spread.mapInArrow(tokens, schema), "fragments")
    done = [level.where("kind = 1")]
    open_ = level.where("kind = 0").withColumn("at", F.row_number().over(_by_doc()) - 1)
    open_ = materialize(open_, "open-ends")
    most = open_.agg(F.max("at")).first()[0]

    def step(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("place").to_dict("records")
        whole, closed = compose(rows)
        out = [whole]
        for place, ids in closed:
            out.append({"doc": whole["doc"], "doc_id": whole["doc_id"], "place": place, "kind": 1, "valid": whole["valid"], "groups": packed_groups([ids])})
        made = pd.DataFrame(out).reindex(columns=[*group.columns])
        return made.drop(columns=["step"]).assign(at=int(rows[0]["step"]))

    while most is not None and most > 0:
        dealt = open_.withColumn("step", F.expr(f"at div {fan}")).drop("at")
        level = materialize(dealt.groupBy("doc", "step").applyInPandas(step, f"{schema}, at long"), "composed")
        done.append(level.where("kind = 1").drop("at"))
        open_ = level.where("kind = 0")
        most = open_.agg(F.max("at")).first()[0]
    # the start of a text is a common place: what is left of the prefix is the first group
    def close(group: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in group:
            rows = rows.copy()
            rows["groups"] = [packed_groups([(a, b)] if a else []) for a, b in zip(rows["head_a"], rows["head_b"])]
            yield rows.assign(kind=1, place=np.int64(-1))

    done.append(open_.select(*[f.split(" ")[0] for f in schema.split(", ")]).mapInPandas(close, schema))
    out = done[0]
    for other in done[1:]:
        out = out.unionByName(other)
    # one bad fragment makes the whole text one without tokens
    bad = open_.where("not valid").select("doc")
    return out.join(bad.withColumn("bad", F.lit(True)), "doc", "left").select("doc", "doc_id", "place", F.col("bad").isNull().alias("valid"), "groups")


def _by_doc():
    from pyspark.sql import Window

    return Window.partitionBy("doc").orderBy("place")


def long_batches(groups: DataFrame, side_a: str, side_b: str) -> DataFrame:
    """Closed groups of long texts to batches, one for each row."""
    spark = groups.sparkSession
    slot_of = slots(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, places = sides(side_a, side_b), numbered(slot_of)
        for part in parts:
            for i in range(part.num_rows):
                here, valid = unpack(part.column(4)[i].as_py()), part.column(3)[i].as_py()
                found = list(zip(here.column(0).to_pylist(), here.column(1).to_pylist())) if valid else []
                number = {f: n for n, f in enumerate(dict.fromkeys(found))}
                said = {f: tool.group_text(*f) for f in number}
                words = np.fromiter(map(number.__getitem__, found), "<i4", len(found)).tobytes()
                rows = pa.RecordBatch.from_arrays(
                    [part.column(1).slice(i, 1), part.column(0).slice(i, 1), part.column(2).slice(i, 1), pa.array([bool(valid)]), pa.array([words], pa.binary()), pa.array([b";".join(map(said.__getitem__, found))], pa.binary())],
                    [n for n, _ in ROWS],
                )
                yield batch_row(next(places), payload_of(number, list(number), rows))

    return stored_batches(groups.mapInArrow(make, BATCHES), "long")


# counts and results -----------------------------------------------------------------------------


def uses(rows: pa.RecordBatch, fragments: int) -> np.ndarray:
    """How often the rows hold each fragment."""
    return np.bincount(np.frombuffer(b"".join(rows.column("words").to_pylist()), "<i4"), minlength=fragments)


class Alignment:
    """Both tokenizations of all texts, grouped; ``groups``, ``links`` and ``summary`` are its results."""

    def __init__(
        self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", side_a: str = SIDE_A, side_b: str = SIDE_B,
        long_bytes: int = LONG_BYTES, batch_bytes: int = BATCH_BYTES, piece: int = PIECE_BYTES, fragment: int = FRAGMENT_BYTES, fan: int = FAN,
    ):
        self.side_a, self.side_b = side_a, side_b
        self.kind = docs.schema[id_col].dataType.simpleString()
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
        long = F.coalesce(F.octet_length("raw") > long_bytes, F.lit(False))
        self.short = short_batches(rows.where(~long), side_a, side_b, batch_bytes)
        self.parts = [self.short]
        texts = rows.where(long)
        if not texts.isEmpty():
            self.parts.append(long_batches(long_groups(texts, self.kind, side_a, side_b, piece, fragment, fan), side_a, side_b))
        self.asked = [materialize(self._pairs(b), "pairs") for b in self.parts]
        self._links: DataFrame | None = None

    def _pairs(self, batches: DataFrame) -> DataFrame:
        """batch, a_id, b_id, links: the different pairs of each batch."""
        side_a, side_b = self.side_a, self.side_b

        def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tool = sides(side_a, side_b)
            for part in parts:
                for batch, payload in zip(part.column(0).to_pylist(), part.column(1)):
                    found, rows = opened(payload.as_py())
                    f = Fragments(tool, found.column(0), found.column(1))
                    often = uses(rows, found.num_rows)[f.owner]
                    pairs, at = np.unique((f.link_b << 32) | f.link_a, return_inverse=True)
                    links = np.bincount(at, weights=often, minlength=len(pairs)).astype(np.int64)
                    pairs, links = pairs[links > 0], links[links > 0]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(pairs), batch), pa.int64()), pa.array(pairs & 0xFFFFFFFF, pa.int32()), pa.array(pairs >> 32, pa.int32()), pa.array(links)],
                        ["batch", "a_id", "b_id", "links"],
                    )

        return batches.select("batch", "payload").mapInArrow(count, "batch long, a_id int, b_id int, links long")

    def links(self) -> DataFrame:
        """a_id, b_id, links, best: how often each pair of ids is linked in all texts; ``best``: no other A id has more with this B id."""
        if self._links is None:
            counts = self.asked[0]
            for other in self.asked[1:]:
                counts = counts.unionByName(other)
            counts = materialize(counts.groupBy("a_id", "b_id").agg(F.sum("links").alias("links")), "pair-counts")
            most = counts.groupBy("b_id").agg(F.max("links").alias("most"))
            self._links = materialize(
                counts.join(most, "b_id").select("a_id", "b_id", "links", (F.col("links") == F.col("most")).alias("best")), "links"
            )
        return self._links

    def groups(self) -> DataFrame:
        """doc_id, doc, place, a_ids, b_ids, a_sizes, b_sizes: ids (32 bits each) of both sides and how many of them each group has.

        A long text has several rows, in the order of ``place`` within ``doc``.
        """
        side_a, side_b = self.side_a, self.side_b

        def expand(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tool = sides(side_a, side_b)
            for part in parts:
                for payload in part.column(0):
                    found, rows = opened(payload.as_py())
                    f = Fragments(tool, found.column(0), found.column(1))
                    cut = lambda x, n: [c.astype("<u4").tobytes() for c in np.split(x, np.cumsum(n)[:-1])] if len(n) else []
                    of = [cut(f.a, f.n_a), cut(f.b, f.n_b), cut(f.group_a, f.n_groups), cut(f.group_b, f.n_groups)]
                    words = [np.frombuffer(w, "<i4").tolist() for w in rows.column("words").to_pylist()]
                    out = [pa.array([b"".join(map(x.__getitem__, w)) for w in words], pa.binary()) for x in of]
                    yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(3)), *out], ["doc_id", "doc", "place", "a_ids", "b_ids", "a_sizes", "b_sizes"])

        schema = f"doc_id {self.kind}, doc long, place long, a_ids binary, b_ids binary, a_sizes binary, b_sizes binary"
        made = [b.select("payload").mapInArrow(expand, schema) for b in self.parts]
        return made[0].unionByName(made[1]) if len(made) > 1 else made[0]

    def summary(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row for each document."""
        numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
        schema = f"doc_id {self.kind}, doc long, place long, " + ", ".join(f"{n} long" for n in numbers) + ", said binary"
        side_a, side_b = self.side_a, self.side_b

        def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tool = sides(side_a, side_b)
            for part in parts:
                for payload, answers in zip(part.column(1), part.column(2)):
                    found, rows = opened(payload.as_py())
                    f = Fragments(tool, found.column(0), found.column(1))
                    per = [f.n_a, f.n_b, f.n_groups, f.n_links, np.zeros(found.num_rows, np.int64), np.zeros(found.num_rows, np.int64)]
                    if answers.is_valid and len(f.owner):
                        got = answers.values
                        key = (np.asarray(got.field("b_id")).astype(np.int64) << 32) | np.asarray(got.field("a_id"))
                        order = np.argsort(key)
                        key, links, best = key[order], np.asarray(got.field("links"))[order], np.asarray(got.field("best").cast(pa.int8()))[order]
                        # fragments of texts without tokens have no answer, and no row asks for them
                        asked = (f.link_b << 32) | f.link_a
                        at = np.minimum(np.searchsorted(key, asked), len(key) - 1)
                        known = key[at] == asked
                        starts = np.concatenate([[0], np.cumsum(f.n_links)])[:-1]
                        full = f.n_links > 0
                        per[4][full] = np.add.reduceat(np.where(known, best[at], 0).astype(np.int64), starts[full])
                        per[5][full] = np.add.reduceat(np.where(known, links[at], 0), starts[full])
                    size = np.array([len(w) // 4 for w in rows.column("words").to_pylist()], np.int64)
                    words = np.frombuffer(b"".join(rows.column("words").to_pylist()), "<i4")
                    starts, full = np.cumsum(size) - size, size > 0
                    out = []
                    for x in per:
                        total = np.zeros(len(size), np.int64)
                        if full.any():
                            total[full] = np.add.reduceat(x[words].astype(np.int64), starts[full])
                        out.append(pa.array(total))
                    yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(3)), *out, rows.column("said")], ["doc_id", "doc", "place", *numbers, "said"])

        made = [
            with_answers(b, asked.select("batch", "a_id", "b_id").join(self.links(), ["a_id", "b_id"]), "a_id", "b_id", "links", "best").mapInArrow(add, schema)
            for b, asked in zip(self.parts, self.asked)
        ]
        out = made[0].select("doc_id", *numbers, F.col("said").cast("string").alias("groups_sha256"))
        if len(made) > 1:
            out = out.unionByName(self._joined(made[1], numbers))
        return out

    def _joined(self, parts: DataFrame, numbers: list[str]) -> DataFrame:
        """Rows of long texts added up; the digest reads the groups of a text in order, one part at a time."""
        stored = materialize(parts, "long-parts")
        sums = stored.groupBy("doc").agg(F.max("doc_id").alias("doc_id"), *[F.sum(n).alias(n) for n in numbers])

        def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            doc, hasher, any_ = None, hashlib.sha256(), False
            line = lambda: pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([hasher.hexdigest() if any_ else ""])], ["doc", "groups_sha256"])
            for part in rows:
                for key, said in zip(part.column(0).to_pylist(), part.column(1)):
                    if key != doc:
                        if doc is not None:
                            yield line()
                        doc, hasher, any_ = key, hashlib.sha256(), False
                    said = said.as_py()
                    if said:
                        hasher.update(b";" + said if any_ else said)
                        any_ = True
            if doc is not None:
                yield line()

        count = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        lined = stored.select("doc", "place", "said").repartition(count, "doc").sortWithinPartitions("doc", "place")
        digests = lined.select("doc", "said").mapInArrow(read, "doc long, groups_sha256 string")
        return sums.join(digests, "doc").select("doc_id", *numbers, "groups_sha256")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return Alignment(table(spark, folder, "documents")).summary()


#: merges of two vocabulary files; tests hold the result against the libraries and a plain loop
ORACLE_SQL = None
