"""Edit-aware token counts over segment trees of pre-tokens.

A text is cut into segments of whole pre-tokens; the leaves of a segment tree hold the characters and
tokens of each segment, inner nodes their sums. An edit finds the segments it touches by descending the
tree on character sums, takes the neighbours into the region where the edit reaches their edge (boundary
context), re-encodes that region only, and updates the sums on the paths above. The count of the edited
text is the root.

Segments start at a space between two characters that are not white space: the pattern starts a new
match there whatever stands before, so no pre-token crosses such a place. A text without such places is
one segment.

Edits apply in the order of ``seq``, each to the text that the one before left: ``start`` (characters
from 0), ``length`` removed, ``text`` inserted. Defined cases: null text is empty; start and length are
cut to the text, null or negative ones read as 0 and null insertions as empty; equal ``seq`` apply in the
order of start, length, text; no edits (null or empty list) give equal counts; repeated rows and null
ids stay rows of their own; other columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biotables.llm.byte_bpe import PATTERN, RANKS, read_ranks
from biotables.llm.columns import table

#: characters per segment, about
SEGMENT = 256
CUT = re.compile(r"(?<=\S)\x20(?=\S)")
EDIT = "struct<seq:bigint,start:bigint,length:bigint,text:string>"


@lru_cache(maxsize=4)
def encoding(ranks: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks), special_tokens={})


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """Pieces of about ``size`` characters that no pre-token crosses."""
    out, at = [], 0
    while len(text) - at > size:
        found = CUT.search(text, at + size)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    out.append(text[at:])
    return out


class TokenTree:
    """Segment tree: characters and tokens of every segment, sums above."""

    def __init__(self, text: str, tool: tiktoken.Encoding, size: int = SEGMENT):
        self.tool, self.size = tool, size
        self.encoded = 0
        self.build(segments(text, size))

    def count(self, text: str) -> int:
        self.encoded += len(text)
        return len(self.tool.encode_ordinary(text))

    def build(self, parts: list[str], tokens: list[int] | None = None) -> None:
        self.parts = parts
        self.leaves = 1 << max(0, (len(parts) - 1).bit_length())
        tokens = [self.count(p) for p in parts] if tokens is None else tokens
        self.chars = [0] * self.leaves + [len(p) for p in parts] + [0] * (self.leaves - len(parts))
        self.tokens = [0] * self.leaves + tokens + [0] * (self.leaves - len(parts))
        for i in range(self.leaves - 1, 0, -1):
            self.add_up(i)

    def add_up(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def put(self, leaf: int, text: str) -> None:
        self.parts[leaf] = text
        i = leaf + self.leaves
        self.chars[i], self.tokens[i] = len(text), self.count(text) if text else 0
        while i > 1:
            i //= 2
            self.add_up(i)

    def find(self, place: int) -> tuple[int, int]:
        """Leaf that holds the character at ``place`` and its first character; the last filled leaf at the end."""
        i, before = 1, 0
        place = min(place, self.chars[1] - 1)
        if place < 0:
            return 0, 0
        while i < self.leaves:
            i *= 2
            if before + self.chars[i] <= place:
                before += self.chars[i]
                i += 1
        return i - self.leaves, before

    def edit(self, start: int, length: int, text: str) -> None:
        total = self.chars[1]
        start = min(max(0, start), total)
        end = min(start + max(0, length), total)
        if start == end and not text:
            return
        # two characters of context on each side decide whether the cuts next to the edit still hold
        first, before = self.find(max(0, start - 2))
        last, _ = self.find(end + 1)
        region = "".join(self.parts[first : last + 1])
        region = region[: start - before] + text + region[end - before :]
        self.put(first, region)
        for leaf in range(first + 1, last + 1):
            if self.parts[leaf]:
                self.put(leaf, "")
        if len(region) > 8 * self.size:
            # a leaf that has grown is cut again; counts of the others stay
            parts = segments(region, self.size)
            if len(parts) > 1:
                counts = self.tokens[self.leaves : self.leaves + len(self.parts)]
                new = [self.count(p) for p in parts]
                self.build([*self.parts[:first], *parts, *self.parts[first + 1 :]], [*counts[:first], *new, *counts[first + 1 :]])

    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.parts)


def apply_edits(text: str | None, edits: list[dict] | None, tool: tiktoken.Encoding) -> tuple[TokenTree, int, int]:
    """Tree of the edited text, tokens before, characters encoded again."""
    tree = TokenTree(text or "", tool)
    before, tree.encoded = tree.total(), 0
    clean = [(e["seq"] or 0, max(0, e["start"] or 0), max(0, e["length"] or 0), e["text"] or "") for e in edits or [] if e]
    for _, start, length, new in sorted(clean):
        tree.edit(start, length, new)
    return tree, before, tree.encoded


def count_edited(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", ranks: str = RANKS, pattern: str = PATTERN, texts: bool = True
) -> DataFrame:
    """doc_id, tokens_before, n_edits, tokens_after, chars_encoded and, if asked for, the edited text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoding(ranks, pattern)
        for rows in parts:
            for a in range(0, rows.num_rows, 256):
                part = rows.slice(a, 256)
                out: list[list] = [[], [], [], [], []]
                for text, edits in zip(part.column(1), part.column(2)):
                    edits = edits.as_py()
                    tree, before, encoded = apply_edits(text.as_py(), edits, tool)
                    for column, value in zip(out, (before, len(edits or []), tree.total(), encoded, tree.text() if texts else None)):
                        column.append(value)
                kinds = [pa.int64()] * 4 + [pa.string()] * texts
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(x, k) for x, k in zip(out, kinds))],
                    ["doc_id", "tokens_before", "n_edits", "tokens_after", "chars_encoded", "edited"][: 1 + len(kinds)],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(edits_col).cast(f"array<{EDIT}>").alias("edits"))
    return rows.mapInArrow(run, f"doc_id {kind}, tokens_before long, n_edits long, tokens_after long, chars_encoded long" + ", edited string" * texts)


def with_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the edits of each id (columns seq, start, length, text) as a list; edits of one text are one list by nature."""
    lists = edits.groupBy(id_col).agg(F.collect_list(F.struct("seq", "start", "length", "text")).alias("edits"))
    return docs.drop("edits").join(lists, id_col, "left")


def derived_edits(id_col: str = "doc_id", text_col: str = "text", count: int = 3):
    """A list of edits that follow from id and text: a place, up to 40 characters less, up to 60 of the text itself more."""
    draw = lambda k, salt, most: f"pmod(xxhash64({id_col}, {k}, '{salt}'), {most})"
    one = lambda k: (
        f"named_struct('seq', {k}L, 'start', {draw(k, 'at', f'length({text_col}) + 1')}, 'length', {draw(k, 'less', 41)}, "
        f"'text', substring({text_col}, int({draw(k, 'from', f'length({text_col}) + 1')}) + 1, int({draw(k, 'more', 61)})))"
    )
    return F.expr(f"if({text_col} is null, null, array({', '.join(one(k) for k in range(count))}))")


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text").withColumn("edits", derived_edits())
    return count_edited(docs, texts=False)


#: counts need the vocabulary's merges; tests compare with a full count of every edited text
ORACLE_SQL = None
