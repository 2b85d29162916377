"""A Spark data source for sequence files: byte ranges that start at a record, wherever their border falls.

``spark.read.format("sequence_records")`` plans ranges of files on the driver; a task opens its file at its range and
finds the first record that starts in it. A record belongs to the range that holds its first byte, so the rows are
the same for every range size.

FASTA records start at a line that begins with ``>``. A FASTQ record is four lines, and its quality line may begin
with ``@`` or ``+`` like the others, so a start is looked for by structure: of the four possible phases, those are kept whose
records all have ``@``, ``+`` and as many qualities as bases. The true phase is always among them; text is
added until it is the only one. If several remain after ``LOOK_MOST`` bytes, the lines before the range are counted.

Compressed files cannot be entered in the middle and are one range each, read as a stream.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 32 << 20
#: bytes of short ranges that are parsed at a time, and of a task of them at least
PARSED_BYTES = 1 << 20
#: short ranges are put together into about so many tasks, if these are not too small
TASKS = 256
#: bytes looked at for a record start, at first and at most
LOOK_FIRST = 1 << 14
LOOK_MOST = 1 << 22
#: bytes of a compressed file, and rows of a result batch, that are held at a time
STREAM_BYTES = 16 << 20
ROWS = 20_000
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4")

SCHEMAS = {
    "fastq": "file string, head string, bases string, quality array<int>",
    "fasta": "file string, head string, body string",
}


def file_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def listed(path: str) -> list[tuple[str, int]]:
    """Files under a path with their sizes; hidden ones and those that begin with ``_`` are left out."""
    system, inner = file_of(path)
    head = path[: len(path) - len(inner)] if path.endswith(inner) else "file://"
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner))
    return sorted((head + i.path, i.size) for i in found if i.type == fs.FileType.File and i.base_name[0] not in "_." and i.size)


@dataclass
class Ranges(InputPartition):
    """``(file, first byte, byte behind the last)`` of one task."""

    parts: list[tuple[str, int, int]]


def planned(files: Sequence[tuple[str, int]], most: int) -> list[Ranges]:
    """Ranges of at most ``most`` bytes; small files and small ranges share a task."""
    out: list[Ranges] = []
    # a task costs about what some MB do: short ranges stand one after the other in a task, when there are many of them
    total = sum(size for _, size in files)
    task = filled = max(most, min(RANGE_BYTES, max(PARSED_BYTES, total // TASKS)))
    for file, size in files:
        step = size if file.endswith(COMPRESSED) else most
        for start in range(0, size, step):
            part = (file, start, min(start + step, size))
            if filled + part[2] - start > task:
                out.append(Ranges([]))
                filled = 0
            out[-1].parts.append(part)
            filled += part[2] - start
    return out


def line_starts(data: bytes) -> np.ndarray:
    """Places behind a line break."""
    return np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1


def consistent(lines: list[bytes]) -> bool:
    """Whether whole records of four lines all look like records."""
    return all(
        head[:1] == b"@" and plus[:1] == b"+" and len(bases.rstrip(b"\r")) == len(marks.rstrip(b"\r"))
        for head, bases, plus, marks in zip(*(lines[k::4] for k in range(4)))
    )


def first_fastq(file: pa.NativeFile, at: int, size: int) -> int:
    """Place of the first record that starts at ``at`` or later; ``size`` if there is none."""
    if at == 0 or at >= size:
        return min(at, size)
    look = LOOK_FIRST
    while True:
        file.seek(at - 1)
        data = file.read(min(look, size - at + 1))
        whole = at - 1 + len(data) >= size
        starts = line_starts(data)
        lines = [data[a : b - 1] for a, b in zip(starts, starts[1:])]
        if len(starts) and whole and starts[-1] < len(data):
            lines.append(data[starts[-1] :])
        phases = [p for p in range(4) if len(lines) >= p + 4 and consistent(lines[p:])]
        if len(phases) == 1 and len(lines) >= 8:
            return at - 1 + int(starts[phases[0]])
        if whole or look >= LOOK_MOST:
            break
        look *= 4
    if not len(starts):
        return size
    before, done = 0, 0
    file.seek(0)
    # a line that starts at ``starts[0]`` has as many lines before it as there are breaks before
    while done < at - 1 + int(starts[0]):
        block = file.read(min(STREAM_BYTES, at - 1 + int(starts[0]) - done))
        before, done = before + block.count(b"\n"), done + len(block)
    phase = -before % 4
    return at - 1 + int(starts[phase]) if phase < len(starts) else size


def first_fasta(file: pa.NativeFile, at: int, size: int) -> int:
    """Place of the first ``>`` at the start of a line, from ``at`` on."""
    if at == 0 or at >= size:
        return min(at, size)
    file.seek(at - 1)
    place, last = at - 1, b""
    while block := file.read(min(1 << 20, size - place)):
        found = (last + block).find(b"\n>")
        if found >= 0:
            return place - len(last) + found + 1
        place, last = place + len(block), block[-1:]
    return size


def fastq_batch(name: str, lines: list[bytes]) -> pa.RecordBatch:
    """Whole records; anything that is no record raises."""
    lines = [x.rstrip(b"\r") for x in lines]
    head, bases, plus, marks = (pa.array(lines[k::4], pa.binary()) for k in range(4))
    good = pc.and_(
        pc.and_(pc.starts_with(head, b"@"), pc.starts_with(plus, b"+")), pc.equal(pc.binary_length(bases), pc.binary_length(marks))
    )
    if not pc.all(good).as_py():
        broken = lines[4 * int(np.flatnonzero(~np.asarray(good))[0])]
        raise ValueError(f"{name} has a broken record at {broken.decode(errors='replace')!r}")
    offsets = np.concatenate([[0], np.cumsum([len(m) for m in lines[3::4]])]).astype(np.int32)
    quality = np.frombuffer(b"".join(lines[3::4]), np.uint8).astype(np.int32) - 33
    return pa.RecordBatch.from_arrays(
        [
            pa.array([name] * len(head)),
            pa.array([h[1:] for h in lines[0::4]], pa.binary()).cast(pa.string()),
            bases.cast(pa.string()),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(quality)),
        ],
        ["file", "head", "bases", "quality"],
    )


def last_lines(lines: list[bytes]) -> list[bytes]:
    """Lines at the end of a file: the rest behind the last break and blank lines go, a missing empty quality line comes."""
    if lines and lines[-1] == b"":
        lines.pop()
    if len(lines) % 4 == 3 and lines[-1][:1] == b"+":
        lines.append(b"")
    while lines and len(lines) % 4 and not lines[-1].strip():
        lines.pop()
    while len(lines) >= 4 and not any(x.strip() for x in lines[-4:]):
        del lines[-4:]
    return lines


def fastq_rows(name: str, blocks: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Blocks of a run of records, the first of which starts with the first block."""
    rest = b""
    for block in blocks:
        *lines, rest = (rest + block).split(b"\n")
        whole = len(lines) // 4 * 4
        rest = b"\n".join([*lines[whole:], rest])
        for a in range(0, whole - 4, 4 * ROWS):  # the last record waits, it may be blank lines at the end
            yield fastq_batch(name, lines[a : min(a + 4 * ROWS, whole - 4)])
        if whole:
            rest = b"\n".join([*lines[whole - 4 : whole], rest])
    lines = last_lines(rest.split(b"\n"))
    if len(lines) % 4:
        raise ValueError(f"{name} ends within a record")
    if lines:
        yield fastq_batch(name, lines)


def fasta_rows(name: str, blocks: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    def batch(records: list[bytes]) -> pa.RecordBatch:
        parts = [r.removeprefix(b">").partition(b"\n") for r in records if r.strip()]
        columns = [[name] * len(parts), [p[0].rstrip(b"\r").decode() for p in parts], [p[2].decode() for p in parts]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.large_string()).cast(pa.string()) for c in columns], ["file", "head", "body"])

    held: list[bytes] = []
    for block in blocks:
        # a long sequence is put together once, at its end
        if b"\n>" not in (held[-1][-1:] if held else b"") + block:
            held.append(block)
            continue
        *records, rest = b"".join([*held, block]).split(b"\n>")
        held = [rest]
        for a in range(0, len(records), ROWS):
            yield batch(records[a : a + ROWS])
    if held:
        yield batch([b"".join(held)])


FIRST = {"fastq": first_fastq, "fasta": first_fasta}
ROWS_OF = {"fastq": fastq_rows, "fasta": fasta_rows}


def range_blocks(file: pa.NativeFile, place: int, stop: int) -> Iterator[bytes]:
    """Bytes from a record start to another one."""
    file.seek(place)
    while place < stop:
        block = file.read(min(STREAM_BYTES, stop - place))
        place += len(block)
        yield block


def file_blocks(file: pa.NativeFile, kind: str, ranges: Sequence[tuple[int, int]]) -> Iterator[bytes]:
    """Bytes of ranges that follow each other, from the first record that starts in a range to the first one behind it.

    Where a range follows another, its first record is the one that the other ended at. Short ones are put together.
    """
    size = file.size()
    stop = FIRST[kind](file, ranges[0][0], size)
    held, length = [], 0
    for _, border in ranges:
        place, stop = stop, FIRST[kind](file, border, size)
        for block in range_blocks(file, place, stop):
            held.append(block)
            length += len(block)
            if length >= PARSED_BYTES:
                yield b"".join(held)
                held, length = [], 0
    if held:
        yield b"".join(held)


def runs(parts: Sequence[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Files with their ranges, ranges that do not follow each other apart."""
    name, ranges = "", []
    for file, start, end in parts:
        if ranges and (file != name or start != ranges[-1][1]):
            yield name, ranges
            ranges = []
        name = file
        ranges.append((start, end))
    if ranges:
        yield name, ranges


def stream_blocks(system: fs.FileSystem, inner: str) -> Iterator[bytes]:
    with system.open_input_stream(inner, compression="detect") as file:
        while block := file.read(STREAM_BYTES):
            yield block


class RecordReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.kind = options.get("kind", "fastq")
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.range_bytes = int(options.get("rangebytes") or options.get("rangeBytes") or RANGE_BYTES)

    def partitions(self) -> list[Ranges]:
        return planned([f for path in self.paths for f in listed(path)], self.range_bytes) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for name, ranges in runs(partition.parts):
            system, inner = file_of(name)
            if name.endswith(COMPRESSED):
                yield from ROWS_OF[self.kind](name, stream_blocks(system, inner))
                continue
            with system.open_input_file(inner) as file:
                yield from ROWS_OF[self.kind](name, file_blocks(file, self.kind, ranges))


class SequenceRecords(DataSource):
    """Options: ``path`` or ``paths`` (a JSON list), ``kind`` (fastq or fasta), ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "sequence_records"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "fastq")]

    def reader(self, schema) -> RecordReader:
        return RecordReader(dict(self.options))


def read_records(spark: SparkSession, path: str | Sequence[str], kind: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(SequenceRecords)
    paths = json.dumps([path] if isinstance(path, str) else list(path))
    return spark.read.format("sequence_records").options(paths=paths, kind=kind, rangeBytes=str(range_bytes)).load()
