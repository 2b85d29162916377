"""Sequence files read in ranges, and interval joins, against plain loops."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from biotables.operators import intervals, reads
from biotables.operators.order import with_position
from biotables.sources import records, text


def odd_fastq(count, seed):
    """Records whose quality lines look like record starts as often as possible."""
    rnd = random.Random(seed)
    out = []
    for i in range(count):
        n = rnd.choice([0, 1, 2, 5, 30])
        marks = "".join(rnd.choice("@+I") for _ in range(n))
        out.append((f"r{i}", "".join(rnd.choice("ACGT") for _ in range(n)), marks))
    return out


def as_file(rows, line="\n"):
    return "".join(f"@{name} text{line}{bases}{line}+{line}{marks}{line}" for name, bases, marks in rows)


@pytest.mark.parametrize("line", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [1, 7, 50, 333, 10**6])
def test_ranges_of_a_fastq_file_hold_every_record_once(tmp_path, line, size):
    rows = odd_fastq(60, size)
    (tmp_path / "a.fastq").write_text(as_file(rows, line), newline="")
    reader = records.RecordReader({"kind": "fastq", "path": str(tmp_path), "rangeBytes": str(size)})
    got = [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
    assert [(r["head"], r["bases"], r["quality"]) for r in got] == [(f"{n} text", b, [ord(c) - 33 for c in m]) for n, b, m in rows]


def test_a_range_counts_lines_where_structure_says_nothing(tmp_path, monkeypatch):
    monkeypatch.setattr(records, "LOOK_FIRST", 64)
    monkeypatch.setattr(records, "LOOK_MOST", 64)
    rows = [(f"@{i}", "@@+", "+@+") for i in range(40)]  # every phase may look like a record for a while
    (tmp_path / "a.fastq").write_text(as_file(rows))
    reader = records.RecordReader({"kind": "fastq", "path": str(tmp_path), "rangeBytes": "11"})
    got = [r["head"] for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
    assert got == [f"@{i} text" for i in range(40)]


@pytest.mark.parametrize("size", [3, 40, 10**6])
def test_ranges_of_a_fasta_file(tmp_path, size):
    rnd = random.Random(size)
    rows = [(f"s{i}", ["".join(rnd.choice("ACGT>") for _ in range(rnd.randrange(1, 30))).replace(">", "N") for _ in range(rnd.randrange(4))]) for i in range(40)]
    (tmp_path / "a.fa").write_text("".join(f">{n} d\n" + "".join(f"{x}\n" for x in lines) for n, lines in rows))
    reader = records.RecordReader({"kind": "fasta", "path": str(tmp_path), "rangeBytes": str(size)})
    got = [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
    assert [(r["head"], r["body"].split()) for r in got] == [(f"{n} d", lines) for n, lines in rows]


@pytest.mark.parametrize("kind", ["fastq", "fasta"])
def test_many_short_ranges_are_few_tasks(tmp_path, kind):
    rows = [(n, b, m) for n, b, m in odd_fastq(3000, 9) if b]
    for part in range(3):
        here = rows[part::3]
        (tmp_path / f"{part}.txt").write_text(as_file(here) if kind == "fastq" else "".join(f">{n} text\n{b}\n" for n, b, _ in here))
    reader = records.RecordReader({"kind": kind, "path": str(tmp_path), "rangeBytes": "16"})
    tasks = reader.partitions()
    ranges = [part for task in tasks for part in task.parts]
    assert len(ranges) > 2000 and all(end - start <= 16 for _, start, end in ranges) and len(tasks) <= 1.2 * records.TASKS
    got = sorted(r["head"].split()[0] for p in tasks for batch in reader.read(p) for r in batch.to_pylist())
    assert got == sorted(n for n, _, _ in rows)


def test_fastq_in_spark_plain_compressed_and_broken(spark, tmp_path):
    rows = odd_fastq(200, 3)
    plain, packed = tmp_path / "S1_L001_R1.fastq", tmp_path / "S1_L002_R1.fastq.gz"
    plain.write_text(as_file(rows) + "\n\n")
    with gzip.open(packed, "wt") as out:
        out.write(as_file(rows))
    got = text.read_fastq(spark, [str(plain), str(packed)], range_bytes=100)
    assert got.count() == 400 and got.groupBy("read_id").count().where("count = 2").count() == 200
    (tmp_path / "broken.fastq").write_text("@r1\nGG\n+\nI\n")
    with pytest.raises(Exception, match="broken record"):
        text.read_fastq(spark, str(tmp_path / "broken.fastq")).collect()
    (tmp_path / "cut.fastq").write_text("@r1\nGG\n")
    with pytest.raises(Exception, match="ends within a record"):
        text.read_fastq(spark, str(tmp_path / "cut.fastq")).collect()
    (tmp_path / "none").mkdir()
    assert text.read_fastq(spark, str(tmp_path / "none")).count() == 0


def test_overlaps_equal_a_plain_loop(spark):
    rnd = random.Random(7)
    size = lambda: rnd.choice([0, 1, 3, 200, 513, 5000, 10**5, 3 * 10**7, 10**8])
    make = lambda n: [(i, rnd.randrange(2), s, s + size()) for i, s in ((i, rnd.choice([rnd.randrange(2000), 511, 512, 4096, 10**8])) for i in range(n))]
    a, b = make(150), make(150)
    probes = spark.createDataFrame(a, "p long, contig int, start long, end long")
    full = spark.createDataFrame(b, "f long, contig int, f_start long, f_end long")
    got = intervals.overlaps(probes, full, "contig", ("start", "end"), ("f_start", "f_end")).select("p", "f").collect()
    want = [(p, f) for p, c, s, e in a for f, d, u, v in b if c == d and max(s, u) < min(e, v)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert intervals.overlaps(probes, full.limit(0), "contig", ("start", "end"), ("f_start", "f_end")).count() == 0


def test_long_features_stay_few_rows(spark):
    features = spark.range(20).select(F.concat(F.lit("f"), "id").alias("feature"), F.lit(1).alias("contig"), F.col("id").alias("start"), (F.col("id") + 10**8).alias("end"))
    entered = intervals.entered(features.withColumnsRenamed({"start": "f_start", "end": "f_end"}), "f_start", "f_end", 1)
    assert entered.count() == 20
    spots = spark.range(0, 10**6, 1000).select(F.lit(1).alias("contig"), F.col("id").alias("start"), (F.col("id") + 100).alias("end"))
    asked = intervals.asked(spots, "start", "end", [8])
    assert asked.count() <= 2 * 1000
    counts = {r.locus_tag: r["count"] for r in reads.feature_counts(spots, features.limit(1)).collect()}
    assert counts == {"f0": 1000}
    assert {r.locus_tag: r["count"] for r in reads.feature_counts(spots, features).collect()}["__ambiguous"] == 1000


def test_positions_follow_the_order(spark):
    rows = spark.range(0, 500, 1, 7).select(F.pmod(F.hash("id"), F.lit(40)).alias("k"), "id")
    got = [(r.k, r.id, r.position) for r in with_position(rows, F.desc("k"), "id", partitions=6).collect()]
    want = sorted(((k, i) for k, i, _ in got), key=lambda r: (-r[0], r[1]))
    assert sorted(got, key=lambda r: r[2]) == [(k, i, n) for n, (k, i) in enumerate(want, start=1)]
    assert with_position(rows.limit(0), "id").count() == 0
