"""Figure numbers and read operators against brute force; plan checks."""

import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from biotables.sources import text
from biotables.operators import figures, joins, reads, totals


def test_histogram_and_bars(spark):
    df = spark.createDataFrame([("a", float(v), 1.0) for v in range(31)], "g string, x double, y double")
    got = rows(figures.histogram_facet(df, "g", ["x", "y"], bins=30))
    x = {r[2]: r[3] for r in got if r[0] == "x"}
    assert x == {**{i: 1 for i in range(29)}, 29: 2}
    assert [r for r in got if r[0] == "y"] == [("y", "a", 0, 31)]
    bars = figures.bar_count(spark.createDataFrame([("a", "Low")], "g string, q string"), "q", "g", ["Low", "High"])
    assert rows(bars) == [("a", "High", 2, 0), ("a", "Low", 1, 1)]


def test_box_and_violin(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(0, 1, 200), [9.0, -9.0], np.repeat(0.5, 90)])
    df = spark.createDataFrame([("a", float(x)) for x in v], "g string, v double")
    q1, med, q3 = np.quantile(v, [0.25, 0.5, 0.75])
    r = figures.box_summary(df, ["g"], "v").first()
    inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
    assert [r.q1, r.median, r.q3, r.whisker_low, r.whisker_high] == pytest.approx([q1, med, q3, inside.min(), inside.max()])
    assert r.n_outliers == len(v) - len(inside)
    bw = 0.9 * min(v.std(ddof=1), (q3 - q1) / 1.34) * len(v) ** -0.2
    for d in figures.violin_density(df, ["g"], "v", points=9).collect():
        want = np.exp(-0.5 * ((d.x - v) / bw) ** 2).sum() / (len(v) * bw * np.sqrt(2 * np.pi))
        assert d.density == pytest.approx(want)


def brute_trim(quality, leading=3, trailing=3, window=4, required=15):
    start = next((i for i, q in enumerate(quality) if q >= leading), len(quality))
    stop = next((i + 1 for i in range(len(quality) - 1, -1, -1) if quality[i] >= trailing), 0)
    stop = max(stop, start)
    for i in range(start, stop - window + 1):
        if sum(quality[i : i + window]) < window * required:
            return start, i
    return start, stop


def test_trim_against_brute_force(spark):
    rng = random.Random(8)
    data = []
    for i in range(120):
        for m in (1, 2):
            n = rng.randint(1, 40)
            q = [rng.choice([0, 2, 3, 10, 16, 20, 40]) for _ in range(n)]
            data.append((i, m, "".join(rng.choice("ACGT") for _ in range(n)), q))
    df = spark.createDataFrame(data, "read_id int, mate int, bases string, quality array<int>")
    want = {}
    for i, m, b, q in data:
        s, e = brute_trim(q)
        if e - s >= 3:
            want[i, m] = b[s:e]
    got = {(r.read_id, r.mate): (r.bases, r.status) for r in reads.trim_reads(df, min_length=3).collect()}
    assert {k: v[0] for k, v in got.items()} == want
    for (i, m), (_, status) in got.items():
        assert status == ("paired" if (i, 3 - m) in got else "unpaired")


def test_profiles_and_interleave(spark):
    df = spark.createDataFrame([(1, 1, "GA", [10, 20]), (2, 1, "C", [30])], "read_id int, mate int, bases string, quality array<int>")
    assert rows(reads.quality_profile(df)) == [(1, 1, 2, 20.0, 10, 30, 1.0), (1, 2, 1, 20.0, 20, 20, 0.0)]
    df = df.drop("mate")
    assert rows(reads.length_profile(df)) == [(1, 1, 1.0), (2, 1, 0.5)]
    pairs = reads.interleave(df, df.filter("read_id = 1"))
    assert rows(pairs, "read_id", "mate", "bases") == [(1, 1, "GA"), (1, 2, "GA")]


def make_alignments(spark):
    rng = random.Random(6)
    data = [("c1", s, s + rng.randint(1, 30)) for s in (rng.randint(0, 150) for _ in range(200))]
    data += [("c1", 40, 60)] * 150 + [("c2", 5, 90)]  # one position holds much of everything
    return data, spark.createDataFrame(
        [(i, c, s, e) for i, (c, s, e) in enumerate(data)], "read_id int, contig string, start bigint, end bigint"
    )


@pytest.mark.parametrize("bucket", [16, 4096])
def test_depth_against_brute_force(spark, bucket):
    data, df = make_alignments(spark)
    contigs = spark.createDataFrame([("c1", 200), ("c2", 100), ("c3", 50)], "contig string, length bigint")
    got = {r[0]: r for r in rows(reads.contig_depth(df, contigs, bucket))}
    for contig, length in (("c1", 200), ("c2", 100), ("c3", 50)):
        depth = np.zeros(length)
        for c, s, e in data:
            if c == contig:
                depth[s:e] += 1
        assert got[contig][2:] == pytest.approx((depth.mean(), depth.var()))


@pytest.mark.parametrize("bucket", [16, 1000])
def test_feature_counts_against_brute_force(spark, bucket):
    data, df = make_alignments(spark)
    rng = random.Random(9)
    genes = [(f"g{i}", "c1", s, s + rng.randint(5, 25)) for i, s in enumerate(range(0, 180, 12))]
    genes += [("same1", "c2", 0, 9), ("same2", "c2", 0, 9), ("far", "c2", 500, 600)]
    want = {g[0]: 0 for g in genes}
    for c, s, e in data:
        hit = [g for g, gc, gs, ge in genes if gc == c and gs < e and ge > s]
        key = hit[0] if len(hit) == 1 else "__ambiguous" if hit else "__no_feature"
        want[key] = want.get(key, 0) + 1
    features = spark.createDataFrame(genes, "feature string, contig string, start bigint, end bigint")
    assert dict(rows(reads.feature_counts(df, features, bucket))) == want


def test_coordinate_sort_is_global(spark):
    _, df = make_alignments(spark)
    out = [tuple(r) for r in reads.coordinate_sort(df, 3).select("contig", "start", "read_id").collect()]
    assert out == sorted(out)


# ---------------------------------------------------------------- plans


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_required_left_join_is_planned_as_inner(spark):
    a = spark.range(10).withColumnRenamed("id", "k")
    b = spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("name"))
    assert "LeftOuter" not in plan(joins.left_join_required(a, b, ["k"], "name"))


def test_running_totals_do_not_use_one_partition(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("b"), "id")
    text = plan(totals.running_total(df, ["g"], "b", ["id"], "id", "s"))
    assert "SinglePartition" not in text and "CartesianProduct" not in text


def test_fact_joins_are_equi_joins(spark):
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    import __spark_entry__ as entry

    text = plan(entry.entry(spark))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    scan = [line for line in text.splitlines() if "lineitem.parquet" in line]
    assert scan and all("l_comment" not in line and "l_tax" not in line for line in scan)


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select("id", F.lit("x").alias("unused"), (F.col("id") * 2).alias("v")).write.parquet(path)
    text = plan(spark.read.parquet(path).filter(F.col("v") > 10).select("id"))
    assert "GreaterThan(v,10)" in text and "unused" not in text.split("ReadSchema")[-1]


def test_fastq_with_quality_lines_that_start_like_a_record(spark, tmp_path):
    (tmp_path / "S1_L001_R1.fastq").write_text("@r1 first\nACG\n+\n@I@\n@r2\nTT\n+r2\n+@\n@r3\n\n+\n\n@r4\nA\n+\n@\n")
    (tmp_path / "S1_L002_R2.fastq").write_text("@r1\nGG\n+\nII")
    got = reads.concat_lanes(text.read_fastq(spark, str(tmp_path)))
    assert rows(got, "lane", "read_id", "mate", "bases", "quality") == [
        ("L001", "r1", 1, "ACG", [31, 40, 31]), ("L001", "r2", 1, "TT", [10, 31]), ("L001", "r3", 1, "", []), ("L001", "r4", 1, "A", [31]),
        ("L002", "r1", 2, "GG", [40, 40]),
    ]
    (tmp_path / "broken.fastq").write_text("@r1\nGG\n+\nI\n")
    with pytest.raises(Exception, match="broken record"):
        text.read_fastq(spark, str(tmp_path / "broken.fastq")).collect()


def test_features_of_an_annotation_file(spark, tmp_path):
    lines = [
        "# comment", 'c1\tx\tCDS\t11\t20\t.\t+\t0\ttranscript_id "t1"; gene_id "g1"', "c1\tx\ttRNA\t1\t5\t.\t+\t0\tgene_id \"g2\"",
        "c2\tx\tCDS\t5\t6\t.\t-\t0\tgene_id=g3;note=y", "c2\tx\tCDS\t7\t9\t.\t-\t0\tother_gene_id=g4",
    ]
    (tmp_path / "a.gtf").write_text("\n".join(lines) + "\n")
    got = text.read_features(spark, str(tmp_path / "a.gtf"))
    assert rows(got, "feature", "contig", "start", "end", "strand") == [("g1", "c1", 10, 20, "+"), ("g3", "c2", 4, 6, "-")]


def test_coordinate_order_over_all_partitions(spark):
    rng = random.Random(2)
    data = [(f"r{i}", rng.randrange(5), rng.randrange(100)) for i in range(500)]
    df = spark.createDataFrame(data, "read_id string, contig int, start int").repartition(7)
    got = [(r.contig, r.start, r.read_id) for r in reads.coordinate_sort(df, 5).collect()]
    assert got == sorted((c, s, r) for r, c, s in data)
