"""Blocks of samples and what tasks get of them."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from biotables.operators import community, distance


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def odd_counts(spark):
    """Samples of many sizes, rows without a feature, without a sample, repeated rows."""
    rng = np.random.default_rng(5)
    data = [(f"s{i:02}", int(f), int(rng.integers(1, 9))) for i in range(23) for f in rng.choice(60, rng.integers(1, 20), replace=False)]
    data += [("big", f, 3) for f in range(60)] + [("s00", None, 4), ("s01", 5, 2), ("none", None, 7), (None, 5, 9)]
    return data, spark.createDataFrame(data, "sample string, feature int, count bigint")


def plain(data):
    table, totals = {}, {}
    for s, f, c in data:
        if s is not None:
            table.setdefault(s, {})
            totals[s] = totals.get(s, 0) + c
            if f is not None:
                table[s][f] = table[s].get(f, 0) + c
    return table, totals


@pytest.mark.parametrize("most", [10**6, 30])
def test_blocks_are_bounded_and_hold_every_cell_once(spark, monkeypatch, most):
    monkeypatch.setattr(distance, "CELLS_PER_TASK", most)
    data, df = odd_counts(spark)
    cells = df.groupBy("sample", "feature").agg(F.sum("count").cast("double").alias("x"))
    blocks = distance.packed_blocks(cells, False, 4).collect()
    table, totals = plain(data)
    got = {}
    for b in blocks:
        assert len(b.ids) <= 4 and (len(b.ids) == 1 or b.cells < most) and b.cells <= max(most, 60)
        codes = np.repeat(np.frombuffer(b.features, np.int64), np.frombuffer(b.sizes, np.int64)).tolist()
        assert all(b.lo <= c <= b.hi for c in codes)
        for row, code, x in zip(np.frombuffer(b["rows"], np.int32), codes, np.frombuffer(b.x)):
            assert (b.ids[row], code) not in got
            got[b.ids[row], code] = x
        if b.hi == distance.LAST:
            assert np.frombuffer(b.totals).tolist() == [totals[s] for s in b.ids]
    assert got == {(s, f): x for s, cells in table.items() for f, x in cells.items()}


def test_bray_curtis_shuffles_no_copies_of_cells(spark):
    data, df = odd_counts(spark)
    table, totals = plain(data)
    out = distance.bray_curtis(df, block=2)
    plan = plan_of(out)
    assert "CartesianProduct" in plan and "FlatMapGroups" not in plan and "hashpartitioning(lo" not in plan
    got = {(a, b): d for a, b, d in rows(out)}
    names = sorted(table)
    assert set(got) == {(a, b) for a in names for b in names if a < b}
    for (a, b), d in got.items():
        both = sum(min(x, table[b].get(f, 0)) for f, x in table[a].items())
        assert d == 1 - 2 * both / (totals[a] + totals[b])


def test_euclidean_shuffles_no_copies_of_cells(spark):
    rng = np.random.default_rng(6)
    data = [(s, f"g{f}", int(rng.integers(0, 5))) for s in range(9) for f in range(4) if (s + f) % 3]
    out = distance.euclidean(spark.createDataFrame(data, "sample bigint, feature string, count bigint"), block=2)
    assert "CartesianProduct" in plan_of(out) and "FlatMapGroups" not in plan_of(out)
    m = np.zeros((9, 4))
    for s, f, x in data:
        m[s, int(f[1:])] += x
    got = {(a, b): d for a, b, d in rows(out)}
    assert set(got) == {(a, b) for a in range(9) for b in range(a + 1, 9)}
    assert all(d == pytest.approx(np.linalg.norm(m[a] - m[b])) for (a, b), d in got.items())


def test_vectors_are_packed_without_a_shuffle_and_met_without_copies(spark):
    v = np.random.default_rng(7).normal(size=(30, 3))
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(4, v[4].tolist()), (None, v[0].tolist())]  # an id that comes twice, one that is missing
    out = distance.vector_distances(spark.createDataFrame(data, "id bigint, v array<double>").repartition(3), "id", "v", block=4)
    assert "CartesianProduct" in plan_of(out) and "FlatMapGroups" not in plan_of(out)
    got = rows(out)
    assert len(got) == 31 * 30 // 2 - 1 and all(a < b for a, b, _ in got)
    assert all(d == pytest.approx(np.linalg.norm(v[a] - v[b])) for a, b, d in got)
    floats = spark.createDataFrame([("a", [0.5, 1.0]), ("c", [0.5, 4.0]), ("b", [0.5, 0.0])], "id string, v array<float>")
    assert rows(distance.vector_distances(floats, "id", "v")) == [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 4.0)]


def test_draws_of_a_sample_in_one_slot_are_made_behind_the_shuffle(spark):
    df = spark.createDataFrame([(f"s{i}", f"f{k}", 3 + i) for i in range(4) for k in range(9)], "sample string, feature string, count bigint")
    for draws in (20_000, 5):  # one slot a sample, and many, whose draws are dealt to them
        out = community.rarefy(df, 81, draws)
        lines = plan_of(out).splitlines()
        made = next(i for i, line in enumerate(lines) if "Generate explode(CASE WHEN isnull(depth" in line)
        dealt = next(i for i, line in enumerate(lines) if "hashpartitioning(sample" in line and "slot" in line and "Exchange" in line)
        assert made < dealt  # a plan is printed from its end
        assert {r.sample: r.n for r in out.groupBy("sample").agg(F.sum("count").alias("n")).collect()} == {f"s{i}": 27 for i in range(4)}
