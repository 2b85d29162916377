"""Bounded distance joins against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from biotables.operators import distance, near


def plain(counts):
    rows = {}
    for s, f, x in counts:
        if x > 0:
            rows.setdefault(s, {})[f] = rows.get(s, {}).get(f, 0) + x
    out = {}
    for a, x in rows.items():
        for b, y in rows.items():
            if a != b:
                shared = sum(min(v, y.get(f, 0)) for f, v in x.items())
                out[a, b] = 1 - 2 * shared / (sum(x.values()) + sum(y.values()))
    return rows, out


def sparse(seed, samples=60):
    rnd = random.Random(seed)
    out = []
    for s in range(samples):
        base = rnd.randrange(6)
        for f in range(40):
            if rnd.random() < (0.6 if f % 6 == base else 0.05) or f == 39:  # feature 39 is in every sample
                out.append((f"s{s:02}", f, rnd.choice([0, 1, 2, 9, 100])))
    # equal samples, one with nothing in common with the others, one huge one
    out += [("t1", 1, 5), ("t1", 2, 7), ("t2", 1, 5), ("t2", 2, 7), ("alone", 99, 3), *[("huge", f, 1000) for f in range(38)]]
    return out


@pytest.mark.parametrize("limit", [0.0, 0.3, 0.7, 0.95])
def test_pairs_within_a_limit(spark, limit):
    counts = sparse(int(limit * 100))
    _, dist = plain(counts)
    got = near.bray_curtis_within(spark.createDataFrame(counts, "sample string, feature long, count long"), limit).collect()
    want = {(a, b): d for (a, b), d in dist.items() if a < b and d <= limit}
    assert {(r.id_a, r.id_b) for r in got} == set(want) and len(got) == len(want)
    assert all(abs(r.dist - want[r.id_a, r.id_b]) < 1e-12 for r in got)


@pytest.mark.parametrize("k,block", [(1, 4), (5, 16), (70, 8)])
def test_nearest_samples(spark, k, block):
    counts = sparse(k)
    rows, dist = plain(counts)
    got = {}
    for r in near.nearest_samples(spark.createDataFrame(counts, "sample string, feature long, count long"), k, block).orderBy("sample", "rank").collect():
        got.setdefault(r["sample"], []).append(r.neighbour)
    for a in rows:
        assert got[a] == sorted((b for b in rows if b != a), key=lambda b: (dist[a, b], b))[:k]


def test_limits_and_nothing(spark):
    empty = spark.createDataFrame([], "sample string, feature long, count long")
    assert near.bray_curtis_within(empty, 0.5).count() == 0 and near.nearest_samples(empty, 3).count() == 0
    with pytest.raises(ValueError, match="limit"):
        near.bray_curtis_within(empty, 1.0)


COLUMNS = "sample string, feature long, count long"


@pytest.mark.parametrize("limit,meetings", [(0.3, 0), (0.3, 10**9), (0.7, 0), (0.98, 0)])
def test_pairs_within_a_limit_by_blocks(spark, monkeypatch, limit, meetings):
    monkeypatch.setattr(near, "MEETINGS", meetings)
    monkeypatch.setattr(near, "ROWS", 9)
    counts = sparse(11)
    _, dist = plain(counts)
    out = near.bray_curtis_within(spark.createDataFrame(counts, COLUMNS).repartition(3), limit)
    by_blocks = "CartesianProduct" in out._jdf.queryExecution().executedPlan().toString()
    assert by_blocks == (meetings == 0)  # many pairs that meet are not written out cell by cell
    got = out.collect()
    want = {(a, b): d for (a, b), d in dist.items() if a < b and d <= limit}
    assert {(r.id_a, r.id_b) for r in got} == set(want) and len(got) == len(want)
    assert all(abs(r.dist - want[r.id_a, r.id_b]) < 1e-12 for r in got)


@pytest.mark.parametrize("k,rows,cells", [(1, 9, 10**6), (5, 9, 10**6), (5, 20, 25), (70, 9, 10**6)])
def test_nearest_samples_over_many_blocks(spark, monkeypatch, k, rows, cells):
    monkeypatch.setattr(near, "ROWS", rows)
    monkeypatch.setattr(distance, "CELLS_PER_TASK", cells)  # the huge sample comes in slices
    counts = sparse(k + 20) + [(f"equal{i:02}", f, 4) for i in range(30) for f in (1, 2, 3)]
    table, dist = plain(counts)
    got = {}
    for r in near.nearest_samples(spark.createDataFrame(counts, COLUMNS).repartition(3), k, 2).orderBy("sample", "rank").collect():
        got.setdefault(r["sample"], []).append(r.neighbour)
    for a in table:
        assert got[a] == sorted((b for b in table if b != a), key=lambda b: (dist[a, b], b))[:k]


def test_a_task_keeps_k_of_many_equal_neighbours():
    best = near._Nearest(3, 2)
    for start in range(0, 40_000, 1000):
        at = np.arange(1000)
        best.add(at % 2, np.full(1000, 0.5), pa.array([f"x{start + 999 - n:05}" for n in at]), at)
    found = best.settle()
    assert found[0].tolist() == [0, 0, 0, 1, 1, 1] and found[2].to_pylist() == ["x00001", "x00003", "x00005", "x00000", "x00002", "x00004"]
    assert len(best.kept[0][0]) == 6
