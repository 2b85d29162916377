"""Buckets with borders from the data, and metrics observed on a write."""

import math
import random
import statistics
import uuid

import pytest
from conftest import rows
from pyspark.sql import functions as F

from biotables.operators import borders, observed, totals


def bucket_facts(df, group, value):
    """Largest bucket, and whether bucket ranges of a group overlap."""
    found = df.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).collect()
    overlap = False
    for g in {tuple(r[k] for k in group) for r in found}:
        mine = sorted((r for r in found if tuple(r[k] for k in group) == g), key=lambda r: r["__bucket"])
        overlap |= any(a["hi"] >= b["lo"] for a, b in zip(mine, mine[1:]))
    return max(r["n"] for r in found), overlap, len(found)


def test_a_narrow_range_leaves_no_bucket_above_the_bound(spark):
    df = spark.range(1_000_000).select((F.lit(1000.0) + F.col("id") * F.lit(3e-6)).alias("v"))
    largest, overlap, count = bucket_facts(borders.with_buckets(df, [], "v", rows=10_000), [], "v")
    assert largest <= 10_000 and not overlap and count >= 100


def test_skewed_groups_and_steep_values(spark):
    rng = random.Random(3)
    data = [("hot", math.copysign(10 ** rng.uniform(-200, 200), rng.random() - 0.5)) for _ in range(4000)]
    data += [(None, float(i)) for i in range(700)] + [("few", 1.0), ("few", 2.0)]
    df = spark.createDataFrame(sorted(set(data), key=str), "g string, v double")
    out = borders.with_buckets(df, ["g"], "v", rows=50)
    largest, overlap, _ = bucket_facts(out, ["g"], "v")
    assert largest <= 50 and not overlap
    assert rows(out.select("g", "v")) == rows(df)
    assert out.filter("g = 'few'").select("__bucket").distinct().count() == 1


def test_repeats_special_values_and_an_empty_table(spark):
    special = [None, float("nan"), float("inf"), float("-inf"), 0.0]
    df = spark.createDataFrame([(1.0,)] * 300 + [(2.0 + i,) for i in range(100)] + [(v,) for v in special], "v double")
    out = borders.with_buckets(df, [], "v", rows=20)
    buckets = {(-1 if r["v"] is None else r["v"]): r["__bucket"] for r in out.collect()}
    assert out.count() == 405
    sizes = {r["__bucket"]: (r["n"], r["d"]) for r in out.groupBy("__bucket").agg(F.count("*").alias("n"), F.countDistinct("v").alias("d")).collect()}
    assert all(n <= 20 or d == 1 for n, d in sizes.values())
    assert buckets[float("-inf")] <= buckets[0.0] <= buckets[1.0] < buckets[100.0] <= buckets[float("inf")]
    assert buckets[-1] <= buckets[0.0]
    assert borders.with_buckets(df.limit(0), [], "v").collect() == []


def test_quantiles_over_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(totals, "with_buckets", lambda df, group, value: borders.with_buckets(df, group, value, rows=16))
    rng = random.Random(8)
    data = [(g, 1000 + rng.random() * 3) for g in ("a", None) for _ in range(500)]
    df = spark.createDataFrame(data, "g string, v double")
    for r in totals.exact_quantiles(df, ["g"], "v", {"q1": 0.25, "m": 0.5, "q3": 0.75}).collect():
        q = statistics.quantiles([v for k, v in data if k == r["g"]], n=4, method="inclusive")
        assert [r["q1"], r["m"], r["q3"]] == pytest.approx(q) and r["n"] == 500


def jobs_of(spark, run):
    """Result of ``run`` and the number of Spark jobs it started."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_metrics_come_with_the_one_job_that_writes(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), (None, None), ("b", 0)], "k string, v int")
    (stored, seen), jobs = jobs_of(spark, lambda: observed.store_observed(df, "t", observed.quality_metrics(["k", "v"], ["v"])))
    assert seen == {"n_rows": 4, "null_k": 1, "null_v": 1, "zero_v": 2}
    assert jobs == 1 and rows(stored) == rows(df)


def test_stacked_tables_reconcile_in_one_job(spark):
    a, b = spark.range(7), spark.range(100, 105)
    (stored, seen), jobs = jobs_of(spark, lambda: observed.store_stacked({"left": a, "right": b}, "stack"))
    assert seen == {"n_left": 7, "n_right": 5, "n_merged": 12, "reconciled": True}
    assert jobs == 1 and stored.count() == 12
    _, seen = observed.store_stacked({"left": a.filter("id < 0"), "right": b}, "stack")
    assert seen == {"n_left": 0, "n_right": 5, "n_merged": 5, "reconciled": True}


def test_unique_keys_with_observed_repeats(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 1), (None, 1), (None, 1), ("b", 2)], "k string, v int")
    stored, seen = observed.store_unique(df, ["k", "v"], "keys")
    assert seen == {"n_rows": 6, "n_duplicated": 3, "any_duplicated": True}
    assert rows(stored) == [(None, 1, 3), ("a", 1, 2), ("b", 2, 1)]
    _, seen = observed.store_unique(df.limit(0), ["k"], "keys")
    assert seen == {"n_rows": 0, "n_duplicated": 0, "any_duplicated": False}
