"""Count outliers in fits against plain numpy, tail probabilities against the math library."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from biotables.functions.normal import erfc, two_sided
from biotables.operators import differential as de
from biotables.operators import outliers


def test_tail_probabilities_as_columns(spark):
    xs = [i / 40 - 6 for i in range(1000)] + [0.46875, 4.0, 26.0]
    frame = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in frame.select("x", erfc(F.col("x")).alias("e"), two_sided(F.col("x")).alias("p")).collect():
        assert r.e == pytest.approx(math.erfc(r.x), rel=1e-12)
        assert r.p == pytest.approx(math.erfc(abs(r.x) / math.sqrt(2)), rel=1e-12)
    odd = spark.createDataFrame([(None,), (float("nan"),)], "x double").select(two_sided(F.col("x")).alias("p")).collect()
    assert odd[0].p is None and math.isnan(odd[1].p)


def test_f_quantiles():
    for share, d1, d2, want in ((0.99, 2, 8, 8.6491), (0.95, 1, 1, 161.4476), (0.99, 5, 45, 3.4544), (0.5, 3, 3, 1.0)):
        assert outliers.f_quantile(share, d1, d2) == pytest.approx(want, rel=1e-4)


def simulated(spark, per_level, seed=1):
    """Counts of 40 features in two levels; features 3 and 7 hold one count far beyond all others."""
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(40):
        base, n = rng.uniform(50, 300), 10
        for s in range(2 * per_level):
            mean = base * (3 if f % 5 == 0 and s < per_level else 1)
            rows.append([f"s{s:02}", f, int(rng.negative_binomial(n, n / (n + mean)))])
    planted = {(f"s{1:02}", 3): 90_000, (f"s{per_level + 2:02}", 7): 60_000}
    rows = [(s, f, planted.get((s, f), c)) for s, f, c in rows]
    counts = spark.createDataFrame(rows, "sample string, feature long, count long")
    samples = spark.createDataFrame([(f"s{s:02}", "A" if s < per_level else "B") for s in range(2 * per_level)], "sample string, level string")
    factors = samples.select("sample", F.lit(1.0).alias("size_factor"))
    return rows, counts, samples, factors


def test_cooks_distances_equal_plain_numpy(spark):
    rows, counts, samples, factors = simulated(spark, 5)
    fit, _ = de.fit_at_dispersion(counts, samples, "level", factors, de.dispersion_moments(counts, factors))
    got = {r.feature: r.max_cooks for r in outliers.cooks_distances(counts, samples, "level", factors, fit, robust=False).collect()}
    for r in fit.collect():
        x = np.array([c for s, f, c in sorted(rows) if f == r.feature], float)
        worst = 0
        for level, span in enumerate((slice(0, 5), slice(5, 10))):
            mu = math.exp(r.beta[level])
            # equal size factors give every sample of a level the same share of its information
            far = (x[span] - mu) ** 2 / (mu + r.dispersion * mu**2) / 2 * 0.2 / 0.8**2
            worst = max(worst, far.max())
        assert got[r.feature] == pytest.approx(worst, rel=1e-9)


def test_planted_outliers_are_flagged_or_replaced(spark):
    _, counts, samples, factors = simulated(spark, 5)
    fit, levels = outliers.fit_without_outliers(counts, samples, "level", factors, trend="local")
    found = {r.feature: r for r in fit.collect()}
    assert {f for f, r in found.items() if r.cooks_outlier} == {3, 7} and len(found) == 40  # five samples a level: nothing is replaced
    tests = {r.feature: r.pvalue for r in outliers.mask_outliers(de.wald_tests(fit, levels), fit).collect()}
    assert {f for f, p in tests.items() if p is None} == {3, 7}

    _, counts, samples, factors = simulated(spark, 8)
    fit, levels = outliers.fit_without_outliers(counts, samples, "level", factors, trend="local")
    found = {r.feature: r for r in fit.collect()}
    assert {f for f, r in found.items() if r.n_replaced} == {3, 7} and not any(r.cooks_outlier for r in found.values())
    plain, _ = de.fit_features(counts, samples, "level", factors, trend="local")
    before = {r.feature: r for r in plain.collect()}
    # the refit is near the level mean of the other samples, the first fit is not
    for f in (3, 7):
        assert found[f].dispersion < before[f].dispersion / 3
    assert all(found[f].beta == pytest.approx(before[f].beta) for f in found if f not in (3, 7))


@pytest.mark.parametrize("neighbours", [2, 4, 9])
def test_smoothed_curve_equals_a_plain_loop(spark, neighbours):
    y = [5.0, 9, 4, 30, 31, 2, 0, 0, 7, 8]
    curve = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(y)] + [("alone", 3, 6.0)], "g string, at int, y double")
    got = {(r.g, r["at"]): r["__smooth"] for r in de.smoothed(curve, ["g"], "at", "y", neighbours).collect()}
    assert got["alone", 3] == 6.0
    for i in range(len(y)):
        far = sorted(abs(j - i) for j in range(len(y)))[neighbours - 1]
        w = np.array([max(0.0, 1 - (abs(j - i) / far) ** 3) ** 3 for j in range(len(y))])
        x = np.arange(len(y)) - i
        det = w.sum() * (w * x * x).sum() - (w * x).sum() ** 2
        want = ((w * x * x).sum() * (w * y).sum() - (w * x).sum() * (w * x * y).sum()) / det if det > 1e-9 else (w * y).sum() / w.sum()
        assert got["g", i] == pytest.approx(want)
