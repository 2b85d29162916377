"""Count outliers in negative-binomial fits: Cook's distances, flags, replacement and one refit.

After Love, Huber and Anders (2014). The distance of a cell is its squared Pearson residual over the number of levels,
times ``h / (1 - h)^2`` of its leverage ``h``; in a one-factor design the leverage is the cell's share of its level's information.
The variance in the residual uses a robust dispersion (trimmed variances within levels), so that
an outlier does not hide itself. A cell is an outlier beyond the 0.99 quantile of the F distribution with (levels, samples - levels) degrees
of freedom, if its level has at least three samples.

In levels with at least ``replace_from`` samples an outlier gets the trimmed mean of the feature's normalised counts times
the sample's size factor, and the feature is fitted once more with the trend and prior of the first fit. Features whose outliers
cannot be replaced are flagged, and their p-values become NULL.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotables.operators import differential as de
from biotables.session import materialize

QUANTILE = 0.99
LEAST_SAMPLES = 3
REPLACE_FROM = 7
TRIM = 0.2
LEAST_ROBUST = 0.04

# Share trimmed from each side and correction of the variance for levels of at most 3, at most 23 and more samples.
TRIM_SHARES = [1 / 3, 1 / 4, 1 / 8]
TRIM_SCALES = [2.04, 1.86, 1.51]


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), (c if abs(c) > tiny else tiny)
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def f_quantile(share: float, d1: float, d2: float) -> float:
    """Quantile of the F distribution, by bisection on the beta scale."""
    low, high = 0.0, 1.0
    for _ in range(200):
        middle = (low + high) / 2
        if incomplete_beta(d1 / 2, d2 / 2, middle) < share:
            low = middle
        else:
            high = middle
    return d2 * low / (d1 * (1 - low)) if low < 1 else math.inf


def trimmed_mean(x: np.ndarray, share: float) -> np.ndarray:
    """Mean of each row without ``share`` of the values at each end."""
    cut = int(share * x.shape[1])
    return np.sort(x, axis=1)[:, cut : x.shape[1] - cut].mean(axis=1)


def robust_dispersion(counts: np.ndarray, design: de._Design) -> np.ndarray:
    """Moment dispersion from the largest trimmed variance of a level; levels of two samples take part in no variance of their own."""
    norm = counts / design.factors
    spans = [slice(a, a + n) for a, n in zip(design.starts, design.sizes) if n >= LEAST_SAMPLES] or [slice(0, norm.shape[1])]
    worst = np.zeros(len(norm))
    for span in spans:
        x = norm[:, span]
        kind = int(np.searchsorted([3.5, 23.5], x.shape[1]))
        gap = (x - trimmed_mean(x, TRIM_SHARES[kind])[:, None]) ** 2
        worst = np.maximum(worst, TRIM_SCALES[kind] * trimmed_mean(gap, TRIM_SHARES[kind]))
    mean = np.maximum(norm.mean(axis=1), 1e-300)
    return np.maximum((worst - mean) / mean**2, LEAST_ROBUST)


def cooks(counts: np.ndarray, beta: np.ndarray, alpha: np.ndarray, spread: np.ndarray, design: de._Design) -> np.ndarray:
    """Distance of every cell at fitted level means and dispersions; ``spread`` is the dispersion in the residual's variance."""
    mu = np.exp(beta)[:, design.codes] * design.factors
    weight = mu / (1 + alpha[:, None] * mu)
    leverage = weight / design.level_sums(weight)[:, design.codes]
    residual = (counts - mu) ** 2 / (mu + spread[:, None] * mu**2)
    room = 1 - leverage
    # a level of one sample fits it exactly
    return np.where(room > 1e-12, residual / len(design.levels) * leverage / np.where(room > 1e-12, room, 1) ** 2, 0.0)


def cooks_distances(
    counts: DataFrame, samples: DataFrame, factor: str, factors: DataFrame, fit: DataFrame, robust: bool = True,
    quantile: float = QUANTILE, replace_from: int = REPLACE_FROM,
) -> DataFrame:
    """``feature, max_cooks, outlier, replaced`` for the features of ``fit``.

    ``outlier``: a cell beyond the cutoff that will not be replaced; ``replaced``: sample and new count of the others.
    """
    table, design = de._load_design(samples, factor, factors)
    n, levels = len(design.codes), len(design.levels)
    cutoff = f_quantile(quantile, levels, n - levels) if n > levels else math.inf
    counted, replaceable = (design.sizes[design.codes] >= least for least in (LEAST_SAMPLES, replace_from))
    number_of = np.argsort(design.column_of)  # matrix column -> sample number

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, cells in de._dense_batches(batches, design):
            alpha = part["dispersion"].to_numpy(dtype=float)
            beta = np.stack(part["beta"].to_numpy())
            far = cooks(cells, beta, alpha, robust_dispersion(cells, design) if robust else alpha, design)
            out = (far > cutoff) & counted
            new = np.floor(trimmed_mean(cells / design.factors, TRIM)[:, None] * design.factors)
            taken = out & replaceable
            yield pd.DataFrame(
                {
                    "feature": part["feature"].to_numpy(), "max_cooks": far.max(axis=1), "outlier": (out & ~replaceable).any(axis=1),
                    "replaced": [[{"idx": int(number_of[j]), "count": int(new[i, j])} for j in np.flatnonzero(taken[i])] for i in range(len(cells))],
                }
            )

    feature = counts.schema["feature"].dataType.simpleString()
    rows = de._feature_rows(counts, table).join(fit.select("feature", "dispersion", "beta"), "feature")
    found = rows.mapInPandas(run, f"feature {feature}, max_cooks double, outlier boolean, replaced array<struct<idx:bigint,count:bigint>>")
    named = found.select("feature", F.explode("replaced").alias("r")).select("feature", F.col("r.idx").alias("idx"), F.col("r.count").alias("count"))
    named = named.join(table.select("idx", "sample"), "idx").groupBy("feature").agg(F.collect_list(F.struct("sample", "count")).alias("replaced"))
    return found.drop("replaced").join(named, "feature", "left")


def fit_without_outliers(
    counts: DataFrame, samples: DataFrame, factor: str, factors: DataFrame, trend: str = "parametric",
    quantile: float = QUANTILE, replace_from: int = REPLACE_FROM,
) -> tuple[DataFrame, list[str]]:
    """:func:`differential.fit_features`, then outliers replaced and their features fitted again; adds ``max_cooks, cooks_outlier, n_replaced``."""
    fit, levels, model = de.fit_model(counts, samples, factor, factors, trend)
    found = materialize(cooks_distances(counts, samples, factor, factors, fit, True, quantile, replace_from), "cooks")
    touched = found.filter(F.col("replaced").isNotNull())
    notes = found.select("feature", "max_cooks", F.col("outlier").alias("cooks_outlier"), F.coalesce(F.size("replaced"), F.lit(0)).alias("n_replaced"))
    notes = notes.withColumn("n_replaced", F.greatest("n_replaced", F.lit(0)))
    new = touched.select("feature", F.inline("replaced")).withColumnRenamed("count", "new")
    mended = counts.join(touched.select("feature"), "feature", "left_semi").join(new, ["feature", "sample"], "full")
    mended = mended.select("sample", "feature", F.coalesce("new", "count").alias("count"))
    again = de.refit(mended, model)
    kept = fit.join(touched.select("feature"), "feature", "left_anti")
    return materialize(kept.unionByName(again).join(notes, "feature"), "fit-without-outliers"), levels


def mask_outliers(tests: DataFrame, fit: DataFrame) -> DataFrame:
    """P-values of flagged features become NULL."""
    flags = fit.select("feature", "cooks_outlier")
    return tests.join(flags, "feature", "left").withColumn("pvalue", F.when(~F.coalesce("cooks_outlier", F.lit(False)), F.col("pvalue")))
