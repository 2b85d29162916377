"""Differential abundance: size factors, negative-binomial fits, contrasts, adjusted p-values.

Counts are long ``(sample, feature, count)``; missing cells are zeros. The fit follows the
published method (Love, Huber, Anders 2014, Genome Biology 15:550) for one-factor
designs. Outlier flags and replacement are in ``outliers``. Left out: fold-change shrinkage.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biotables.functions import ifelse_na
from biotables.functions.normal import two_sided
from biotables.operators.borders import with_buckets
from biotables.operators.joins import key_join
from biotables.operators.reshape import dense_index
from biotables.operators.totals import exact_quantiles, later_minimum, running_total
from biotables.session import materialize, task_count

MIN_DISPERSION = 1e-8
CELLS_PER_BATCH = 200_000
CELLS_PER_TASK = 500_000
# One row of the fit holds a feature's counts over all samples of the design.
MAX_SAMPLES = 2_000_000


# ---------------------------------------------------------------- size factors


def geometric_means(counts: DataFrame, samples: DataFrame) -> DataFrame:
    """``exp(sum(ln x over positive x) / number of samples)`` per feature."""
    n = samples.select("sample").distinct().agg(F.count(F.lit(1))).scalar()
    logs = (
        counts.filter(F.col("count") > 0)
        .groupBy("feature")
        .agg(F.sum(F.log(F.col("count").cast("double"))).alias("s"))
    )
    return logs.select("feature", F.exp(F.col("s") / n).alias("geo_mean"))


def size_factors(counts: DataFrame, geo: DataFrame, rescale: bool = True) -> DataFrame:
    """Median over features of count / geometric mean, positive counts only.

    ``rescale`` divides by the geometric mean of the factors, as the published software
    does when geometric means are handed in.
    """
    ratios = (
        counts.filter(F.col("count") > 0)
        .join(geo, "feature")
        .select("sample", (F.log(F.col("count").cast("double")) - F.log("geo_mean")).alias("r"))
    )
    logs = exact_quantiles(ratios, ["sample"], "r", {"m": 0.5}).select("sample", "m")
    logs = materialize(logs, "size-factors")  # one row per sample, read by every later step
    if rescale:
        logs = logs.select("sample", (F.col("m") - logs.agg(F.avg("m")).scalar()).alias("m"))
    return logs.select("sample", F.exp("m").alias("size_factor"))


def normalized(counts: DataFrame, factors: DataFrame) -> DataFrame:
    return counts.join(factors, "sample").withColumn("norm", F.col("count") / F.col("size_factor"))


def dispersion_moments(counts: DataFrame, factors: DataFrame) -> DataFrame:
    """Moment estimate ``(var - mean * avg(1/s)) / mean^2`` on normalised counts, zeros included."""
    n = factors.agg(F.count(F.lit(1)).cast("double")).scalar()
    inverse = factors.agg(F.avg(1 / F.col("size_factor"))).scalar()
    sums = normalized(counts, factors).groupBy("feature").agg(
        F.sum("norm").alias("s1"), F.sum(F.col("norm") * F.col("norm")).alias("s2")
    )
    mean = F.col("s1") / F.col("n")
    var = (F.col("s2") - F.col("n") * mean * mean) / (F.col("n") - 1)
    return (
        sums.withColumn("n", n)
        .select("feature", mean.alias("base_mean"), var.alias("base_var"), inverse.alias("inv"))
        .select(
            "feature",
            "base_mean",
            "base_var",
            F.greatest(
                (F.col("base_var") - F.col("base_mean") * F.col("inv"))
                / (F.col("base_mean") * F.col("base_mean")),
                F.lit(MIN_DISPERSION),
            ).alias("dispersion"),
        )
    )


# ---------------------------------------------------------------- design


def design_report(samples: DataFrame, factor: str) -> DataFrame:
    """Samples per level of the factor and whether any level is replicated."""
    levels = samples.groupBy(F.col(factor).alias("level")).agg(F.count(F.lit(1)).alias("n_samples"))
    return levels.select(
        "level",
        "n_samples",
        levels.agg(F.count(F.lit(1))).scalar().alias("n_levels"),
        (levels.agg(F.max("n_samples")).scalar() >= 2).alias("replicated"),
    )


def check_design(samples: DataFrame, factor: str, levels: Sequence[str] = ()) -> DataFrame:
    """Return the report; a missing level, one level only, or no replicate raises."""
    report = design_report(samples, factor)
    n_levels, most = report.agg(F.count(F.lit(1)), F.max("n_samples")).first()
    if levels:
        found = {r["level"] for r in report.filter(F.col("level").isin(list(levels))).select("level").collect()}
        absent = [level for level in levels if level not in found]
        if absent:
            raise ValueError(f"levels {absent} do not occur in {factor}")
    if n_levels < 2:
        raise ValueError(f"{factor} needs at least two levels")
    if most < 2:
        raise ValueError(f"no level of {factor} has two samples, nothing can be tested")
    return report


# ---------------------------------------------------------------- numeric helpers


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log-gamma by Stirling's series after shifting the argument up by eight."""
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    z = x + 8.0
    inv = 1.0 / (z * z)
    series = (1 / 12 - inv * (1 / 360 - inv * (1 / 1260 - inv / 1680))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - np.log(shift)


def _trigamma(x: float) -> float:
    total = 0.0
    while x < 8:
        total += 1 / (x * x)
        x += 1
    inv = 1 / (x * x)
    return total + 1 / x + inv / 2 + inv / x * (1 / 6 - inv * (1 / 30 - inv / 42))


class _Design:
    """Sample columns of the model, put in level order so that a level is one slice."""

    def __init__(self, factors: np.ndarray, codes: np.ndarray, levels: list[str]):
        order = np.argsort(codes, kind="stable")
        self.column_of = np.argsort(order)  # sample number -> matrix column
        self.factors, self.codes, self.levels = factors[order], codes[order], levels
        self.sizes = np.bincount(codes, minlength=len(levels))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])

    def level_sums(self, cells: np.ndarray) -> np.ndarray:
        return np.add.reduceat(cells, self.starts, axis=1)

    def group_means(self, counts: np.ndarray) -> np.ndarray:
        return self.level_sums(counts / self.factors) / self.sizes

    def fitted(self, means: np.ndarray) -> np.ndarray:
        return np.maximum(means[:, self.codes] * self.factors, 1e-6)


def _profile(counts: np.ndarray, mu: np.ndarray, log_alpha: np.ndarray, design: _Design) -> np.ndarray:
    """Cox-Reid adjusted log-likelihood of one dispersion per feature."""
    alpha = np.exp(log_alpha)[:, None]
    r = 1.0 / alpha
    mass = np.log1p(alpha * mu)
    ll = counts * (np.log(mu) + np.log(alpha) - mass) - r * mass
    # log-gamma of r is one number a feature, and nothing is picked out where no count is zero
    hit = counts > 0
    log_r = _lgamma(r)
    if hit.all():
        extra = _lgamma(counts + r) - log_r
    else:
        extra = np.zeros_like(counts)
        extra[hit] = _lgamma(counts[hit] + np.broadcast_to(r, counts.shape)[hit]) - np.broadcast_to(log_r, counts.shape)[hit]
    info = design.level_sums(mu / (1.0 + alpha * mu))
    return (ll + extra).sum(axis=1) - 0.5 * np.log(info).sum(axis=1)


def _best_dispersion(
    counts: np.ndarray, mu: np.ndarray, design: _Design, prior: np.ndarray | None = None,
    variance: float = 1.0,
) -> tuple[np.ndarray, np.ndarray]:
    """Maximise over ln(dispersion), and whether the maximum is met to 1e-4.

    A coarse and a finer grid bracket the best value; then the vertex of the parabola through three points
    is taken until it stays. A maximum at the ends of the range counts as met.
    """
    low, high = math.log(MIN_DISPERSION), math.log(max(10.0, counts.shape[1]))

    def value(at: np.ndarray) -> np.ndarray:
        score = _profile(counts, mu, at, design)
        return score if prior is None else score - (at - prior) ** 2 / (2 * variance)

    center = np.full(len(counts), (low + high) / 2)
    half = (high - low) / 2
    for points in (25, 11):
        offsets = np.linspace(-half, half, points)
        scores = np.empty((points, len(counts)))
        for k, offset in enumerate(offsets):
            scores[k] = value(np.clip(center + offset, low, high))
        center = np.clip(center + offsets[scores.argmax(axis=0)], low, high)
        half = half / (points - 1) * 2
    step = np.full(len(counts), half / 2)
    here = value(center)
    converged = np.zeros(len(counts), bool)
    for _ in range(8):
        below, above = value(np.maximum(center - step, low)), value(np.minimum(center + step, high))
        bend = below - 2 * here + above
        move = np.where(bend < 0, 0.5 * step * (below - above) / np.where(bend < 0, bend, -1.0), 0.0)
        new = np.clip(center + np.clip(move, -step, step), low, high)
        reached = value(new)
        # the best of the four points goes on
        options = np.stack([here, below, above, reached])
        places = np.stack([center, np.maximum(center - step, low), np.minimum(center + step, high), new])
        best = options.argmax(axis=0)
        moved = np.abs(np.take_along_axis(places, best[None], 0)[0] - center)
        center, here = np.take_along_axis(places, best[None], 0)[0], options.max(axis=0)
        step = np.maximum(np.minimum(step / 4, 2 * moved + step / 16), 1e-5)
        converged = (moved < 1e-4) & (step < 1e-2)
        if converged.all():
            break
    return np.exp(center), converged | (center <= low) | (center >= high)


def _fit_levels(counts: np.ndarray, alpha: np.ndarray, design: _Design, rounds: int = 100):
    """Newton steps per level on the log mean; returns estimates, informations and whether each row has settled."""
    floor = math.log(1e-8)
    beta = np.log(np.maximum(design.group_means(counts), 1e-8))
    a = alpha[:, None]
    for _ in range(rounds):
        mu = np.exp(beta)[:, design.codes] * design.factors
        weight = 1.0 / (1.0 + a * mu)
        info = design.level_sums(mu * weight)
        step = design.level_sums((counts - mu) * weight) / np.maximum(info, 1e-12)
        new = np.clip(beta + np.clip(step, -3, 3), floor, 60)
        settled = (np.abs(new - beta) < 1e-8).all(axis=1)
        beta = new
        if settled.all():
            break
    mu = np.exp(beta)[:, design.codes] * design.factors
    return beta, design.level_sums(mu / (1.0 + a * mu)), settled


# ---------------------------------------------------------------- feature rows


def _feature_rows(counts: DataFrame, design: DataFrame) -> DataFrame:
    """One row per feature: sample numbers and counts; bounded by the number of samples."""
    cells = counts.join(design.select("sample", "idx"), "sample")
    packed = F.array_sort(F.collect_list(F.struct("idx", F.col("count").cast("double").alias("x"))))
    return (
        cells.groupBy("feature", "idx")
        .agg(F.sum("count").alias("count"))
        .groupBy("feature")
        .agg(packed.alias("cells"))
        .select("feature", F.col("cells.idx").alias("idx"), F.col("cells.x").alias("x"))
    )


def _load_design(samples: DataFrame, factor: str, factors: DataFrame) -> tuple[DataFrame, _Design]:
    """Number the samples and fetch their size factors and levels (one row per sample)."""
    table = samples.select("sample", F.col(factor).alias("level")).join(factors, "sample")
    table = materialize(dense_index(table, ["sample"], "idx"), "design")
    n = table.count()
    if n > MAX_SAMPLES:
        raise ValueError(f"{n} samples in one design; fit subsets of the samples instead")
    rows = table.orderBy("idx").toPandas()
    levels = sorted(rows["level"].unique())
    codes = rows["level"].map({v: i for i, v in enumerate(levels)}).to_numpy()
    return table, _Design(rows["size_factor"].to_numpy(), codes, levels)


def _dense_batches(
    batches: Iterator[pd.DataFrame], design: _Design
) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    n = len(design.codes)
    rows = max(1, CELLS_PER_BATCH // n)
    for pdf in batches:
        for start in range(0, len(pdf), rows):
            part = pdf.iloc[start : start + rows]
            dense = np.zeros((len(part), n))
            for i, (idx, x) in enumerate(zip(part["idx"], part["x"])):
                dense[i, design.column_of[np.asarray(idx, dtype=int)]] = x
            yield part, dense


# ---------------------------------------------------------------- dispersion


def _gene_dispersion(design: _Design):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, counts in _dense_batches(batches, design):
            mu = design.fitted(design.group_means(counts))
            dispersion, converged = _best_dispersion(counts, mu, design)
            yield pd.DataFrame(
                {
                    "feature": part["feature"].to_numpy(),
                    "base_mean": (counts / design.factors).mean(axis=1),
                    "disp_gene": dispersion,
                    "gene_converged": converged,
                }
            )

    return run


def parametric_trend(genes: DataFrame, rounds: int = 50) -> tuple[float, float] | None:
    """Coefficients of ``a1 / mean + a0`` by gamma regression on aggregated sums.

    None when the regression leaves the positive range or does not settle (the caller falls back to the
    local trend, as the published software does).
    """
    usable = genes.filter((F.col("disp_gene") > 100 * MIN_DISPERSION) & (F.col("base_mean") > 0))
    a0, a1 = 0.1, 1.0
    for _ in range(rounds):
        fit = F.lit(a1) / F.col("base_mean") + F.lit(a0)
        ratio = F.col("disp_gene") / fit
        x, w = 1 / F.col("base_mean"), 1 / (fit * fit)
        row = (
            usable.filter((ratio > 1e-4) & (ratio < 15))
            .agg(
                F.sum(w).alias("w"),
                F.sum(w * x).alias("wx"),
                F.sum(w * x * x).alias("wxx"),
                F.sum(w * F.col("disp_gene")).alias("wy"),
                F.sum(w * x * F.col("disp_gene")).alias("wxy"),
            )
            .first()
        )
        if row["w"] is None:
            return None
        det = row["w"] * row["wxx"] - row["wx"] ** 2
        if det <= 0:
            return None
        new1 = (row["w"] * row["wxy"] - row["wx"] * row["wy"]) / det
        new0 = (row["wxx"] * row["wy"] - row["wx"] * row["wxy"]) / det
        if new0 <= 0 or new1 <= 0:
            return None
        change = math.log(new0 / a0) ** 2 + math.log(new1 / a1) ** 2
        a0, a1 = new0, new1
        if change < 1e-6:
            return a0, a1
    return None


def local_trend(genes: DataFrame, points: int = 40, share: float = 0.7) -> tuple[list, list]:
    """Tricube-weighted line of ln(dispersion) on ln(mean) at a fixed grid of means.

    Each grid point uses the nearest ``share`` of the features. The features are summed
    per grid point; only the grid reaches the driver.
    """
    usable = genes.filter((F.col("disp_gene") >= 10 * MIN_DISPERSION) & (F.col("base_mean") > 0))
    xy = usable.select(F.log("base_mean").alias("x"), F.log("disp_gene").alias("y"))
    ends = xy.agg(F.min("x"), F.max("x")).first()
    if ends[0] is None:
        raise ValueError("no feature has a usable dispersion")
    grid = np.unique(np.linspace(ends[0], ends[1], points)).tolist()
    at = xy.withColumn("g", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    at = at.withColumn("gap", F.abs(F.col("x") - F.col("g")))
    reach = exact_quantiles(at, ["g"], "gap", {"h": share}).select("g", "h").collect()
    width = F.create_map(*[F.lit(float(v)) for r in reach for v in (r["g"], max(r["h"], 1e-6))])
    rel = F.col("gap") / F.try_element_at(width, F.col("g"))
    weight = F.when(rel < 1, F.pow(1 - F.pow(rel, 3), 3)).otherwise(0.0)
    dx = F.col("x") - F.col("g")
    rows = (
        at.withColumn("w", weight)
        .withColumn("dx", dx)
        .groupBy("g")
        .agg(
            F.sum("w").alias("w"),
            F.sum(F.col("w") * F.col("dx")).alias("wx"),
            F.sum(F.col("w") * F.col("dx") * F.col("dx")).alias("wxx"),
            F.sum(F.col("w") * F.col("y")).alias("wy"),
            F.sum(F.col("w") * F.col("dx") * F.col("y")).alias("wxy"),
        )
        .orderBy("g")
        .collect()
    )
    means, values = [], []
    for r in rows:
        if not r["w"]:
            continue
        det = r["w"] * r["wxx"] - r["wx"] ** 2
        level = r["wy"] / r["w"] if det <= 1e-12 else (r["wxx"] * r["wy"] - r["wx"] * r["wxy"]) / det
        means.append(r["g"])
        values.append(level)
    return means, values


class _Trend:
    def __init__(self, parametric=None, local=None):
        self.parametric, self.local = parametric, local

    def log_value(self, mean: np.ndarray) -> np.ndarray:
        if self.parametric:
            return np.log(self.parametric[1] / mean + self.parametric[0])
        return np.interp(np.log(mean), self.local[0], self.local[1])

    def column(self, mean: Column) -> Column:
        """The same trend as a column expression."""
        if self.parametric:
            return F.log(F.lit(self.parametric[1]) / mean + F.lit(self.parametric[0]))
        xs, ys = (np.asarray(v, dtype=float) for v in self.local)
        slopes = np.append(np.diff(ys) / np.diff(xs), 0.0)
        x = F.greatest(F.log(mean), F.lit(float(xs[0])))
        grid, heights, rises = (F.array(*[F.lit(float(v)) for v in arr]) for arr in (xs, ys, slopes))
        below = F.size(F.filter(grid, lambda g: g <= x)) - 1
        return F.get(heights, below) + (x - F.get(grid, below)) * F.get(rises, below)


def _shrinkage(genes: DataFrame, trend: _Trend, n_samples: int, n_levels: int) -> tuple[float, float]:
    """Prior variance of ln(dispersion) around the trend, and the robust spread."""
    gap = genes.filter(F.col("disp_gene") >= 100 * MIN_DISPERSION).select(
        (F.log("disp_gene") - trend.column(F.col("base_mean"))).alias("gap")
    )
    middle = exact_quantiles(gap, [], "gap", {"m": 0.5}).first()
    if middle is None:
        return 0.25, 0.0
    away = gap.select(F.abs(F.col("gap") - F.lit(middle["m"])).alias("a"))
    spread = 1.4826 * exact_quantiles(away, [], "a", {"m": 0.5}).first()["m"]
    freedom = n_samples - n_levels
    noise = _trigamma(freedom / 2) if freedom > 0 else 0.0
    return max(spread**2 - noise, 0.25), spread


class _Model:
    """What a fit of other features needs: design, trend, prior width and spread around the trend."""

    def __init__(self, table: DataFrame, design: _Design, curve: _Trend, variance: float, spread: float):
        self.table, self.design, self.curve, self.variance, self.spread = table, design, curve, variance, spread


def _stored_rows(counts: DataFrame, table: DataFrame, design: _Design) -> DataFrame:
    n_features = counts.select("feature").distinct().count()
    tasks = task_count(counts.sparkSession, -(-n_features * len(design.codes) // CELLS_PER_TASK))
    return materialize(_feature_rows(counts, table).repartition(tasks, "feature"), "feature-rows")


def _gene_table(rows: DataFrame, design: _Design) -> DataFrame:
    feature = rows.schema["feature"].dataType.simpleString()
    schema = f"feature {feature}, base_mean double, disp_gene double, gene_converged boolean"
    return materialize(rows.mapInPandas(_gene_dispersion(design), schema), "gene-dispersion")


def _final_fit(rows: DataFrame, genes: DataFrame, model: _Model) -> DataFrame:
    feature = rows.schema["feature"].dataType.simpleString()
    design, curve, variance, spread = model.design, model.curve, model.variance, model.spread

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, cells in _dense_batches(batches, design):
            means = design.group_means(cells)
            mu = design.fitted(means)
            base = part["base_mean"].to_numpy()
            gene = part["disp_gene"].to_numpy()
            prior = curve.log_value(base)
            alpha, found = _best_dispersion(cells, mu, design, prior, variance)
            outlier = np.log(gene) > prior + 2 * spread
            alpha = np.where(outlier, gene, alpha)
            beta, info, settled = _fit_levels(cells, alpha, design)
            # an outlier keeps the gene's own estimate
            found = np.where(outlier, part["gene_converged"].to_numpy(dtype=bool), found)
            yield pd.DataFrame(
                {
                    "feature": part["feature"].to_numpy(),
                    "base_mean": base,
                    "disp_gene": gene,
                    "disp_trend": np.exp(prior),
                    "dispersion": alpha,
                    "outlier": outlier,
                    "beta": list(beta),
                    "info": list(info),
                    "all_zero": list(means <= 0),
                    "converged": found & settled,
                }
            )

    fitted = rows.join(genes, "feature").mapInPandas(
        final,
        f"feature {feature}, base_mean double, disp_gene double, disp_trend double, "
        "dispersion double, outlier boolean, beta array<double>, info array<double>, "
        "all_zero array<boolean>, converged boolean",
    )
    return materialize(fitted, "fit")


def fit_model(
    counts: DataFrame,
    samples: DataFrame,
    factor: str,
    factors: DataFrame,
    trend: str = "parametric",
) -> tuple[DataFrame, list[str], _Model]:
    """:func:`fit_features` with the model, for :func:`refit`."""
    check_design(samples, factor)
    table, design = _load_design(samples, factor, factors)
    rows = _stored_rows(counts, table, design)
    genes = _gene_table(rows, design)
    coefficients = parametric_trend(genes) if trend == "parametric" else None
    curve = _Trend(parametric=coefficients) if coefficients else _Trend(local=local_trend(genes))
    variance, spread = _shrinkage(genes, curve, len(design.codes), len(design.levels))
    model = _Model(table, design, curve, variance, spread)
    return _final_fit(rows, genes, model), design.levels, model


def refit(counts: DataFrame, model: _Model) -> DataFrame:
    """Fit some features with the trend and prior of an earlier fit."""
    rows = _stored_rows(counts, model.table, model.design)
    return _final_fit(rows, _gene_table(rows, model.design), model)


def fit_features(
    counts: DataFrame,
    samples: DataFrame,
    factor: str,
    factors: DataFrame,
    trend: str = "parametric",
) -> tuple[DataFrame, list[str]]:
    """Dispersions, level means (natural log) and informations, one row per feature.

    Returns the table and the level names in the order of the array columns.
    """
    fit, levels, _ = fit_model(counts, samples, factor, factors, trend)
    return fit, levels


def fit_at_dispersion(
    counts: DataFrame, samples: DataFrame, factor: str, factors: DataFrame, dispersions: DataFrame
) -> tuple[DataFrame, list[str]]:
    """Level means and informations at given dispersions (``feature, base_mean, dispersion``), for :func:`wald_tests`."""
    check_design(samples, factor)
    table, design = _load_design(samples, factor, factors)
    rows = _feature_rows(counts, table).join(dispersions.select("feature", "base_mean", "dispersion"), "feature")
    feature = counts.schema["feature"].dataType.simpleString()

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, cells in _dense_batches(batches, design):
            beta, info, settled = _fit_levels(cells, part["dispersion"].to_numpy(), design)
            yield pd.DataFrame(
                {
                    "feature": part["feature"].to_numpy(),
                    "base_mean": part["base_mean"].to_numpy(),
                    "dispersion": part["dispersion"].to_numpy(),
                    "beta": list(beta),
                    "info": list(info),
                    "all_zero": list(design.group_means(cells) <= 0),
                    "converged": settled,
                }
            )

    schema = (
        f"feature {feature}, base_mean double, dispersion double, beta array<double>, info array<double>, "
        "all_zero array<boolean>, converged boolean"
    )
    return materialize(rows.mapInPandas(fit, schema), "fit"), design.levels


def contrast_names(levels: Sequence[str]) -> list[tuple[str, str]]:
    """Every available pair of levels as (numerator, denominator)."""
    return [(b, a) for a, b in combinations(levels, 2)]


def wald_tests(
    fit: DataFrame, levels: Sequence[str], contrasts: Sequence[tuple[str, str]] | None = None
) -> DataFrame:
    """Log2 fold change, standard error, statistic and p-value per feature and contrast.

    One fit serves every contrast. A feature that is zero in both levels has no test;
    ``one_sided_zero`` marks a level without any count, whose estimate is bounded.
    """
    pairs = list(contrasts) if contrasts is not None else contrast_names(levels)
    for level in {x for pair in pairs for x in pair}:
        if level not in levels:
            raise ValueError(f"level {level} does not occur in the design")
    at = {level: i for i, level in enumerate(levels)}
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f"{num}_vs_{den}").alias("comparison"),
                    F.col("beta")[at[num]].alias("b1"),
                    F.col("beta")[at[den]].alias("b0"),
                    F.col("info")[at[num]].alias("i1"),
                    F.col("info")[at[den]].alias("i0"),
                    F.col("all_zero")[at[num]].alias("z1"),
                    F.col("all_zero")[at[den]].alias("z0"),
                )
                for num, den in pairs
            ]
        )
    ).alias("c")
    ln2 = math.log(2)
    empty = F.col("c.z1") & F.col("c.z0")
    lfc = F.when(~empty, (F.col("c.b1") - F.col("c.b0")) / ln2)
    se = F.when(~empty, F.sqrt(1 / F.col("c.i1") + 1 / F.col("c.i0")) / ln2)
    tests = fit.select("feature", "base_mean", "dispersion", cells).select(
        "feature",
        "base_mean",
        "dispersion",
        F.col("c.comparison").alias("comparison"),
        lfc.alias("log2_fold_change"),
        se.alias("lfc_se"),
        (lfc / se).alias("stat"),
        ((F.col("c.z1") != F.col("c.z0"))).alias("one_sided_zero"),
    )
    return tests.withColumn("pvalue", two_sided(F.col("stat")))


# ---------------------------------------------------------------- p-values and labels


def bh_adjust(df: DataFrame, group: Sequence[str], p: str = "pvalue", name: str = "padj") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values per group; NULL stays NULL.

    Works on counts of distinct p-values, so ties share one row, and on running totals
    per bucket of p, so one huge comparison is spread over many tasks.
    """
    group = list(group)
    spread = df.filter(F.col(p).isNotNull()).groupBy(*group, p).agg(F.count(F.lit(1)).alias("__n"))
    spread = with_buckets(spread, group, p)
    ranked = running_total(spread, group, "__bucket", [p], "__n", "__rank", total="__m")
    ranked = ranked.withColumn(
        "__q", F.least(F.lit(1.0), F.col(p) * F.col("__m") / F.col("__rank"))
    )
    adjusted = later_minimum(ranked, group, "__bucket", p, "__q", name).select(*group, p, name)
    # NULL p-values join the NULL key of no row and keep a NULL.
    return key_join(df, adjusted, [*group, p], "left")


def smoothed(curve: DataFrame, group: Sequence[str], at: str, y: str, neighbours: int) -> DataFrame:
    """Adds ``__smooth``: a weighted line through the ``neighbours`` nearest points, read at the point, for curves of a few points.

    Weights are tricube; the farthest neighbour has none. Points that stand alone keep their value.
    """
    group = list(group)
    other = curve.select(*group, F.col(at).alias("__j"), F.col(y).cast("double").alias("__y"))
    pairs = curve.select(*group, F.col(at).alias("__i")).join(other, group)
    x = (F.col("__j") - F.col("__i")).cast("double")
    near = Window.partitionBy(*group, "__i")
    ranked = pairs.withColumn("__d", F.abs(x)).withColumn("__rank", F.row_number().over(near.orderBy("__d", "__j")))
    reach = F.max(F.when(F.col("__rank") <= neighbours, F.col("__d"))).over(near)
    r = F.col("__d") / F.nullif("__reach", F.lit(0.0))
    weight = F.when(F.coalesce(r, F.lit(0.0)) < 1, F.pow(1 - F.pow(F.coalesce(r, F.lit(0.0)), F.lit(3.0)), F.lit(3.0))).otherwise(0.0)
    sums = ranked.withColumn("__reach", reach).withColumn("__w", weight).groupBy(*group, "__i").agg(
        *[F.sum(F.col("__w") * term).alias(n) for n, term in (
            ("__s", F.lit(1.0)), ("__sx", x), ("__sxx", x * x), ("__sy", F.col("__y")), ("__sxy", x * F.col("__y"))
        )]
    )
    det = F.col("__s") * F.col("__sxx") - F.col("__sx") * F.col("__sx")
    line = (F.col("__sxx") * F.col("__sy") - F.col("__sx") * F.col("__sxy")) / det
    fitted = F.when(det > 1e-9, line).otherwise(F.col("__sy") / F.col("__s"))
    return curve.join(sums.select(*group, F.col("__i").alias(at), fitted.alias("__smooth")), [*group, at])


def _smooth_cutoff(found: DataFrame, group: list[str], steps: int, span: float, few: int) -> DataFrame:
    found = materialize(found, "rejections")  # a few rows for each group, read several times
    curve = smoothed(found, group, "__step_no", "__hits", max(2, int(span * steps + 1e-9)))
    gap = F.when(F.col("__hits") > 0, F.pow(F.col("__hits") - F.col("__smooth"), F.lit(2.0)))
    level = curve.groupBy(*group).agg(
        (F.max("__smooth") - F.sqrt(F.coalesce(F.avg(gap), F.lit(0.0)))).alias("__level"), F.max("__hits").alias("__most"),
        F.min_by("__cut", "__step_no").alias("__lowest"),
    )
    over = curve.join(level, group).filter((F.col("__most") > few) & (F.col("__hits") > F.col("__level")))
    first = over.groupBy(*group).agg(F.min_by("__cut", "__step_no").alias("__first"))
    return level.join(first, group, "left").select(*group, F.coalesce("__first", "__lowest").alias("base_mean_cutoff"))


def bh_adjust_filtered(
    df: DataFrame, group: Sequence[str], base_mean: str = "base_mean", p: str = "pvalue", alpha: float = 0.1, steps: int = 20, name: str = "padj",
    smooth: bool = False, span: float = 0.2, few: int = 10,
) -> DataFrame:
    """Adjusted p-values after independent filtering on the base mean, per group.

    The cutoffs tried are the quantiles 0, 1/steps, 2/steps, ... of the base mean; the one with the most adjusted p-values
    below ``alpha`` is taken, the lowest of several. With ``smooth`` the curve of rejections is smoothed first (:func:`smoothed`) and
    the lowest cutoff is taken whose rejections exceed the top of the smooth curve less its residual spread; a curve of
    at most ``few`` rejections keeps the lowest cutoff. Rows below the cutoff get NULL. Every row is
    counted once per cutoff it passes, so the work is ``steps`` times that of one adjustment.
    """
    group = list(group)
    shares = {f"__c{i}": i / steps for i in range(steps)}
    wide = exact_quantiles(df, group, base_mean, shares)
    cuts = wide.select(*group, F.posexplode(F.array(*shares)).alias("__step_no", "__cut"))
    tried = (
        df.filter(F.col(p).isNotNull())
        .groupBy(*group, p, base_mean).agg(F.count(F.lit(1)).alias("__n"))
        .join(cuts, group).filter(F.col(base_mean) >= F.col("__cut"))
        .groupBy(*group, "__step_no", "__cut", p).agg(F.sum("__n").alias("__n"))
    )
    tried = with_buckets(tried, [*group, "__step_no", "__cut"], p)
    ranked = running_total(tried, [*group, "__step_no", "__cut"], "__bucket", [p], "__n", "__rank", total="__m")
    found = ranked.groupBy(*group, "__step_no", "__cut").agg(
        F.max(F.when(F.col(p) * F.col("__m") / F.col("__rank") < alpha, F.col("__rank")).otherwise(0)).alias("__hits")
    )
    if smooth:
        best = _smooth_cutoff(found, group, steps, span, few)
    else:
        best = found.groupBy(*group).agg(F.max_by("__cut", F.struct("__hits", -F.col("__step_no"))).alias("base_mean_cutoff"))
    kept = df.join(best, group, "left").withColumn("__p", F.when(F.col(base_mean) >= F.col("base_mean_cutoff"), F.col(p)))
    return bh_adjust(kept, group, "__p", name).drop("__p")


def significant_only(df: DataFrame, alpha: float = 0.01, padj: str = "padj") -> DataFrame:
    return df.filter(F.col(padj) < alpha)


def volcano_label(
    df: DataFrame, lfc: str, padj: str, product: str, min_lfc: float = 2.0, alpha: float = 0.01
) -> DataFrame:
    """Enriched or Not_Enriched, the product of enriched rows, and the plotted height."""
    hit = (F.abs(F.col(lfc)) > min_lfc) & (F.col(padj) < alpha)
    threshold = ifelse_na(hit, F.lit("Enriched"), F.lit("Not_Enriched"))
    return (
        df.withColumn("threshold", threshold)
        .withColumn(
            "shown_product",
            ifelse_na(F.col("threshold") == "Enriched", F.col(product), F.lit("Not_Enriched")),
        )
        .withColumn("neg_log10_padj", -F.log10(padj))
    )


def contrast_threshold(
    df: DataFrame, lfc: str, padj: str, min_lfc: float = 1.5, alpha: float = 0.05
) -> DataFrame:
    """Label rows with ``padj <= alpha`` and ``|lfc| >= min_lfc``."""
    hit = (F.col(padj) <= alpha) & (F.abs(F.col(lfc)) >= min_lfc)
    return df.withColumn("threshold", ifelse_na(hit, F.lit("Enriched"), F.lit("Not_Enriched")))


def log2_ratio_pairs(counts: DataFrame, samples: DataFrame, factor: str, factors: DataFrame,
                     levels: Sequence[str]) -> DataFrame:
    """Log2 ratio of the mean normalised count between every pair of levels, per feature.

    One aggregation computes all level sums, zero cells included through the sample counts. Every feature has a
    row for every pair: a level without counts gives an infinite ratio and ``one_sided_zero``, two such
    levels give NULL.
    """
    scaled = normalized(counts, factors).join(
        samples.select("sample", F.col(factor).alias("level")), "sample"
    )
    sizes = samples.groupBy(F.col(factor).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    sums = scaled.groupBy("feature").agg(
        *[
            F.sum(F.when(F.col("level") == level, F.col("norm"))).alias(f"s{i}")
            for i, level in enumerate(levels)
        ]
    )
    n_of = [sizes.filter(F.col("level") == level).select("n").scalar() for level in levels]
    means = sums.select("feature", *[(F.col(f"s{i}") / n).alias(f"m{i}") for i, n in enumerate(n_of)])
    rows = [
        F.struct(
            F.lit(f"{levels[b]}_vs_{levels[a]}").alias("comparison"),
            F.coalesce(F.col(f"m{b}"), F.lit(0.0)).alias("num"),
            F.coalesce(F.col(f"m{a}"), F.lit(0.0)).alias("den"),
        )
        for a, b in combinations(range(len(levels)), 2)
    ]
    ratio = (
        F.when((F.col("num") == 0) & (F.col("den") == 0), F.lit(None))
        .when(F.col("num") == 0, F.lit(float("-inf")))
        .when(F.col("den") == 0, F.lit(float("inf")))
        .otherwise(F.log2(F.col("num")) - F.log2(F.col("den")))
    )
    return means.select("feature", F.inline(F.array(*rows))).select(
        "feature", "comparison", ratio.alias("log2_ratio"), ((F.col("num") == 0) != (F.col("den") == 0)).alias("one_sided_zero")
    )
