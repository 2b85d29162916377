"""The numbers behind the figures: bins, bars, boxes, densities, tiles, log totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotables.operators.joins import key_join
from biotables.operators.reshape import pivot_longer
from biotables.operators.totals import exact_quantiles


def histogram_facet(
    df: DataFrame, facet: str, measures: Sequence[str], bins: int = 30
) -> DataFrame:
    """Counts in equal-width bins from the smallest to the largest value of a measure.

    Bins are shared by the facets; the last bin is closed; only filled bins come out.
    """
    long = pivot_longer(df.select(facet, *measures), measures, "measure", "value", [facet])
    long = long.filter(F.col("value").isNotNull())
    ends = long.groupBy("measure").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    raw = F.floor((F.col("value") - F.col("lo")) / F.nullif(width, F.lit(0.0)))
    number = F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1)).cast("int")
    # one row per measure name, a fixed list
    return (
        long.join(F.broadcast(ends), "measure")
        .groupBy("measure", facet, number.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def bar_count(df: DataFrame, category: str, facet: str, levels: Sequence[str]) -> DataFrame:
    """Rows per level and facet; a level without rows is kept with zero."""
    counted = df.groupBy(facet, category).agg(F.count(F.lit(1)).alias("n"))
    listed = F.array(
        *[F.struct(F.lit(v).alias(category), F.lit(i + 1).alias("level")) for i, v in enumerate(levels)]
    )
    grid = df.select(facet).distinct().select(facet, F.inline(listed))
    return key_join(grid, counted, [facet, category], "left").withColumn(
        "n", F.coalesce(F.col("n"), F.lit(0))
    )


def limit_levels(df: DataFrame, category: str, levels: Sequence[str]) -> DataFrame:
    """Keep the rows of the listed levels and add their position."""
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(category))
    return df.filter(F.col(category).isin(list(levels))).withColumn("level", position.cast("int"))


def box_summary(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers at the last value within 1.5 box lengths, and outlier count."""
    box = exact_quantiles(df, group, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    return (
        key_join(df.select(*group, value).filter(v.isNotNull()), box, group)
        .groupBy(*group, "n", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, v)).alias("whisker_low"),
            F.max(F.when(inside, v)).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def violin_density(df: DataFrame, group: Sequence[str], value: str, points: int = 32) -> DataFrame:
    """Gaussian kernel density of each group on a grid from its smallest to its largest value.

    Bandwidth ``0.9 * min(sd, IQR / 1.34) * n^(-1/5)``. Repeated values are counted once
    with a weight before they meet the grid.
    """
    values = df.select(*group, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    moments = values.groupBy(*group).agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_samp("v").alias("sd")
    )
    box = exact_quantiles(values, group, "v", {"q1": 0.25, "q3": 0.75})
    iqr = (F.col("q3") - F.col("q1")) / 1.34
    spread = F.when(iqr > 0, F.least(F.col("sd"), iqr)).otherwise(F.col("sd"))
    scale = key_join(moments, box, group).select(
        *group, "lo", "hi", "n", (0.9 * spread * F.pow(F.col("n").cast("double"), -0.2)).alias("bw")
    )
    weighted = values.groupBy(*group, "v").agg(F.count(F.lit(1)).alias("w"))
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    z = (F.col("x") - F.col("v")) / F.col("bw")
    return (
        key_join(weighted, scale.filter(F.col("bw") > 0), group)
        .select("*", grid)
        .withColumn("x", F.col("lo") + step * F.col("point"))
        .groupBy(*group, "point", "x", "n", "bw")
        .agg(F.sum(F.col("w") * F.exp(-0.5 * z * z)).alias("k"))
        .select(
            *group,
            "point",
            "x",
            (F.col("k") / (F.col("n") * F.col("bw") * F.sqrt(2 * F.pi()))).alias("density"),
        )
    )


def tile_matrix(df: DataFrame, x: str, y: str, facets: Sequence[str], fill: str) -> DataFrame:
    """One fill value per tile: the largest, with the number of rows that fell on the tile."""
    return df.groupBy(x, y, *facets).agg(
        F.max(fill).alias("fill"), F.count(F.lit(1)).alias("n_rows")
    )


def log_totals(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Group totals on a log10 axis; groups at zero have no place on it."""
    return (
        df.groupBy(*group)
        .agg(F.sum(value).alias("total"))
        .filter(F.col("total") > 0)
        .withColumn("log10_total", F.log10(F.col("total").cast("double")))
    )
