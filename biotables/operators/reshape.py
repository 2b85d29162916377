"""Wide and long tables, keys, and the full sample x feature grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from biotables.operators.joins import key_join
from biotables.operators.observed import store_observed

#: most cells of a dense sample x feature table, unless the caller names another bound
MAX_CELLS = 10**12


def pivot_longer(
    df: DataFrame, cols: Sequence[str], names_to: str, values_to: str, ids: Sequence[str] | None = None
) -> DataFrame:
    """One row per listed column; missing values stay as rows."""
    ids = list(ids) if ids is not None else [c for c in df.columns if c not in cols]
    return df.unpivot(ids, list(cols), names_to, values_to)


def pivot_wider_first(
    df: DataFrame, ids: Sequence[str], names_from: str, values_from: str, levels: Sequence[str]
) -> DataFrame:
    """One column per level; two values for one cell raise.

    Written as conditional aggregates, so that it takes one shuffle with map-side combine.
    """
    cells = []
    for level in levels:
        here = F.col(names_from) == F.lit(level)
        value = F.first(F.when(here, F.col(values_from)), ignorenulls=True)
        clash = F.raise_error(F.lit(f"more than one value in column {level}"))
        cells.append(F.when(F.count(F.when(here, 1)) > 1, clash).otherwise(value).alias(level))
    return df.groupBy(*ids).agg(*cells)


def pivot_wider_sum(
    df: DataFrame,
    ids: Sequence[str],
    names_from: str,
    values_from: str,
    levels: Sequence[str],
    fill: int | None = 0,
) -> DataFrame:
    """One summed column per level; an empty cell takes ``fill``."""
    cells = []
    for level in levels:
        total = F.sum(F.when(F.col(names_from) == F.lit(level), F.col(values_from)))
        cells.append((total if fill is None else F.coalesce(total, F.lit(fill))).alias(level))
    return df.groupBy(*ids).agg(*cells)


def key_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys and keys that occur more than once."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("n") > 1).alias("n_repeated_keys"),
    )


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Return ``df``; a repeated key raises. Runs one count over the key columns."""
    if key_report(df, keys).first()["n_repeated_keys"]:
        raise ValueError(f"{list(keys)} is not a unique key")
    return df


def explode_lists(df: DataFrame, ids: Sequence[Column], lists: Column, name: str) -> DataFrame:
    """One row per list item and id, without repeats and without missing items."""
    return df.select(*ids, F.explode(lists).alias(name)).filter(F.col(name).isNotNull()).distinct()


def dense_index(df: DataFrame, keys: Sequence[str], name: str, buckets: int | None = None) -> DataFrame:
    """Number distinct keys 0..n-1 without one global sort.

    Keys are numbered inside hash buckets, eight for each shuffle partition and 1,024 at least; the
    only ungrouped window runs over the bucket counts, at most ``buckets`` rows.
    """
    if buckets is None:
        buckets = max(1024, 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucketed = df.withColumn("__b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    sizes = bucketed.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = F.row_number().over(W.partitionBy("__b").orderBy(*keys))
    return (
        bucketed.withColumn("__r", inside)
        .join(F.broadcast(offsets), "__b")
        .withColumn(name, (F.col("__offset") + F.col("__r") - 1).cast("bigint"))
        .drop("__b", "__r", "__offset")
    )


def full_grid(samples: DataFrame, sample: str, features: DataFrame, feature: str, max_cells: int = MAX_CELLS) -> DataFrame:
    """Every sample x feature cell. The result is dense by definition; one of more than ``max_cells`` raises.

    Each feature is expanded over the sample numbers and joined on the number, so no
    cross product is planned and the expansion runs where the features already are.
    """
    indexed, seen = store_observed(dense_index(samples.select(sample).distinct(), [sample], "__i"), "grid", {"n": F.count(F.lit(1))})
    names, found = store_observed(features.select(feature).distinct(), "grid", {"n": F.count(F.lit(1))})
    n = seen.get("n", 0)
    if n * found.get("n", 0) > max_cells:
        raise ValueError(f"{n} samples x {found['n']} features are more than max_cells = {max_cells}")
    numbers = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(n - 1, 0)).cast("bigint")))
    cells = names.select(feature, numbers.alias("__i"))
    return cells.join(indexed, "__i").select(sample, feature)


def melt_bundle(
    counts: DataFrame,
    samples: DataFrame,
    features: DataFrame,
    sample: str = "sample",
    feature: str = "feature",
    count: str = "count",
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """One long table with Abundance, sample columns and feature columns, zero cells included."""
    cells = key_join(full_grid(samples, sample, features, feature, max_cells), counts, [sample, feature], "left")
    cells = cells.withColumn("Abundance", F.coalesce(F.col(count), F.lit(0))).drop(count)
    return key_join(key_join(cells, samples, [sample]), features, [feature])
