"""Buckets of bounded size in the order of a value, with borders taken from the data.

A fixed grid puts a narrow range of values into one bucket. Here every group starts as one bucket. A bucket with more
rows than the bound is cut at quantiles of its own rows (a mergeable sketch, combined before the shuffle), its parts are
counted, and parts that are too large are cut again. The sketch need not be exact: any borders give the right order.
Rows of finished buckets are never read again by later rounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biotables.operators.joins import key_join
from biotables.operators.observed import store_observed
from biotables.session import materialize

#: most rows of a bucket, unless they all have one value
ROWS = 50_000
#: borders of a cut; a value may lie below, on or between them, so a cut has at most 2 * CUTS + 1 parts
CUTS = 31
ROUND_BITS = 6  # 2 * CUTS + 1 parts
TOP = 60
ACCURACY = 2_000


def _part(value: Column, borders: str) -> Column:
    """Number of borders below ``value`` plus the number of borders at most ``value``: never falls as it grows."""
    below = F.size(F.filter(borders, lambda b: b < value))
    upto = F.size(F.filter(borders, lambda b: b <= value))
    return (below + upto).cast("bigint")


def with_buckets(df: DataFrame, group: Sequence[str], value: str | Column, name: str = "__bucket", rows: int = ROWS) -> DataFrame:
    """Adds ``name``, a number that sorts like ``value`` inside a group; equal values share a bucket.

    No bucket has more than ``rows`` rows, but for rows of a single value: feed counts of distinct values to exclude
    that case. NULL is a group of its own, a missing value sorts as the smallest, NaN as the largest. The table is written
    once and counted on the way; one that fits the bound as a whole needs no further job. A cut leaves a part with
    at most about 1 in 30 of the rows of its bucket, so ``n`` rows take about log(n / rows) / log(30) rounds.
    """
    group = list(group)
    keys = [*group, name]
    value = (F.col(value) if isinstance(value, str) else value).cast("double")
    rest, seen = store_observed(
        df.withColumn("__at", F.coalesce(value, F.lit(float("-inf")))).withColumn(name, F.lit(0).cast("bigint")), "buckets", {"n": F.count(F.lit(1))}
    )
    done: list[DataFrame] = []
    shift = TOP
    while seen.get("n", 0) > rows and shift > 0:
        sizes = rest.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"), F.min("__at").alias("__low"), F.max("__at").alias("__high"))
        full = sizes.filter((F.col("__size") > rows) & (F.col("__low") < F.col("__high"))).select(*keys)
        full, found = store_observed(full, "full_buckets", {"n": F.count(F.lit(1))})
        if not found.get("n", 0):
            break
        shift -= ROUND_BITS
        at = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
        cuts = key_join(rest, full, keys).groupBy(*keys).agg(F.array_distinct(F.percentile_approx("__at", at, ACCURACY)).alias("__cuts"))
        cuts = materialize(cuts, "bucket_cuts")
        done.append(key_join(rest, full, keys, "left_anti"))
        below = _part(F.col("__at"), "__cuts") * F.lit(1 << shift)
        rest, seen = store_observed(
            key_join(rest, cuts, keys).withColumn(name, F.col(name) + below).drop("__cuts"), "buckets", {"n": F.count(F.lit(1))}
        )
    return reduce(DataFrame.unionByName, [*done, rest]).drop("__at")
