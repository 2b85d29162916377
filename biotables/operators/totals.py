"""Group totals on rows, running totals, ranks and exact quantiles.

A plain window sends one group to one task. Here a total is a small aggregate joined
back (a hot key is split by the adaptive skew join), and a running total works on
(group, bucket of the ordering value), with the totals of earlier buckets added.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from biotables.operators.borders import with_buckets
from biotables.operators.joins import key_join


def attach_totals(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Group aggregates on every row of the group."""
    totals = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return key_join(df, totals, keys)


def share_of_group(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Value over the total of its group; NULL when the total is zero."""
    out = attach_totals(df, keys, {"__total": F.sum(value)})
    return out.withColumn(name, F.col(value) / F.nullif("__total", F.lit(0))).drop("__total")


def fill_proportion(
    df: DataFrame, stack: Sequence[str], fill: str, value: str, name: str
) -> DataFrame:
    """Share of each fill level inside a stack (x position and facet)."""
    sums = df.groupBy(*stack, fill).agg(F.sum(value).alias(value))
    return share_of_group(sums, stack, value, name)


def lump_rare(
    df: DataFrame, within: str, label: str, limit: float, rare: str, missing: str
) -> DataFrame:
    """Relabel classes whose row count over the row total of ``within`` is below ``limit``.

    The two counts use different groups, as the published figure does.
    """
    out = df.withColumn(label, F.coalesce(F.col(label), F.lit(missing)))
    out = attach_totals(out, [within], {"n_total": F.count(F.lit(1))})
    out = attach_totals(out, [label], {"__n": F.count(F.lit(1))})
    out = out.withColumn("share", F.col("__n") / F.col("n_total")).drop("__n")
    return out.withColumn(label, F.when(F.col("share") < limit, rare).otherwise(F.col(label)))


def value_bucket(c: str | Column, per_octave: int = 256) -> Column:
    """Integer that never falls as the number grows; splits every power of two evenly."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    width = F.lit(2000 * per_octave)
    size = width + F.floor(F.log2(F.abs(c)) * per_octave)
    return F.when(c == 0, F.lit(0)).when(c > 0, size).otherwise(-size).cast("bigint")


def _with_carry(df: DataFrame, carry: DataFrame) -> DataFrame:
    """Rows of each bucket behind one row that carries what the other buckets add."""
    rows = df.withColumn("__is_row", F.lit(True))
    return rows.unionByName(carry.withColumn("__is_row", F.lit(False)), allowMissingColumns=True)


def running_total(
    df: DataFrame,
    group: Sequence[str],
    bucket: str,
    order: Sequence[str],
    value: str,
    name: str,
    total: str | None = None,
) -> DataFrame:
    """Inclusive running sum of ``value`` in (bucket, order) order inside each group.

    ``bucket`` must sort like the order columns. A window never holds more than one
    bucket of rows, or the bucket totals of one group. ``total`` names a column for the
    sum of the whole group.
    """
    keys = [*group, bucket]
    whole = W.partitionBy(*group)
    before = whole.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    carry = (
        df.groupBy(*keys)
        .agg(F.sum(value).alias("__sum"))
        .select(
            *keys,
            F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__step"),
            F.sum("__sum").over(whole).alias("__whole"),
        )
    )
    upto = W.partitionBy(*keys).orderBy("__is_row", *order).rowsBetween(W.unboundedPreceding, 0)
    out = _with_carry(df.withColumn("__step", F.col(value)), carry).withColumn(
        name, F.sum("__step").over(upto)
    )
    if total:
        out = out.withColumn(total, F.first("__whole", ignorenulls=True).over(upto))
    return out.filter("__is_row").drop("__is_row", "__step", "__whole")


def later_minimum(
    df: DataFrame, group: Sequence[str], bucket: str, order: str, value: str, name: str
) -> DataFrame:
    """Smallest ``value`` at this or any later position of the group."""
    keys = [*group, bucket]
    # backwards, because a frame that grows from the start is kept up row by row
    after = W.partitionBy(*group).orderBy(F.desc(bucket)).rowsBetween(W.unboundedPreceding, -1)
    carry = (
        df.groupBy(*keys)
        .agg(F.min(value).alias("__min"))
        .select(*keys, F.min("__min").over(after).alias("__low"))
    )
    back = (
        W.partitionBy(*keys)
        .orderBy("__is_row", F.desc(order))
        .rowsBetween(W.unboundedPreceding, 0)
    )
    out = _with_carry(df.withColumn("__low", F.col(value)), carry)
    out = out.withColumn(name, F.min("__low").over(back))
    return out.filter("__is_row").drop("__is_row", "__low")


def exact_quantiles(
    df: DataFrame, group: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Exact quantiles by linear interpolation, one row per group, plus the row count ``n``.

    Works on counts of distinct values and their running totals; no group is collected. Buckets of
    values have borders from the data, whatever range the values lie in.
    """
    group = list(group)
    spread = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).cast("double").alias("__v"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    spread = with_buckets(spread, group, "__v")
    ranked = running_total(spread, group, "__bucket", ["__v"], "__n", "__upto", total="n")
    aggs = []
    for i, prob in enumerate(probs.values()):
        at = (F.col("n") - 1) * F.lit(float(prob))
        for side, position in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (F.col("__upto") > position) & (F.col("__upto") - F.col("__n") <= position)
            aggs.append(F.max(F.when(inside, F.col("__v"))).alias(f"__{side}{i}"))
    picked = ranked.groupBy(*group, "n").agg(*aggs)
    out = []
    for i, (name, prob) in enumerate(probs.items()):
        at = (F.col("n") - 1) * F.lit(float(prob))
        low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        out.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return picked.select(*group, "n", *out)


def descending_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Competition rank of a non-negative count, largest first, without a global window over rows."""
    spread = df.groupBy(value).agg(F.count(F.lit(1)).alias("__n")).withColumn("__down", -F.col(value))
    spread = with_buckets(spread, [], "__down")
    ranked = running_total(spread, [], "__bucket", ["__down"], "__n", "__upto")
    ranks = ranked.select(value, (F.col("__upto") - F.col("__n") + 1).alias(name))
    return key_join(df, ranks, [value])


def duplicate_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows beyond the first of each key (NULL is a value) and whether any exist."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicated"),
        F.coalesce(F.max("n") > 1, F.lit(False)).alias("any_duplicated"),
    )
