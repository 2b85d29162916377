"""Joins by column name in which a missing key matches a missing key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RIGHT = "__right_"


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def key_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    nulls_match: bool = True,
    spread_nulls: int = 1,
) -> DataFrame:
    """Join on named keys; each key comes out once, filled from whichever side has it.

    With matching NULLs all left rows that miss a key are one key. ``spread_nulls`` deals them to that many by a hash of
    their other columns and repeats the right rows that miss a key for each, so a hot NULL is no single task. Only for
    joins that keep no unmatched right rows; the left columns may hold no maps.
    """
    on = list(on)
    if spread_nulls > 1 and nulls_match:
        return _spread_join(left, right, on, how, spread_nulls)
    clash = [c for c in right.columns if c in left.columns and c not in on]
    if clash and how not in ("left_semi", "left_anti"):
        raise ValueError(f"columns {clash} exist on both sides and are not keys")
    rest = [c for c in right.columns if c not in on]
    renamed = right.select(*[F.col(f"`{k}`").alias(_RIGHT + k) for k in on], *rest)
    conditions = []
    for k in on:
        l_key, r_key = left[k], renamed[_RIGHT + k]
        conditions.append(l_key.eqNullSafe(r_key) if nulls_match else l_key == r_key)
    joined = left.join(renamed, reduce(lambda a, b: a & b, conditions), how)
    if how in ("left_semi", "left_anti"):
        return joined
    outer = how.replace("_", "") in ("full", "fullouter", "outer", "right", "rightouter")

    def out(name: str) -> Column:
        column = F.col(f"`{name}`")
        if outer and name in on:
            return F.coalesce(column, F.col(f"`{_RIGHT}{name}`")).alias(name)
        return column

    return joined.select(*[out(c) for c in left.columns], *[F.col(f"`{c}`") for c in rest])


def _spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str, parts: int) -> DataFrame:
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a {how} join would repeat unmatched right rows")
    missing = reduce(lambda a, b: a | b, [F.col(f"`{k}`").isNull() for k in on])
    rest = [F.col(f"`{c}`") for c in left.columns if c not in on] or [F.lit(0)]
    dealt = F.when(missing, F.pmod(F.xxhash64(*rest), F.lit(parts)).cast("int")).otherwise(0)
    copies = F.when(missing, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    out = key_join(left.withColumn("__deal", dealt), right.withColumn("__deal", F.explode(copies)), [*on, "__deal"], how)
    return out.drop("__deal")


def natural_join(
    left: DataFrame, right: DataFrame, how: str = "full", nulls_match: bool = True
) -> DataFrame:
    """Join on every column the two sides share."""
    keys = shared_columns(left, right)
    if not keys:
        raise ValueError("the two sides share no column")
    return key_join(left, right, keys, how, nulls_match)


def left_join_required(
    left: DataFrame, right: DataFrame, on: Sequence[str], required: str
) -> DataFrame:
    """Left join, then keep the rows in which a column of the right side was found."""
    return key_join(left, right, on, "left").filter(F.col(required).isNotNull())


def membership_flag(
    df: DataFrame, values: DataFrame, cols: Sequence[str], name: str, paired: bool = False
) -> DataFrame:
    """Flag rows whose columns occur in ``values``; NULL is a value like any other.

    By default each column is looked up on its own, as two separate ``in`` tests.
    ``paired=True`` looks the combination up.
    """
    groups = [list(cols)] if paired else [[c] for c in cols]
    flags = []
    for i, group in enumerate(groups):
        flag = f"__member_{i}"
        flags.append(flag)
        lookup = values.select(*group).distinct().withColumn(flag, F.lit(True))
        df = key_join(df, lookup, group, "left")
    found = reduce(lambda a, b: a & b, [F.coalesce(F.col(f), F.lit(False)) for f in flags])
    return df.withColumn(name, found).drop(*flags)
