"""Counts and flags that come with a write that runs anyway.

``DataFrame.observe`` adds aggregates to the plan of the write; no second pass reads the rows. Metrics sit in the
stage that writes: a task that runs again there is counted once. Below a shuffle a lost map task could be counted
twice, so numbers of rows before a shuffle are carried through it as sums (:func:`store_unique`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from biotables.session import materialize


def store_observed(df: DataFrame, label: str, metrics: Mapping[str, Column]) -> tuple[DataFrame, dict]:
    """Write ``df`` to the shared folder; the stored table and the aggregates over its rows, from one job."""
    seen = Observation(label)
    stored = materialize(df.observe(seen, *[a.alias(n) for n, a in metrics.items()]), label)
    return stored, seen.get


def quality_metrics(missing: Sequence[str], zero: Sequence[str] = ()) -> dict[str, Column]:
    """Row count, missing cells of each ``missing`` column and zero cells of each ``zero`` column."""
    return {
        "n_rows": F.count(F.lit(1)),
        **{f"null_{c}": F.count_if(F.col(c).isNull()) for c in missing},
        **{f"zero_{c}": F.count_if(F.col(c) == 0) for c in zero},
    }


def store_stacked(parts: Mapping[str, DataFrame], label: str) -> tuple[DataFrame, dict]:
    """Stack tables by column name, write the result, and count the rows of each part and of the whole.

    Each part is observed on its own branch and the union above them; all of it is one job.
    ``reconciled`` says that the parts add up to the whole.
    """
    seen = {name: Observation(f"{label}_{name}") for name in parts}
    branches = [df.observe(seen[name], F.count(F.lit(1)).alias("n")) for name, df in parts.items()]
    stored, whole = store_observed(reduce(DataFrame.unionByName, branches), label, {"n_merged": F.count(F.lit(1))})
    counts = {f"n_{name}": o.get.get("n", 0) for name, o in seen.items()}
    merged = whole.get("n_merged", 0)
    return stored, {**counts, "n_merged": merged, "reconciled": sum(counts.values()) == merged}


def store_unique(df: DataFrame, keys: Sequence[str], label: str) -> tuple[DataFrame, dict]:
    """Write one row for each key (NULL is a value) with ``n``, its number of rows, and observe the repeats.

    ``n_rows`` is the sum of ``n`` after the shuffle, hence exact when map tasks are repeated.
    """
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return store_observed(groups, label, {
        "n_rows": F.coalesce(F.sum("n"), F.lit(0)),
        "n_duplicated": F.coalesce(F.sum(F.col("n") - 1), F.lit(0)),
        "any_duplicated": F.coalesce(F.max("n") > 1, F.lit(False)),
    })
