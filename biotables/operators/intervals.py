"""Interval joins over a fixed tree of bins.

Level ``k`` cuts positions into bins of ``FINEST * FACTOR ** k``; the last level is one bin. An interval lies in the smallest
bin that holds it, so it is one row whatever its length. Of two intervals that overlap, the longer one's bin is an
ancestor of the shorter one's, but for borders; a probe no longer than a bin touches at most two bins of its level.

A probe therefore asks, from the first level whose bins are as long as itself, the one or two bins it touches. On that
first level it also asks for all intervals that lie deeper; for these every interval is entered once under each
ancestor. Both sides have at most a few rows for each level, and only levels with intervals are asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINEST = 512
FACTOR = 8
LEVELS = 12


def width(level: int, finest: int = FINEST) -> int:
    return finest * FACTOR**level


def bin_at(position: Column, level: int, finest: int) -> Column:
    return F.floor(position / F.lit(width(level, finest))) if level < LEVELS - 1 else F.lit(0).cast("bigint")


def own_level(start: Column, end: Column, finest: int = FINEST) -> Column:
    """The first level at which one bin holds the interval."""
    out = F.lit(LEVELS - 1)
    for level in reversed(range(LEVELS - 1)):
        out = F.when(bin_at(start, level, finest) == bin_at(end - 1, level, finest), F.lit(level)).otherwise(out)
    return out


def long_enough(start: Column, end: Column, finest: int = FINEST) -> Column:
    """The first level whose bins are as long as the interval."""
    out = F.lit(LEVELS - 1)
    for level in reversed(range(LEVELS - 1)):
        out = F.when(end - start <= width(level, finest), F.lit(level)).otherwise(out)
    return out


def entered(intervals: DataFrame, start: str, end: str, first: int = LEVELS - 1, finest: int = FINEST) -> DataFrame:
    """Adds ``level, bin, deep``: the interval under its own bin, and under its ancestors as one that lies deeper.

    Ancestors above level ``first`` are left out: no probe asks there for what lies deeper.
    """
    s, own = F.col(start), F.col("__own")
    places = F.array(
        *[F.struct(F.lit(k).alias("level"), bin_at(s, k, finest).alias("bin"), (own < k).alias("deep")) for k in range(LEVELS)]
    )
    rows = intervals.withColumn("__own", own_level(s, F.col(end), finest))
    return rows.select(*intervals.columns, F.inline(F.filter(places, lambda p: (p["level"] == own) | (p["level"] > own) & (p["level"] <= first))))


def asked(probes: DataFrame, start: str, end: str, levels: list[int], finest: int = FINEST) -> DataFrame:
    """Adds ``level, bin, deep`` for the bins in which overlapping intervals may be entered; ``levels`` hold intervals."""
    s, e, first = F.col(start), F.col(end), F.col("__first")
    rows = []
    for k in range(LEVELS):
        for place in (s, e - 1):
            if k in levels:
                rows.append(F.struct(F.lit(k).alias("level"), bin_at(place, k, finest).alias("bin"), F.lit(False).alias("deep")))
            if any(level < k for level in levels):
                rows.append(F.struct(F.lit(k).alias("level"), bin_at(place, k, finest).alias("bin"), F.lit(True).alias("deep")))
    wanted = F.filter(F.array(*rows), lambda p: (p["level"] > first) & ~p["deep"] | (p["level"] == first))
    out = probes.withColumn("__first", long_enough(s, e, finest))
    return out.select(*probes.columns, F.inline(F.array_distinct(wanted)))


def overlaps(
    probes: DataFrame, intervals: DataFrame, key: str, probe: tuple[str, str], interval: tuple[str, str], longest: int | None = None,
    finest: int = FINEST,
) -> DataFrame:
    """Every pair of a probe and an interval of the same ``key`` that share a position, once.

    ``probe`` and ``interval`` name the start and end columns (end exclusive); empty intervals overlap nothing.
    ``longest`` may say how long probes are at most, if that is known. Column names of the two tables must
    differ but for the key.
    """
    (p_start, p_end), (i_start, i_end) = probe, interval
    full = intervals.filter(F.col(i_end) > F.col(i_start))
    # a dozen levels at most
    levels = [r["level"] for r in full.select(own_level(F.col(i_start), F.col(i_end), finest).alias("level")).distinct().collect()]
    if not levels:
        return probes.join(full, key).limit(0)
    if longest is None:
        longest = probes.agg(F.max(F.col(p_end) - F.col(p_start))).first()[0] or 0
    deepest = next((k for k in range(LEVELS) if longest <= width(k, finest)), LEVELS - 1)
    left = asked(probes.filter(F.col(p_end) > F.col(p_start)), p_start, p_end, levels, finest)
    right = entered(full, i_start, i_end, deepest, finest)
    return (
        left.join(right, [key, "level", "bin", "deep"])
        .filter((F.col(i_start) < F.col(p_end)) & (F.col(i_end) > F.col(p_start)))
        .drop("level", "bin", "deep")
    )
