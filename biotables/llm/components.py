"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotables.session import materialize


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every id in ``links`` (columns a, b; null and equal ends are left out).

    Every round is one grouped minimum and one join per star, written to the shared folder. A hub is one
    key of the join, which the adaptive skew join splits. The rounds grow with the logarithm of the
    largest component.
    """
    known = links.where("a is not null and b is not null and a <> b")
    edges = materialize(known.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF))).first())
        if state == before or state[0] == 0:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        before = state
        # large star: every larger neighbour goes to the smallest one
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large-star")
        # small star: the smaller neighbours and the node itself go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
