"""Bin quality, bin taxonomy and the tables made of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotables.functions import (
    RANKS,
    best_classification,
    parse_bin_stats,
    parse_rank_score,
    quality_tier,
    separate,
    unite,
)
from biotables.operators.joins import key_join, membership_flag
from biotables.operators.reshape import pivot_longer, pivot_wider_first
from biotables.operators.totals import descending_rank

# The 17 tab-separated fields of a bin classification line.
LINEAGE_COLUMNS = [f"lineage_{i}" for i in range(1, 11)]
CLASSIFICATION_FIELDS = [
    "bin_file",
    "status",
    "No_ORFs",
    "unused_1",
    "unused_2",
    "unused_3",
    "unused_4",
    *LINEAGE_COLUMNS,
]


def bin_quality(stats: DataFrame, compat: bool = False) -> DataFrame:
    """Statistics rows ``(V1, V2)`` of all enrichments to the typed quality table."""
    return stats.select(
        F.col("V1").alias("BinID"),
        *separate("V1", ["Enrichment"], "metabat"),
        *parse_bin_stats("V2", compat),
    ).withColumn("Quality", quality_tier("Completeness", "Contamination"))


def bin_lineage(lines: DataFrame) -> DataFrame:
    """Split classification lines to one row per bin and lineage entry."""
    long = pivot_longer(
        lines.select("bin_file", "No_ORFs", *LINEAGE_COLUMNS),
        LINEAGE_COLUMNS,
        "field",
        "entry",
        ["bin_file", "No_ORFs"],
    )
    return long.filter(F.col("entry").isNotNull() & (F.col("bin_file") != "")).select(
        *separate("bin_file", ["BinID"], ".f"), "No_ORFs", *parse_rank_score("entry")
    )


def ambiguous_ranks(lineage: DataFrame) -> DataFrame:
    """Bin and rank pairs that occur more than once."""
    return (
        lineage.groupBy("BinID", "Tax_Level")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )


def bin_taxonomy(lineage: DataFrame, paired: bool = False) -> DataFrame:
    """One row per bin with one column per rank and the deepest classification.

    Rows of a bin and rank that occur twice are dropped. By default bin and rank are
    looked up independently of each other; ``paired=True`` looks up the combination.
    """
    flagged = membership_flag(
        lineage, ambiguous_ranks(lineage), ["BinID", "Tax_Level"], "ambiguous", paired
    )
    named = flagged.filter(~F.col("ambiguous")).withColumn(
        "label", unite(["Classification", "Confidence", "Tax_Level"])
    )
    wide = pivot_wider_first(named, ["BinID", "No_ORFs"], "Tax_Level", "label", RANKS)
    return wide.withColumn("Best_Classification", best_classification())


def taxa_quality(taxonomy: DataFrame, quality: DataFrame) -> DataFrame:
    """Bins of either table with classification parts and quality."""
    both = key_join(
        taxonomy.select("BinID", "Best_Classification"),
        quality.select("BinID", "Enrichment", "Completeness", "Contamination", "Quality"),
        ["BinID"],
        "full",
    )
    name, confidence, level = separate(
        "Best_Classification", ["Classification", "Confidence", "Tax_Level"], "_"
    )
    return both.select(
        "BinID",
        "Enrichment",
        "Best_Classification",
        "Completeness",
        "Contamination",
        "Quality",
        name,
        confidence.try_cast("double").alias("Confidence"),
        level,
    )


def taxa_tally(taxonomy: DataFrame, quality: DataFrame, rank: str = "genus", tier: str = "High") -> DataFrame:
    """Bins of one tier per taxon name, ranked by count."""
    both = key_join(taxonomy.select("BinID", rank), quality.select("BinID", "Quality"), ["BinID"], "full")
    counted = (
        both.filter(F.col("Quality") == tier)
        .select(*separate(rank, [rank], "_"))
        .groupBy(rank)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return descending_rank(counted, "n", "position").orderBy("position", rank)
