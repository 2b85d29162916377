"""The count table per locus, the fact table and the expression summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotables.functions import (
    any_not_null,
    any_positive,
    count_bucket,
    separate,
    strict_sum,
)
from biotables.operators.joins import key_join, natural_join
from biotables.operators.reshape import pivot_longer, pivot_wider_sum
from biotables.operators.totals import attach_totals
from biotables.sources.buckets import store_bucketed

# Substrates of the experiment, in the order of the count columns.
SUBSTRATES = ["TPA", "DCPET", "HDPE", "TA", "EG"]
UNKNOWN_PATHWAY = "Unknown_Pathway"
#: keys that rows without a contig are dealt to
NULL_PARTS = 64


def drop_special_rows(counts: DataFrame, tag: str = "locus_tag") -> DataFrame:
    """Without the summary rows of the read counter, whose tags start with two underscores.

    Rows without a tag fail the test as well.
    """
    return counts.filter(~F.col(tag).startswith("__"))


def merge_counts(long: DataFrame, substrates: Sequence[str] = SUBSTRATES) -> DataFrame:
    """Stacked count files ``(locus_tag, substrate, count)`` to one row per locus.

    A substrate in which the locus was never reported stays NULL.
    """
    return pivot_wider_sum(
        drop_special_rows(long), ["locus_tag"], "substrate", "count", substrates, fill=None
    )


def merge_counts_natural(files: Sequence[DataFrame]) -> DataFrame:
    """Count files merged by successive natural full joins.

    Files that share their substrate column with an earlier one match on it too, so a
    locus can come out as several rows with one filled substrate each.
    """
    return drop_special_rows(reduce(lambda a, b: natural_join(a, b, "full"), files))


def assemble_fact(
    counts: DataFrame,
    genes: DataFrame,
    pathways: DataFrame | None,
    loci: DataFrame | None,
    contigs: DataFrame,
    taxa: DataFrame,
    contig_keys: Sequence[str] = ("contigName", "Enrichment"),
    distinct_inputs: bool = False,
) -> DataFrame:
    """Counts per locus with gene, pathway, contig, bin, taxonomy and quality.

    ``counts`` has one row per locus (:func:`merge_counts`). Bins are required. A locus
    whose enzyme is on several pathways has one row per pathway, so sums over loci start
    from ``pathways=None``, which has one row per locus.

    Locus tags are never missing, so the three tables keyed by them are joined by plain
    equality and shuffled once each; the other keys may be missing and match as such. The
    result has no repeated rows because no input has any: removing repeats from the narrow
    inputs is cheaper than from the wide result, and ``distinct_inputs`` says that there are none.
    ``loci=None`` means that ``genes`` holds the contig columns itself, which saves a join.
    """
    clean = (lambda df: df) if distinct_inputs else DataFrame.distinct
    fact = key_join(counts, clean(genes), ["locus_tag"], "left", nulls_match=False)
    if loci is not None:
        fact = key_join(fact, clean(loci), ["locus_tag"], "left", nulls_match=False)
    # loci without a gene row have no contig: a NULL key that may be hot
    fact = key_join(fact, clean(contigs), list(contig_keys), "left", spread_nulls=NULL_PARTS)
    fact = key_join(
        fact.filter(F.col("BinID").isNotNull()), clean(taxa), ["BinID", "Enrichment"], "left"
    )
    if pathways is None:
        return fact
    return key_join(fact, clean(pathways), ["EC_number"], "left").withColumn(
        "General_Pathway", F.coalesce("General_Pathway", F.lit(UNKNOWN_PATHWAY))
    )


@dataclass(frozen=True)
class LocusStore:
    """Counts and genes in the same hash buckets of the locus tag, written once and read by many tables.

    Merging the counts of a locus and joining its gene are then work inside a bucket: no shuffle, whatever the size.
    """

    counts: DataFrame  # locus_tag, substrate, count
    genes: DataFrame  # locus_tag, Enrichment, contigName, ... one row per locus

    @staticmethod
    def write(counts: DataFrame, genes: DataFrame, buckets: int | None = None) -> LocusStore:
        """Stores both tables without the counter's summary rows; genes with repeated rows are stored once."""
        return LocusStore(
            store_bucketed(drop_special_rows(counts), "counts", ["locus_tag"], buckets),
            store_bucketed(genes.distinct(), "genes", ["locus_tag"], buckets),
        )

    def fact(self, pathways: DataFrame | None, contigs: DataFrame, taxa: DataFrame) -> DataFrame:
        """:func:`assemble_fact` over the stored loci."""
        return assemble_fact(merge_counts(self.counts), self.genes, pathways, None, contigs, taxa, distinct_inputs=True)

    def gene_totals(self, *by: str) -> DataFrame:
        """Total count and number of expressed loci per gene columns ``by``; loci without a gene row have none."""
        loci = self.counts.groupBy("locus_tag").agg(F.sum("count").alias("count"))
        named = key_join(loci, self.genes.select("locus_tag", *by), ["locus_tag"], nulls_match=False)
        return named.groupBy(*by).agg(F.sum("count").alias("count"), F.count_if(F.col("count") > 0).alias("n_loci"))


def strict_group_totals(
    fact: DataFrame, keys: Sequence[str], substrates: Sequence[str] = SUBSTRATES
) -> DataFrame:
    """Expressed rows summed per key; a missing count makes its sum missing, then zero.

    Groups in which every substrate is missing are dropped.
    """
    sums = (
        fact.filter(any_positive(substrates))
        .groupBy(*keys)
        .agg(*[strict_sum(s).alias(s) for s in substrates])
    )
    return sums.filter(any_not_null(substrates)).fillna(0, subset=list(substrates))


def expression_long(
    fact: DataFrame,
    keys: Sequence[str],
    classification: str = "Best_Classification",
    substrates: Sequence[str] = SUBSTRATES,
) -> DataFrame:
    """Strict totals per key with the taxon name, one row per substrate."""
    totals = strict_group_totals(fact, [*keys, classification], substrates)
    parts = separate(classification, ["Taxa", "Similarity", "Taxa_Level"], "_")
    wide = totals.select(*keys, *parts, *substrates)
    return pivot_longer(
        wide, substrates, "Substrate", "Counts", [*keys, "Taxa", "Similarity", "Taxa_Level"]
    )


def expression_share(
    fact: DataFrame, pathway_genes: DataFrame, keys: Sequence[str],
    classification: str = "Best_Classification", substrates: Sequence[str] = SUBSTRATES,
) -> DataFrame:
    """Pathway genes with their counts as a share of all expressed counts of the bin."""
    long = expression_long(fact, keys, classification, substrates).filter(F.col("Counts") != 0)
    totals = attach_totals(
        long, ["BinID", "Substrate"], {"expressed_genes_per_bin": F.sum("Counts")}
    )
    joined = key_join(pathway_genes, totals, list(keys), "left").filter(
        F.col("Substrate").isNotNull()
    )
    return joined.withColumn(
        "percent_expressed_gene_per_bin", F.col("Counts") / F.col("expressed_genes_per_bin")
    )


def pathway_totals(
    fact: DataFrame, keys: Sequence[str], by: Sequence[str],
    classification: str = "Best_Classification", substrates: Sequence[str] = SUBSTRATES,
) -> DataFrame:
    """Counts above zero per taxon and the ``by`` columns."""
    long = expression_long(fact, keys, classification, substrates).filter(F.col("Counts") > 0)
    named = long.withColumn("Taxa", F.coalesce("Taxa", F.lit("Unclassified")))
    return named.groupBy(*by, "Taxa").agg(F.sum("Counts").alias("Counts"))


def count_tiles(
    fact: DataFrame, keep: Sequence[str], substrates: Sequence[str] = SUBSTRATES,
    lower: int | None = None,
) -> DataFrame:
    """Non-zero counts per substrate with their size class."""
    long = pivot_longer(fact.select(*keep, *substrates), substrates, "Substrate", "Counts", keep)
    return long.filter(F.col("Counts") != 0).withColumn(
        "Num_Transcripts", count_bucket("Counts", lower)
    )


def gene_export(genes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Gene rows for sharing: the enrichment instead of the locus tag, listed columns only."""
    return genes.select(*columns, *separate("locus_tag", ["Enrichment"], "metabat."))
