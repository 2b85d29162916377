"""Text formats of the upstream tools, parsed into typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biotables.functions.columns import numeric_value, separate

# Field names of the bin-statistics text and the columns they fill.
BIN_STAT_FIELDS = {
    "marker lineage": "Marker_Genes",
    "# genomes": "Genomes",
    "# markers": "Markers",
    "# marker sets": "Marker_Sets",
    "Completeness": "Completeness",
    "Contamination": "Contamination",
    "GC": "GC",
    "GC std": "GC_std",
    "Genome size": "Genome_Size",
    "# ambiguous bases": "Ambiguous_Bases",
    "# scaffolds": "Scaffolds",
    "# contigs": "Contigs",
    "# predicted genes": "Predicted_Genes",
}
BIN_STAT_TEXT = {"Marker_Genes"}


def _piece(c: Column, regex: str, index: int) -> Column:
    return F.get(F.split(c, regex, -1), index)


def parse_rank_score(c: str | Column) -> list[Column]:
    """``Name (rank): score`` to Classification, Tax_Level and Confidence (text)."""
    c = F.col(c) if isinstance(c, str) else c
    rest = _piece(c, r" \(", 1)
    return [
        _piece(c, r" \(", 0).alias("Classification"),
        _piece(rest, r"\): ", 0).alias("Tax_Level"),
        _piece(rest, r"\): ", 1).alias("Confidence"),
    ]


def parse_orf_id(c: str | Column) -> list[Column]:
    """``<enrichment>metabat.<n>.fa_<a>_<b>_<orf>`` to bin, contig, enrichment and bin number."""
    c = F.col(c) if isinstance(c, str) else c
    bin_id = _piece(c, ".fa_", 0)
    tail = _piece(c, ".fa_", 1)
    contig = F.concat_ws(
        "_",
        F.coalesce(_piece(tail, "_", 0), F.lit("NA")),
        F.coalesce(_piece(tail, "_", 1), F.lit("NA")),
    )
    after = _piece(bin_id, "metabat.", 1)
    return [
        bin_id.alias("BinID"),
        contig.alias("contigName"),
        _piece(bin_id, "metabat.", 0).alias("Enrichment"),
        _piece(after, "[^A-Za-z0-9]+", 0).alias("Bin_Number"),
    ]


def gtf_attribute(c: str | Column, name: str) -> Column:
    """Value of one ``name "value"`` attribute; NULL when it is absent."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_extract(c, f'(?:^|;)\\s*{name} "([^"]*)"', 1), F.lit(""))


def gff_attribute(c: str | Column, name: str) -> Column:
    """Value of one ``name=value`` attribute; NULL when it is absent."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_extract(c, f"(?:^|;)\\s*{name}=([^;]*)", 1), F.lit(""))


def parse_gtf(df: DataFrame) -> DataFrame:
    """Headerless GTF columns to one row per contig, locus and gene caller."""
    return df.select(
        F.col("V1").alias("contigName"),
        gtf_attribute("V9", "gene_id").alias("locus_tag"),
        _piece(F.col("V2"), ":", 0).alias("prodigal"),
    ).distinct()


def parse_locus_tag(c: str | Column, enrichment_regex: str = ".c") -> list[Column]:
    """``<enrichment>.contigs_<number>`` to bin part, gene id and enrichment."""
    c = F.col(c) if isinstance(c, str) else c
    bin_part = _piece(c, "_", 0)
    return [
        bin_part.alias("BinID"),
        _piece(c, "_", 1).alias("geneID"),
        _piece(bin_part, enrichment_regex, 0).alias("Enrichment"),
    ]


def parse_bin_tag(c: str | Column) -> list[Column]:
    """``<enrichment>metabat.<n>_<number>`` to bin, gene id, enrichment and bin number."""
    c = F.col(c) if isinstance(c, str) else c
    bin_id = _piece(c, "_", 0)
    return [
        bin_id.alias("BinID"),
        _piece(c, "_", 1).alias("geneID"),
        *separate(bin_id, ["Enrichment", "Bin_Number"], "metabat."),
    ]


def bin_stat(c: str | Column, field: str) -> Column:
    """Raw text of one field of the dict-like statistics cell; NULL when absent."""
    c = F.col(c) if isinstance(c, str) else c
    pattern = f"(?:^|[{{,]\\s*)'?{field}'?: '?([^,'}}]*)"
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def parse_bin_stats(c: str | Column, compat: bool = False) -> list[Column]:
    """Dict-like statistics cell to one typed column per field."""
    out = []
    for field, name in BIN_STAT_FIELDS.items():
        raw = bin_stat(c, field)
        out.append((raw if name in BIN_STAT_TEXT else numeric_value(raw, compat)).alias(name))
    return out
