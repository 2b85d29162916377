"""The finished tables, end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from biotables.catalog.bindings import (
    TIER_SQL,
    bins,
    enzyme_pathway,
    genes,
    wide_sql,
    with_tables,
)
from biotables.catalog.columns import bin_stat_lines
from biotables.catalog.registry import Tables, query
from biotables.catalog.scans import _write_lines
from biotables.catalog.shaping import FACT_TABLES, MERGED_SQL, fact_inputs
from biotables.functions import quality_tier
from biotables.plans import bins as bin_plans
from biotables.plans import expression, genes as gene_plans
from biotables.plans.expression import SUBSTRATES
from biotables.session import scratch_path
from biotables.sources import sinks, text

# ---------------------------------------------------------------- bins

_STATS = """SELECT (CASE WHEN s_suppkey % 2 = 0 THEN 'Alpha' ELSE 'Beta' END) || 'metabat.' || s_suppkey AS BinID,
 CASE WHEN s_suppkey % 2 = 0 THEN 'Alpha' ELSE 'Beta' END AS Enrichment, 'k__' || s_name AS Marker_Genes,
 s_suppkey::DOUBLE AS Genome_Size, (s_nationkey + 1) / 100000.0::DOUBLE AS GC_std,
 (floor(abs(s_acctbal) * 100)::BIGINT % 10000) / 100.0::DOUBLE AS Completeness,
 s_nationkey / 10.0::DOUBLE AS Contamination FROM supplier"""


def quality_table(t: Tables):
    lines = bin_stat_lines(t)
    path = _write_lines(lines, F.concat_ws("\t", "V1", "V2"), "bin-stats")
    return bin_plans.bin_quality(text.read_headerless(t.spark, path, text.BIN_STATS_SCHEMA))


@query(with_tables("", f"""SELECT BinID, Enrichment, Marker_Genes, Genome_Size, round(GC_std, 9) AS "GC_std",
 Completeness, Contamination, {TIER_SQL} AS "Quality" FROM stats""", stats=_STATS))
def table_bin_quality(t: Tables):
    """Statistics files to the typed quality table."""
    return quality_table(t).select(
        "BinID", "Enrichment", "Marker_Genes", "Genome_Size", F.round("GC_std", 9).alias("GC_std"),
        "Completeness", "Contamination", "Quality",
    )


def lineage_lines(t: Tables):
    """Classification lines, one per part: 17 tab-separated fields.

    Every line has a phylum; some a class, a genus, a second genus (ambiguous) and an
    entry without a rank.
    """
    def entry(name, rank: str):
        score = F.concat(F.lit("0."), F.lpad(F.col("p_size").cast("string"), 2, "0"))
        return F.concat(name, F.lit(f" ({rank}): "), score)

    genus = entry(F.col("p_brand"), "genus")
    entries = [
        entry(F.col("p_type"), "phylum"),
        F.when(F.col("p_size") > 10, entry(F.upper("p_name"), "class")),
        F.when(F.col("p_size") > 20, genus),
        F.when((F.col("p_size") > 20) & (F.col("p_retailprice") > 1050), entry(F.lit("other"), "genus")),
        F.when(F.col("p_size") > 45, F.lit("no support")),
    ]
    fields = [
        F.concat(F.lit("Betametabat."), F.col("p_partkey"), F.lit(".fa")), F.lit("classified"),
        F.col("p_size").cast("string"), *[F.lit("x")] * 4, *entries,
    ]
    # a missing entry in the middle is left out, so lines differ in length as in the format
    return t.part.select("p_partkey", "p_size", F.concat_ws("\t", *fields).alias("value"))


def taxonomy_table(t: Tables, paired: bool = False):
    path = _write_lines(lineage_lines(t), F.col("value"), "lineage")
    lines = text.read_lines(t.spark, path, bin_plans.CLASSIFICATION_FIELDS)
    return bin_plans.bin_taxonomy(bin_plans.bin_lineage(lines), paired)


def part_quality(t: Tables):
    """Quality rows of the bins named after parts; bins of size 5 or less have none."""
    rows = t.part.filter(F.col("p_size") > 5).select(
        F.concat(F.lit("Betametabat."), F.col("p_partkey")).alias("BinID"),
        F.lit("Beta").alias("Enrichment"),
        (F.col("p_size") * 2).cast("double").alias("Completeness"),
        (F.length("p_name") / 2.0).alias("Contamination"),
    )
    return rows.withColumn("Quality", quality_tier("Completeness", "Contamination"))


_LINEAGE = {
    "entries": """SELECT 'Betametabat.' || p_partkey AS BinID, p_size::VARCHAR AS No_ORFs, score, name, rank, pos FROM (
 SELECT *, '0.' || lpad(p_size::VARCHAR, 2, '0') AS s FROM part) CROSS JOIN LATERAL (VALUES
 (1, p_type, 'phylum', s, true), (2, upper(p_name), 'class', s, p_size > 10), (3, p_brand, 'genus', s, p_size > 20),
 (4, 'other', 'genus', s, p_size > 20 AND p_retailprice > 1050), (5, 'no support', NULL, NULL, p_size > 45))
 e(pos, name, rank, score, present) WHERE present""",
    "twice": "SELECT BinID, rank FROM entries GROUP BY 1, 2 HAVING COUNT(*) > 1",
    "quality": f"""SELECT *, {TIER_SQL} AS quality FROM (SELECT 'Betametabat.' || p_partkey AS BinID, 'Beta' AS Enrichment,
 (p_size * 2)::DOUBLE AS completeness, length(p_name) / 2.0::DOUBLE AS contamination FROM part WHERE p_size > 5)""",
}


def _taxonomy_sql(keep: str, body: str) -> str:
    return with_tables(
        "",
        body,
        **_LINEAGE,
        kept=f"SELECT *, name || '_' || coalesce(score, 'NA') || '_' || coalesce(rank, 'NA') AS label FROM entries e WHERE {keep}",
        taxonomy="""SELECT BinID, No_ORFs, max(label) FILTER (rank = 'phylum') AS phylum, max(label) FILTER (rank = 'class') AS class,
 max(label) FILTER (rank = 'genus') AS genus, coalesce(max(label) FILTER (rank = 'genus'), max(label) FILTER (rank = 'class'),
 max(label) FILTER (rank = 'phylum'), 'fill later') AS best FROM kept GROUP BY 1, 2""",
    )


_INDEPENDENT = """NOT (BinID IN (SELECT BinID FROM twice)
 AND EXISTS (SELECT 1 FROM twice w WHERE w.rank IS NOT DISTINCT FROM e.rank))"""
_PAIRED = "NOT EXISTS (SELECT 1 FROM twice w WHERE w.BinID = e.BinID AND w.rank IS NOT DISTINCT FROM e.rank)"
_TAXA_BODY = 'SELECT BinID, No_ORFs AS "No_ORFs", phylum, class, genus, best AS "Best_Classification" FROM taxonomy'


@query(_taxonomy_sql(_INDEPENDENT, _TAXA_BODY))
def table_bin_taxonomy(t: Tables):
    """Classification lines to ranks; ambiguous bins and ranks looked up independently."""
    return taxonomy_table(t).select("BinID", "No_ORFs", "phylum", "class", "genus", "Best_Classification")


@query(_taxonomy_sql(_PAIRED, _TAXA_BODY))
def table_bin_taxonomy_paired(t: Tables):
    """The same with ambiguous (bin, rank) pairs."""
    return taxonomy_table(t, paired=True).select(
        "BinID", "No_ORFs", "phylum", "class", "genus", "Best_Classification"
    )


@query(_taxonomy_sql(_INDEPENDENT, """SELECT coalesce(a.BinID, q.BinID) AS "BinID", Enrichment AS "Enrichment",
 best AS "Best_Classification", completeness AS "Completeness", contamination AS "Contamination", quality AS "Quality",
 nullif(split_part(best, '_', 1), '') AS "Classification", TRY_CAST(nullif(split_part(best, '_', 2), '') AS DOUBLE) AS "Confidence",
 nullif(split_part(best, '_', 3), '') AS "Tax_Level" FROM taxonomy a FULL JOIN quality q ON a.BinID = q.BinID"""))
def table_taxa_quality(t: Tables):
    """Bin taxonomy and quality in one table."""
    return bin_plans.taxa_quality(taxonomy_table(t), part_quality(t))


# ---------------------------------------------------------------- genes


def bin_taxa(t: Tables):
    """Bins with the classification split into its parts."""
    table = bins(t)
    return bin_plans.taxa_quality(
        table.select("BinID", "Best_Classification"),
        table.select("BinID", "Enrichment", "Completeness", "Contamination", "Quality"),
    )


def bin_genes(t: Tables):
    """Gene rows of the bins, the enrichment coming from the locus tag."""
    return gene_plans.known_products(genes(t).drop("Enrichment"), "red rod").drop("Bin_Number")


_GENE_TABLES = {
    "bin_genes": """SELECT split_part(locus_tag, '_', 1) AS BinID, split_part(locus_tag, '_', 2) AS geneID, Enrichment, gene,
 EC_number, product FROM genes WHERE product <> 'red rod'""",
    "taxa": """SELECT *, nullif(split_part(Best_Classification, '_', 1), '') AS Classification,
 TRY_CAST(split_part(Best_Classification, '_', 2) AS DOUBLE) AS Confidence,
 nullif(split_part(Best_Classification, '_', 3), '') AS Tax_Level FROM bins""",
}
_AROMATIC = """SELECT EC_number, BinID, g.Enrichment, product, gene, Classification, Confidence, Tax_Level, Quality,
 General_Pathway FROM bin_genes g JOIN taxa USING (BinID) JOIN enzyme_pathway USING (EC_number)"""


@query(with_tables("genes bins enzyme_pathway", _AROMATIC, **_GENE_TABLES))
def table_aromatic_genes(t: Tables):
    """Genes of classified bins on a pathway, written as CSV and read back."""
    table = gene_plans.aromatic_genes(bin_genes(t), bin_taxa(t), enzyme_pathway(t))
    path = sinks.write_csv(table, scratch_path(t.spark, "aromatic"))
    return text.read_table(t.spark, path, table.schema)


@query(with_tables("genes bins enzyme_pathway", _AROMATIC + " WHERE Quality = 'High' AND Classification IS NOT NULL", **_GENE_TABLES))
def table_aromatic_genes_high(t: Tables):
    """The same for high-quality bins with a classification."""
    return gene_plans.aromatic_genes(bin_genes(t), bin_taxa(t), enzyme_pathway(t), "High")


@query(with_tables("genes bins enzyme_pathway", """SELECT BinID, geneID AS "geneID", gene, product, EC_number, General_Pathway
 FROM bin_genes JOIN taxa USING (BinID) LEFT JOIN (SELECT * FROM enzyme_pathway WHERE General_Pathway = 'ECONOMY' AND EC_number < 'EC 2') USING (EC_number)
 WHERE regexp_matches(product, 'hot.') OR regexp_matches(product, '.bolt') OR General_Pathway IS NOT NULL""", **_GENE_TABLES))
def table_regex_genes(t: Tables):
    """Genes by product pattern or by one pathway's enzymes."""
    pathway = enzyme_pathway(t).filter((F.col("General_Pathway") == "ECONOMY") & (F.col("EC_number") < "EC 2"))
    rows = gene_plans.regex_genes(bin_genes(t), bin_taxa(t), pathway, ["hot.", ".bolt"])
    return rows.select("BinID", "geneID", "gene", "product", "EC_number", "General_Pathway")


def curated_products(t: Tables):
    """Curated list: pathway name, product, product name of the pathway database."""
    listed = t.part.filter(F.col("p_size") > 49).select("p_name", "p_type").distinct()
    return listed.select(
        F.col("p_type").alias("MetaCyc_Pathway_Name"),
        F.col("p_name").alias("prokka_product"),
        F.upper("p_name").alias("metacyc_product"),
    )


_CURATED = """SELECT DISTINCT p_type AS pathway_name, p_name AS prokka_product, upper(p_name) AS metacyc_product
 FROM part WHERE p_size > 49"""


@query(with_tables("genes", """SELECT BinID, geneID AS "geneID", gene, product, EC_number, Enrichment, prokka_product,
 pathway_name AS "MetaCyc_Pathway_Name", metacyc_product FROM bin_genes JOIN curated ON product = prokka_product""",
    bin_genes=_GENE_TABLES["bin_genes"], curated=_CURATED))
def table_pathway_genes(t: Tables):
    """Genes whose product is on the curated pathway list."""
    return gene_plans.pathway_genes(bin_genes(t), curated_products(t)).select(
        "BinID", "geneID", "gene", "product", "EC_number", "Enrichment", "prokka_product",
        "MetaCyc_Pathway_Name", "metacyc_product",
    )


HEAT = {"Brand#3": "Terephthalate", "Brand#7": "Protocatechuate", "no_name": "Cleave Ethylene Glycol"}


@query(with_tables("genes bins", """SELECT gene, product, CASE gene WHEN 'Brand#3' THEN 'Terephthalate' WHEN 'Brand#7' THEN 'Protocatechuate'
 WHEN 'no_name' THEN 'Cleave Ethylene Glycol' ELSE gene END AS pathway, COUNT(*) AS n FROM (
 SELECT CASE WHEN product = 'blue ring' THEN 'no_name' ELSE gene END AS gene, product FROM bin_genes FULL JOIN taxa USING (BinID)
 WHERE product = 'blue ring' OR gene IN ('Brand#3', 'Brand#7', 'Brand#9')) GROUP BY 1, 2, 3""", **_GENE_TABLES))
def table_gene_heat(t: Tables):
    """Listed genes per name, product and pathway category."""
    return gene_plans.gene_heat(
        bin_genes(t), bin_taxa(t), "blue ring", ["Brand#3", "Brand#7", "Brand#9"], HEAT
    )


# ---------------------------------------------------------------- expression


def locus_fact(t: Tables):
    """The fact table with one row per locus; the files of one enrichment list every locus."""
    fact = expression.assemble_fact(pathways=None, **fact_inputs(t))
    complete = F.col("Enrichment") == "Alpha"
    return fact.withColumns(
        {s: F.when(complete, F.coalesce(s, F.lit(0))).otherwise(F.col(s)) for s in SUBSTRATES}
    )


def _any(op: str) -> str:
    return "(" + " OR ".join(f'"{s}" {op}' for s in SUBSTRATES) + ")"


_FACT = {
    "merged": MERGED_SQL,
    "fact": f"""SELECT DISTINCT locus_tag, {wide_sql("CASE WHEN Enrichment = 'Alpha' THEN coalesce({s}, 0) ELSE {s} END")}, Enrichment, gene, EC_number, product, contigName, BinID,
 Best_Classification, Completeness, Contamination, Quality FROM merged LEFT JOIN genes USING (locus_tag)
 LEFT JOIN locus_contig USING (locus_tag) LEFT JOIN contig_bin USING (contigName, Enrichment)
 LEFT JOIN bins USING (BinID, Enrichment) WHERE BinID IS NOT NULL""",
}


def _strict(keys: str) -> dict[str, str]:
    """Strict group totals and their long form."""
    sums = wide_sql('CASE WHEN COUNT("{s}") = COUNT(*) THEN SUM("{s}")::BIGINT END')
    long = " UNION ALL ".join(
        f"SELECT {keys}, Best_Classification, '{s}' AS Substrate, coalesce(\"{s}\", 0) AS Counts FROM strict" for s in SUBSTRATES
    )
    return {
        "strict": f"SELECT * FROM (SELECT {keys}, Best_Classification, {sums} FROM fact WHERE {_any('> 0')}"
        f" GROUP BY {keys}, Best_Classification) WHERE {_any('IS NOT NULL')}",
        "long": long,
    }


@query(with_tables(FACT_TABLES, """SELECT g.BinID, product, g.Enrichment, gene, pathway_name AS "MetaCyc_Pathway_Name", split_part(Best_Classification, '_', 1) AS "Taxa",
 Substrate AS "Substrate", Counts AS "Counts", round(Counts / total, 9) AS percent_expressed_gene_per_bin
 FROM (SELECT * FROM bin_genes JOIN curated ON product = prokka_product) g JOIN shares USING (BinID, product, Enrichment)""",
    **_FACT, **_strict("BinID, product, Enrichment"), bin_genes=_GENE_TABLES["bin_genes"], curated=_CURATED,
    shares="SELECT *, SUM(Counts) OVER (PARTITION BY BinID, Substrate) AS total FROM long WHERE Counts <> 0"))
def table_expression_share(t: Tables):
    """Pathway genes with their share of all counts of the bin and substrate."""
    members = gene_plans.pathway_genes(bin_genes(t), curated_products(t))
    shares = expression.expression_share(locus_fact(t), members, ["BinID", "product", "Enrichment"])
    return shares.select(
        "BinID", "product", "Enrichment", "gene", "MetaCyc_Pathway_Name", "Taxa",
        "Substrate", "Counts", F.round("percent_expressed_gene_per_bin", 9).alias("percent_expressed_gene_per_bin"),
    )


@query(with_tables(FACT_TABLES, """SELECT Enrichment AS "Enrichment", product, coalesce(split_part(Best_Classification, '_', 1), 'Unclassified') AS "Taxa",
 SUM(Counts)::BIGINT AS "Counts" FROM long WHERE Counts > 0 GROUP BY 1, 2, 3""", **_FACT, **_strict("BinID, product, Enrichment")))
def table_pathway_totals(t: Tables):
    """Counts per taxon, product and enrichment."""
    return expression.pathway_totals(
        locus_fact(t), ["BinID", "product", "Enrichment"], ["Enrichment", "product"]
    )


_BUCKET = """CASE WHEN Counts <= 100 THEN '1 to 100' WHEN Counts <= 500 THEN '100 to 500'
 WHEN Counts <= 1000 THEN '500 to 1,000' ELSE '> 1,000' END"""


@query(with_tables(FACT_TABLES, f"""SELECT locus_tag, gene, product, BinID, Quality, Substrate AS "Substrate", Counts AS "Counts",
 {_BUCKET} AS "Num_Transcripts" FROM ({' UNION ALL '.join(f"SELECT locus_tag, gene, product, BinID, Quality, '{s}' AS Substrate, {s} AS Counts FROM fact" for s in SUBSTRATES)})
 WHERE Counts <> 0 AND Quality = 'Medium' AND (product = 'blue ring' OR gene IN ('Brand#3', 'Brand#7'))""", **_FACT))
def table_known_genes(t: Tables):
    """Known genes of one quality tier with their transcript class per substrate."""
    fact = locus_fact(t).filter(F.col("Quality") == "Medium")
    known = fact.filter(gene_plans.whitelist("blue ring", ["Brand#3", "Brand#7"]))
    return expression.count_tiles(known, ["locus_tag", "gene", "product", "BinID", "Quality"])


@query(with_tables("genes", """SELECT product, gene, EC_number, Enrichment AS "Enrichment" FROM genes"""))
def table_export(t: Tables):
    """Gene rows for sharing, written as CSV and read back."""
    out = expression.gene_export(genes(t).drop("Enrichment"), ["product", "gene", "EC_number"])
    path = sinks.write_csv(out, scratch_path(t.spark, "export"))
    return text.read_table(t.spark, path, out.schema)
