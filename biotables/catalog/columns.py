"""Projections, filters, conditionals and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from biotables.catalog.bindings import (
    SUBSTRATE_OF,
    TIER_SQL,
    enrichment,
    genes,
    locus_wide,
    parts,
    wide_sql,
    with_tables,
)
from biotables.catalog.registry import Tables, query
from biotables.functions import (
    any_match,
    any_not_null,
    any_positive,
    best_classification as deepest_rank,
    category_rank as rank_of,
    count_bucket as bucket_of,
    gff_attribute,
    ifelse_na as conditional,
    numeric_value,
    parse_bin_stats as bin_stat_columns,
    parse_bin_tag,
    parse_gtf,
    parse_orf_id as orf_columns,
    parse_rank_score as rank_columns,
    quality_tier,
    recode,
    replace_first as first_replaced,
    separate as split_columns,
    split_list,
    unite as united,
)
from biotables.operators.figures import limit_levels as keep_levels
from biotables.operators.reshape import explode_lists
from biotables.plans.expression import SUBSTRATES
from biotables.plans.genes import pathway_category, whitelist


@query("SELECT p_type, p_partkey, p_name, p_size FROM part")
def project_reorder(t: Tables):
    """Move a column first, drop others."""
    df = t.part.drop("p_brand", "p_retailprice")
    return df.select("p_type", *[c for c in df.columns if c != "p_type"])


@query("SELECT l_partkey AS locus_tag, l_quantity::BIGINT AS \"TPA\" FROM lineitem")
def project_rename(t: Tables):
    return t.lineitem.select(
        F.col("l_partkey").alias("locus_tag"), F.col("l_quantity").cast("bigint").alias("TPA")
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
 WHERE l_quantity > 40 AND l_returnflag = 'R'""")
def filter_compare(t: Tables):
    return t.lineitem.filter((F.col("l_quantity") > 40) & (F.col("l_returnflag") == "R")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"
    )


@query(with_tables("parts", """SELECT l_partkey, gene, product FROM parts
 WHERE product = 'blue ring' OR gene IN ('Brand#3', 'Brand#7', 'Brand#25')"""))
def filter_whitelist(t: Tables):
    """Product equals the named one, or the gene is on the list."""
    kept = parts(t).filter(whitelist("blue ring", ["Brand#3", "Brand#7", "Brand#25"]))
    return kept.select("l_partkey", "gene", "product")


@query("""SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
 WHERE n_name IN ('NATION_1', 'NATION_4', 'NATION_9', 'NATION_16')""")
def filter_taxa(t: Tables):
    taxa = t.nation.filter(F.col("n_name").isin("NATION_1", "NATION_4", "NATION_9", "NATION_16"))
    named = taxa.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return t.customer.join(named, "c_nationkey").select("c_custkey", "n_name")


@query(with_tables("locus_wide", """SELECT * FROM locus_wide
 WHERE (greatest("DCPET", "HDPE") > 40 OR "EG" > 45) AND coalesce("TPA", "TA") IS NOT NULL"""))
def filter_any_expressed(t: Tables):
    high = any_positive([F.col("DCPET") - 40, F.col("HDPE") - 40, F.col("EG") - 45])
    return locus_wide(t).filter(high & any_not_null(["TPA", "TA"]))


@query(with_tables("locus_wide", """SELECT l_suppkey, l_partkey, CASE WHEN "TPA" > "EG" IS NULL THEN NULL
 WHEN "TPA" > "EG" THEN 'more' ELSE 'less' END AS direction FROM locus_wide"""))
def ifelse_na(t: Tables):
    """NULL condition gives NULL."""
    direction = conditional(F.col("TPA") > F.col("EG"), F.lit("more"), F.lit("less"))
    return locus_wide(t).select("l_suppkey", "l_partkey", direction.alias("direction"))


@query(f"""SELECT s_suppkey, round(completeness, 6) AS completeness, contamination, CASE WHEN completeness IS NULL
 AND contamination < 10 THEN NULL ELSE {TIER_SQL} END AS quality FROM (
 SELECT s_suppkey, CASE WHEN s_nationkey <> 3 THEN abs(s_acctbal) % 100 END AS completeness,
 s_nationkey * 0.6::DOUBLE AS contamination FROM supplier)""")
def bin_quality_tier(t: Tables):
    df = t.supplier.select(
        "s_suppkey",
        F.when(F.col("s_nationkey") != 3, F.abs("s_acctbal") % 100).alias("completeness"),
        (F.col("s_nationkey") * F.lit(0.6)).alias("contamination"),
    )
    return df.withColumn("quality", quality_tier("completeness", "contamination")).withColumn(
        "completeness", F.round("completeness", 6)
    )


@query("""SELECT l_suppkey, CASE WHEN n <= 100 THEN '1 to 100' WHEN n <= 500 THEN '100 to 500'
 WHEN n <= 1000 THEN '500 to 1,000' ELSE '> 1,000' END AS bucket, n FROM (
 SELECT l_suppkey, l_partkey, SUM(l_quantity * l_linenumber)::BIGINT AS n FROM lineitem GROUP BY 1, 2)""")
def count_bucket(t: Tables):
    sums = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(
        F.sum(F.col("l_quantity") * F.col("l_linenumber")).cast("bigint").alias("n")
    )
    return sums.select("l_suppkey", bucket_of("n").alias("bucket"), "n")


RECODE = {"Brand#3": "Terephthalate", "Brand#7": "Terephthalate", "Brand#12": "Catechol",
          "no_name": "Cleave Ethylene Glycol"}


@query(with_tables("parts", """SELECT l_partkey, name AS gene, CASE name WHEN 'Brand#3' THEN 'Terephthalate'
 WHEN 'Brand#7' THEN 'Terephthalate' WHEN 'Brand#12' THEN 'Catechol' WHEN 'no_name' THEN 'Cleave Ethylene Glycol'
 ELSE name END AS pathway FROM (SELECT l_partkey, CASE WHEN product IS NULL THEN NULL
 WHEN product = 'red bolt' THEN 'no_name' ELSE gene END AS name FROM
 (SELECT l_partkey, gene, nullif(product, 'cold rod') AS product FROM parts))"""))
def pathway_recode(t: Tables):
    """Gene to pathway category with fall-through; a missing product makes it missing."""
    name, pathway = pathway_category("red bolt", RECODE)
    df = parts(t).withColumn("product", F.nullif("product", F.lit("cold rod")))
    return df.select("l_partkey", name.alias("gene"), pathway.alias("pathway"))


@query("""SELECT p_partkey, coalesce(CASE WHEN p_size > 40 THEN p_name END, CASE WHEN p_size > 30 THEN p_brand END,
 CASE WHEN p_size > 20 THEN p_type END, 'fill later') AS best FROM part""")
def best_classification(t: Tables):
    """Deepest filled rank."""
    ranks = {
        "superkingdom": F.lit(None).cast("string"),
        "phylum": F.when(F.col("p_size") > 20, F.col("p_type")),
        "family": F.when(F.col("p_size") > 30, F.col("p_brand")),
        "species": F.when(F.col("p_size") > 40, F.col("p_name")),
    }
    return t.part.select("p_partkey", deepest_rank(ranks).alias("best"))


@query(with_tables("locus_wide", f"SELECT l_suppkey, l_partkey, {wide_sql('coalesce({s}, 0)')} FROM locus_wide"))
def null_default(t: Tables):
    return locus_wide(t).fillna(0, subset=SUBSTRATES)


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'TPA' WHEN '2-HIGH' THEN 'DCPET'
 WHEN '3-MEDIUM' THEN 'HDPE' WHEN '4-NOT SPECIFIED' THEN 'TA' WHEN '5-LOW' THEN 'EG' END AS substrate FROM orders""")
def label_recode(t: Tables):
    return t.orders.select("o_orderkey", recode("o_orderpriority", SUBSTRATE_OF).alias("substrate"))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '5-LOW' THEN 3
 END AS level FROM orders""")
def category_rank(t: Tables):
    """Position in an ordered level list; values outside of it have none."""
    return t.orders.select(
        "o_orderkey", rank_of("o_orderpriority", ["3-MEDIUM", "1-URGENT", "5-LOW"]).alias("level")
    )


@query("""SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '5-LOW' THEN 1 ELSE 2 END AS level
 FROM orders WHERE o_orderpriority IN ('5-LOW', '2-HIGH')""")
def limit_levels(t: Tables):
    """Axis limits: rows outside the list vanish, the rest is ordered by it."""
    return keep_levels(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["5-LOW", "2-HIGH"])


@query("""SELECT 'Gene_' || l_partkey AS gene_id, l_suppkey || '_' || l_returnflag AS sample,
 'R vs. N' AS comparison FROM lineitem""")
def derive_ids(t: Tables):
    return t.lineitem.select(
        united([F.lit("Gene"), "l_partkey"]).alias("gene_id"),
        united(["l_suppkey", "l_returnflag"]).alias("sample"),
        F.lit("R vs. N").alias("comparison"),
    )


# ---------------------------------------------------------------- text


@query("""SELECT p_partkey, split_part(p_name, ' ', 1) AS first,
 CASE WHEN p_size > 10 THEN split_part(p_name, ' ', 2) || '' ELSE split_part(p_name, ' ', 2) END AS second,
 NULLIF(split_part(p_name, ' ', 3), '') AS third FROM part""")
def separate(t: Tables):
    """Regex split into named columns; extra pieces dropped, missing ones NULL."""
    # blanks, and for small parts a longer run of them
    cell = F.when(F.col("p_size") > 10, F.col("p_name")).otherwise(
        F.regexp_replace("p_name", " ", "   ")
    )
    return t.part.select("p_partkey", *split_columns(cell, ["first", "second", "third"], " +"))


@query("""SELECT p_partkey, coalesce(nullif(p_type, 'PROMO'), 'NA') || '_' || p_size AS id FROM part""")
def unite(t: Tables):
    return t.part.select(
        "p_partkey", united([F.nullif("p_type", F.lit("PROMO")), "p_size"]).alias("id")
    )


@query("""SELECT event_id, TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k,
 CASE WHEN user_id > 50 THEN 1e-05::DOUBLE ELSE user_id::DOUBLE END AS exponent,
 CASE WHEN user_id > 50 THEN NULL ELSE user_id::DOUBLE END AS exponent_compat FROM events""")
def numeric_extract(t: Tables):
    """Number inside a text; the compatible form loses exponents."""
    cell = F.when(F.col("user_id") > 50, "GC std: 1e-05").otherwise(
        F.concat(F.lit("GC std: "), F.col("user_id"))
    )
    return t.events.select(
        "event_id",
        numeric_value("props").alias("k"),
        numeric_value(cell).alias("exponent"),
        numeric_value(cell, compat=True).alias("exponent_compat"),
    )


@query("""SELECT page_id, regexp_replace(regexp_replace(html, '</li>', ''), '<li>', '') AS html FROM pages""")
def replace_first(t: Tables):
    """First occurrence only, over the whole text."""
    return t.pages.select(
        "page_id", first_replaced(first_replaced("html", "</li>", ""), "<li>", "").alias("html")
    )


@query("""SELECT doc_id FROM documents WHERE regexp_matches(text, 'The.') OR regexp_matches(text, '.license.')
 OR regexp_matches(text, '.@') OR lang = 'fr'""")
def regex_any(t: Tables):
    hit = any_match("text", ["The.", ".license.", ".@"])
    return t.documents.filter(hit | (F.col("lang") == "fr")).select("doc_id")


@query("""SELECT DISTINCT p_brand AS pathway, product FROM (SELECT p_brand, unnest([p_name, p_type] ||
 list_transform(range(p_size, p_size + 38), lambda i: i::VARCHAR)) AS product FROM part)""")
def explode_pathway_lists(t: Tables):
    """List cells of 40 items to distinct (pathway, product) rows."""
    numbers = F.expr("array_join(transform(sequence(p_size, p_size + 37), i -> string(i)), ' // ')")
    cell = F.concat("p_name", F.lit(" // "), "p_type", F.lit(" / "), numbers)
    return explode_lists(t.part, [F.col("p_brand").alias("pathway")], split_list(cell), "product")


@query("""SELECT p_partkey, p_name AS "Classification", CASE WHEN p_size <= 45 THEN lower(p_type) END AS "Tax_Level",
 CASE WHEN p_size <= 45 THEN '0.' || lpad(p_size::VARCHAR, 2, '0') END AS "Confidence" FROM part""")
def parse_rank_score(t: Tables):
    """``Name (rank): score``; an entry without a rank has neither rank nor score."""
    scored = F.concat(
        "p_name", F.lit(" ("), F.lower("p_type"), F.lit("): 0."), F.lpad(F.col("p_size").cast("string"), 2, "0")
    )
    entry = F.when(F.col("p_size") <= 45, scored).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", *rank_columns(entry))


@query("""SELECT DISTINCT enr || 'metabat.' || l_suppkey AS "BinID", p_size || '_' || l_linenumber AS "contigName",
 enr AS "Enrichment", l_suppkey::VARCHAR AS "Bin_Number" FROM (SELECT l_suppkey, l_linenumber, p_size,
 CASE WHEN l_suppkey % 2 = 0 THEN 'Alpha' ELSE 'Beta' END AS enr FROM lineitem JOIN part ON l_partkey = p_partkey)""")
def parse_orf_id(t: Tables):
    """``<enrichment>metabat.<n>.fa_<a>_<b>_<orf>`` to bin, contig, enrichment, bin number."""
    rows = t.lineitem.select("l_suppkey", "l_partkey", "l_linenumber").join(
        parts(t).select("l_partkey", "p_size"), "l_partkey"
    )
    orf = F.concat(
        enrichment("l_suppkey"), F.lit("metabat."), F.col("l_suppkey"), F.lit(".fa_"), F.col("p_size"),
        F.lit("_"), F.col("l_linenumber"), F.lit("_"), F.col("l_partkey"),
    )
    return rows.select(*orf_columns(orf)).distinct()


@query("""SELECT DISTINCT 'contig_' || l_suppkey AS "contigName", 'tag_' || l_partkey AS locus_tag,
 'Prodigal' AS prodigal FROM lineitem""")
def parse_gtf_attributes(t: Tables):
    attributes = F.concat(
        F.lit('transcript_id "t'), F.col("l_orderkey"), F.lit('"; gene_id "tag_'), F.col("l_partkey"), F.lit('";')
    )
    gtf = t.lineitem.select(
        F.concat(F.lit("contig_"), F.col("l_suppkey")).alias("V1"),
        F.lit("Prodigal:002006").alias("V2"),
        attributes.alias("V9"),
    )
    return parse_gtf(gtf)


@query("""SELECT 'rna' || l_partkey AS transcript_id, 'gene' || l_suppkey AS gene_id, COUNT(*) AS n
 FROM lineitem GROUP BY 1, 2""")
def gff_transcripts(t: Tables):
    """GFF attributes to transcript and gene ids."""
    attributes = F.concat(
        F.lit("ID=rna"), F.col("l_partkey"), F.lit(";Parent=gene"), F.col("l_suppkey"), F.lit(";note=x y")
    )
    ids = t.lineitem.select(
        gff_attribute(attributes, "ID").alias("transcript_id"),
        gff_attribute(attributes, "Parent").alias("gene_id"),
    )
    return ids.groupBy("transcript_id", "gene_id").agg(F.count(F.lit(1)).alias("n"))


@query(with_tables("loci", """SELECT enr || 'metabat.' || l_suppkey AS "BinID", l_partkey::VARCHAR AS "geneID",
 enr AS "Enrichment", l_suppkey::VARCHAR AS "Bin_Number" FROM (SELECT *,
 CASE WHEN l_suppkey % 2 = 0 THEN 'Alpha' ELSE 'Beta' END AS enr FROM loci)"""))
def parse_locus_tag(t: Tables):
    return genes(t).select(*parse_bin_tag("locus_tag"))


@query("""SELECT s_suppkey, 'k__' || s_name AS "Marker_Genes", (5000 + s_nationkey)::DOUBLE AS "Genomes",
 (100 + s_nationkey)::DOUBLE AS "Markers", 58::DOUBLE AS "Marker_Sets", pct / 100.0::DOUBLE AS "Completeness",
 s_nationkey / 10.0::DOUBLE AS "Contamination", 0.5::DOUBLE AS "GC", ((s_nationkey + 1) || 'e-05')::DOUBLE AS "GC_std",
 s_suppkey::DOUBLE AS "Genome_Size", 0::DOUBLE AS "Ambiguous_Bases", 7::DOUBLE AS "Scaffolds", 8::DOUBLE AS "Contigs",
 -9::DOUBLE AS "Predicted_Genes" FROM (SELECT *, floor(abs(s_acctbal) * 100)::BIGINT % 10000 AS pct FROM supplier)""")
def parse_bin_stats(t: Tables):
    return bin_stat_lines(t).select("s_suppkey", *bin_stat_columns("V2"))


def bin_stat_lines(t: Tables):
    """Headerless statistics rows ``(V1, V2)`` in the dict-like text format."""
    pct = F.floor(F.abs("s_acctbal") * 100) % 10000
    hundredths = F.concat(
        F.floor(pct / 100), F.lit("."), F.lpad((pct % 100).cast("string"), 2, "0")
    )
    tenths = F.concat(
        F.floor(F.col("s_nationkey") / 10), F.lit("."), F.col("s_nationkey") % 10
    )
    stats = F.concat(
        F.lit("{'marker lineage': 'k__"), "s_name", F.lit("', '# genomes': "), F.col("s_nationkey") + 5000,
        F.lit(", '# markers': "), F.col("s_nationkey") + 100, F.lit(", '# marker sets': 58, '0': 1, "),
        F.lit("'Completeness': "), hundredths, F.lit(", 'Contamination': "), tenths,
        F.lit(", 'GC': 0.5, 'GC std': "), F.col("s_nationkey") + 1, F.lit("e-05, 'Genome size': "), F.col("s_suppkey"),
        F.lit(", '# ambiguous bases': 0, '# scaffolds': 7, '# contigs': 8, '# predicted genes': -9}"),
    )
    name = F.concat(enrichment("s_suppkey"), F.lit("metabat."), F.col("s_suppkey"))
    return t.supplier.select("s_suppkey", name.alias("V1"), stats.alias("V2"))


@query("""SELECT p_partkey, TRY_CAST(CASE WHEN p_size > 25 THEN p_size::VARCHAR ELSE p_name END AS BIGINT) AS size,
 TRY_CAST(CASE WHEN p_size > 25 THEN p_size || '.5' ELSE 'NA' END AS DOUBLE) AS score FROM part""")
def safe_cast(t: Tables):
    size = F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise(F.col("p_name"))
    score = F.when(F.col("p_size") > 25, F.concat(F.col("p_size"), F.lit(".5"))).otherwise("NA")
    return t.part.select(
        "p_partkey", size.try_cast("bigint").alias("size"), score.try_cast("double").alias("score")
    )
