"""Reshaping, joins, sort, limit and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from biotables.catalog.bindings import (
    contig_bin,
    counts_long,
    enzyme_pathway,
    gene_features,
    genes,
    bins,
    locus_contig,
    locus_wide,
    parts,
    results_table,
    sales,
    taxon_counts,
    taxon_samples,
    wide_sql,
    with_tables,
)
from biotables.catalog.registry import Tables, query
from biotables.operators import joins, reshape
from biotables.operators.totals import descending_rank
from biotables.plans import expression
from biotables.plans.expression import SUBSTRATES
from biotables.session import materialize

# ---------------------------------------------------------------- reshape


@query(with_tables("locus_wide", " UNION ALL ".join(
    f"SELECT l_suppkey, l_partkey, '{s}' AS substrate, \"{s}\" AS count FROM locus_wide" for s in SUBSTRATES)))
def pivot_longer(t: Tables):
    """One row per substrate column; NULL cells stay."""
    return reshape.pivot_longer(locus_wide(t), SUBSTRATES, "substrate", "count")


@query(with_tables("sales", f"""SELECT l_suppkey, l_partkey, {wide_sql("max(CASE WHEN substrate = '{s}' THEN first END)")}
 FROM (SELECT l_suppkey, l_partkey, substrate, min(count) AS first FROM sales GROUP BY 1, 2, 3) GROUP BY 1, 2"""))
def pivot_wider_first(t: Tables):
    """One value per cell; a second one would raise."""
    cells = sales(t).groupBy("l_suppkey", "l_partkey", "substrate").agg(F.min("count").alias("first"))
    return reshape.pivot_wider_first(cells, ["l_suppkey", "l_partkey"], "substrate", "first", SUBSTRATES)


@query(with_tables("sales", f"""SELECT l_partkey,
 {wide_sql("coalesce(SUM(CASE WHEN substrate = '{s}' THEN count END), 0)::BIGINT")} FROM sales GROUP BY 1"""))
def pivot_wider_sum(t: Tables):
    return reshape.pivot_wider_sum(sales(t), ["l_partkey"], "substrate", "count", SUBSTRATES)


@query("""SELECT COUNT(*) AS n_rows, COUNT(DISTINCT (l_orderkey, l_linenumber)) AS n_keys,
 (SELECT COUNT(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1))
 AS n_repeated_keys FROM lineitem""")
def key_uniqueness(t: Tables):
    """Row names as a key column: is the key unique?"""
    return reshape.key_report(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(with_tables("taxon_counts taxon_samples gene_features", """SELECT sample, feature,
 coalesce(count, 0)::BIGINT AS "Abundance", substrate, taxon, gene, product, EC_number
 FROM taxon_samples CROSS JOIN gene_features LEFT JOIN taxon_counts USING (sample, feature)"""))
def melt_bundle(t: Tables):
    """Counts with sample and feature columns, zero cells included."""
    return reshape.melt_bundle(taxon_counts(t), taxon_samples(t), gene_features(t))


# ---------------------------------------------------------------- joins


@query("""WITH c AS (SELECT nullif(c_nationkey, 7) AS nation, COUNT(*) AS customers FROM customer GROUP BY 1),
 s AS (SELECT nullif(s_nationkey, 9) AS nation, COUNT(*) AS suppliers FROM supplier GROUP BY 1)
 SELECT coalesce(c.nation, s.nation) AS nation, customers, suppliers
 FROM c FULL JOIN s ON c.nation IS NOT DISTINCT FROM s.nation""")
def natural_full_join(t: Tables):
    """Full join on the shared column; a missing key meets a missing key."""
    c = t.customer.groupBy(F.nullif("c_nationkey", F.lit(7)).alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    s = t.supplier.groupBy(F.nullif("s_nationkey", F.lit(9)).alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    return joins.natural_join(c, s, "full")


@query(with_tables("counts_long", f"""SELECT locus_tag, {wide_sql()} FROM counts_long
 WHERE NOT starts_with(locus_tag, '__') GROUP BY 1"""))
def merge_counts(t: Tables):
    """Count files of all samples to one row per locus; special rows dropped."""
    return expression.merge_counts(counts_long(t))


def count_files(t: Tables) -> list:
    """Ten count files ``(locus_tag, <substrate>)``: two enrichments, five substrates."""
    long = counts_long(t).withColumn("locus_tag", F.regexp_replace("locus_tag", "metabat[.].*_", "_"))
    long = long.groupBy("locus_tag", "substrate").agg(F.sum("count").alias("count"))
    files = []
    for first in ("Alpha", "Beta"):
        rows = long.filter(F.col("locus_tag").startswith(first))
        for s in SUBSTRATES:
            files.append(rows.filter(F.col("substrate") == s).select("locus_tag", F.col("count").alias(s)))
    return files


def _natural_sql() -> str:
    alpha = ", ".join(f"max(CASE WHEN substrate = '{s}' THEN count END) AS \"{s}\"" for s in SUBSTRATES)
    beta = " UNION ALL ".join(
        "SELECT locus_tag, "
        + ", ".join("count" if s == own else "NULL" for s in SUBSTRATES)
        + f" FROM merged WHERE starts_with(locus_tag, 'Beta') AND substrate = '{own}'"
        for own in SUBSTRATES
    )
    return with_tables(
        "counts_long",
        f"SELECT locus_tag, {alpha} FROM merged WHERE starts_with(locus_tag, 'Alpha') GROUP BY 1 UNION ALL {beta}",
        merged="""SELECT regexp_replace(locus_tag, 'metabat[.].*_', '_') AS locus_tag, substrate,
 SUM(count)::BIGINT AS count FROM counts_long WHERE NOT starts_with(locus_tag, '__') GROUP BY 1, 2""",
    )


@query(_natural_sql())
def merge_counts_natural(t: Tables):
    """Successive natural full joins: the second enrichment falls into fragments."""
    return expression.merge_counts_natural(count_files(t))


@query(with_tables("parts enzyme_pathway", """SELECT l_partkey, gene, EC_number, General_Pathway
 FROM parts LEFT JOIN enzyme_pathway USING (EC_number)"""))
def left_join_key(t: Tables):
    genes_only = parts(t).select("l_partkey", "gene", "EC_number")
    return joins.key_join(genes_only, enzyme_pathway(t), ["EC_number"], "left")


@query(with_tables("loci locus_contig contig_bin", f"""SELECT l.contigName, l.Enrichment, l.locus_tag, c.BinID FROM
 (SELECT *, CASE WHEN starts_with(locus_tag, 'Alpha') THEN 'Alpha' ELSE 'Beta' END AS Enrichment FROM locus_contig) l
 LEFT JOIN contig_bin c ON l.contigName IS NOT DISTINCT FROM c.contigName AND l.Enrichment IS NOT DISTINCT FROM c.Enrichment"""))
def natural_left_join(t: Tables):
    """Left join on all shared columns (contig and enrichment), NULL-safe."""
    located = locus_contig(t).withColumn(
        "Enrichment", F.when(F.col("locus_tag").startswith("Alpha"), "Alpha").otherwise("Beta")
    )
    return joins.natural_join(located, contig_bin(t), "left")


@query(with_tables("loci bins enzyme_pathway", """SELECT gene, EC_number, BinID, Quality, General_Pathway FROM (
 SELECT *, (CASE WHEN l_suppkey % 2 = 0 THEN 'Alpha' ELSE 'Beta' END) || 'metabat.' || l_suppkey AS BinID FROM loci)
 JOIN bins USING (BinID) JOIN enzyme_pathway USING (EC_number)"""))
def inner_join_chain(t: Tables):
    """Genes with bins (shared columns), then with pathways by enzyme."""
    gene_rows = genes(t).select(
        F.get(F.split("locus_tag", "_"), 0).alias("BinID"), "gene", "EC_number", "Enrichment"
    )
    binned = joins.natural_join(gene_rows, bins(t), "inner")
    return joins.key_join(binned, enzyme_pathway(t), ["EC_number"]).select(
        "gene", "EC_number", "BinID", "Quality", "General_Pathway"
    )


@query(with_tables("parts enzyme_pathway", """SELECT l_partkey, EC_number, General_Pathway
 FROM parts JOIN enzyme_pathway USING (EC_number)"""))
def left_join_required(t: Tables):
    """Left join whose key must be found; planned as an inner join."""
    gene_rows = parts(t).select("l_partkey", "EC_number")
    return joins.left_join_required(gene_rows, enzyme_pathway(t), ["EC_number"], "General_Pathway")


@query(with_tables("results_table", """SELECT feature, comparison, lfc, o_totalprice AS annotation
 FROM results_table JOIN orders ON feature = o_orderkey"""))
def annotate_results(t: Tables):
    """Feature annotation joined to result rows by id, never by position."""
    notes = t.orders.select(F.col("o_orderkey").alias("feature"), F.col("o_totalprice").alias("annotation"))
    return joins.key_join(results_table(t).select("feature", "comparison", "lfc"), notes, ["feature"])


_REPEATED = """repeated AS (SELECT nullif(p_type, 'PROMO') AS kind, p_size FROM part GROUP BY 1, 2 HAVING COUNT(*) > 8)"""


def _repeated(t: Tables):
    rows = t.part.select("p_partkey", F.nullif("p_type", F.lit("PROMO")).alias("kind"), "p_size")
    often = rows.groupBy("kind", "p_size").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 8)
    return rows, often


@query(f"""WITH {_REPEATED} SELECT p_partkey, nullif(p_type, 'PROMO') AS kind, p_size,
 EXISTS (SELECT 1 FROM repeated r WHERE r.kind IS NOT DISTINCT FROM nullif(p_type, 'PROMO'))
 AND p_size IN (SELECT p_size FROM repeated) AS flagged FROM part""")
def membership_flag(t: Tables):
    """Both columns occur in the list, each on its own."""
    rows, often = _repeated(t)
    return joins.membership_flag(rows, often, ["kind", "p_size"], "flagged")


@query(f"""WITH {_REPEATED} SELECT p_partkey, nullif(p_type, 'PROMO') AS kind, p.p_size,
 EXISTS (SELECT 1 FROM repeated r WHERE r.kind IS NOT DISTINCT FROM nullif(p_type, 'PROMO') AND r.p_size = p.p_size)
 AS flagged FROM part p""")
def membership_flag_pair(t: Tables):
    """The combination of both columns occurs in the list."""
    rows, often = _repeated(t)
    return joins.membership_flag(rows, often, ["kind", "p_size"], "flagged", paired=True)


def fact_inputs(t: Tables):
    return {
        "counts": expression.merge_counts(counts_long(t)),
        "genes": genes(t, "contigName"),  # genes and their contigs in one pass over the loci
        "loci": None,
        "contigs": contig_bin(t),
        "taxa": materialize(bins(t), "taxa"),  # a stored table, so its size is known to the planner
        "distinct_inputs": True,  # grouped or distinct already
    }


FACT_TABLES = "counts_long genes enzyme_pathway locus_contig contig_bin bins"
MERGED_SQL = f"SELECT locus_tag, {wide_sql()} FROM counts_long WHERE NOT starts_with(locus_tag, '__') GROUP BY 1"


FACT_SQL = with_tables(FACT_TABLES, f"""SELECT DISTINCT locus_tag, {wide_sql('"{s}"')}, Enrichment, gene, EC_number, product,
 coalesce(General_Pathway, 'Unknown_Pathway') AS "General_Pathway", contigName, BinID, Best_Classification,
 round(Completeness, 6) AS "Completeness", round(Contamination, 6) AS "Contamination", Quality
 FROM merged LEFT JOIN genes USING (locus_tag) LEFT JOIN enzyme_pathway USING (EC_number)
 LEFT JOIN locus_contig USING (locus_tag) LEFT JOIN contig_bin USING (contigName, Enrichment)
 LEFT JOIN bins USING (BinID, Enrichment) WHERE BinID IS NOT NULL""", merged=MERGED_SQL)


@query(FACT_SQL)
def fact_assembly(t: Tables):
    """The main table: counts, gene, pathway, contig, bin, taxonomy and quality per locus."""
    fact = expression.assemble_fact(pathways=enzyme_pathway(t), **fact_inputs(t))
    return fact.withColumn("Completeness", F.round("Completeness", 6)).withColumn(
        "Contamination", F.round("Contamination", 6)
    )


@query(FACT_SQL)
def fact_from_buckets(t: Tables):
    """The main table from loci stored in buckets: counts merge and meet their genes inside a bucket."""
    store = expression.LocusStore.write(counts_long(t), genes(t, "contigName"))
    fact = store.fact(enzyme_pathway(t), contig_bin(t), materialize(bins(t), "taxa"))
    return fact.withColumn("Completeness", F.round("Completeness", 6)).withColumn("Contamination", F.round("Contamination", 6))


@query(with_tables("counts_long genes", """SELECT gene, SUM(count)::BIGINT AS count, COUNT(*) FILTER (count > 0) AS n_loci FROM
 (SELECT locus_tag, SUM(count) AS count FROM counts_long WHERE NOT starts_with(locus_tag, '__') GROUP BY 1)
 JOIN genes USING (locus_tag) GROUP BY 1"""))
def gene_totals_bucketed(t: Tables):
    """Counts per gene from stored loci."""
    return expression.LocusStore.write(counts_long(t), genes(t)).gene_totals("gene")


# ---------------------------------------------------------------- sort, limit, sets


@query("""SELECT p_type, n, RANK() OVER (ORDER BY n DESC) AS position FROM
 (SELECT p_type || ' ' || p_size AS p_type, COUNT(*) AS n FROM part GROUP BY 1)""")
def order_by_count(t: Tables):
    """Groups by count, largest first, with their rank."""
    kind = F.concat_ws(" ", "p_type", "p_size").alias("p_type")
    counted = t.part.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
    return descending_rank(counted, "n", "position").orderBy("position", "p_type")


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders")
def order_by_label(t: Tables):
    return t.orders.select("o_orderpriority", "o_orderkey", "o_totalprice").orderBy("o_orderpriority", "o_orderkey")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_n(t: Tables):
    """The first rows of an ordered table."""
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return rows.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("""SELECT 'customer' AS origin, c_nationkey AS nationkey, c_acctbal AS acctbal FROM customer
 UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier""")
def union_all(t: Tables):
    """Stack tables by column name; repeats stay."""
    c = t.customer.select(
        F.lit("customer").alias("origin"), F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal")
    )
    s = t.supplier.select(
        F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").alias("nationkey"), F.lit("supplier").alias("origin")
    )
    return c.unionByName(s)


@query("""SELECT p_brand AS enzyme, p_type AS pathway FROM part WHERE p_size < 30
 UNION SELECT p_brand, p_type FROM part WHERE p_size > 20""")
def union_distinct(t: Tables):
    """Full join on all columns: the union of two keyed lists."""
    rows = t.part.select("p_size", F.col("p_brand").alias("enzyme"), F.col("p_type").alias("pathway"))
    low = rows.filter(F.col("p_size") < 30).drop("p_size")
    return low.unionByName(rows.filter(F.col("p_size") > 20).drop("p_size")).distinct()
