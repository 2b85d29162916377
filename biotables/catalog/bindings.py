"""How the given tables stand in for the tables of the domain, in Spark and in SQL.

A supplier is a genome bin, a part is a gene, the five order priorities are the five
substrates and the quantity is the transcript count. A locus is a (bin, gene) pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biotables.catalog.registry import Tables
from biotables.functions import quality_tier, recode
from biotables.plans.expression import SUBSTRATES

# Order priority -> substrate.
SUBSTRATE_OF = {
    "1-URGENT": "TPA",
    "2-HIGH": "DCPET",
    "3-MEDIUM": "HDPE",
    "4-NOT SPECIFIED": "TA",
    "5-LOW": "EG",
}


def enrichment(key: str) -> Column:
    return F.when(F.col(key) % 2 == 0, "Alpha").otherwise("Beta")


def bin_name(key: str = "l_suppkey") -> Column:
    return F.concat(enrichment(key), F.lit("metabat."), F.col(key))


def tag() -> Column:
    return F.concat(bin_name(), F.lit("_"), F.col("l_partkey"))


def sales(t: Tables) -> DataFrame:
    """One row per count: bin, gene, substrate."""
    orders = t.orders.select(
        F.col("o_orderkey").alias("l_orderkey"),
        recode("o_orderpriority", SUBSTRATE_OF).alias("substrate"),
    )
    return (
        t.lineitem.select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity")
        .join(orders, "l_orderkey")
        .select(
            "l_suppkey",
            "l_partkey",
            "substrate",
            F.col("l_quantity").cast("bigint").alias("count"),
        )
    )


def counts_long(t: Tables) -> DataFrame:
    """Count files stacked: locus tag, substrate, count, with the special rows of the counter."""
    loci = sales(t).groupBy("l_suppkey", "l_partkey", "substrate").agg(F.sum("count").alias("count"))
    special = t.orders.groupBy(recode("o_orderpriority", SUBSTRATE_OF).alias("substrate")).agg(
        F.count(F.lit(1)).alias("count")
    )
    return loci.select(tag().alias("locus_tag"), "substrate", "count").unionByName(
        special.select(F.lit("__not_aligned").alias("locus_tag"), "substrate", "count")
    )


def wide_sums(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("substrate") == s, F.col("count"))).alias(s) for s in SUBSTRATES]
    )


def locus_wide(t: Tables) -> DataFrame:
    """Counts per (bin, gene), one column per substrate, NULL where never seen."""
    return wide_sums(sales(t), "l_suppkey", "l_partkey")


def parts(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("l_partkey"),
        F.col("p_brand").alias("gene"),
        F.col("p_name").alias("product"),
        F.concat(F.lit("EC "), F.col("p_size")).alias("EC_number"),
        "p_size",
    )


def loci(t: Tables) -> DataFrame:
    """Distinct (bin, gene) pairs with the gene's columns."""
    return t.lineitem.select("l_suppkey", "l_partkey").distinct().join(parts(t), "l_partkey")


def genes(t: Tables, *more: str) -> DataFrame:
    """Gene rows per locus; ``more`` may ask for contigName."""
    return loci(t).select(
        tag().alias("locus_tag"), enrichment("l_suppkey").alias("Enrichment"), "gene", "EC_number", "product",
        *[contig_name().alias(c) for c in more],
    )


def enzyme_pathway(t: Tables) -> DataFrame:
    """Two pathways per enzyme (its first and last part type); sizes above 40 have none."""
    ends = (
        t.part.filter(F.col("p_size") <= 40)
        .groupBy("p_size")
        .agg(F.min("p_type").alias("a"), F.max("p_type").alias("b"))
    )
    return ends.select(
        F.concat(F.lit("EC "), F.col("p_size")).alias("EC_number"),
        F.explode(F.array("a", "b")).alias("General_Pathway"),
    ).distinct()


def contig_name() -> Column:
    return F.concat_ws("_", F.col("l_suppkey"), F.col("p_size"))


def locus_contig(t: Tables) -> DataFrame:
    return loci(t).select(tag().alias("locus_tag"), contig_name().alias("contigName"))


def contig_bin(t: Tables) -> DataFrame:
    """Contigs seen on returned items; other contigs belong to no bin."""
    returned = t.lineitem.filter(F.col("l_returnflag") == "R").select("l_suppkey", "l_partkey").distinct()
    return (
        returned.join(parts(t).select("l_partkey", "p_size"), "l_partkey")
        .select(
            contig_name().alias("contigName"),
            enrichment("l_suppkey").alias("Enrichment"),
            bin_name().alias("BinID"),
        )
        .distinct()
    )


def bins(t: Tables) -> DataFrame:
    """One row per bin with quality; nation 7 stands for an unclassified bin."""
    name = F.concat(
        F.regexp_replace("n_name", "_", ""),
        F.lit("_0."),
        F.lpad((F.col("s_nationkey") * 3 + 20).cast("string"), 2, "0"),
        F.lit("_"),
        F.when(F.col("n_regionkey") < 2, "genus").when(F.col("n_regionkey") < 4, "family").otherwise("order"),
    )
    nation = t.nation.withColumnRenamed("n_nationkey", "s_nationkey")
    return (
        t.supplier.join(nation, "s_nationkey")
        .select(
            bin_name("s_suppkey").alias("BinID"),
            enrichment("s_suppkey").alias("Enrichment"),
            F.when(F.col("s_nationkey") != 7, name).alias("Best_Classification"),
            (F.sqrt(F.abs("s_acctbal") % 100) * 10).alias("Completeness"),
            (F.col("s_nationkey") * F.lit(0.6)).alias("Contamination"),
        )
        .withColumn("Quality", quality_tier("Completeness", "Contamination"))
    )


def sample_name(bin_key: str = "l_suppkey") -> Column:
    return F.concat_ws("_", F.col(bin_key), F.col("substrate"))


def sample_counts(t: Tables) -> DataFrame:
    """Community counts: sample = bin x substrate, feature = gene."""
    return (
        sales(t)
        .groupBy("l_suppkey", "substrate", F.col("l_partkey").alias("feature"))
        .agg(F.sum("count").alias("count"))
        .select(sample_name().alias("sample"), "feature", "count")
    )


def bin_samples(t: Tables) -> DataFrame:
    """Sample table of :func:`sample_counts`."""
    return (
        sales(t)
        .select("l_suppkey", "substrate")
        .distinct()
        .select(sample_name().alias("sample"), "substrate", enrichment("l_suppkey").alias("enrichment"))
    )


def taxon_sales(t: Tables) -> DataFrame:
    supplier = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("taxon"))
    return sales(t).join(supplier, "l_suppkey")


def taxon_counts(t: Tables, feature: str = "l_partkey") -> DataFrame:
    """Coarse community counts: sample = taxon x substrate."""
    df = taxon_sales(t)
    if feature == "gene":
        df = df.join(parts(t).select("l_partkey", "gene"), "l_partkey")
    return (
        df.groupBy("taxon", "substrate", F.col(feature).alias("feature"))
        .agg(F.sum("count").alias("count"))
        .select(sample_name("taxon").alias("sample"), "feature", "count")
    )


def taxon_samples(t: Tables) -> DataFrame:
    pairs = taxon_sales(t).select("taxon", "substrate").distinct()
    return pairs.select(sample_name("taxon").alias("sample"), "substrate", "taxon")


def gene_features(t: Tables) -> DataFrame:
    return parts(t).select(F.col("l_partkey").alias("feature"), "gene", "product", "EC_number")


def _hash_share(text: Column) -> Column:
    """Number in [0, 1) from the first 32 bits of an md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def results_table(t: Tables) -> DataFrame:
    """Stand-in for a results table: feature, comparison, p-value, fold change, product."""
    key = F.col("o_orderkey").cast("string")
    u, v = _hash_share(F.concat(F.lit("p"), key)), _hash_share(F.concat(F.lit("l"), key))
    return t.orders.select(
        F.col("o_orderkey").alias("feature"),
        recode("o_orderpriority", SUBSTRATE_OF).alias("comparison"),
        F.when(F.col("o_orderstatus") != "P", u * u * u * u).alias("pvalue"),
        ((v - F.lit(0.5)) * F.lit(12.0)).alias("lfc"),
        F.concat(F.lit("product "), F.col("o_custkey")).alias("product"),
    )


# ---------------------------------------------------------------- the same in SQL


def _enr(key: str) -> str:
    return f"(CASE WHEN {key} % 2 = 0 THEN 'Alpha' ELSE 'Beta' END)"


def _bin(key: str) -> str:
    return f"({_enr(key)} || 'metabat.' || {key})"


ENR = _enr("l_suppkey")
TAG = f"({_bin('l_suppkey')} || '_' || l_partkey)"
SUBSTRATE_SQL = (
    "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SUBSTRATE_OF.items()) + " END"
)
TIER_SQL = """CASE WHEN completeness > 90 AND contamination < 5 THEN 'High'
 WHEN completeness >= 50 AND contamination < 10 THEN 'Medium'
 WHEN completeness < 50 AND contamination < 10 THEN 'Low' ELSE 'Contaminated' END"""


def wide_sql(expr: str = "SUM(CASE WHEN substrate = '{s}' THEN count END)::BIGINT") -> str:
    return ", ".join(f'{expr.format(s=s)} AS "{s}"' for s in SUBSTRATES)


CTES = {
    "sales": f"""SELECT l_suppkey, l_partkey, {SUBSTRATE_SQL} AS substrate, CAST(l_quantity AS BIGINT) AS count
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "counts_long": f"""SELECT {TAG} AS locus_tag, substrate, SUM(count)::BIGINT AS count FROM sales GROUP BY 1, 2
 UNION ALL SELECT '__not_aligned', {SUBSTRATE_SQL}, COUNT(*) FROM orders GROUP BY 2""",
    "locus_wide": f"SELECT l_suppkey, l_partkey, {wide_sql()} FROM sales GROUP BY 1, 2",
    "parts": """SELECT p_partkey AS l_partkey, p_brand AS gene, p_name AS product,
 'EC ' || p_size AS EC_number, p_size FROM part""",
    "loci": """SELECT * FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN parts USING (l_partkey)""",
    "genes": f"""SELECT {TAG} AS locus_tag, {ENR} AS Enrichment, gene, EC_number, product FROM loci""",
    "enzyme_pathway": """SELECT EC_number, General_Pathway FROM (
 SELECT 'EC ' || p_size AS EC_number, MIN(p_type) AS General_Pathway FROM part WHERE p_size <= 40 GROUP BY p_size
 UNION SELECT 'EC ' || p_size, MAX(p_type) FROM part WHERE p_size <= 40 GROUP BY p_size)""",
    "locus_contig": f"SELECT {TAG} AS locus_tag, l_suppkey || '_' || p_size AS contigName FROM loci",
    "contig_bin": f"""SELECT DISTINCT l_suppkey || '_' || p_size AS contigName, {ENR} AS Enrichment,
 {_bin('l_suppkey')} AS BinID FROM lineitem JOIN parts USING (l_partkey) WHERE l_returnflag = 'R'""",
    "bins": f"""SELECT BinID, Enrichment, Best_Classification, Completeness, Contamination, {TIER_SQL} AS Quality
 FROM (SELECT {_bin('s_suppkey')} AS BinID, {_enr('s_suppkey')} AS Enrichment,
 CASE WHEN s_nationkey <> 7 THEN replace(n_name, '_', '') || '_0.' || lpad((s_nationkey * 3 + 20)::VARCHAR, 2, '0')
 || '_' || CASE WHEN n_regionkey < 2 THEN 'genus' WHEN n_regionkey < 4 THEN 'family' ELSE 'order' END END
 AS Best_Classification, sqrt(abs(s_acctbal) % 100) * 10 AS Completeness, s_nationkey * 0.6::DOUBLE AS Contamination
 FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    "sample_counts": """SELECT l_suppkey || '_' || substrate AS sample, l_partkey AS feature,
 SUM(count)::BIGINT AS count FROM sales GROUP BY 1, 2""",
    "bin_samples": f"""SELECT DISTINCT l_suppkey || '_' || substrate AS sample, substrate, {ENR} AS enrichment FROM sales""",
    "taxon_sales": """SELECT sales.*, s_nationkey AS taxon FROM sales JOIN supplier ON l_suppkey = s_suppkey""",
    "taxon_counts": """SELECT taxon || '_' || substrate AS sample, l_partkey AS feature, SUM(count)::BIGINT AS count
 FROM taxon_sales GROUP BY 1, 2""",
    "taxon_gene_counts": """SELECT taxon || '_' || substrate AS sample, gene AS feature, SUM(count)::BIGINT AS count
 FROM taxon_sales JOIN parts USING (l_partkey) GROUP BY 1, 2""",
    "taxon_samples": """SELECT DISTINCT taxon || '_' || substrate AS sample, substrate, taxon FROM taxon_sales""",
    "gene_features": "SELECT l_partkey AS feature, gene, product, EC_number FROM parts",
    "results_table": f"""SELECT feature, comparison, CASE WHEN o_orderstatus <> 'P' THEN u * u * u * u END AS pvalue,
 (v - 0.5::DOUBLE) * 12.0::DOUBLE AS lfc, product FROM (SELECT o_orderkey AS feature, {SUBSTRATE_SQL} AS comparison,
 o_orderstatus, ('0x' || substr(md5('p' || o_orderkey), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u,
 ('0x' || substr(md5('l' || o_orderkey), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS v,
 'product ' || o_custkey AS product FROM orders)""",
}

# Which tables each of them is made of.
NEEDS = {
    "counts_long": ["sales"],
    "locus_wide": ["sales"],
    "loci": ["parts"],
    "genes": ["loci"],
    "locus_contig": ["loci"],
    "contig_bin": ["parts"],
    "sample_counts": ["sales"],
    "bin_samples": ["sales"],
    "taxon_sales": ["sales"],
    "taxon_counts": ["taxon_sales"],
    "taxon_gene_counts": ["taxon_sales", "parts"],
    "taxon_samples": ["taxon_sales"],
    "gene_features": ["parts"],
}


def with_tables(names: str, body: str, **more: str) -> str:
    """SQL with the named stand-in tables (and what they need) in front of ``body``."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    blocks = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in ordered]
    blocks += [f"{n} AS MATERIALIZED ({s})" for n, s in more.items()]
    return ("WITH " + ",\n".join(blocks) + "\n" if blocks else "") + body
