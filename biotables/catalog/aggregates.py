"""Aggregations, diagnostics and group totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from biotables.catalog.bindings import (
    bins,
    locus_wide,
    parts,
    sales,
    taxon_sales,
    wide_sql,
    with_tables,
)
from biotables.catalog.registry import Tables, query
from biotables.functions import strict_sum
from biotables.operators import observed, totals
from biotables.plans.bins import taxa_tally as tally
from biotables.plans.expression import SUBSTRATES


@query("""SELECT CASE WHEN p_size > 30 THEN p_brand END AS gene, p_type AS product, COUNT(*) AS n FROM part GROUP BY 1, 2""")
def group_count(t: Tables):
    """NULL is a group of its own."""
    gene = F.when(F.col("p_size") > 30, F.col("p_brand")).alias("gene")
    return t.part.groupBy(gene, F.col("p_type").alias("product")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def group_count_having(t: Tables):
    counted = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") > 1)


@query(with_tables("sales", """SELECT l_suppkey, substrate, SUM(count)::BIGINT AS count FROM sales GROUP BY 1, 2"""))
def group_sum(t: Tables):
    return sales(t).groupBy("l_suppkey", "substrate").agg(F.sum("count").alias("count"))


@query(with_tables("locus_wide", f"""SELECT l_partkey,
 {wide_sql('CASE WHEN COUNT("{s}") = COUNT(*) THEN SUM("{s}")::BIGINT END')} FROM locus_wide GROUP BY 1"""))
def group_strict_sum(t: Tables):
    """A missing value makes the sum of its group missing."""
    return locus_wide(t).groupBy("l_partkey").agg(*[strict_sum(s).alias(s) for s in SUBSTRATES])


@query("""SELECT COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT l_suppkey, l_partkey, l_quantity FROM lineitem))
 AS n_duplicated, true AS any_duplicated FROM lineitem""")
def dup_count(t: Tables):
    """Rows beyond the first of each key."""
    return totals.duplicate_counts(t.lineitem, ["l_suppkey", "l_partkey", "l_quantity"])


@query(with_tables("locus_wide", """SELECT bool_or("TPA" IS NULL) AS any_null, bool_or("EG" = 1) AS any_one,
 COUNT(*) FILTER ("TPA" IS NULL) AS n_null, COUNT(*) FILTER (coalesce("EG", 0) = 0) AS n_zero FROM locus_wide"""))
def quality_flags(t: Tables):
    """Any missing, any equal, how many missing or zero."""
    return locus_wide(t).agg(
        F.bool_or(F.col("TPA").isNull()).alias("any_null"),
        F.bool_or(F.col("EG") == 1).alias("any_one"),
        F.count_if(F.col("TPA").isNull()).alias("n_null"),
        F.count_if(F.coalesce("EG", F.lit(0)) == 0).alias("n_zero"),
    )


@query("""SELECT l_returnflag, MIN(l_quantity) AS lowest, MAX(l_quantity) AS highest,
 COUNT(DISTINCT l_partkey) AS n_distinct FROM lineitem GROUP BY 1""")
def value_profile(t: Tables):
    """Range and number of distinct values; distinct pairs are counted after a first grouping."""
    pairs = t.lineitem.groupBy("l_returnflag", "l_partkey").agg(
        F.min("l_quantity").alias("lowest"), F.max("l_quantity").alias("highest")
    )
    return pairs.groupBy("l_returnflag").agg(
        F.min("lowest").alias("lowest"), F.max("highest").alias("highest"), F.count(F.lit(1)).alias("n_distinct")
    )


@query("""SELECT (SELECT COUNT(*) FROM customer) AS n_left, (SELECT COUNT(*) FROM supplier) AS n_right,
 (SELECT COUNT(*) FROM (SELECT c_nationkey, c_acctbal FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier))
 AS n_merged, true AS reconciled""")
def row_reconcile(t: Tables):
    """Rows of the parts against rows of the merged table."""
    left = t.customer.select(F.lit("l").alias("side"), F.col("c_nationkey").alias("nation"))
    right = t.supplier.select(F.lit("r").alias("side"), F.col("s_nationkey").alias("nation"))
    return left.unionByName(right).agg(
        F.count_if(F.col("side") == "l").alias("n_left"),
        F.count_if(F.col("side") == "r").alias("n_right"),
        F.count(F.lit(1)).alias("n_merged"),
    ).withColumn("reconciled", F.col("n_left") + F.col("n_right") == F.col("n_merged"))


def _one_row(t: Tables, values: dict):
    """Observed metrics as a table of one row."""
    return t.spark.range(1).select(*[F.lit(v).cast("boolean" if isinstance(v, bool) else "bigint").alias(n) for n, v in values.items()])


@query("""SELECT (SELECT COUNT(*) FROM customer) AS n_left, (SELECT COUNT(*) FROM supplier) AS n_right,
 (SELECT COUNT(*) FROM customer) + (SELECT COUNT(*) FROM supplier) AS n_merged, true AS reconciled""")
def row_reconcile_observed(t: Tables):
    """Reconciliation of a stacked table that is stored: the counts come with the write."""
    left = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    right = t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    _, seen = observed.store_stacked({"left": left, "right": right}, "stacked")
    return _one_row(t, seen)


@query(with_tables("locus_wide", f"""SELECT COUNT(*) AS n_rows, {", ".join(
    f'COUNT(*) FILTER ("{s}" IS NULL) AS "null_{s}"' for s in SUBSTRATES)}, {", ".join(
    f'COUNT(*) FILTER ("{s}" = 0) AS "zero_{s}"' for s in SUBSTRATES)} FROM locus_wide"""))
def quality_flags_observed(t: Tables):
    """Missing and zero cells of every count column, observed while the table of loci is stored."""
    _, seen = observed.store_observed(locus_wide(t), "loci", observed.quality_metrics(SUBSTRATES, SUBSTRATES))
    return _one_row(t, seen)


@query("""SELECT COUNT(*) AS n_rows, COUNT(*) - (SELECT COUNT(*) FROM
 (SELECT DISTINCT l_suppkey, l_partkey, l_quantity FROM lineitem)) AS n_duplicated, true AS any_duplicated FROM lineitem""")
def dup_count_observed(t: Tables):
    """Repeats of each key, observed while the distinct keys are stored."""
    _, seen = observed.store_unique(t.lineitem, ["l_suppkey", "l_partkey", "l_quantity"], "keys")
    return _one_row(t, seen)


@query("SELECT COUNT(*) FILTER (l_quantity > 45 AND l_discount > 0.05) AS n_enriched FROM lineitem")
def count_where(t: Tables):
    hit = (F.col("l_quantity") > 45) & (F.col("l_discount") > 0.05)
    return t.lineitem.agg(F.count_if(hit).alias("n_enriched"))


@query("SELECT DISTINCT l_suppkey, l_partkey, l_returnflag FROM lineitem")
def distinct_rows(t: Tables):
    return t.lineitem.select("l_suppkey", "l_partkey", "l_returnflag").distinct()


@query(with_tables("bins", """SELECT genus, n, RANK() OVER (ORDER BY n DESC) AS position FROM (
 SELECT split_part(Best_Classification, '_', 1) AS genus, COUNT(*) AS n FROM bins WHERE Quality = 'Medium' GROUP BY 1)"""))
def taxa_tally(t: Tables):
    """Bins of one tier per taxon name, largest first."""
    table = bins(t)
    named = table.select("BinID", F.col("Best_Classification").alias("genus"))
    return tally(named, table.select("BinID", "Quality"), "genus", "Medium")


# ---------------------------------------------------------------- group totals on rows


@query(with_tables("sales", """SELECT l_suppkey, l_partkey, substrate, count,
 SUM(count) OVER (PARTITION BY l_suppkey, substrate)::BIGINT AS bin_total FROM sales"""))
def window_total(t: Tables):
    return totals.attach_totals(sales(t), ["l_suppkey", "substrate"], {"bin_total": F.sum("count")})


@query(with_tables("sales", """SELECT l_suppkey, l_partkey, substrate, count,
 round(count / SUM(count) OVER (PARTITION BY l_suppkey, substrate), 9) AS share FROM sales"""))
def window_share(t: Tables):
    out = totals.share_of_group(sales(t), ["l_suppkey", "substrate"], "count", "share")
    return out.withColumn("share", F.round("share", 9))


@query("""SELECT o_orderkey, priority, n_total, round(share, 9) AS share,
 CASE WHEN share < 0.5 THEN '< 50%' ELSE priority END AS label FROM (SELECT *,
 COUNT(*) OVER (PARTITION BY priority)::DOUBLE / n_total AS share FROM (
 SELECT o_orderkey, o_orderstatus, coalesce(nullif(o_orderpriority, '5-LOW'), 'Unclassified') AS priority,
 COUNT(*) OVER (PARTITION BY o_orderstatus) AS n_total FROM orders))""")
def lump_rare(t: Tables):
    """Rare classes lumped; the share divides two counts over different groups."""
    rows = t.orders.select(
        "o_orderkey", "o_orderstatus", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("label")
    ).withColumn("priority", F.coalesce("label", F.lit("Unclassified")))
    out = totals.lump_rare(rows, "o_orderstatus", "label", 0.5, "< 50%", "Unclassified")
    return out.select("o_orderkey", "priority", "n_total", F.round("share", 9).alias("share"), "label")


@query(with_tables("taxon_sales parts", """SELECT taxon, substrate, gene, count, round(count / SUM(count)
 OVER (PARTITION BY taxon, substrate), 9) AS proportion FROM (SELECT taxon, substrate, gene, SUM(count)::BIGINT AS count
 FROM taxon_sales JOIN parts USING (l_partkey) GROUP BY 1, 2, 3)"""))
def fill_proportion(t: Tables):
    """Stacked-to-one proportions within x and facet."""
    rows = taxon_sales(t).join(parts(t).select("l_partkey", "gene"), "l_partkey")
    out = totals.fill_proportion(rows, ["taxon", "substrate"], "gene", "count", "proportion")
    return out.withColumn("proportion", F.round("proportion", 9))
