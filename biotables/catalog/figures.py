"""The numbers behind the figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from biotables.catalog.bindings import bins, parts, sales, taxon_sales, with_tables
from biotables.catalog.registry import Tables, query
from biotables.functions import QUALITY_LEVELS
from biotables.operators import figures

_HIST = """SELECT measure, Enrichment, least(coalesce(floor((value - lo) / nullif((hi - lo) / 30, 0)), 0), 29)::INT AS bin,
 COUNT(*) AS n FROM long JOIN (SELECT measure, MIN(value) AS lo, MAX(value) AS hi FROM long GROUP BY 1) USING (measure) GROUP BY 1, 2, 3"""


@query(with_tables("bins", _HIST, long="""SELECT 'Completeness' AS measure, Enrichment, Completeness AS value FROM bins
 UNION ALL SELECT 'Contamination', Enrichment, Contamination FROM bins"""))
def histogram_facet(t: Tables):
    """Two measures in 30 bins per facet."""
    return figures.histogram_facet(bins(t), "Enrichment", ["Completeness", "Contamination"])


@query(with_tables("bins", """SELECT Enrichment, Quality, level, coalesce(n, 0)::BIGINT AS n FROM
 (SELECT DISTINCT Enrichment FROM bins) CROSS JOIN (VALUES ('Contaminated', 1), ('Low', 2), ('Medium', 3), ('High', 4)) v(Quality, level)
 LEFT JOIN (SELECT Enrichment, Quality, COUNT(*) AS n FROM bins GROUP BY 1, 2) USING (Enrichment, Quality)"""))
def bar_count(t: Tables):
    """Bins per tier and facet, empty tiers kept."""
    return figures.bar_count(bins(t), "Quality", "Enrichment", QUALITY_LEVELS)


_VALUES = {
    "v": """SELECT substrate, price * 1.0::DOUBLE AS value FROM (SELECT substrate, l_suppkey, SUM(count)::BIGINT AS price
 FROM sales GROUP BY 1, 2, l_partkey)""",
    "q": """SELECT substrate, COUNT(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
 quantile_cont(value, 0.75) AS q3, MIN(value) AS lo, MAX(value) AS hi, stddev_samp(value) AS sd FROM v GROUP BY 1""",
}


def locus_totals(t: Tables):
    """Counts per locus and substrate."""
    sums = sales(t).groupBy("substrate", "l_suppkey", "l_partkey").agg(F.sum("count").alias("value"))
    return sums.select("substrate", F.col("value").cast("double").alias("value"))


@query(with_tables("sales", """SELECT substrate, n, q1, median, q3, MIN(value) FILTER (inside) AS whisker_low,
 MAX(value) FILTER (inside) AS whisker_high, COUNT(*) FILTER (NOT inside) AS n_outliers FROM (SELECT *,
 value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) AS inside FROM v JOIN q USING (substrate)) GROUP BY 1, 2, 3, 4, 5""", **_VALUES))
def box_summary(t: Tables):
    """Quartiles, whiskers and outliers per group."""
    return figures.box_summary(locus_totals(t), ["substrate"], "value")


@query(with_tables("sales", """SELECT substrate, point, round(x, 6) AS x, round(SUM(exp(-0.5 * ((x - value) / bw) ** 2)) / (n * bw * sqrt(2 * pi())), 8) AS density
 FROM (SELECT substrate, value, n, point, lo + (hi - lo) / 31 * point AS x, 0.9 * least(sd, (q3 - q1) / 1.34) * n ** (-0.2) AS bw
 FROM v JOIN q USING (substrate) CROSS JOIN (SELECT unnest(range(32))::INT AS point)) GROUP BY substrate, point, x, n, bw""", **_VALUES))
def violin_density(t: Tables):
    """Kernel density per group on a grid."""
    out = figures.violin_density(locus_totals(t), ["substrate"], "value")
    return out.withColumn("x", F.round("x", 6)).withColumn("density", F.round("density", 8))


@query(with_tables("sales parts", """SELECT gene, l_suppkey, substrate, MAX(count) AS fill, COUNT(*) AS n_rows
 FROM sales JOIN parts USING (l_partkey) GROUP BY 1, 2, 3"""))
def tile_matrix(t: Tables):
    """One fill value per tile and facet."""
    rows = sales(t).join(parts(t).select("l_partkey", "gene"), "l_partkey")
    return figures.tile_matrix(rows, "gene", "l_suppkey", ["substrate"], "count")


@query(with_tables("taxon_sales", """SELECT taxon, substrate, SUM(count)::BIGINT AS total, round(log10(SUM(count)), 6) AS log10_total
 FROM taxon_sales GROUP BY 1, 2 HAVING SUM(count) > 0"""))
def log_totals(t: Tables):
    out = figures.log_totals(taxon_sales(t), ["taxon", "substrate"], "count")
    return out.withColumn("log10_total", F.round("log10_total", 6))
