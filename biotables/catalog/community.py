"""Community statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from biotables.catalog.bindings import (
    bin_name,
    bin_samples,
    enrichment,
    gene_features,
    parts,
    sales,
    sample_counts,
    taxon_counts,
    taxon_samples,
    wide_sums,
    with_tables,
)
from biotables.catalog.registry import Tables, query
from biotables.operators import clustering, community, distance, near, ordination
from biotables.plans.expression import SUBSTRATES
from biotables.session import materialize


def wide_fact(t: Tables):
    """Per locus: bin, gene id, gene, product and the five count columns."""
    keyed = sales(t).join(parts(t), "l_partkey")
    wide = wide_sums(keyed, "l_suppkey", "l_partkey", "gene", "product")
    return wide.select(
        bin_name().alias("bin_id"),
        enrichment("l_suppkey").alias("enrichment"),
        F.col("l_partkey").alias("gene_id"),
        F.nullif("gene", F.lit("Brand#5")).alias("gene"),
        F.when(F.col("product") == "red rod", community.NO_PRODUCT).otherwise(F.col("product")).alias("product"),
        *SUBSTRATES,
    )


_NAMED = with_tables(
    "sales parts",
    "{body}",
    named="""SELECT (CASE WHEN l_suppkey % 2 = 0 THEN 'Alpha' ELSE 'Beta' END) || 'metabat.' || l_suppkey AS bin_id,
 CASE WHEN l_suppkey % 2 = 0 THEN 'Alpha' ELSE 'Beta' END AS enrichment, l_partkey AS gene_id, substrate, count,
 nullif(gene, 'Brand#5') AS gene, CASE WHEN product = 'red rod' THEN 'hypothetical protein' ELSE product END AS product
 FROM sales JOIN parts USING (l_partkey)""",
)


def _named(body: str) -> str:
    return _NAMED.replace("{body}", body)


@query(_named("""SELECT bin_id || '_' || substrate AS sample, gene_id AS feature, SUM(count)::BIGINT AS count
 FROM named GROUP BY 1, 2"""))
def bundle_counts(t: Tables):
    """Fact rows to sample x gene counts."""
    return community.bundle_counts(wide_fact(t), SUBSTRATES, "gene_id")


@query(_named("""SELECT bin_id || '_' || substrate AS sample, product AS feature, SUM(count)::BIGINT AS count
 FROM named WHERE product <> 'hypothetical protein' AND gene <> '' GROUP BY 1, 2"""))
def bundle_counts_product(t: Tables):
    """The product-level variant: named genes with a known product."""
    return community.bundle_counts(community.product_level(wide_fact(t)), SUBSTRATES, "product")


@query(_named("SELECT DISTINCT bin_id || '_' || substrate AS sample, bin_id, substrate, enrichment FROM named"))
def bundle_samples(t: Tables):
    return community.bundle_samples(wide_fact(t), SUBSTRATES, ["enrichment"])


@query(_named("SELECT DISTINCT gene_id AS feature, gene, product FROM named"))
def bundle_features(t: Tables):
    """One row per feature id."""
    return community.bundle_features(wide_fact(t), "gene_id", ["gene", "product"])


@query(with_tables("sample_counts", """SELECT sample, feature, count FROM sample_counts
 WHERE sample IN (SELECT sample FROM sample_counts GROUP BY 1 HAVING SUM(count) > 3000)"""))
def filter_sample_depth(t: Tables):
    return community.keep_deep_samples(sample_counts(t), 3000)


_SPARSE = """sparse AS (SELECT l_suppkey AS sample, l_orderkey AS feature,
 SUM(greatest(l_quantity - 25, 0))::BIGINT AS count FROM lineitem GROUP BY 1, 2)"""


def sparse_counts(t: Tables):
    """Counts per bin and order that contain zeros."""
    x = F.greatest(F.col("l_quantity") - 25, F.lit(0.0))
    sums = t.lineitem.groupBy(F.col("l_suppkey").alias("sample"), F.col("l_orderkey").alias("feature"))
    return sums.agg(F.sum(x).cast("bigint").alias("count"))


@query(f"""WITH {_SPARSE} SELECT * FROM sparse WHERE feature IN (SELECT feature FROM sparse GROUP BY 1 HAVING SUM(count) > 0)""")
def prune_features(t: Tables):
    """Features without any count leave the table."""
    return community.prune_features(sparse_counts(t))


@query(f"""WITH {_SPARSE} SELECT COUNT(*) AS n_features, COUNT(*) FILTER (total = 0) AS n_zero, bool_or(total = 0) AS any_zero
 FROM (SELECT o_orderkey, coalesce(SUM(count), 0) AS total FROM orders LEFT JOIN sparse ON feature = o_orderkey GROUP BY 1)""")
def zero_features(t: Tables):
    """How many features have no count at all."""
    return community.zero_features(sparse_counts(t), t.orders.select(F.col("o_orderkey").alias("feature")))


@query(with_tables("sample_counts", """SELECT sample, feature, COUNT(*) AS count FROM (
 SELECT d.sample, p.feature FROM draws d ASOF JOIN placed p ON d.sample = p.sample AND d.u >= p.start) GROUP BY 1, 2""",
    placed="""SELECT sample, feature, SUM(count) OVER (PARTITION BY sample ORDER BY md5(feature::VARCHAR), feature)::BIGINT - count AS start
 FROM sample_counts""",
    sizes="SELECT sample, SUM(count)::BIGINT AS total FROM sample_counts GROUP BY 1",
    draws="""SELECT sample, ((('0x' || substr(md5('81|' || sample || '|' || d), 1, 15))::BIGINT::HUGEINT * total)
 // 1152921504606846976)::BIGINT AS u FROM (SELECT sample, total, unnest(range((SELECT MIN(total) FROM sizes))) AS d FROM sizes)"""))
def rarefy(t: Tables):
    """Every sample drawn with replacement to the smallest sample total."""
    return community.rarefy(sample_counts(t), seed=81)


@query(with_tables("sample_counts bin_samples", """SELECT sample, substrate, enrichment, observed FROM (
 SELECT sample, COUNT(*) AS observed FROM sample_counts GROUP BY 1) JOIN bin_samples USING (sample)"""))
def alpha_observed(t: Tables):
    """Features with a count, per sample, with the sample columns."""
    return community.alpha_diversity(sample_counts(t)).drop("shannon").join(bin_samples(t), "sample")


@query(with_tables("sample_counts bin_samples", """SELECT sample, substrate, enrichment, round(shannon, 6) AS shannon FROM (
 SELECT sample, -SUM(p * ln(p)) AS shannon FROM (SELECT sample, count::DOUBLE / SUM(count) OVER (PARTITION BY sample) AS p
 FROM sample_counts) GROUP BY 1) JOIN bin_samples USING (sample)"""))
def alpha_shannon(t: Tables):
    out = community.alpha_diversity(sample_counts(t)).drop("observed").join(bin_samples(t), "sample")
    return out.withColumn("shannon", F.round("shannon", 6))


@query(with_tables("sample_counts", """SELECT a.sample AS id_a, b.sample AS id_b,
 round(1 - 2 * coalesce(shared, 0)::DOUBLE / (a.total + b.total), 6) AS dist FROM sizes a JOIN sizes b ON a.sample < b.sample
 LEFT JOIN overlap o ON o.sa = a.sample AND o.sb = b.sample""",
    sizes="SELECT sample, SUM(count)::BIGINT AS total FROM sample_counts GROUP BY 1",
    overlap="""SELECT a.sample AS sa, b.sample AS sb, SUM(least(a.count, b.count))::BIGINT AS shared
 FROM sample_counts a JOIN sample_counts b ON a.feature = b.feature AND a.sample < b.sample GROUP BY 1, 2"""))
def bray_curtis(t: Tables):
    """Dissimilarity of every pair of samples; pairs that share nothing get 1."""
    return distance.bray_curtis(sample_counts(t)).withColumn("dist", F.round("dist", 6))


_PAIR_DISTANCES = {
    "sizes": "SELECT sample, SUM(count)::BIGINT AS total FROM sample_counts GROUP BY 1",
    "overlap": """SELECT a.sample AS sa, b.sample AS sb, SUM(least(a.count, b.count))::BIGINT AS shared
 FROM sample_counts a JOIN sample_counts b ON a.feature = b.feature AND a.sample <> b.sample GROUP BY 1, 2""",
    "pairs": """SELECT a.sample AS a, b.sample AS b, 1 - 2 * coalesce(shared, 0)::DOUBLE / (a.total + b.total) AS dist
 FROM sizes a JOIN sizes b ON a.sample <> b.sample LEFT JOIN overlap o ON o.sa = a.sample AND o.sb = b.sample""",
}


@query(with_tables("sample_counts", "SELECT a AS id_a, b AS id_b, round(dist, 6) AS dist FROM pairs WHERE a < b AND dist <= 0.98", **_PAIR_DISTANCES))
def bray_curtis_within(t: Tables):
    """Pairs of samples with a dissimilarity of at most 0.98."""
    return near.bray_curtis_within(sample_counts(t), 0.98).withColumn("dist", F.round("dist", 6))


@query(with_tables("sample_counts", """SELECT a AS sample, rank, b AS neighbour, round(dist, 6) AS dist FROM (SELECT *,
 row_number() OVER (PARTITION BY a ORDER BY dist, b)::INT AS rank FROM pairs) WHERE rank <= 5""", **_PAIR_DISTANCES))
def nearest_samples(t: Tables):
    """The five nearest samples of each sample."""
    return near.nearest_samples(sample_counts(t), 5, block=8).withColumn("dist", F.round("dist", 6))


def taxon_distances(t: Tables):
    return distance.bray_curtis(taxon_counts(t, "gene"))


_TAXON_DIST = {
    "sizes": "SELECT sample, SUM(count)::BIGINT AS total FROM taxon_gene_counts GROUP BY 1",
    "overlap": """SELECT a.sample AS sa, b.sample AS sb, SUM(least(a.count, b.count))::BIGINT AS shared
 FROM taxon_gene_counts a JOIN taxon_gene_counts b ON a.feature = b.feature AND a.sample < b.sample GROUP BY 1, 2""",
    "dist": """SELECT a.sample AS id_a, b.sample AS id_b, 1 - 2 * coalesce(shared, 0)::DOUBLE / (a.total + b.total) AS d
 FROM sizes a JOIN sizes b ON a.sample < b.sample LEFT JOIN overlap o ON o.sa = a.sample AND o.sb = b.sample""",
    "cells": """SELECT id_a AS i, id_b AS j, d * d AS d2 FROM dist UNION ALL SELECT id_b, id_a, d * d FROM dist
 UNION ALL SELECT sample, sample, 0 FROM sizes""",
    "means": "SELECT i, AVG(d2) AS m FROM cells GROUP BY 1",
}


@query(with_tables("taxon_gene_counts", """SELECT c.i AS id_a, c.j AS id_b,
 round(-0.5 * (d2 - a.m - b.m + (SELECT AVG(d2) FROM cells)), 6) + 0.0 AS b FROM cells c
 JOIN means a ON a.i = c.i JOIN means b ON b.i = c.j WHERE c.i <= c.j""", **_TAXON_DIST))
def pcoa_centered(t: Tables):
    """Double-centred squared distances, one row per pair and the diagonal."""
    centered = ordination.double_center(taxon_distances(t))
    return centered.withColumn("b", F.round("b", 6) + F.lit(0.0))


@query()
def pcoa_axes(t: Tables):
    """Leading principal coordinates with the sample columns."""
    axes = ordination.pcoa(taxon_distances(t), axes=2)
    return axes.withColumnRenamed("id", "sample").join(taxon_samples(t), "sample")


@query("""SELECT * FROM (VALUES (1::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), (2, 0.0, 0.0, 0.0)) v(axis, residual, length_gap, dot)""")
def pcoa_check(t: Tables):
    """Per axis: largest |Bx - lambda x|, |x.x - lambda| and the dot product with the other axis, all zero."""
    dist = materialize(taxon_distances(t), "taxon-distances")
    axes = materialize(ordination.pcoa(dist, axes=2), "taxon-axes")
    cells = ordination.double_center(dist)
    off = ordination.both_directions(cells.filter("id_a <> id_b"), "b")
    cells = off.unionByName(cells.filter("id_a = id_b").select(F.col("id_a").alias("i"), F.col("id_b").alias("j"), "b"))
    image = cells.join(axes.withColumnRenamed("id", "j"), "j").groupBy("i", "axis").agg(F.sum(F.col("b") * F.col("coordinate")).alias("y"))
    gaps = image.join(axes.withColumnRenamed("id", "i"), ["i", "axis"]).withColumn("gap", F.abs(F.col("y") - F.col("eigenvalue") * F.col("coordinate")))
    other = axes.select("id", (3 - F.col("axis")).alias("axis"), F.col("coordinate").alias("z"))
    dots = axes.join(other, ["id", "axis"]).groupBy("axis").agg(
        F.abs(F.sum(F.col("coordinate") * F.col("coordinate")) - F.first("eigenvalue")).alias("length_gap"),
        F.abs(F.sum(F.col("coordinate") * F.col("z"))).alias("dot"),
    )
    worst = gaps.groupBy("axis").agg(F.max("gap").alias("residual"))
    return worst.join(dots, "axis").select("axis", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("residual", "length_gap", "dot")])


@query(with_tables("taxon_counts gene_features", """SELECT sample, gene, product, SUM(count)::BIGINT AS count
 FROM taxon_counts JOIN (SELECT feature, nullif(gene, 'Brand#5') AS gene, product FROM gene_features) USING (feature)
 WHERE gene IS NOT NULL GROUP BY 1, 2, 3"""))
def agglomerate(t: Tables):
    """Counts summed per feature rank; features without the rank are left out."""
    features = gene_features(t).withColumn("gene", F.nullif("gene", F.lit("Brand#5")))
    return community.agglomerate(taxon_counts(t), features, ["gene", "product"])


@query(with_tables("sample_counts", """SELECT sample, feature, count,
 round(count / SUM(count) OVER (PARTITION BY sample), 9) AS rel FROM sample_counts"""))
def relative_abundance(t: Tables):
    out = community.relative_abundance(sample_counts(t))
    return out.withColumn("rel", F.round("rel", 9))


@query(with_tables("", """SELECT sample, feature, count, CASE WHEN count < 10 THEN '< 10' ELSE feature::VARCHAR END AS label
 FROM sparse WHERE count > 0""", sparse=_SPARSE.split("AS ", 1)[1].strip()[1:-1]))
def lump_low_abundance(t: Tables):
    """Positive rows; small ones share a label."""
    rows = sparse_counts(t).withColumn("name", F.col("feature").cast("string"))
    return community.lump_low_abundance(rows, "count", "name", 10, "< 10").drop("name")


@query(with_tables("parts", """SELECT a.sample AS id_a, b.sample AS id_b, round(sqrt(a.sq + b.sq - 2 * coalesce(dot, 0)), 6) AS dist
 FROM sizes a JOIN sizes b ON a.sample < b.sample LEFT JOIN dots ON sa = a.sample AND sb = b.sample""",
    n="""SELECT l_suppkey AS sample, gene AS feature, COUNT(*)::DOUBLE AS x FROM lineitem JOIN parts USING (l_partkey) GROUP BY 1, 2""",
    sizes="SELECT sample, SUM(x * x) AS sq FROM n GROUP BY 1",
    dots="SELECT a.sample AS sa, b.sample AS sb, SUM(a.x * b.x) AS dot FROM n a JOIN n b ON a.feature = b.feature AND a.sample < b.sample GROUP BY 1, 2"))
def euclidean_distance(t: Tables):
    """Distance of bins by their gene presence counts."""
    rows = t.lineitem.select("l_suppkey", "l_partkey").join(parts(t).select("l_partkey", "gene"), "l_partkey")
    matrix = rows.groupBy(F.col("l_suppkey").alias("sample"), F.col("gene").alias("feature")).agg(
        F.count(F.lit(1)).alias("count")
    )
    return distance.euclidean(matrix).withColumn("dist", F.round("dist", 6))


@query("""SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dist
 FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id""")
def vector_distance(t: Tables):
    """The same distance on a table of array rows."""
    out = distance.vector_distances(t.embeddings, "vec_id", "embedding")
    return out.withColumn("dist", F.round("dist", 6))


@query()
def hclust_average(t: Tables):
    """Average-linkage merge list of the taxon samples."""
    return clustering.average_linkage(taxon_distances(t))


@query(with_tables("taxon_samples", "SELECT count(*) AS leaves, count(*) AS places, 1::BIGINT AS first_place, count(*) AS last_place FROM taxon_samples"))
def hclust_leaf_check(t: Tables):
    """Leaf positions are 1 to n, each once."""
    order = clustering.leaf_order(clustering.average_linkage(taxon_distances(t)))
    return order.agg(
        F.count_distinct("leaf").alias("leaves"), F.count_distinct("position").alias("places"),
        F.min("position").alias("first_place"), F.max("position").alias("last_place"),
    )


@query(with_tables("taxon_gene_counts", """SELECT (SELECT count(*) - 1 FROM sizes)::BIGINT AS merges, 0::BIGINT AS wrong_heights, count(*) AS joined_pairs,
 round(min(d), 6) AS lowest, round(sum(d), 4) AS height_sum FROM dist""", **{k: _TAXON_DIST[k] for k in ("sizes", "overlap", "dist")}))
def hclust_check(t: Tables):
    """Each height is the mean distance of the leaves that the merge brings together; all pairs are joined once."""
    dist = materialize(taxon_distances(t), "taxon-distances")
    merges = materialize(clustering.average_linkage(dist), "taxon-merges")
    joined = clustering.cophenetic(merges, dist).groupBy("merge_left", "size").agg(
        F.count(F.lit(1)).alias("pairs"), F.avg("dist").alias("mean"), F.first("height").alias("height")
    )
    wrong = F.round(F.abs(F.col("mean") - F.col("height")), 9) != 0
    return joined.agg(
        F.count(F.lit(1)).alias("merges"), F.count_if(wrong).alias("wrong_heights"), F.sum("pairs").alias("joined_pairs"),
        F.round(F.min("height"), 6).alias("lowest"), F.round(F.sum(F.col("height") * F.col("pairs")), 4).alias("height_sum"),
    )


@query()
def hclust_leaf_order(t: Tables):
    """Left-to-right order of the dendrogram leaves."""
    return clustering.leaf_order(clustering.average_linkage(taxon_distances(t)))


@query(with_tables("sample_counts bin_samples", """SELECT sample, feature, count FROM sample_counts
 WHERE sample IN (SELECT sample FROM bin_samples WHERE enrichment = 'Alpha' AND substrate <> 'HDPE')"""))
def subset_samples(t: Tables):
    keep = (F.col("enrichment") == "Alpha") & (F.col("substrate") != "HDPE")
    return community.subset_samples(sample_counts(t), bin_samples(t), keep)


@query(with_tables("taxon_counts taxon_samples gene_features", """SELECT sample, feature, coalesce(count, 0)::BIGINT + 1 AS count
 FROM taxon_samples CROSS JOIN gene_features LEFT JOIN taxon_counts USING (sample, feature)"""))
def pseudocount(t: Tables):
    """One added to every cell, empty cells included."""
    return community.add_pseudocount(taxon_counts(t), taxon_samples(t), gene_features(t))
