"""Differential abundance."""

from __future__ import annotations

from pyspark.sql import functions as F

from biotables.catalog.bindings import (
    enrichment,
    gene_features,
    results_table,
    taxon_counts,
    taxon_samples,
    with_tables,
)
from biotables.catalog.registry import Tables, query
from biotables.operators import differential as de
from biotables.operators import outliers
from biotables.operators.community import add_pseudocount
from biotables.plans.expression import SUBSTRATES
from biotables.session import materialize

_GEO = {
    "geo": """SELECT feature, exp(SUM(ln(count)) / (SELECT COUNT(*) FROM taxon_samples)) AS g FROM taxon_counts GROUP BY 1""",
    "raw": """SELECT sample, quantile_cont(ln(count) - ln(g), 0.5) AS m FROM taxon_counts JOIN geo USING (feature) GROUP BY 1""",
    "factors": "SELECT sample, exp(m - (SELECT AVG(m) FROM raw)) AS size_factor FROM raw",
}
_BOTH = "taxon_counts taxon_samples"


def stored_inputs(t: Tables):
    """Counts, samples and size factors as stored tables; the statistics read them repeatedly."""
    counts = materialize(taxon_counts(t), "counts")
    samples = materialize(taxon_samples(t), "samples")
    return counts, samples, de.size_factors(counts, de.geometric_means(counts, samples))


@query(with_tables(_BOTH, "SELECT feature, round(g, 6) AS geo_mean FROM geo", geo=_GEO["geo"]))
def geo_mean(t: Tables):
    """Zero-tolerant geometric mean per feature."""
    out = de.geometric_means(taxon_counts(t), taxon_samples(t))
    return out.withColumn("geo_mean", F.round("geo_mean", 6))


@query(with_tables(_BOTH, "SELECT sample, round(size_factor, 6) AS size_factor FROM factors", **_GEO))
def size_factors(t: Tables):
    """Median ratio per sample, scaled to geometric mean 1."""
    return stored_inputs(t)[2].withColumn("size_factor", F.round("size_factor", 6))


@query(with_tables(_BOTH, """SELECT sample, feature, count, round(count / size_factor, 6) AS norm
 FROM taxon_counts JOIN factors USING (sample)""", **_GEO))
def normalized_counts(t: Tables):
    counts, _, factors = stored_inputs(t)
    return de.normalized(counts, factors).drop("size_factor").withColumn("norm", F.round("norm", 6))


@query(with_tables(_BOTH, """SELECT feature, round(m, 5) AS base_mean, round(v, 5) AS base_var,
 round(greatest((v - m * inv) / (m * m), 1e-8), 5) AS dispersion FROM (
 SELECT feature, s1 / n AS m, (s2 - s1 * s1 / n) / (n - 1) AS v, inv FROM (
 SELECT feature, SUM(count / size_factor) AS s1, SUM((count / size_factor) * (count / size_factor)) AS s2
 FROM taxon_counts JOIN factors USING (sample) GROUP BY 1),
 (SELECT COUNT(*)::DOUBLE AS n, AVG(1 / size_factor) AS inv FROM factors))""", **_GEO))
def dispersion_moments(t: Tables):
    counts, _, factors = stored_inputs(t)
    out = de.dispersion_moments(counts, factors)
    return out.select("feature", *[F.round(c, 5).alias(c) for c in ("base_mean", "base_var", "dispersion")])


@query()
def dispersion_fit(t: Tables):
    """Gene-wise, trend (local) and shrunken dispersion per feature."""
    counts, samples, factors = stored_inputs(t)
    fit, _ = de.fit_features(counts, samples, "substrate", factors, trend="local")
    return fit.select("feature", "base_mean", "disp_gene", "disp_trend", "dispersion", "outlier", "converged")


@query()
def nb_wald(t: Tables):
    """Zero-tolerant size factors, local trend, one contrast between two enrichments."""
    counts, samples, factors = stored_inputs(t)
    samples = samples.withColumn("enrichment", enrichment("taxon"))
    fit, levels = de.fit_features(counts, samples, "enrichment", factors, trend="local")
    return de.bh_adjust(de.wald_tests(fit, levels, [("Beta", "Alpha")]), ["comparison"])


_WALD = """WITH RECURSIVE cells AS MATERIALIZED (
 SELECT f.feature, s.sample, CASE WHEN s.taxon % 2 = 0 THEN 'Alpha' ELSE 'Beta' END AS level, coalesce(c.count, 0)::DOUBLE AS x,
 size_factor AS sf, dispersion AS a FROM moments f CROSS JOIN taxon_samples s JOIN factors USING (sample)
 LEFT JOIN taxon_counts c ON c.sample = s.sample AND c.feature = f.feature),
 it AS (SELECT feature, level, 0 AS r, ln(greatest(AVG(x / sf), 1e-8)) AS beta FROM cells GROUP BY 1, 2
 UNION ALL SELECT feature, level, r + 1, least(greatest(beta + least(greatest(score / greatest(info, 1e-12), -3), 3), ln(1e-8)), 60)
 FROM (SELECT it.feature, it.level, it.r, it.beta, SUM((x - exp(beta) * sf) / (1 + a * exp(beta) * sf)) AS score,
 SUM(exp(beta) * sf / (1 + a * exp(beta) * sf)) AS info FROM it JOIN cells c ON c.feature = it.feature AND c.level = it.level
 WHERE r < 40 GROUP BY ALL)),
 fit AS (SELECT it.feature, it.level, it.beta, SUM(exp(beta) * sf / (1 + a * exp(beta) * sf)) AS info, MAX(x) = 0 AS zero
 FROM it JOIN cells c ON c.feature = it.feature AND c.level = it.level WHERE r = 40 GROUP BY ALL)
 SELECT b.feature, 'Beta_vs_Alpha' AS comparison, (b.beta - a.beta) / ln(2) AS lfc, sqrt(1 / b.info + 1 / a.info) / ln(2) AS se,
 a.zero <> b.zero AS one_sided_zero, a.zero AND b.zero AS no_test FROM fit a JOIN fit b ON a.feature = b.feature AND a.level = 'Alpha' AND b.level = 'Beta'"""

_COOKS_CELLS = _WALD[_WALD.index("SELECT f.feature") : _WALD.index("),\n it AS")]
_COOKS_LEVELS = _WALD[: _WALD.index("\n SELECT b.feature")] + " SELECT feature, level, beta FROM fit"

_MOMENTS = """SELECT feature, greatest((v - m * inv) / (m * m), 1e-8) AS dispersion FROM (
 SELECT feature, s1 / n AS m, (s2 - s1 * s1 / n) / (n - 1) AS v, inv FROM (
 SELECT feature, SUM(count / size_factor) AS s1, SUM((count / size_factor) * (count / size_factor)) AS s2
 FROM taxon_counts JOIN factors USING (sample) GROUP BY 1),
 (SELECT COUNT(*)::DOUBLE AS n, AVG(1 / size_factor) AS inv FROM factors))"""


@query(with_tables(_BOTH, """SELECT feature, comparison, round(CASE WHEN NOT no_test THEN lfc END, 5) + 0.0 AS log2_fold_change,
 round(CASE WHEN NOT no_test THEN se END, 5) AS lfc_se, round(CASE WHEN NOT no_test THEN lfc / se END, 5) + 0.0 AS stat, one_sided_zero FROM wald""",
    **_GEO, moments=_MOMENTS, wald=_WALD))
def nb_wald_moments(t: Tables):
    """Wald step of the model at the moment dispersions: level means by Newton steps, fold change, error, statistic."""
    counts, samples, factors = stored_inputs(t)
    samples = samples.withColumn("enrichment", enrichment("taxon"))
    fit, levels = de.fit_at_dispersion(counts, samples, "enrichment", factors, de.dispersion_moments(counts, factors))
    out = de.wald_tests(fit, levels, [("Beta", "Alpha")])
    return out.select(
        "feature", "comparison", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("log2_fold_change", "lfc_se", "stat")], "one_sided_zero"
    )


@query(with_tables(_BOTH, """SELECT feature, round(MAX(r2 / 2 * h / ((1 - h) * (1 - h))), 4) AS max_cooks FROM (SELECT c.feature,
 (x - mu) * (x - mu) / (mu + a * mu * mu) AS r2, mu / (1 + a * mu) / SUM(mu / (1 + a * mu)) OVER (PARTITION BY c.feature, c.level) AS h
 FROM (SELECT c.*, exp(beta) * sf AS mu FROM cells c JOIN levels_ l ON l.feature = c.feature AND l.level = c.level) c) GROUP BY 1""",
    **_GEO, moments=_MOMENTS, cells=_COOKS_CELLS, levels_=_COOKS_LEVELS))
def cooks_distance(t: Tables):
    """Largest Cook's distance of each feature at the moment dispersions."""
    counts, samples, factors = stored_inputs(t)
    samples = materialize(samples.withColumn("enrichment", enrichment("taxon")), "samples")
    fit, _ = de.fit_at_dispersion(counts, samples, "enrichment", factors, de.dispersion_moments(counts, factors))
    found = outliers.cooks_distances(counts, samples, "enrichment", factors, fit, robust=False)
    return found.select("feature", F.round("max_cooks", 4).alias("max_cooks"))


@query()
def nb_wald_outliers(t: Tables):
    """Fit with outliers replaced or flagged, one contrast, p-values of flagged features NULL."""
    counts, samples, factors = stored_inputs(t)
    samples = materialize(samples.withColumn("enrichment", enrichment("taxon")), "samples")
    fit, levels = outliers.fit_without_outliers(counts, samples, "enrichment", factors, trend="local")
    tests = outliers.mask_outliers(de.wald_tests(fit, levels, [("Beta", "Alpha")]), fit)
    return de.bh_adjust(tests, ["comparison"]).join(fit.select("feature", "n_replaced"), "feature")


@query()
def pairwise_contrasts(t: Tables):
    """One added to every cell, parametric trend, every pair of substrates from one fit."""
    samples = materialize(taxon_samples(t), "samples")
    counts = add_pseudocount(taxon_counts(t), samples, gene_features(t))
    counts = materialize(counts, "pseudocount")
    factors = de.size_factors(counts, de.geometric_means(counts, samples), rescale=False)
    fit, levels = de.fit_features(counts, samples, "substrate", factors, trend="parametric")
    return de.bh_adjust(de.wald_tests(fit, levels), ["comparison"])


#: features 0 modulo 3 lose one substrate, features 1 modulo 3 have explicit zeros there, so levels without counts occur
_SOME_COUNTS = """SELECT c.sample, feature, CASE WHEN substrate = 'EG' AND feature % 3 = 1 THEN 0 ELSE count END AS count
 FROM taxon_counts c JOIN taxon_samples USING (sample) WHERE NOT (substrate = 'TPA' AND feature % 3 = 0)"""


def _ratio_sql() -> str:
    levels = sorted(SUBSTRATES)
    pairs = ", ".join(f"('{levels[j]}', '{levels[i]}')" for i in range(5) for j in range(i + 1, 5))
    return with_tables(
        _BOTH,
        f"""SELECT feature, num || '_vs_' || den AS comparison, CASE WHEN a = 0 AND b = 0 THEN NULL WHEN a = 0 THEN '-Infinity'::DOUBLE
 WHEN b = 0 THEN 'Infinity'::DOUBLE ELSE round(log2(a) - log2(b), 6) + 0.0 END AS log2_ratio, (a = 0) <> (b = 0) AS one_sided_zero
 FROM (SELECT f.feature, num, den, coalesce(x.m, 0) AS a, coalesce(y.m, 0) AS b
 FROM (SELECT DISTINCT feature FROM counts_) f CROSS JOIN (VALUES {pairs}) p(num, den)
 LEFT JOIN means x ON x.feature = f.feature AND x.substrate = num LEFT JOIN means y ON y.feature = f.feature AND y.substrate = den)""",
        counts_=_SOME_COUNTS,
        **_GEO,
        sizes="SELECT substrate, COUNT(*) AS n FROM taxon_samples GROUP BY 1",
        means="""SELECT feature, substrate, SUM(count / size_factor) / MAX(n) AS m FROM counts_
 JOIN factors USING (sample) JOIN taxon_samples USING (sample) JOIN sizes USING (substrate) GROUP BY 1, 2""",
    )


@query(_ratio_sql())
def log2_ratio_pairs(t: Tables):
    """Log2 ratio of mean normalised counts for every pair of substrates, levels without counts included."""
    counts, samples, factors = stored_inputs(t)
    some = (
        counts.join(samples.select("sample", "substrate"), "sample")
        .where(~((F.col("substrate") == "TPA") & (F.col("feature") % 3 == 0)))
        .withColumn("count", F.when((F.col("substrate") == "EG") & (F.col("feature") % 3 == 1), 0).otherwise(F.col("count")))
        .drop("substrate")
    )
    out = de.log2_ratio_pairs(some, samples, "substrate", factors, sorted(SUBSTRATES))
    return out.withColumn("log2_ratio", F.round("log2_ratio", 6) + F.lit(0.0))


_PADJ = """SELECT *, CASE WHEN pvalue IS NOT NULL THEN MIN(q) OVER (PARTITION BY comparison ORDER BY pvalue DESC
 RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS padj FROM (SELECT *,
 least(1.0, pvalue * COUNT(pvalue) OVER (PARTITION BY comparison) /
 CASE WHEN pvalue IS NOT NULL THEN COUNT(pvalue) OVER (PARTITION BY comparison ORDER BY pvalue
 RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END) AS q FROM results_table) WHERE pvalue IS NOT NULL
 UNION ALL SELECT *, NULL, NULL FROM results_table WHERE pvalue IS NULL"""


def adjusted(t: Tables):
    return de.bh_adjust(results_table(t), ["comparison"])


@query(with_tables("results_table", "SELECT feature, comparison, pvalue, round(padj, 9) AS padj FROM a", a=_PADJ))
def bh_adjust(t: Tables):
    """Adjusted p-values per comparison; NULL stays NULL."""
    return adjusted(t).select("feature", "comparison", "pvalue", F.round("padj", 9).alias("padj"))


_FILTERED = """WITH r AS (SELECT *, (split_part(product, ' ', 2)::BIGINT % 500)::DOUBLE AS base_mean FROM results_table),
 cuts AS (SELECT comparison, unnest(range(20)) AS k, unnest(c) AS cut FROM (SELECT comparison, quantile_cont(base_mean,
 [0, .05, .1, .15, .2, .25, .3, .35, .4, .45, .5, .55, .6, .65, .7, .75, .8, .85, .9, .95]) AS c FROM r GROUP BY 1)),
 tried AS (SELECT comparison, k, cut, pvalue, COUNT(*) OVER (PARTITION BY comparison, k) AS m,
 COUNT(*) OVER (PARTITION BY comparison, k ORDER BY pvalue RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank
 FROM r JOIN cuts USING (comparison) WHERE pvalue IS NOT NULL AND base_mean >= cut),
 hits AS (SELECT comparison, k, cut, MAX(CASE WHEN pvalue * m / rank < 0.1 THEN rank ELSE 0 END) AS hits FROM tried GROUP BY ALL),
 best AS (SELECT comparison, cut FROM hits QUALIFY row_number() OVER (PARTITION BY comparison ORDER BY hits DESC, k) = 1),
 used AS (SELECT feature, comparison, pvalue, m, rank FROM (SELECT feature, comparison, pvalue,
 COUNT(*) OVER (PARTITION BY comparison) AS m, COUNT(*) OVER (PARTITION BY comparison ORDER BY pvalue RANGE BETWEEN UNBOUNDED PRECEDING
 AND CURRENT ROW) AS rank FROM r JOIN best USING (comparison) WHERE pvalue IS NOT NULL AND base_mean >= cut)),
 adj AS (SELECT feature, comparison, MIN(least(1.0, pvalue * m / rank)) OVER (PARTITION BY comparison ORDER BY pvalue DESC
 RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS padj FROM used)
 SELECT r.feature, r.comparison, round(b.cut, 6) AS base_mean_cutoff, round(adj.padj, 9) AS padj
 FROM r JOIN best b USING (comparison) LEFT JOIN adj ON adj.feature = r.feature AND adj.comparison = r.comparison"""


@query(with_tables("results_table", "SELECT * FROM filtered", filtered=_FILTERED))
def bh_adjust_filtered(t: Tables):
    """Adjusted p-values after independent filtering on a base-mean column."""
    rows = results_table(t).withColumn("base_mean", (F.substring_index("product", " ", -1).cast("bigint") % 500).cast("double"))
    out = de.bh_adjust_filtered(rows, ["comparison"])
    return out.select("feature", "comparison", F.round("base_mean_cutoff", 6).alias("base_mean_cutoff"), F.round("padj", 9).alias("padj"))


_SMOOTHED = _FILTERED.replace(
    " best AS (SELECT comparison, cut FROM hits QUALIFY row_number() OVER (PARTITION BY comparison ORDER BY hits DESC, k) = 1),",
    """ near AS (SELECT a.comparison, a.k, (b.k - a.k)::DOUBLE AS x, abs(b.k - a.k)::DOUBLE AS d, b.hits::DOUBLE AS y,
 row_number() OVER (PARTITION BY a.comparison, a.k ORDER BY abs(b.k - a.k), b.k) AS place FROM hits a JOIN hits b ON a.comparison = b.comparison),
 weighed AS (SELECT *, CASE WHEN d < reach THEN pow(1 - pow(d / reach, 3), 3) ELSE 0 END AS w FROM (
 SELECT *, MAX(d) FILTER (place <= 4) OVER (PARTITION BY comparison, k) AS reach FROM near)),
 line AS (SELECT comparison, k, SUM(w) AS s, SUM(w * x) AS sx, SUM(w * x * x) AS sxx, SUM(w * y) AS sy, SUM(w * x * y) AS sxy FROM weighed GROUP BY 1, 2),
 curve AS (SELECT h.*, (sxx * sy - sx * sxy) / (s * sxx - sx * sx) AS smooth FROM hits h JOIN line USING (comparison, k)),
 level AS (SELECT comparison, MAX(smooth) - sqrt(coalesce(AVG(pow(hits - smooth, 2)) FILTER (hits > 0), 0)) AS level, MAX(hits) AS most FROM curve GROUP BY 1),
 best AS (SELECT comparison, coalesce(arg_min(cut, k) FILTER (most > 10 AND hits > level), arg_min(cut, k)) AS cut FROM curve JOIN level USING (comparison) GROUP BY 1),""",
)


@query(with_tables("results_table", "SELECT * FROM filtered", filtered=_SMOOTHED))
def bh_adjust_smoothed(t: Tables):
    """Independent filtering at the cutoff chosen from the smoothed curve of rejections."""
    rows = results_table(t).withColumn("base_mean", (F.substring_index("product", " ", -1).cast("bigint") % 500).cast("double"))
    out = de.bh_adjust_filtered(rows, ["comparison"], smooth=True)
    return out.select("feature", "comparison", F.round("base_mean_cutoff", 6).alias("base_mean_cutoff"), F.round("padj", 9).alias("padj"))


@query(with_tables("results_table", "SELECT feature, comparison FROM a WHERE padj < 0.01", a=_PADJ))
def significant_only(t: Tables):
    return de.significant_only(adjusted(t)).select("feature", "comparison")


@query(with_tables("results_table", """SELECT feature, comparison, threshold, CASE WHEN threshold = 'Enriched' THEN product
 WHEN threshold IS NOT NULL THEN 'Not_Enriched' END AS shown_product, round(-log10(padj), 6) AS neg_log10_padj FROM (
 SELECT *, CASE WHEN (abs(lfc) > 2 AND padj < 0.01) IS NULL THEN NULL WHEN abs(lfc) > 2 AND padj < 0.01 THEN 'Enriched'
 ELSE 'Not_Enriched' END AS threshold FROM a)""", a=_PADJ))
def volcano_label(t: Tables):
    """Enriched rows with their product, and the plotted height."""
    out = de.volcano_label(adjusted(t), "lfc", "padj", "product")
    return out.select(
        "feature", "comparison", "threshold", "shown_product", F.round("neg_log10_padj", 6).alias("neg_log10_padj")
    )


@query(with_tables("results_table", """SELECT comparison, CASE WHEN (padj <= 0.05 AND abs(lfc) >= 1.5) IS NULL THEN NULL
 WHEN padj <= 0.05 AND abs(lfc) >= 1.5 THEN 'Enriched' ELSE 'Not_Enriched' END AS threshold, COUNT(*) AS n FROM a GROUP BY 1, 2""", a=_PADJ))
def contrast_union(t: Tables):
    """All comparisons stacked, thresholded and counted."""
    rows = de.contrast_threshold(adjusted(t), "lfc", "padj")
    return rows.groupBy("comparison", "threshold").agg(F.count(F.lit(1)).alias("n"))


@query(with_tables("taxon_samples", """SELECT substrate AS level, COUNT(*) AS n_samples,
 (SELECT COUNT(DISTINCT substrate) FROM taxon_samples) AS n_levels, true AS replicated FROM taxon_samples GROUP BY 1"""))
def design_check(t: Tables):
    """Samples per level; a design without replicates raises."""
    return de.check_design(taxon_samples(t), "substrate", SUBSTRATES)
