"""Community and differential statistics against brute force and known answers."""

import hashlib
import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from biotables.operators import clustering, community, distance, ordination
from biotables.operators import differential as de


def make_counts(spark, n_samples=9, n_features=14, seed=3):
    """Counts with one feature and one sample that hold a large part of everything."""
    rng = random.Random(seed)
    data = []
    for s in range(n_samples):
        for f in range(n_features):
            hot = f == 0 or s == 0
            if hot or rng.random() < 0.4:
                data.append((f"s{s}", f"f{f}", rng.randint(1, 500 if hot else 20)))
    return data, spark.createDataFrame(data, "sample string, feature string, count bigint")


def by_sample(data):
    out = {}
    for s, f, c in data:
        out.setdefault(s, {})[f] = c
    return out


def test_rarefy_matches_the_written_recipe(spark):
    data, df = make_counts(spark)
    profiles = by_sample(data)
    depth = min(sum(p.values()) for p in profiles.values())
    want = {}
    for s, profile in profiles.items():
        order = sorted(profile, key=lambda f: (hashlib.md5(f.encode()).hexdigest(), f))
        ends = np.cumsum([profile[f] for f in order])
        for d in range(depth):
            h = int(hashlib.md5(f"81|{s}|{d}".encode()).hexdigest()[:15], 16)
            u = h * int(ends[-1]) // 2**60
            f = order[int(np.searchsorted(ends, u, side="right"))]
            want[s, f] = want.get((s, f), 0) + 1
    for draws in (20_000, 50):  # one slot per sample, and many
        got = {(r[0], r[1]): r[2] for r in rows(community.rarefy(df, 81, draws), "sample", "feature", "count")}
        assert got == want


def test_alpha_diversity(spark):
    data, df = make_counts(spark)
    for r in community.alpha_diversity(df).collect():
        p = np.array(list(by_sample(data)[r["sample"]].values()), dtype=float)
        p /= p.sum()
        assert r["observed"] == len(p)
        assert r["shannon"] == pytest.approx(-(p * np.log(p)).sum())
        assert r["shannon"] <= math.log(r["observed"]) + 1e-12


def matrix_of(data):
    profiles = by_sample(data)
    features = sorted({f for _, f, _ in data})
    names = sorted(profiles)
    return names, np.array([[profiles[s].get(f, 0) for f in features] for s in names], dtype=float)


@pytest.mark.parametrize("block,cells", [(512, 200_000), (4, 200_000), (4, 5)])
@pytest.mark.parametrize("gain", [8, 10**9])
def test_distances_by_blocks(spark, monkeypatch, block, cells, gain):
    monkeypatch.setattr(distance, "CELLS_PER_TASK", cells)
    monkeypatch.setattr(distance, "DENSE_GAIN", gain)
    monkeypatch.setattr(distance, "EXPAND", 7)
    data, _ = make_counts(spark)
    data += [("alone", "g1", 4)]  # shares nothing with the others
    df = spark.createDataFrame(data, "sample string, feature string, count bigint")
    names, m = matrix_of(data)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    bray = {(a, b): d for a, b, d in rows(distance.bray_curtis(df, block))}
    euclid = {(a, b): d for a, b, d in rows(distance.euclidean(df, block))}
    assert len(bray) == len(euclid) == len(pairs)
    for i, j in pairs:
        key = (names[i], names[j])
        assert bray[key] == pytest.approx(1 - 2 * np.minimum(m[i], m[j]).sum() / (m[i].sum() + m[j].sum()))
        assert euclid[key] == pytest.approx(np.linalg.norm(m[i] - m[j]))
    assert bray["alone", "s3"] == 1.0


def test_vector_distances(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(11, 5))
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(11)], "id bigint, v array<double>")
    got = {(a, b): d for a, b, d in rows(distance.vector_distances(df, "id", "v", block=4))}
    assert len(got) == 55
    assert all(d == pytest.approx(np.linalg.norm(v[a] - v[b])) for (a, b), d in got.items())


def points_distances(spark, n, dims, seed=1):
    p = np.random.default_rng(seed).normal(size=(n, dims)) * np.arange(dims, 0, -1)
    data = [(f"p{i:02}", f"p{j:02}", float(np.linalg.norm(p[i] - p[j]))) for i in range(n) for j in range(i + 1, n)]
    return p, spark.createDataFrame(data, "id_a string, id_b string, dist double")


def coordinates(df, axes):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], np.zeros(axes))[r["axis"] - 1] = r["coordinate"]
    return np.array([out[k] for k in sorted(out)])


def test_pcoa_reproduces_euclidean_distances(spark):
    p, dist = points_distances(spark, 12, 3)
    c = coordinates(ordination.pcoa(dist, axes=3), 3)
    gaps = np.linalg.norm(c[:, None] - c[None], axis=2)
    assert np.allclose(gaps, np.linalg.norm(p[:, None] - p[None], axis=2))
    assert np.allclose(c.sum(axis=0), 0, atol=1e-9)
    assert np.allclose(c.T @ c, np.diag(np.diag(c.T @ c)), atol=1e-8)


def centred(distances):
    n = len(distances)
    center = np.eye(n) - 1 / n
    return -0.5 * center @ (distances * distances) @ center


def test_pcoa_with_negative_eigenvalues_gives_both_axes(spark):
    rng = np.random.default_rng(0)
    n = 40
    basis = np.linalg.qr(np.c_[np.ones(n), rng.standard_normal((n, n - 1))])[0][:, 1:]
    values = np.r_[100, 3, -np.arange(1, 10), np.zeros(n - 12)]
    b = basis * values @ basis.T
    d = np.sqrt(np.maximum(np.diag(b)[:, None] + np.diag(b) - 2 * b, 0))
    i, j = np.triu_indices(n, 1)
    dist = spark.createDataFrame([(int(x), int(y), float(d[x, y])) for x, y in zip(i, j)], "id_a long, id_b long, dist double")
    want, vectors = np.linalg.eigh(centred(d))
    got = coordinates(ordination.pcoa(dist, axes=2), 2)
    assert np.allclose((got * got).sum(axis=0), want[:-3:-1])
    assert np.allclose(np.abs(got), np.abs(vectors[:, :-3:-1] * np.sqrt(want[:-3:-1])), atol=1e-7)


def test_pcoa_of_one_place_has_no_axes(spark):
    dist = spark.createDataFrame([(1, 2, 0.0), (1, 3, 0.0), (2, 3, 0.0)], "id_a long, id_b long, dist double")
    assert ordination.pcoa(dist).count() == 0


def naive_average_linkage(dist):
    d = {tuple(sorted(k)): v for k, v in dist.items()}
    size = {x: 1 for k in d for x in k}
    merges = []
    while d:
        (a, b), h = min(d.items(), key=lambda kv: (kv[1], kv[0]))
        for c in [x for x in size if x not in (a, b)]:
            da, db = d.pop(tuple(sorted((a, c)))), d.pop(tuple(sorted((b, c))))
            d[tuple(sorted((a, c)))] = (size[a] * da + size[b] * db) / (size[a] + size[b])
        del d[a, b]
        size[a] += size.pop(b)
        merges.append((a, b, round(h, 9), size[a]))
    return sorted(merges)


def test_clustering_equals_naive(spark):
    _, dist = points_distances(spark, 16, 2, seed=4)
    want = naive_average_linkage({(a, b): d for a, b, d in rows(dist)})
    merges = clustering.average_linkage(dist)
    assert sorted((a, b, round(h, 9), n) for a, b, h, n, _, _ in rows(merges)) == want
    order = rows(clustering.leaf_order(merges), "position", "leaf")
    assert [r[0] for r in order] == list(range(1, 17)) and len({r[1] for r in order}) == 16


def test_clustering_with_ties_writes_in_proportion_to_pairs(spark, monkeypatch):
    rnd = np.random.default_rng(8)
    spots = rnd.integers(0, 5, (40, 2))  # many equal places and equal distances
    data = [(a, b, float(abs(spots[a] - spots[b]).sum())) for a in range(40) for b in range(a + 1, 40)]
    dist = spark.createDataFrame(data, "id_a long, id_b long, dist double")
    written, plain = [], clustering.materialize

    def counted(df, label):
        out = plain(df, label)
        written.append(out.count() if label == "links" else 0)
        return out

    monkeypatch.setattr(clustering, "materialize", counted)
    merges = plain(clustering.average_linkage(dist), "t")
    assert merges.count() == 39 and sum(written) <= 4 * len(data)
    found = rows(clustering.cophenetic(merges, dist), "id_a", "id_b", "dist", "merge_left", "size", "height")
    assert sorted((a, b, d) for a, b, d, *_ in found) == sorted(data)
    groups = {}
    for _, _, d, name, size, height in found:
        groups.setdefault((name, size, height), []).append(d)
    assert len(groups) == 39 and all(abs(np.mean(ds) - key[2]) < 1e-9 for key, ds in groups.items())


def test_clustering_of_nothing_and_of_one_pair(spark):
    schema = "id_a long, id_b long, dist double"
    assert clustering.average_linkage(spark.createDataFrame([], schema)).count() == 0
    assert rows(clustering.average_linkage(spark.createDataFrame([(2, 1, 0.5)], schema))) == [(1, 2, 0.5, 2, 1, 1)]


def test_tied_clusters_pair_off_together(spark):
    data = [(a, b, 1.0) for a in range(14) for b in range(a + 1, 14)]
    dist = spark.createDataFrame(data, "id_a long, id_b long, dist double")
    merges = clustering.average_linkage(dist)
    assert merges.count() == 13 and {r.height for r in merges.collect()} == {1.0}
    assert sorted(r.position for r in clustering.leaf_order(merges).collect()) == list(range(1, 15))
    first = clustering._mutual_pairs(dist.selectExpr("id_a lo", "id_b hi", "dist d", "1D w_lo", "1D w_hi"), 0)
    assert first.count() >= 2


def test_pseudocount_and_zero_features(spark):
    counts = spark.createDataFrame([("s1", "f1", 3)], "sample string, feature string, count bigint")
    samples = spark.createDataFrame([("s1",), ("s2",)], "sample string")
    features = spark.createDataFrame([("f1",), ("f2",)], "feature string")
    assert rows(community.add_pseudocount(counts, samples, features)) == [
        ("s1", "f1", 4), ("s1", "f2", 1), ("s2", "f1", 1), ("s2", "f2", 1),
    ]
    assert tuple(community.zero_features(counts, features).first()) == (2, 1, True)


# ---------------------------------------------------------------- differential


def bh(p):
    p = np.asarray(p)
    order = np.argsort(-p)
    out = np.empty(len(p))
    low = 1.0
    for rank, i in zip(range(len(p), 0, -1), order):
        low = min(low, p[i] * len(p) / rank)
        out[i] = low
    return out


def test_bh_with_ties_and_missing(spark):
    rng = random.Random(2)
    ps = [0.0, 1.0, 1.0, 0.01, 0.01, 0.01] + [rng.random() ** 6 for _ in range(200)] + [0.3] * 120
    data = [("a", i, p) for i, p in enumerate(ps)] + [("b", 0, 0.04), ("b", 1, None), ("b", 2, 0.05)]
    df = spark.createDataFrame(data, "g string, i int, pvalue double")
    got = {(r["g"], r["i"]): r["padj"] for r in de.bh_adjust(df, ["g"]).collect()}
    want = bh(ps)
    assert all(got["a", i] == pytest.approx(want[i]) for i in range(len(ps)))
    assert got["b", 1] is None and got["b", 0] == pytest.approx(0.05) and got["b", 2] == pytest.approx(0.05)
    assert all(got["a", i] >= ps[i] for i in range(len(ps)))


def simulated(spark, effect, n_features=400, per_level=6, seed=7):
    rng = np.random.default_rng(seed)
    n = per_level * 2
    depth = np.exp(rng.normal(0, 0.3, n))
    base = np.exp(rng.normal(4, 1, n_features))
    fold = np.where(np.arange(n_features) < n_features // 4, 2.0**effect, 1.0)
    data = []
    for f in range(n_features):
        for s in range(n):
            mu = base[f] * depth[s] * (fold[f] if s >= per_level else 1)
            data.append((f"s{s:02}", f"f{f:04}", int(rng.poisson(rng.gamma(5, mu / 5)))))
    counts = spark.createDataFrame([d for d in data if d[2] > 0], "sample string, feature string, count bigint")
    samples = spark.createDataFrame(
        [(f"s{s:02}", "treated" if s >= per_level else "control") for s in range(n)], "sample string, arm string"
    )
    return data, depth, counts, samples


@pytest.fixture(scope="module")
def fitted(spark):
    data, depth, counts, samples = simulated(spark, effect=1.5)
    factors = de.size_factors(counts, de.geometric_means(counts, samples))
    fit, levels = de.fit_features(counts, samples, "arm", factors)
    return data, depth, counts, samples, factors, fit, levels


def test_size_factors_match_numpy(fitted):
    data, depth, _, _, factors, _, _ = fitted
    names, m = matrix_of([(s, f, c) for s, f, c in data])
    with np.errstate(divide="ignore"):
        logs = np.where(m > 0, np.log(np.maximum(m, 1)), 0)
    geo = np.exp(logs.sum(axis=0) / len(names))
    raw = np.array([np.median(np.log(row[row > 0] / geo[row > 0])) for row in m])
    want = np.exp(raw - raw.mean())
    got = {s: v for s, v in rows(factors)}
    assert [got[s] for s in names] == pytest.approx(list(want))


def test_wald_recovers_the_fold_change(fitted):
    *_, fit, levels = fitted
    tests = de.wald_tests(fit, levels, [("treated", "control")]).toPandas().sort_values("feature")
    changed, null = tests.iloc[:100], tests.iloc[100:]
    assert changed["log2_fold_change"].mean() - null["log2_fold_change"].median() == pytest.approx(1.5, abs=0.15)
    z = null["stat"] - null["stat"].median()
    assert 0.8 < z.std() < 1.25
    spread = fit.select(F.median("dispersion")).first()[0]
    assert 0.12 < spread < 0.32  # simulated with 0.2


def test_contrasts_are_antisymmetric_and_checked(fitted):
    *_, fit, levels = fitted
    both = de.wald_tests(fit, levels, [("treated", "control"), ("control", "treated")])
    sums = both.groupBy("feature").agg(F.sum("log2_fold_change").alias("s"), F.count_distinct("pvalue").alias("p"))
    assert sums.filter((F.abs("s") > 1e-9) | (F.col("p") > 1)).count() == 0
    with pytest.raises(ValueError):
        de.wald_tests(fit, levels, [("treated", "absent")])


def test_local_trend_follows_the_parametric_one(spark):
    rng = np.random.default_rng(0)
    mean = np.exp(rng.uniform(0, 8, 600))
    disp = (3 / mean + 0.1) * np.exp(rng.normal(0, 0.1, 600))
    genes = spark.createDataFrame([(float(m), float(d)) for m, d in zip(mean, disp)], "base_mean double, disp_gene double")
    a0, a1 = de.parametric_trend(genes)
    assert a0 == pytest.approx(0.1, rel=0.1) and a1 == pytest.approx(3, rel=0.1)
    trend = de._Trend(local=de.local_trend(genes))
    at = np.array([5.0, 50.0, 500.0])
    assert np.exp(trend.log_value(at)) == pytest.approx(3 / at + 0.1, rel=0.5)
    column = spark.createDataFrame([(float(v),) for v in at], "m double").select(trend.column(F.col("m"))).collect()
    assert [r[0] for r in column] == pytest.approx(list(trend.log_value(at)))


def test_lgamma_and_trigamma():
    x = np.array([1e-3, 0.5, 1.0, 7.3, 1e5])
    assert de._lgamma(x) == pytest.approx([math.lgamma(v) for v in x], abs=1e-9)
    assert de._trigamma(1.0) == pytest.approx(math.pi**2 / 6)


def test_design_needs_replicates_and_levels(spark):
    single = spark.createDataFrame([("s1", "a"), ("s2", "b")], "sample string, arm string")
    with pytest.raises(ValueError, match="two samples"):
        de.check_design(single, "arm")
    with pytest.raises(ValueError, match="do not occur"):
        de.check_design(single, "arm", ["zzz"])


def test_labels(spark):
    df = spark.createDataFrame(
        [(3.0, 0.001, "p"), (-3.0, 0.001, "q"), (3.0, None, "r"), (1.0, None, "s"), (3.0, 0.5, "t")],
        "lfc double, padj double, product string",
    )
    got = rows(de.volcano_label(df, "lfc", "padj", "product"), "product", "threshold", "shown_product")
    assert got == [
        ("p", "Enriched", "p"), ("q", "Enriched", "q"), ("r", None, None), ("s", "Not_Enriched", "Not_Enriched"),
        ("t", "Not_Enriched", "Not_Enriched"),
    ]


def test_log2_ratio_has_a_row_for_every_pair(spark):
    samples = spark.createDataFrame([("s1", "A"), ("s2", "A"), ("s3", "B"), ("s4", "C")], "sample string, f string")
    factors = samples.select("sample", F.lit(1.0).alias("size_factor"))
    counts = spark.createDataFrame([("s1", "f1", 4), ("s3", "f1", 0), ("s3", "f2", 8), ("s1", "f3", 2), ("s2", "f3", 2), ("s3", "f3", 4)], "sample string, feature string, count long")
    got = {(r.feature, r.comparison): (r.log2_ratio, r.one_sided_zero) for r in de.log2_ratio_pairs(counts, samples, "f", factors, ["A", "B", "C"]).collect()}
    assert len(got) == 9 and got["f3", "B_vs_A"] == (1.0, False)
    assert got["f1", "B_vs_A"] == (float("-inf"), True) and got["f2", "B_vs_A"] == (float("inf"), True)
    assert got["f1", "C_vs_B"] == (None, False) and got["f2", "C_vs_B"] == (float("-inf"), True)


def test_filtered_adjustment_equals_plain_python(spark):
    rng = np.random.default_rng(5)
    mean = rng.integers(0, 50, 300).astype(float)
    p = np.where(mean > 25, rng.random(300) ** 5, rng.random(300))
    df = spark.createDataFrame([("g", i, float(m), float(v)) for i, (m, v) in enumerate(zip(mean, p))], "g string, i int, base_mean double, pvalue double")

    def adjust(v):
        order = np.argsort(v)
        q = v[order] * len(v) / np.arange(1, len(v) + 1)
        out = np.empty(len(v))
        out[order] = np.minimum(1, np.minimum.accumulate(q[::-1])[::-1])
        return out

    cuts = [np.quantile(mean, k / 20) for k in range(20)]
    hits = [(adjust(p[mean >= c]) < 0.1).sum() for c in cuts]
    cut = cuts[int(np.argmax(hits))]
    got = {r.i: r for r in de.bh_adjust_filtered(df, ["g"]).collect()}
    want = dict(zip(np.flatnonzero(mean >= cut), adjust(p[mean >= cut])))
    assert {r.base_mean_cutoff for r in got.values()} == {cut}
    assert all((i in want) == (r.padj is not None) and (r.padj is None or abs(r.padj - want[i]) < 1e-9) for i, r in got.items())


def test_distances_with_one_huge_sample(spark, monkeypatch):
    monkeypatch.setattr(distance, "CELLS_PER_TASK", 300)
    rng = np.random.default_rng(3)
    data = [("s0", f"f{k}", int(rng.integers(1, 9))) for k in range(4000)]
    data += [(f"s{i}", f"f{int(k)}", int(rng.integers(1, 9))) for i in range(1, 7) for k in rng.choice(4000, 4, replace=False)]
    table = {}
    for s, f, c in data:
        table.setdefault(s, {})[f] = c
    got = {(r.id_a, r.id_b): r.dist for r in distance.bray_curtis(spark.createDataFrame(data, "sample string, feature string, count long"), block=2).collect()}
    assert len(got) == 21
    for (a, b), d in got.items():
        both = sum(min(c, table[b].get(f, 0)) for f, c in table[a].items())
        assert abs(d - (1 - 2 * both / (sum(table[a].values()) + sum(table[b].values())))) < 1e-12


def test_log_gamma_of_the_dispersion_once_a_feature(monkeypatch):
    design = de._Design(np.ones(6), np.array([0, 0, 0, 1, 1, 1]), ["a", "b"])
    counts = np.array([[3.0, 4, 5, 6, 7, 8], [1, 2, 1, 5, 4, 3]])
    plain, seen = de._lgamma, []
    monkeypatch.setattr(de, "_lgamma", lambda x: seen.append(x.size) or plain(x))
    for zero in (False, True):
        counts[0, 0] = 0 if zero else 3
        mu = design.fitted(design.group_means(counts))
        seen.clear()
        got = de._profile(counts, mu, np.array([-1.0, 0.5]), design)
        assert sum(seen) == (counts > 0).sum() + len(counts)
        for row, x, m, log_alpha in zip(got, counts, mu, (-1.0, 0.5)):
            r = math.exp(-log_alpha)
            ll = sum(math.lgamma(k + r) - math.lgamma(r) + k * math.log(u / (u + r)) - r * math.log1p(u / r) if k else -r * math.log1p(u / r) for k, u in zip(x, m))
            info = [sum(u / (1 + u / r) for u in part) for part in (m[:3], m[3:])]
            assert row == pytest.approx(ll - 0.5 * sum(map(math.log, info)))
