"""Joins, reshaping, totals, quantiles and sources on hand-made rows."""

import os
import random
import statistics

import pytest
from conftest import rows
from pyspark.sql import functions as F

from biotables import sources
from biotables.operators import joins, reshape, totals
from biotables.plans import bins as bin_plans
from biotables.plans import expression, genes as gene_plans


def test_natural_join_matches_missing_keys(spark):
    a = spark.createDataFrame([("x", 1), (None, 2), ("only a", 3)], "k string, a int")
    b = spark.createDataFrame([("x", 10), (None, 20), ("only b", 30)], "k string, b int")
    assert rows(joins.natural_join(a, b, "full")) == [
        (None, 2, 20), ("only a", 3, None), ("only b", None, 30), ("x", 1, 10),
    ]
    assert len(rows(joins.natural_join(a, b, "inner", nulls_match=False))) == 1
    with pytest.raises(ValueError):
        joins.natural_join(a, b.withColumnRenamed("k", "other"), "full")
    with pytest.raises(ValueError):
        joins.key_join(a, a, ["k"])


def test_missing_keys_meet_missing_keys_in_chains(spark):
    loci = spark.createDataFrame([("l1", None), ("l2", "c1")], "locus string, contig string")
    bins = spark.createDataFrame([(None, "b0"), ("c1", "b1")], "contig string, bin string")
    assert rows(joins.natural_join(loci, bins, "left"), "locus", "bin") == [("l1", "b0"), ("l2", "b1")]


def test_left_join_required(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, "p"), (2, None)], "k int, name string")
    assert rows(joins.left_join_required(a, b, ["k"], "name")) == [(1, "p")]


def test_membership_independent_and_paired(spark):
    df = spark.createDataFrame([("b1", "genus"), ("b2", "genus"), ("b1", "order"), ("b3", None)], "bin string, rank string")
    flagged = spark.createDataFrame([("b1", "genus"), ("b2", "order"), ("b3", None)], "bin string, rank string")
    alone = joins.membership_flag(df, flagged, ["bin", "rank"], "hit")
    assert [r[2] for r in rows(alone)] == [True, True, True, True]
    paired = joins.membership_flag(df, flagged, ["bin", "rank"], "hit", paired=True)
    assert rows(paired) == [("b1", "genus", True), ("b1", "order", False), ("b2", "genus", False), ("b3", None, True)]


def test_pivots(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 5)], "id string, k string, v int")
    assert rows(reshape.pivot_wider_first(df, ["id"], "k", "v", ["x", "y"])) == [("a", 1, 2), ("b", 5, None)]
    assert rows(reshape.pivot_wider_sum(df.union(df), ["id"], "k", "v", ["x", "y"])) == [("a", 2, 4), ("b", 10, 0)]
    with pytest.raises(Exception, match="more than one value"):
        reshape.pivot_wider_first(df.union(df), ["id"], "k", "v", ["x", "y"]).collect()
    wide = reshape.pivot_wider_first(df, ["id"], "k", "v", ["x", "y"])
    assert len(rows(reshape.pivot_longer(wide, ["x", "y"], "k", "v"))) == 4


def test_keys_and_dense_index(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    numbers = [r[0] for r in reshape.dense_index(df, ["k"], "i", buckets=7).select("i").collect()]
    assert sorted(numbers) == list(range(1000))
    assert reshape.require_unique(df, ["k"]) is df
    with pytest.raises(ValueError):
        reshape.require_unique(df.union(df), ["k"])


def test_full_grid_has_every_cell(spark):
    s = spark.createDataFrame([("s1",), ("s2",)], "sample string")
    f = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "feature string")
    grid = reshape.full_grid(s, "sample", f, "feature")
    assert len(set(rows(grid))) == 6
    assert rows(reshape.full_grid(s.limit(0), "sample", f, "feature")) == []
    with pytest.raises(ValueError, match="max_cells"):
        reshape.full_grid(s, "sample", f, "feature", max_cells=5)
    assert reshape.full_grid(s, "sample", f, "feature", max_cells=6).count() == 6


def test_running_total_and_quantiles_against_plain_python(spark):
    rng = random.Random(5)
    data = [(g, rng.choice([-1, 1]) * rng.random() ** 8) for g in ("a", "b", None) for _ in range(300)]
    data += [("a", 0.25)] * 400 + [("a", 0.0), ("b", None), ("one", 7.0)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r["g"]: r for r in totals.exact_quantiles(df, ["g"], "v", {"q1": 0.25, "m": 0.5, "q3": 0.75}).collect()}
    for g in ("a", "b", None):
        values = [v for k, v in data if k == g and v is not None]
        q = statistics.quantiles(values, n=4, method="inclusive")
        assert got[g]["n"] == len(values)
        assert [got[g][c] for c in ("q1", "m", "q3")] == pytest.approx(q)
    assert got["one"]["m"] == 7.0


def test_value_bucket_is_monotone(spark):
    rng = random.Random(1)
    values = sorted([0.0, 1e-300, -1e-300, 1.0, -1.0] + [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 9) for _ in range(500)])
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("b", totals.value_bucket("v"))
    buckets = [r["b"] for r in df.orderBy("v").collect()]
    assert buckets == sorted(buckets)


def test_totals_shares_and_ranks(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), (None, 5)], "g string, v bigint")
    assert rows(totals.share_of_group(df, ["g"], "v", "s")) == [(None, 5, 1.0), ("a", 1, 0.25), ("a", 3, 0.75)]
    counted = spark.createDataFrame([("x", 5), ("y", 9), ("z", 5), ("w", 1)], "k string, n bigint")
    assert rows(totals.descending_rank(counted, "n", "r"), "k", "r") == [("w", 4), ("x", 2), ("y", 1), ("z", 2)]
    assert tuple(totals.duplicate_counts(df.union(df), ["g", "v"]).first()) == (3, True)


def test_lump_rare_uses_two_groups(spark):
    data = [("e1", "A")] * 99 + [("e1", None)] + [("e2", "A")]
    df = spark.createDataFrame(data, "w string, c string")
    out = totals.lump_rare(df, "w", "c", 0.05, "rare", "Unclassified")
    assert rows(out.groupBy("w", "c").count()) == [("e1", "A", 99), ("e1", "rare", 1), ("e2", "A", 1)]


# ---------------------------------------------------------------- files


def write(tmp_path, name, text, newline="\n"):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.replace("\n", newline).encode())
    return str(path)


def test_table_blank_and_missing_cells(spark, tmp_path):
    path = write(tmp_path, "t.csv", "id,gene,n\n1,,NA\nNA,abc,7\n3,NA,x\n")
    schema = "id bigint, gene string, n bigint"
    assert rows(sources.read_table(spark, path, schema)) == [(None, "abc", 7), (1, "", None), (3, None, None)]
    assert (1, None, None) in rows(sources.read_table(spark, path, schema, blank_as_null=True))
    with pytest.raises(Exception, match="(?i)header"):
        sources.read_table(spark, path, "id bigint, other string, n bigint").collect()


def test_sample_sheet_and_quantification(spark, tmp_path):
    sheet_path = write(tmp_path, "samples.csv", "﻿sample\nDCPET\nEG", "\r\n")
    sheet = sources.read_sample_sheet(spark, sheet_path)
    assert rows(sheet) == [("DCPET",), ("EG",)]
    for sample in ("DCPET", "EG", "HDPE"):
        write(tmp_path, f"quants/{sample}/quant.sf", "Name\tLength\tEffectiveLength\tTPM\tNumReads\nt1\t9\t8.5\t1.5\t3\n")
    got = rows(sources.read_quant(spark, str(tmp_path / "quants"), sheet))
    assert got == [("DCPET", "t1", 3.0, 1.5, 8.5), ("EG", "t1", 3.0, 1.5, 8.5)]


def test_text_readers(spark, tmp_path):
    counts = write(tmp_path, "c.txt", "E_1\t5\n__no_feature\t9\n")
    assert rows(sources.read_headerless(spark, counts, sources.COUNTS_SCHEMA)) == [("E_1", 5), ("__no_feature", 9)]
    gtf = write(tmp_path, "g.gtf", 'c1\tP:1\tCDS\t1\t9\t.\t+\t0\ttranscript_id "t"; gene_id "L_1";\n')
    assert sources.read_headerless(spark, gtf, sources.GTF_SCHEMA).first()["V9"].endswith('gene_id "L_1";')
    orf = write(tmp_path, "o.txt", "# ORF\tbin\no1\tb1\n")
    assert rows(sources.read_renamed(spark, orf, {"# ORF": "orf", "bin": "bin"})) == [("o1", "b1")]
    mark = write(tmp_path, "d.txt", "id\tv\n1\t2_5\n")
    assert rows(sources.read_decimal_mark(spark, mark, "id bigint, v double", "_")) == [(1, 2.5)]


def test_fasta(spark, tmp_path):
    path = write(tmp_path, "x.fa", ">c1 some text\nACGT\nacgg\n>c2\nTTTT\n")
    got = rows(sources.read_fasta(spark, path))
    assert got == [("c1", "some text", "ACGTACGG", 8, 0.625), ("c2", None, "TTTT", 4, 0.0)]


def test_csv_and_bundle_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "a,b")], "id bigint, s string")
    path = sources.write_csv(df, str(tmp_path / "out"))
    assert rows(sources.read_table(spark, path, "id bigint, s string")) == [(1, None), (2, "a,b")]
    bundle = sources.Bundle(df, df, df)
    back = sources.read_bundle(spark, sources.write_bundle(bundle, str(tmp_path / "bundle")))
    assert rows(back.samples) == rows(df)
    assert sorted(os.listdir(tmp_path / "bundle")) == ["counts", "features", "samples"]


# ---------------------------------------------------------------- plans


def classification_lines(spark):
    def line(name, *entries):
        return (f"{name}.fa\tclassified\t10\ta\tb\tc\td\t" + "\t".join(entries),)

    return spark.createDataFrame(
        [
            line("E1metabat.1", "Bac (superkingdom): 1.0", "Prot (phylum): 0.9", "G (genus): 0.7", "G2 (genus): 0.3"),
            line("E1metabat.2", "Bac (superkingdom): 1.0", "Firm (phylum): 0.8", "H (genus): 0.6"),
            line("E2metabat.3", "Bac (superkingdom): 1.0", "no support"),
        ],
        "value string",
    ).select(*[F.get(F.split("value", "\t"), i).alias(n) for i, n in enumerate(bin_plans.CLASSIFICATION_FIELDS)])


def test_taxonomy_drops_ambiguous_ranks(spark):
    lineage = bin_plans.bin_lineage(classification_lines(spark))
    assert lineage.count() == 9
    taxonomy = bin_plans.bin_taxonomy(lineage)
    assert rows(taxonomy, "BinID", "genus", "Best_Classification") == [
        ("E1metabat.1", None, "Prot_0.9_phylum"),
        ("E1metabat.2", "H_0.6_genus", "H_0.6_genus"),
        ("E2metabat.3", None, "Bac_1.0_superkingdom"),
    ]


def test_taxa_quality_is_a_full_join(spark):
    taxonomy = bin_plans.bin_taxonomy(bin_plans.bin_lineage(classification_lines(spark)))
    quality = spark.createDataFrame(
        [("E1metabat.1", "E1", 95.0, 1.0, "High"), ("E9metabat.9", "E9", 10.0, 1.0, "Low")],
        "BinID string, Enrichment string, Completeness double, Contamination double, Quality string",
    )
    got = rows(bin_plans.taxa_quality(taxonomy, quality), "BinID", "Enrichment", "Classification", "Confidence", "Tax_Level")
    assert got == [
        ("E1metabat.1", "E1", "Prot", 0.9, "phylum"),
        ("E1metabat.2", None, "H", 0.6, "genus"),
        ("E2metabat.3", None, "Bac", 1.0, "superkingdom"),
        ("E9metabat.9", "E9", None, None, None),
    ]


def test_count_merging_modes(spark):
    def counts(substrate, *pairs):
        return spark.createDataFrame(list(pairs), f"locus_tag string, {substrate} bigint")

    files = [
        counts("TPA", ("a_1", 5), ("a_2", 0), ("__ambiguous", 9)), counts("EG", ("a_1", 7), ("a_2", 1)),
        counts("TPA", ("b_1", 3)), counts("EG", ("b_1", 4)),
    ]
    natural = expression.merge_counts_natural(files)
    assert rows(natural, "locus_tag", "TPA", "EG") == [("a_1", 5, 7), ("a_2", 0, 1), ("b_1", None, 4), ("b_1", 3, None)]
    long = files[0].selectExpr("locus_tag", "'TPA' substrate", "TPA as count")
    for f, s in ((files[1], "EG"), (files[2], "TPA"), (files[3], "EG")):
        long = long.union(f.selectExpr("locus_tag", f"'{s}' substrate", f"{s} as count"))
    merged = expression.merge_counts(long, ["TPA", "EG"])
    assert rows(merged) == [("a_1", 5, 7), ("a_2", 0, 1), ("b_1", 3, 4)]


def test_fact_keeps_one_row_per_pathway_and_per_locus(spark):
    counts = spark.createDataFrame([("l1", 5), ("l2", 6), ("l3", 7)], "locus_tag string, TPA bigint")
    genes = spark.createDataFrame(
        [("l1", "E1", "ec1"), ("l2", "E1", "ec2"), ("l3", "E1", None)], "locus_tag string, Enrichment string, EC_number string"
    )
    pathways = spark.createDataFrame([("ec1", "p"), ("ec1", "q")], "EC_number string, General_Pathway string")
    loci = spark.createDataFrame([("l1", "c1"), ("l2", "c1"), ("l3", "c9")], "locus_tag string, contigName string")
    contigs = spark.createDataFrame([("c1", "E1", "b1")], "contigName string, Enrichment string, BinID string")
    taxa = spark.createDataFrame([("b1", "E1", "High")], "BinID string, Enrichment string, Quality string")
    fact = expression.assemble_fact(counts, genes, pathways, loci, contigs, taxa)
    assert rows(fact, "locus_tag", "General_Pathway", "Quality") == [
        ("l1", "p", "High"), ("l1", "q", "High"), ("l2", "Unknown_Pathway", "High"),
    ]
    single = expression.assemble_fact(counts, genes, None, loci, contigs, taxa)
    assert rows(single, "locus_tag", "TPA") == [("l1", 5), ("l2", 6)]


def test_expression_share_sums_to_one(spark):
    fact = spark.createDataFrame(
        [("b", "p1", "E", "T_0.5_genus", 1, 4), ("b", "p2", "E", "T_0.5_genus", 3, None), ("b", "p2", "E", "T_0.5_genus", 1, 1)],
        "BinID string, product string, Enrichment string, Best_Classification string, TPA bigint, EG bigint",
    )
    long = expression.expression_long(fact, ["BinID", "product", "Enrichment"], substrates=["TPA", "EG"])
    assert rows(long, "product", "Taxa", "Substrate", "Counts") == [
        ("p1", "T", "EG", 4), ("p1", "T", "TPA", 1), ("p2", "T", "EG", 0), ("p2", "T", "TPA", 4),
    ]
    members = spark.createDataFrame([("b", "p1", "E", "path"), ("b", "p2", "E", "path")], "BinID string, product string, Enrichment string, name string")
    share = expression.expression_share(fact, members, ["BinID", "product", "Enrichment"], substrates=["TPA", "EG"])
    assert rows(share, "product", "Substrate", "percent_expressed_gene_per_bin") == [
        ("p1", "EG", 1.0), ("p1", "TPA", 0.2), ("p2", "TPA", 0.8),
    ]


def test_gene_lists(spark):
    mapping = gene_plans.PATHWAY_OF_GENE
    assert mapping["tphBI_1"] == "Terephthalate" and mapping["pcaH"] == "Protocatechuate"
    assert mapping["alkB2"] == "Alkane" and mapping["tcbC"] == "Catechol" and len(mapping) == 18
    df = spark.createDataFrame([("tcbC", "x"), (None, gene_plans.PET_PRODUCT), ("zzz", "x"), ("pcaG", None)], "gene string, product string")
    name, pathway = gene_plans.pathway_category(gene_plans.PET_PRODUCT, mapping)
    got = rows(df.select(name.alias("g"), pathway.alias("p")))
    assert got == [(None, None), ("no_name", "Cleave Ethylene Glycol"), ("tcbC", "Catechol"), ("zzz", "zzz")]
    listed = df.filter(gene_plans.whitelist(gene_plans.PET_PRODUCT, gene_plans.DEGRADATION_GENES))
    assert listed.count() == 3


def test_pathway_products(spark):
    export = spark.createDataFrame([("P one // P 1", "<i>a</i> x // b / b"), ("P two", None)], "names string, enzymes string")
    assert rows(gene_plans.pathway_products(export)) == [("P one", "a x"), ("P one", "b")]
    long = spark.createDataFrame([("P", " // ".join(f"e{k}" for k in range(40)))], "names string, enzymes string")
    assert gene_plans.pathway_products(long).count() == 40


def test_headers_are_checked_in_every_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n3,4\n")
    assert rows(sources.read_table(spark, str(tmp_path / "a.csv"), "x int, y int")) == [(1, 2)]
    with pytest.raises(Exception, match="(?i)header"):
        sources.read_directory(spark, str(tmp_path), "x int, y int", sep=",").collect()


def test_quotes_are_doubled(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "a, b"'), (2, "back\\slash"), (3, None), (4, "")], "x int, y string")
    path = sources.write_csv(df, str(tmp_path / "out"))
    written = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert '"say ""a, b"""' in written
    assert rows(sources.read_table(spark, path, "x int, y string")) == rows(df)
