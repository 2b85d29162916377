"""Tables stored in hash buckets: joins and groupings on the key without a shuffle."""

import re

from conftest import rows
from pyspark.sql import functions as F

from biotables.plans import expression
from biotables.sources.buckets import store_bucketed


def exchanges(df):
    """Shuffles in the physical plan; broadcasts do not count."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"(?<!Broadcast)Exchange (\w+)\(([^)]*)\)", text)


def inputs(spark):
    counts = spark.createDataFrame(
        [("b_1", "TPA", 3), ("b_1", "EG", 0), ("b_2", "TPA", 5), ("b_3", "TA", 1), ("__no_feature", "TPA", 99), ("b_4", "EG", 2)],
        "locus_tag string, substrate string, count long",
    )
    genes = spark.createDataFrame(
        [("b_1", "E", "c1", "g", "EC 1"), ("b_1", "E", "c1", "g", "EC 1"), ("b_2", "E", "c1", "h", None), ("b_3", "E", "c2", "g", "EC 2")],
        "locus_tag string, Enrichment string, contigName string, gene string, EC_number string",
    )
    contigs = spark.createDataFrame([("c1", "E", "bin1"), ("c9", "E", "bin2")], "contigName string, Enrichment string, BinID string")
    taxa = spark.createDataFrame([("bin1", "E", "X_0.5_genus")], "BinID string, Enrichment string, Best_Classification string")
    pathways = spark.createDataFrame([("EC 1", "p"), ("EC 1", "q")], "EC_number string, General_Pathway string")
    return counts, genes, contigs, taxa, pathways


def test_loci_meet_inside_their_buckets(spark):
    counts, genes, contigs, taxa, pathways = inputs(spark)
    store = expression.LocusStore.write(counts, genes, buckets=3)
    loci = expression.merge_counts(store.counts).join(store.genes.withColumnRenamed("locus_tag", "tag").hint("merge"), F.col("locus_tag") == F.col("tag"))
    assert exchanges(loci) == []
    assert exchanges(expression.merge_counts(store.counts)) == []
    fact = store.fact(pathways, contigs, taxa)
    assert not any("locus_tag" in keys for _, keys in exchanges(fact)) and len(exchanges(fact)) <= 4
    plain = expression.assemble_fact(expression.merge_counts(counts), genes, pathways, None, contigs, taxa)
    assert rows(fact, *sorted(plain.columns)) == rows(plain, *sorted(plain.columns))
    assert len(rows(fact)) == 3


def test_gene_totals(spark):
    counts, genes, *_ = inputs(spark)
    store = expression.LocusStore.write(counts, genes, buckets=2)
    assert rows(store.gene_totals("gene")) == [("g", 4, 2), ("h", 5, 1)]


def test_buckets_keep_every_row_and_one_file_each(spark, tmp_path):
    df = spark.createDataFrame([(k, i) for i, k in enumerate(["a", "b", None, "a", "c", None])], "k string, v int")
    stored = store_bucketed(df, "t", ["k"], 4, str(tmp_path / "t"))
    assert rows(stored) == rows(df)
    assert len(list((tmp_path / "t").glob("*.parquet"))) <= 4
    assert exchanges(stored.groupBy("k").count()) == []
    assert store_bucketed(df.limit(0), "empty", ["k"], 4).collect() == []
