"""Known result rows, NULL keys dealt to many tasks, headers of quantification files."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from biotables.functions import quality_tier
from biotables.operators.joins import key_join
from biotables.plans import bins
from biotables.sources import text

# Bins of the published result table. Label, completeness, contamination, tier, name, confidence, rank.
KNOWN = [
    ("Paracoccus alcaliphilus_0.80_species", 97.12121212121212, 1.9949494949494948, "High", "Paracoccus alcaliphilus", 0.8, "species"),
    ("Alcaligenaceae bacterium_0.55_species", 91.92849177585725, 5.687203791469194, "Medium", "Alcaligenaceae bacterium", 0.55, "species"),
    ("Pusillimonas noertemannii_0.47_species", 63.06105380540842, 3.080568720379147, "Medium", "Pusillimonas noertemannii", 0.47, "species"),
    ("Trueperaceae bacterium*_0.38_species", 21.379310344827587, 0.0, "Low", "Trueperaceae bacterium*", 0.38, "species"),
    ("Proteobacteria_0.32_phylum", 0.31347962382445144, 0.0, "Low", "Proteobacteria", 0.32, "phylum"),
    ("Intramacronucleata_0.57_subphylum", 6.919482386772106, 0.9345794392523364, "Low", "Intramacronucleata", 0.57, "subphylum"),
    ("Pelagibacterium_0.65_genus", 100.0, 21.473354231974923, "Contaminated", "Pelagibacterium", 0.65, "genus"),
    ("Alcaligenaceae_0.63_family", 52.72585669781931, 15.23281041388518, "Contaminated", "Alcaligenaceae", 0.63, "family"),
    (None, 98.51485148514851, 0.0, "High", None, None, None),
    (None, 22.413793103448278, 0.0, "Low", None, None, None),
]


def test_known_bins_get_their_tier_and_labels(spark):
    taxonomy = spark.createDataFrame([(str(i), r[0]) for i, r in enumerate(KNOWN)], "BinID string, Best_Classification string")
    stats = spark.createDataFrame([(str(i), "E", r[1], r[2]) for i, r in enumerate(KNOWN)], "BinID string, Enrichment string, Completeness double, Contamination double")
    out = bins.taxa_quality(taxonomy.filter("Best_Classification is not null"), stats.withColumn("Quality", quality_tier("Completeness", "Contamination")))
    got = {int(r["BinID"]): r for r in out.collect()}
    for i, (label, *_, tier, name, confidence, rank) in enumerate(KNOWN):
        r = got[i]
        assert (r["Best_Classification"], r["Quality"], r["Classification"], r["Confidence"], r["Tax_Level"]) == (label, tier, name, confidence, rank)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_dealt_null_keys_join_like_plain_ones(spark, how):
    left = spark.createDataFrame([("a", 1, i) for i in range(3)] + [(None, 1, i) for i in range(40)] + [("b", None, 9)], "k string, j int, v int")
    for data in ([("a", 1, "x"), (None, 1, "y"), (None, 1, "z")], [("a", 1, "x")], [("b", None, "w")]):
        right = spark.createDataFrame(data, "k string, j int, w string")
        assert rows(key_join(left, right, ["k", "j"], how, spread_nulls=8)) == rows(key_join(left, right, ["k", "j"], how))
    keys = left.select("k", "j")
    assert rows(key_join(keys, right, ["k", "j"], how, spread_nulls=8)) == rows(key_join(keys, right, ["k", "j"], how))


def test_a_hot_null_key_is_dealt_and_outer_joins_refuse(spark):
    left = spark.range(1000).select(F.lit(None).cast("string").alias("k"), "id")
    right = spark.createDataFrame([("a", 1)], "k string, w int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = key_join(left, right, ["k"], "left", spread_nulls=16).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) > 1 and sum(r["count"] for r in parts) == 1000
    with pytest.raises(ValueError, match="full"):
        key_join(left, right, ["k"], "full", spread_nulls=16)


def test_a_quant_file_with_other_columns_raises(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "quant.sf").write_text("Name\tEffectiveLength\tLength\tTPM\tNumReads\nx\t1\t2\t3\t4\n")
    sheet = spark.createDataFrame([("s1",)], "sample string")
    with pytest.raises(Exception, match="CSV header"):
        text.read_quant(spark, str(tmp_path), sheet).collect()
