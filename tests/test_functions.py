"""Column functions: missing values, regexes, thresholds, text formats."""

from conftest import rows
from pyspark.sql import functions as F

from biotables import functions as B


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {_type(v)}" for k, v in cols.items()))
    return df.select(expr.alias("x")).first()["x"]


def _type(v):
    return {int: "bigint", float: "double", str: "string", bool: "boolean", type(None): "string"}[type(v)]


def test_conditional_keeps_null(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "a bigint")
    got = rows(df.select("a", B.ifelse_na(F.col("a") > 2, F.lit("y"), F.lit("n")).alias("x")))
    assert got == [(None, None), (1, "n"), (5, "y")]


def test_separate_drops_extra_and_fills_missing(spark):
    df = spark.createDataFrame([("a_b_c_d",), ("a",), (None,), ("a__c",)], "v string")
    got = rows(df.select(*B.separate("v", ["p", "q", "r"], "_")))
    assert got == [(None, None, None), ("a", None, None), ("a", "", "c"), ("a", "b", "c")]


def test_separate_pattern_is_a_regex(spark):
    # ".f" is any character followed by f, so it cuts at the first such place
    df = spark.createDataFrame([("Xafbin.1.fa",)], "v string")
    assert df.select(*B.separate("v", ["p"], ".f")).first()["p"] == "X"


def test_unite_writes_na(spark):
    assert one(spark, B.unite(["a", "b"]), a="x", b=None) == "x_NA"


def test_strict_sum(spark):
    df = spark.createDataFrame([(1, 2), (1, None), (2, 3), (2, 4)], "g int, v bigint")
    got = rows(df.groupBy("g").agg(B.strict_sum("v").alias("s")))
    assert got == [(1, None), (2, 7)]


def test_any_positive_and_any_not_null(spark):
    df = spark.createDataFrame([(0, None), (None, None), (None, 3)], "a bigint, b bigint")
    got = df.select(B.any_positive(["a", "b"]).alias("p"), B.any_not_null(["a", "b"]).alias("n")).collect()
    assert [tuple(r) for r in got] == [(False, True), (None, False), (True, True)]


def test_replace_first_only(spark):
    assert one(spark, B.replace_first("v", "</i>", ""), v="a</i>\nb</i>") == "a\nb</i>"
    assert one(spark, B.replace_first("v", "zz", ""), v="a") == "a"


def test_numeric_value(spark):
    assert one(spark, B.numeric_value("v"), v="GC std: 1e-05") == 1e-05
    assert one(spark, B.numeric_value("v", compat=True), v="GC std: 1e-05") is None
    assert one(spark, B.numeric_value("v"), v="x -3.5 y") == -3.5
    assert one(spark, B.numeric_value("v"), v="none") is None


def test_quality_tier_edges(spark):
    cases = [
        (90.0, 4.9, "Medium"), (90.1, 4.9, "High"), (95.0, 5.0, "Medium"), (50.0, 9.9, "Medium"),
        (49.9, 9.9, "Low"), (99.0, 10.0, "Contaminated"), (10.0, 30.0, "Contaminated"),
        (None, 3.0, None), (None, 30.0, "Contaminated"), (50.0, None, None),
    ]
    df = spark.createDataFrame(cases, "c double, k double, want string")
    bad = df.withColumn("got", B.quality_tier("c", "k")).filter(~F.col("got").eqNullSafe(F.col("want")))
    assert bad.collect() == []


def test_count_bucket_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 100, 101, 500, 501, 1000, 1001)], "v bigint")
    got = [r[0] for r in df.select(B.count_bucket("v")).collect()]
    assert got == ["1 to 100"] * 3 + ["100 to 500"] * 2 + ["500 to 1,000"] * 2 + ["> 1,000"]
    assert df.select(B.count_bucket("v", lower=1)).first()[0] == "other"


def test_recode_rank_and_best(spark):
    assert one(spark, B.recode("v", {"a": "A"}, F.lit("z")), v="b") == "z"
    assert one(spark, B.recode("v", {"a": "A"}), v=None) is None
    assert one(spark, B.category_rank("v", ["lo", "hi"]), v="hi") == 2
    assert one(spark, B.category_rank("v", ["lo", "hi"]), v="other") is None
    ranks = {"phylum": F.col("p"), "genus": F.col("g")}
    assert one(spark, B.best_classification(ranks), p="P", g=None) == "P"
    assert one(spark, B.best_classification(ranks), p=None, g=None) == "fill later"


def test_parsers(spark):
    df = spark.createDataFrame([("Rhizo (genus): 0.81",), ("no support",), ("A * (order): 1",)], "v string")
    assert [tuple(r) for r in df.select(*B.parse_rank_score("v")).collect()] == [
        ("Rhizo", "genus", "0.81"), ("no support", None, None), ("A *", "order", "1"),
    ]

    orf = spark.createDataFrame([("E1metabat.12.fa_k141_7_3",)], "v string")
    assert tuple(orf.select(*B.parse_orf_id("v")).first()) == ("E1metabat.12", "k141_7", "E1", "12")
    locus = spark.createDataFrame([("E1.contigs_00012",)], "v string")
    assert tuple(locus.select(*B.parse_locus_tag("v")).first()) == ("E1.contigs", "00012", "E1")
    tag = spark.createDataFrame([("E1metabat.12_00007",)], "v string")
    assert tuple(tag.select(*B.parse_bin_tag("v")).first()) == ("E1metabat.12", "00007", "E1", "12")


def test_gtf_and_gff(spark):
    gtf = spark.createDataFrame(
        [("c1", "Prodigal:2.6", 'transcript_id "t1"; gene_id "L_1";')] * 2, "V1 string, V2 string, V9 string"
    )
    assert rows(B.parse_gtf(gtf)) == [("c1", "L_1", "Prodigal")]
    assert one(spark, B.gff_attribute("v", "Parent"), v="ID=a;Parent=b;x=c") == "b"
    assert one(spark, B.gff_attribute("v", "Name"), v="ID=a;Parent=b") is None


def test_bin_stats_with_and_without_quotes(spark):
    quoted = "{'marker lineage': 'k__B', '# genomes': 5449, '# markers': 104, '# marker sets': 58, '0': 1, " \
        "'Completeness': 91.2, 'Contamination': 0.5, 'GC': 0.61, 'GC std': 1e-05, 'Genome size': 3, " \
        "'# ambiguous bases': 0, '# scaffolds': 2, '# contigs': 4, '# predicted genes': 9}"
    df = spark.createDataFrame([(quoted,), (quoted.replace("'", ""),)], "v string")
    first, second = df.select(*B.parse_bin_stats("v")).collect()
    assert first == second
    assert first.Marker_Genes == "k__B" and first.Markers == 104 and first.Marker_Sets == 58
    assert first.GC == 0.61 and first.GC_std == 1e-05 and first.Contigs == 4 and first.Predicted_Genes == 9
    assert df.select(*B.parse_bin_stats("v", compat=True)).first().GC_std is None


def test_split_list_and_any_match(spark):
    assert one(spark, B.split_list("v"), v="a // b / c") == ["a", "b", "c"]
    # a pattern with a neighbour character does not match at the very start
    assert one(spark, B.any_match("v", [".cellulose"]), v="cellulose x") is False
    assert one(spark, B.any_match("v", ["Cellulose.", ".cellulose"]), v="a cellulose") is True
