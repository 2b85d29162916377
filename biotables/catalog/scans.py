"""Sources and sinks: text is written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from biotables.catalog.bindings import (
    bin_samples,
    gene_features,
    parts,
    sample_counts,
    with_tables,
)
from biotables.catalog.registry import Tables, query
from biotables.functions import split_list
from biotables.session import scratch_path
from biotables.sources import sinks, text


def _write_lines(df, line, label: str) -> str:
    path = scratch_path(df.sparkSession, label)
    df.select(line.alias("value")).write.text(path)
    return path


@query("SELECT p_partkey, p_name, p_brand, nullif(p_type, 'PROMO') AS p_type, p_size FROM part")
def scan_table(t: Tables):
    """Delimited text with a header; NA is a missing value."""
    df = t.part.select(
        "p_partkey", "p_name", "p_brand", F.nullif("p_type", F.lit("PROMO")).alias("p_type"), "p_size"
    )
    path = sinks.write_csv(df, scratch_path(t.spark, "table"))
    return text.read_table(
        t.spark, path, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int"
    )


@query("""SELECT p_name || '_' || p_partkey AS "V1", p_size::BIGINT AS "V2" FROM part""")
def scan_headerless(t: Tables):
    line = F.concat_ws("\t", F.concat_ws("_", "p_name", "p_partkey"), F.col("p_size"))
    return text.read_headerless(
        t.spark, _write_lines(t.part, line, "headerless"), text.COUNTS_SCHEMA
    )


@query("""SELECT p_partkey::VARCHAR AS bin_file, p_name AS status, p_type AS entry_1,
 CASE WHEN p_size > 25 THEN p_brand END AS entry_2 FROM part""")
def scan_raw_lines(t: Tables):
    """Whole lines split on tabs; short lines leave the last columns missing."""
    line = F.concat_ws(
        "\t", F.col("p_partkey"), F.col("p_name"), F.col("p_type"), F.when(F.col("p_size") > 25, F.col("p_brand"))
    )
    path = _write_lines(t.part, line, "lines")
    return text.read_lines(t.spark, path, ["bin_file", "status", "entry_1", "entry_2"])


@query("""SELECT p_partkey || '_' || p_size AS locus_tag, p_size::BIGINT AS length_bp, p_name AS product,
 'hash-' || p_type AS run FROM part""")
def scan_directory(t: Tables):
    """One folder per run, all files stacked, the run taken from the path."""
    root = scratch_path(t.spark, "runs")
    df = t.part.select(
        F.concat_ws("_", "p_partkey", "p_size").alias("locus_tag"),
        F.col("p_size").cast("bigint").alias("length_bp"),
        F.col("p_name").alias("product"),
        F.concat(F.lit("hash-"), "p_type").alias("run"),
    )
    df.write.partitionBy("run").option("sep", "\t").option("header", True).csv(root)
    stacked = text.read_directory(
        t.spark, f"{root}/*/*.csv", "locus_tag string, length_bp bigint, product string"
    )
    run = F.regexp_extract("source_path", "run=([^/]+)/", 1).alias("run")
    return stacked.select("locus_tag", "length_bp", "product", run)


@query(with_tables("parts", """SELECT l_suppkey::VARCHAR AS sample, 'tx' || l_partkey AS tx,
 SUM(l_quantity)::DOUBLE AS num_reads, MAX(l_quantity)::DOUBLE AS tpm, MIN(p_size)::DOUBLE AS eff_length
 FROM lineitem JOIN parts USING (l_partkey) JOIN supplier ON l_suppkey = s_suppkey
 WHERE s_acctbal > 0 GROUP BY 1, 2"""))
def import_quant(t: Tables):
    """Quantifications of the samples on the sheet; the sheet is a table of suppliers."""
    sheet = t.supplier.filter(F.col("s_acctbal") > 0).select(
        F.col("s_suppkey").cast("string").alias("sample")
    )
    quant = (
        t.lineitem.select("l_suppkey", "l_partkey", "l_quantity")
        .join(parts(t).select("l_partkey", "p_size"), "l_partkey")
        .groupBy(
            F.col("l_suppkey").cast("string").alias("sample"),
            F.concat(F.lit("tx"), F.col("l_partkey")).alias("Name"),
        )
        .agg(
            F.sum("l_quantity").alias("NumReads"),
            F.max("l_quantity").alias("TPM"),
            F.min("p_size").cast("double").alias("EffectiveLength"),
        )
    )
    return text.import_quant(quant, sheet)


@query("""SELECT (CASE WHEN s_suppkey % 2 = 0 THEN 'Alpha' ELSE 'Beta' END) || 'metabat.' || s_suppkey
 || '.fa_1_2_' || s_nationkey AS orf, s_name AS bin FROM supplier""")
def scan_renamed(t: Tables):
    """Header ``# ORF`` becomes a usable name."""
    orf = F.concat(
        F.when(F.col("s_suppkey") % 2 == 0, "Alpha").otherwise("Beta"),
        F.lit("metabat."), F.col("s_suppkey"), F.lit(".fa_1_2_"), F.col("s_nationkey"),
    )
    path = scratch_path(t.spark, "renamed")
    rows = t.supplier.select(orf.alias("# ORF"), F.col("s_name").alias("bin"))
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return text.read_renamed(t.spark, path, {"# ORF": "orf", "bin": "bin"})


@query("SELECT p_partkey, p_size + 0.25::DOUBLE AS score FROM part")
def scan_decimal_mark(t: Tables):
    path = scratch_path(t.spark, "decimal")
    rows = t.part.select("p_partkey", F.concat(F.col("p_size"), F.lit("_25")).alias("score"))
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return text.read_decimal_mark(t.spark, path, "p_partkey bigint, score double", "_")


@query("""SELECT 'doc' || doc_id AS seq_id, lang || ' ' || source AS description, seq AS sequence,
 length(seq)::BIGINT AS length,
 round(length(replace(translate(seq, 'AT', '  '), ' ', ''))::DOUBLE / length(seq), 6) AS gc
 FROM (SELECT *, translate(md5(text) || md5(source || text), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq
 FROM documents)""")
def fasta_records(t: Tables):
    bases = F.translate(
        F.concat(F.md5("text"), F.md5(F.concat("source", "text"))), "0123456789abcdef", "ACGTACGTACGTACGT"
    )
    record = F.concat(
        F.lit(">doc"), F.col("doc_id"), F.lit(" "), "lang", F.lit(" "), "source", F.lit("\n"),
        F.substring(bases, 1, 40), F.lit("\n"), F.substring(bases, 41, 24),
    )
    records = text.read_fasta(t.spark, _write_lines(t.documents, record, "fasta"))
    return records.withColumn("gc", F.round("gc", 6))


@query("""SELECT DISTINCT 'EC ' || p_size AS "EC_number", p_brand AS "General_Pathway" FROM part""")
def pathway_enzymes(t: Tables):
    """Pathway rows with an enzyme array to one row per enzyme."""
    listed = t.part.groupBy(F.col("p_brand").alias("name")).agg(
        F.collect_set(F.concat(F.lit("EC "), F.col("p_size"))).alias("enzymes")
    )
    return text.pathway_enzymes(listed)


@query("""SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS o_orderpriority, o_totalprice,
 CASE WHEN o_orderstatus <> 'F' THEN o_custkey END AS o_custkey FROM orders""")
def sink_csv_roundtrip(t: Tables):
    df = t.orders.select(
        "o_orderkey",
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"),
        "o_totalprice",
        F.when(F.col("o_orderstatus") != "F", F.col("o_custkey")).alias("o_custkey"),
    )
    path = sinks.write_csv(df, scratch_path(t.spark, "csv"))
    return text.read_table(
        t.spark, path, "o_orderkey bigint, o_orderpriority string, o_totalprice double, o_custkey bigint"
    )


@query(with_tables("sample_counts bin_samples gene_features", """SELECT sample, feature, count, substrate,
 enrichment, gene, product, EC_number FROM sample_counts JOIN bin_samples USING (sample)
 JOIN gene_features USING (feature)"""))
def bundle_roundtrip(t: Tables):
    """Save the community bundle as three tables, load it and join it by key."""
    folder = scratch_path(t.spark, "bundle")
    sinks.write_bundle(sinks.Bundle(sample_counts(t), bin_samples(t), gene_features(t)), folder)
    bundle = sinks.read_bundle(t.spark, folder)
    return bundle.counts.join(bundle.samples, "sample").join(bundle.features, "feature")


@query("""SELECT DISTINCT p_brand AS pathway, p_name || ' a' AS first_item, 3 + p_size AS n_items, 'n' || p_size AS last_item FROM part""")
def split_list_cap(t: Tables):
    """List cell with two delimiters, of any length; its first and last item and their number."""
    rest = F.expr("array_join(transform(sequence(1, p_size), i -> 'n' || i), ' / ')")
    items = split_list(F.concat("p_name", F.lit(" a // "), "p_type", F.lit(" / "), "p_brand", F.lit(" // "), rest))
    return t.part.select(
        F.col("p_brand").alias("pathway"), F.get(items, 0).alias("first_item"), F.size(items).alias("n_items"),
        F.element_at(items, -1).alias("last_item"),
    ).distinct()
