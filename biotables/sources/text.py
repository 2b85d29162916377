"""Readers for the text files of the upstream tools. Schemas are given, never inferred."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biotables.sources import records

# Column layouts of the input formats.
GTF_SCHEMA = ", ".join(f"V{i} string" for i in range(1, 10))
COUNTS_SCHEMA = "V1 string, V2 bigint"
BIN_STATS_SCHEMA = "V1 string, V2 string"
ANNOTATION_SCHEMA = (
    "locus_tag string, ftype string, length_bp bigint, gene string, "
    "EC_number string, COG string, product string"
)
QUANT_SCHEMA = "Name string, Length bigint, EffectiveLength double, TPM double, NumReads double"


def as_schema(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: str | T.StructType,
    sep: str = ",",
    blank_as_null: bool = False,
    null_text: str = "NA",
    multiline: bool = False,
) -> DataFrame:
    """Delimited text with a header line, quotes doubled within quotes.

    ``null_text`` stands for a missing value. A blank text cell stays "" unless
    ``blank_as_null`` is set. The header of every file is compared with the schema while it is read;
    another name or order raises. ``multiline`` allows line breaks in quoted cells and keeps files whole.
    """
    schema = as_schema(schema)
    raw_schema = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = (
        spark.read.schema(raw_schema)
        .option("sep", sep)
        .option("header", True)
        .option("enforceSchema", False)
        .option("escape", '"')
        .option("multiLine", multiline)
        .csv(path)
    )
    return raw.select(*[_typed(f, null_text, blank_as_null) for f in schema.fields])


def _typed(field: T.StructField, null_text: str, blank_as_null: bool) -> Column:
    # the reader hands a blank cell over as NULL
    cell = F.col(f"`{field.name}`")
    if not isinstance(field.dataType, T.StringType):
        value = F.nullif(cell, F.lit(null_text)).try_cast(field.dataType)
    elif blank_as_null:
        value = F.nullif(F.nullif(cell, F.lit(null_text)), F.lit(""))
    else:
        value = F.nullif(F.coalesce(cell, F.lit("")), F.lit(null_text))
    return value.alias(field.name)


def read_headerless(
    spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType, sep: str = "\t"
) -> DataFrame:
    """Delimited text without a header line."""
    return (
        spark.read.schema(as_schema(schema))
        .option("sep", sep)
        .option("header", False)
        .option("quote", "\u0000")
        .csv(path)
    )


def read_lines(
    spark: SparkSession, path: str | Sequence[str], into: Sequence[str], regex: str = "\t"
) -> DataFrame:
    """Whole lines, then split on a regex into text columns."""
    pieces = F.split("value", regex, -1)
    return spark.read.text(path).select(*[F.get(pieces, i).alias(n) for i, n in enumerate(into)])


def read_directory(
    spark: SparkSession, folder: str, schema: str | T.StructType, sep: str = "\t", **options
) -> DataFrame:
    """Every file of a folder stacked, with the path of the file each row came from."""
    df = read_table(spark, folder, schema, sep, **options)
    return df.withColumn("source_path", F.col("_metadata.file_path"))


def read_renamed(
    spark: SparkSession,
    path: str | Sequence[str],
    names: Mapping[str, str],
    sep: str = "\t",
) -> DataFrame:
    """Text whose header needs other names (such as ``# ORF``); all columns are text."""
    schema = T.StructType([T.StructField(old, T.StringType()) for old in names])
    df = read_table(spark, path, schema, sep)
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()])


def read_decimal_mark(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: str | T.StructType,
    mark: str,
    sep: str = "\t",
) -> DataFrame:
    """Text with a header whose double columns use another decimal mark."""
    schema = as_schema(schema)
    raw_schema = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = read_table(spark, path, raw_schema, sep)
    return raw.select(
        *[
            F.translate(f.name, mark, ".").try_cast("double").alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name).try_cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def read_sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    """One column ``sample``; byte-order mark and CRLF line ends are accepted."""
    return (
        spark.read.schema("sample string")
        .option("header", True)
        .csv(path)
        .select(F.regexp_replace("sample", "[\\r\\uFEFF]", "").alias("sample"))
    )


def import_quant(quant: DataFrame, sheet: DataFrame) -> DataFrame:
    """Quantification rows ``(sample, Name, …)`` of the samples on the sheet, in long form."""
    return quant.join(sheet.select("sample").distinct(), "sample", "left_semi").select(
        "sample",
        F.col("Name").alias("tx"),
        F.col("NumReads").alias("num_reads"),
        F.col("TPM").alias("tpm"),
        F.col("EffectiveLength").alias("eff_length"),
    )


def read_quant(spark: SparkSession, root: str, sheet: DataFrame) -> DataFrame:
    """``<root>/<sample>/quant.sf`` of every sample on the sheet."""
    raw = (
        spark.read.schema(QUANT_SCHEMA)
        .option("sep", "\t")
        .option("header", True)
        .option("enforceSchema", False)
        .csv(f"{root.rstrip('/')}/*/quant.sf")
    )
    sample = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return import_quant(raw.withColumn("sample", sample), sheet)


def read_fasta(spark: SparkSession, path: str | Sequence[str], range_bytes: int = records.RANGE_BYTES) -> DataFrame:
    """One row per FASTA record: id, description, sequence, length and GC share."""
    sequence = F.upper(F.regexp_replace("body", "\\s", ""))
    return (
        records.read_records(spark, path, "fasta", range_bytes)
        .select(_id_and_description()[0].alias("seq_id"), _id_and_description()[1], sequence.alias("sequence"))
        .withColumn("length", F.length("sequence").cast("bigint"))
        .withColumn(
            "gc",
            F.length(F.regexp_replace("sequence", "[^GC]", "")) / F.nullif("length", F.lit(0)),
        )
    )


def read_fastq(spark: SparkSession, path: str | Sequence[str], range_bytes: int = records.RANGE_BYTES) -> DataFrame:
    """``file, read_id, description, bases, quality``; one row per record of all files, in one read.

    Rows do not depend on ``range_bytes`` (``records``); a broken record raises. Compressed files are one task each.
    """
    return records.read_records(spark, path, "fastq", range_bytes).select("file", *_id_and_description(), "bases", "quality")


def _id_and_description() -> list[Column]:
    rest = F.nullif(F.trim(F.regexp_replace("head", "^\\S*", "")), F.lit(""))
    return [F.regexp_extract("head", "^(\\S*)", 1).alias("read_id"), rest.alias("description")]


def read_features(spark: SparkSession, path: str | Sequence[str], feature_type: str = "CDS", id_attribute: str = "gene_id") -> DataFrame:
    """``feature, contig, start, end, strand`` of one type of an annotation file; start counts from 0, end is exclusive.

    The id comes from ``id_attribute "value"`` or ``id_attribute=value`` of the last column; rows without it are left out.
    """
    rows = read_headerless(spark, path, GTF_SCHEMA).filter((F.col("V3") == feature_type) & ~F.startswith("V1", F.lit("#")))
    found = F.regexp_extract("V9", f'(?:^|;)\\s*{id_attribute}[ =]"?([^";]+)', 1)
    return rows.select(
        F.nullif(found, F.lit("")).alias("feature"), F.col("V1").alias("contig"),
        (F.col("V4").cast("bigint") - 1).alias("start"), F.col("V5").cast("bigint").alias("end"), F.col("V7").alias("strand"),
    ).filter(F.col("feature").isNotNull())


def pathway_enzymes(pathways: DataFrame) -> DataFrame:
    """``(pathway_id, name, enzymes array)`` to one row per enzyme and pathway."""
    return pathways.select(
        F.explode("enzymes").alias("EC_number"), F.col("name").alias("General_Pathway")
    ).distinct()
