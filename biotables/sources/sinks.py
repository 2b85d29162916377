"""Writers: CSV tables and the community bundle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str, mode: str = "error") -> str:
    """CSV with a header line, quotes doubled and NA for missing values, one file per task.

    A text cell that says NA reads back as missing; line breaks in cells need a reader with ``multiline``.
    """
    df.write.mode(mode).option("header", True).option("nullValue", "NA").option("escape", '"').option(
        "emptyValue", '""'
    ).csv(path)
    return path


@dataclass(frozen=True)
class Bundle:
    """Count table in long form with its sample and feature tables, joined by key."""

    counts: DataFrame  # sample, feature, count (> 0)
    samples: DataFrame  # sample, ...
    features: DataFrame  # feature, ...


def write_bundle(bundle: Bundle, folder: str, mode: str = "error") -> str:
    """Three Parquet tables under one folder."""
    bundle.counts.write.mode(mode).parquet(f"{folder}/counts")
    bundle.samples.write.mode(mode).parquet(f"{folder}/samples")
    bundle.features.write.mode(mode).parquet(f"{folder}/features")
    return folder


def read_bundle(spark: SparkSession, folder: str) -> Bundle:
    return Bundle(
        spark.read.parquet(f"{folder}/counts"),
        spark.read.parquet(f"{folder}/samples"),
        spark.read.parquet(f"{folder}/features"),
    )
