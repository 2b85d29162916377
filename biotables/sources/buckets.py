"""Tables stored in hash buckets of a key, so that later joins and groupings on the key need no shuffle."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biotables.session import scratch_path


def store_bucketed(df: DataFrame, label: str, keys: Sequence[str], buckets: int | None = None, path: str | None = None) -> DataFrame:
    """Write ``df`` in ``buckets`` hash buckets of ``keys`` (one sorted file each) and read it as a table.

    Tables that are joined with each other need the same number of buckets; choose it so that a bucket fits
    a task (default: the shuffle width of the session). One key value lies in one bucket: a key that holds a large share
    of the rows belongs into a table without buckets, where the adaptive skew join can split it. Rows with a missing key
    form one bucket entry of their own. ``path`` keeps the files; by default they go with the run's folder.
    """
    spark = df.sparkSession
    keys = list(keys)
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"bucketed_{label}_{uuid.uuid4().hex}"
    # the same hash as that of the buckets, hence one file for each bucket
    placed = df.repartition(count, *[F.col(f"`{k}`") for k in keys])
    placed.write.format("parquet").option("path", path or scratch_path(spark, label)).bucketBy(count, *keys).sortBy(*keys).saveAsTable(name)
    atexit.register(_forget, spark, name)
    return spark.table(name)


def _forget(spark: SparkSession, name: str) -> None:
    """The catalog entry goes with the driver's Python; the files stay where they are."""
    if spark.sparkContext._jsc is not None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
