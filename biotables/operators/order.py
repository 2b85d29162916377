"""The global order of a table as a column.

Rows are range-partitioned by the order columns and sorted inside each partition, so partition numbers
rise with the order. A row's position is its place in its partition plus the rows of the earlier ones.
Only one count for each partition reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biotables.session import materialize

#: bits below the partition number in monotonically_increasing_id()
PLACE_BITS = 33


def with_position(df: DataFrame, *order: str | Column, name: str = "position", partitions: int | None = None) -> DataFrame:
    """Adds ``name``: 1, 2, 3 ... in the given order over the whole table.

    Order columns should end in a key; rows that tie in all of them get their places in no defined order.
    The sorted rows are stored once, so that positions do not change when a task runs again.
    """
    spark = df.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    sorted_ = df.repartitionByRange(count, *order).sortWithinPartitions(*order)
    stored = materialize(sorted_.withColumn("__part", F.shiftright(place, PLACE_BITS)).withColumn("__place", place.bitwiseAND((1 << PLACE_BITS) - 1)), "ordered")
    sizes = sorted((r["__part"], r["n"]) for r in stored.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, rows = [], 0
    for part, n in sizes:
        before.append((part, rows))
        rows += n
    offsets = spark.createDataFrame(before or [(0, 0)], "__part long, __before long")
    return stored.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__place") + 1).drop("__part", "__place", "__before")
