"""Table operations on reads ``(read_id, mate, bases, quality)`` and alignments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from biotables.operators.intervals import FINEST, overlaps


def concat_lanes(reads: DataFrame, pattern: str = r"_(L[0-9]{3})_R([12])") -> DataFrame:
    """Reads of many files (:func:`read_fastq`) with lane and mate from the name of their file."""
    return reads.select(
        F.regexp_extract("file", pattern, 1).alias("lane"),
        "read_id",
        F.regexp_extract("file", pattern, 2).cast("int").alias("mate"),
        "bases",
        "quality",
    )


def interleave(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """Two rows per pair, mate 1 then mate 2; reads without a partner are left out."""
    pair = forward.select("read_id", F.struct("bases", "quality").alias("m1")).join(
        reverse.select("read_id", F.struct("bases", "quality").alias("m2")), "read_id"
    )
    mates = F.array(
        F.struct(F.lit(1).alias("mate"), F.col("m1.bases"), F.col("m1.quality")),
        F.struct(F.lit(2).alias("mate"), F.col("m2.bases"), F.col("m2.quality")),
    )
    return pair.select("read_id", F.inline(mates))


def quality_profile(reads: DataFrame) -> DataFrame:
    """Per mate and cycle: reads that reach it, mean quality, smallest and largest quality, GC share."""
    cell = F.transform("quality", lambda q, i: F.struct(q.alias("q"), F.substr(F.col("bases"), i + 1, F.lit(1)).isin("G", "C").alias("is_gc")))
    cycles = reads.select("mate", F.posexplode(cell).alias("pos", "c"))
    return cycles.groupBy("mate", (F.col("pos") + 1).alias("cycle")).agg(
        F.count(F.lit(1)).alias("n_reads"),
        F.avg("c.q").alias("mean_quality"),
        F.min("c.q").alias("min_quality"),
        F.max("c.q").alias("max_quality"),
        F.avg(F.col("c.is_gc").cast("double")).alias("gc"),
    )


def length_profile(reads: DataFrame) -> DataFrame:
    """Reads per length with their mean GC share."""
    length = F.length("bases")
    gc = F.length(F.regexp_replace("bases", "[^GC]", "")) / F.nullif(length, F.lit(0))
    return reads.groupBy(length.alias("length")).agg(
        F.count(F.lit(1)).alias("n_reads"), F.avg(gc).alias("gc")
    )


def _trimmed(rows: pa.RecordBatch, leading: int, trailing: int, window: int, required: float, min_length: int) -> pa.RecordBatch:
    bases, quality = rows.column(2), rows.column(3)
    size = np.asarray(quality.value_lengths().fill_null(0)).astype(np.int64)
    letters = np.asarray(pc.binary_length(bases).fill_null(0)).astype(np.int64)
    if (size != letters).any():
        raise ValueError("a read has another number of bases than of qualities")
    begin = np.cumsum(size) - size
    read = np.repeat(np.arange(len(size)), size)
    q = np.asarray(quality.flatten()).astype(np.int64)
    place = np.arange(len(q)) - begin[read]
    none = np.int64(2**60)

    some = size > 0

    def least(of: np.ndarray, empty: np.ndarray) -> np.ndarray:
        out = np.full(len(size), none)
        if some.any():
            out[some] = np.minimum.reduceat(np.where(of, place, none), begin[some])
        return np.where(out == none, empty, out)

    first = least(q >= leading, size)
    last = np.full(len(size), -1)
    if some.any():
        last[some] = np.maximum.reduceat(np.where(q >= trailing, place, -1), begin[some])
    stop = np.maximum(first, last + 1)
    sums = np.concatenate([[0], np.cumsum(q)])
    ends = np.minimum(np.arange(len(q)) + window, len(q))
    weak = (place >= first[read]) & (place + window <= stop[read]) & (sums[ends] - sums[:-1] < window * required)
    kept = least(weak, stop) - first
    stays = kept >= min_length
    keep = stays[read] & (place >= first[read]) & (place < (first + kept)[read])
    offsets = np.concatenate([[0], np.cumsum(kept[stays])]).astype(np.int32)
    text = np.frombuffer(b"".join(bases.fill_null("").cast(pa.binary()).to_pylist()), np.uint8)
    return pa.RecordBatch.from_arrays(
        [
            rows.column(0).filter(pa.array(stays)),
            rows.column(1).filter(pa.array(stays)),
            pa.Array.from_buffers(pa.string(), int(stays.sum()), [None, pa.py_buffer(offsets), pa.py_buffer(text[keep].tobytes())]),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(q[keep].astype(np.int32))),
        ],
        ["read_id", "mate", "bases", "quality"],
    )


def trim_reads(
    reads: DataFrame,
    leading: int = 3,
    trailing: int = 3,
    window: int = 4,
    required: float = 15,
    min_length: int = 36,
) -> DataFrame:
    """Quality-trim both mates and mark whether the pair survives as a pair.

    Ends lose the bases below the limits; then the read is cut at the start of the first
    window whose mean is below ``required``. Bases are ASCII letters, one quality each.

    ``status`` is ``paired`` when both mates keep ``min_length`` bases, ``unpaired`` when
    only this one does; reads that become too short are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield _trimmed(rows, leading, trailing, window, required, min_length)

    rows = reads.select("read_id", "mate", "bases", F.col("quality").cast("array<int>"))
    trimmed = rows.mapInArrow(run, rows.schema)
    # a read id has at most two rows, its mates, so this window stays tiny
    mates = F.count(F.lit(1)).over(W.partitionBy("read_id"))
    return trimmed.withColumn("status", F.when(mates == 2, "paired").otherwise("unpaired"))


def coordinate_sort(alignments: DataFrame, partitions: int | None = None) -> DataFrame:
    """Order by contig, position and read id over range partitions."""
    keys = ["contig", "start", "read_id"]
    parts = (
        alignments.repartitionByRange(partitions, *keys)
        if partitions
        else alignments.repartitionByRange(*keys)
    )
    return parts.sortWithinPartitions(*keys)


def contig_depth(alignments: DataFrame, contigs: DataFrame, bucket: int = 4096) -> DataFrame:
    """Mean and variance of the depth per contig.

    Reads are cut at bucket borders and reduced to +1/-1 events per position, so a bucket
    is complete on its own and never has more than ``bucket`` + 1 event positions,
    however many reads pile up in it.
    """
    span = F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))
    pieces = (
        alignments.groupBy("contig", "start", "end")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("b", F.explode(span))
        .select(
            "contig",
            "b",
            "n",
            F.greatest("start", F.col("b") * bucket).alias("from"),
            F.least("end", (F.col("b") + 1) * bucket).alias("to"),
        )
    )
    events = (
        pieces.select(
            "contig",
            "b",
            F.inline(
                F.array(
                    F.struct(F.col("from").alias("pos"), F.col("n").alias("step")),
                    F.struct(F.col("to").alias("pos"), (-F.col("n")).alias("step")),
                )
            ),
        )
        .groupBy("contig", "b", "pos")
        .agg(F.sum("step").alias("step"))
    )
    order = W.partitionBy("contig", "b").orderBy("pos")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    segments = events.select(
        "contig",
        F.sum("step").over(upto).alias("depth"),
        (F.lead("pos").over(order) - F.col("pos")).alias("len"),
    ).filter(F.col("depth") > 0)
    sums = segments.groupBy("contig").agg(
        F.sum(F.col("depth") * F.col("len")).alias("s1"),
        F.sum(F.col("depth") * F.col("depth") * F.col("len")).alias("s2"),
    )
    size = F.col("length").cast("double")
    mean = F.coalesce(F.col("s1"), F.lit(0)) / size
    square = F.coalesce(F.col("s2"), F.lit(0)) / size
    return contigs.join(sums, "contig", "left").select(
        "contig",
        "length",
        mean.alias("mean_depth"),
        (square - mean * mean).alias("var_depth"),
    )


def read_categories(alignments: DataFrame, features: DataFrame, bucket: int = FINEST) -> DataFrame:
    """Distinct read positions with the feature they count for and the number of reads.

    A read counts for a feature when it overlaps that one only; otherwise it falls under
    ``__no_feature`` or ``__ambiguous``. Identical positions are merged before the overlap
    join, and a feature is one row of it however long it is (``intervals``); ``bucket`` is the width
    of the finest bins.
    """
    longest = alignments.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 0
    spots = alignments.groupBy("contig", "start", "end").agg(F.count(F.lit(1)).alias("n"))
    # features at the same place: only the id range matters to tell one from several
    places = features.groupBy("contig", F.col("start").alias("f_start"), F.col("end").alias("f_end")).agg(
        F.min("feature").alias("f_min"), F.max("feature").alias("f_max")
    )
    hits = (
        overlaps(spots, places, "contig", ("start", "end"), ("f_start", "f_end"), longest, bucket)
        .groupBy("contig", "start", "end")
        .agg(F.min("f_min").alias("lo"), F.max("f_max").alias("hi"))
    )
    category = (
        F.when(F.col("lo").isNull(), "__no_feature")
        .when(F.col("lo") != F.col("hi"), "__ambiguous")
        .otherwise(F.col("lo"))
    )
    return spots.join(hits, ["contig", "start", "end"], "left").withColumn("locus_tag", category)


def feature_counts(alignments: DataFrame, features: DataFrame, bucket: int = FINEST) -> DataFrame:
    """Reads per feature, zero counts included, plus the two special rows."""
    counted = (
        read_categories(alignments, features, bucket)
        .groupBy("locus_tag")
        .agg(F.sum("n").alias("count"))
    )
    zero = features.select(F.col("feature").alias("locus_tag"), F.lit(0).cast("bigint").alias("count"))
    return counted.unionByName(zero).groupBy("locus_tag").agg(F.sum("count").alias("count"))
