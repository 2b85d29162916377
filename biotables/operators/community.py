"""Community statistics on long count tables ``(sample, feature, count)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from biotables.functions import any_not_null, unite
from biotables.operators.borders import with_buckets
from biotables.operators.joins import key_join
from biotables.operators.reshape import MAX_CELLS, full_grid, pivot_longer
from biotables.operators.totals import running_total, share_of_group
from biotables.session import task_count
from biotables.sources.sinks import Bundle

NO_PRODUCT = "hypothetical protein"
#: draws and features that a task of the rarefaction sorts
ROWS_PER_TASK = 500_000


def expressed_long(fact: DataFrame, substrates: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Wide fact rows to one row per bin and substrate with a positive count."""
    wide = fact.select(*keep, *substrates).filter(any_not_null(substrates))
    long = pivot_longer(wide, substrates, "substrate", "count", keep).filter(F.col("count") > 0)
    return long.withColumn("sample", unite(["bin_id", "substrate"]))


def bundle_counts(fact: DataFrame, substrates: Sequence[str], feature: str) -> DataFrame:
    long = expressed_long(fact, substrates, ["bin_id", feature])
    return long.groupBy("sample", F.col(feature).alias("feature")).agg(F.sum("count").alias("count"))


def bundle_samples(fact: DataFrame, substrates: Sequence[str], columns: Sequence[str]) -> DataFrame:
    long = expressed_long(fact, substrates, ["bin_id", *columns])
    return long.select("sample", "bin_id", "substrate", *columns).distinct()


def bundle_features(fact: DataFrame, feature: str, columns: Sequence[str]) -> DataFrame:
    """One row per feature; where rows disagree the smallest combination is kept."""
    first = F.min(F.struct(*columns)).alias("__first")
    rows = fact.groupBy(F.col(feature).alias("feature")).agg(first)
    return rows.select("feature", *[F.col(f"__first.{c}").alias(c) for c in columns])


def product_level(fact: DataFrame, gene: str = "gene", product: str = "product") -> DataFrame:
    """Rows with a named gene and a known product."""
    return fact.filter((F.col(product) != NO_PRODUCT) & (F.col(gene) != ""))


def make_bundle(
    fact: DataFrame,
    substrates: Sequence[str],
    feature: str,
    sample_columns: Sequence[str],
    feature_columns: Sequence[str],
) -> Bundle:
    return Bundle(
        bundle_counts(fact, substrates, feature),
        bundle_samples(fact, substrates, sample_columns),
        bundle_features(fact, feature, feature_columns),
    )


def keep_deep_samples(counts: DataFrame, above: int = 100) -> DataFrame:
    """Counts of the samples whose total is above a limit."""
    deep = counts.groupBy("sample").agg(F.sum("count").alias("n")).filter(F.col("n") > above)
    return counts.join(deep, "sample", "left_semi")


def prune_features(counts: DataFrame) -> DataFrame:
    """Counts without the features whose total is zero."""
    present = counts.groupBy("feature").agg(F.sum("count").alias("n")).filter(F.col("n") > 0)
    return counts.join(present, "feature", "left_semi")


def zero_features(counts: DataFrame, features: DataFrame) -> DataFrame:
    """One row: features, features without any count, and whether there are any."""
    totals = counts.groupBy("feature").agg(F.sum("count").alias("n"))
    all_features = key_join(features.select("feature").distinct(), totals, ["feature"], "left")
    empty = F.coalesce(F.col("n"), F.lit(0)) == 0
    return all_features.agg(
        F.count(F.lit(1)).alias("n_features"),
        F.count_if(empty).alias("n_zero"),
        F.coalesce(F.bool_or(empty), F.lit(False)).alias("any_zero"),
    )


def subset_samples(counts: DataFrame, samples: DataFrame, keep: Column) -> DataFrame:
    """Counts of the samples that satisfy a condition on the sample table."""
    return counts.join(samples.filter(keep).select("sample"), "sample", "left_semi")


def add_pseudocount(counts: DataFrame, samples: DataFrame, features: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """Add one to every cell, empty ones included; the result is dense, and more than ``max_cells`` cells raise."""
    cells = key_join(
        full_grid(samples, "sample", features, "feature", max_cells), counts, ["sample", "feature"], "left"
    )
    return cells.select(
        "sample", "feature", (F.coalesce(F.col("count"), F.lit(0)) + 1).alias("count")
    )


def alpha_diversity(counts: DataFrame) -> DataFrame:
    """Observed features and Shannon entropy per sample.

    With total N, -sum(p ln p) equals ln N - sum(x ln x) / N, which takes one aggregation.
    """
    x = F.col("count").cast("double")
    sums = (
        counts.filter(F.col("count") > 0)
        .groupBy("sample")
        .agg(
            F.count(F.lit(1)).alias("observed"),
            F.sum(x).alias("n"),
            F.sum(x * F.log(x)).alias("xlogx"),
        )
    )
    return sums.select(
        "sample", "observed", (F.log("n") - F.col("xlogx") / F.col("n")).alias("shannon")
    )


def agglomerate(counts: DataFrame, features: DataFrame, ranks: Sequence[str]) -> DataFrame:
    """Sum counts per sample and feature rank; features without the rank are left out."""
    known = features.select("feature", *ranks).dropna(subset=list(ranks))
    return counts.join(known, "feature").groupBy("sample", *ranks).agg(F.sum("count").alias("count"))


def relative_abundance(counts: DataFrame, name: str = "rel") -> DataFrame:
    return share_of_group(counts, ["sample"], "count", name)


def lump_low_abundance(
    df: DataFrame, value: str, label: str, limit: float = 0.5, low: str = "< 50%"
) -> DataFrame:
    """Keep positive rows; rows below the limit take the ``low`` label."""
    return df.filter(F.col(value) > 0).withColumn(
        "label", F.when(F.col(value) < limit, low).otherwise(F.col(label))
    )


def _scaled(h: str, total: str) -> Column:
    """``floor(h * total / 2^60)`` for a 60-bit ``h``, exact.

    Totals below 2^33 fit two 30-bit halves into long arithmetic; others use decimals.
    """
    high, low = F.shiftright(h, 30), F.col(h).bitwiseAND(F.lit(2**30 - 1))
    narrow = F.shiftright(high * F.col(total) + F.shiftright(low * F.col(total), 30), 30)
    wide = F.expr(f"(cast({h} as decimal(19,0)) * cast({total} as decimal(18,0))) div {2**60}")
    return F.when(F.col(total) < 2**33, narrow).otherwise(wide)


def rarefy(counts: DataFrame, seed: int = 81, slot_draws: int = 20_000) -> DataFrame:
    """Draw every sample, with replacement, down to the smallest sample total.

    Draw ``d`` of a sample lands at ``floor(h * total / 2^60)``, where ``h`` is the first
    60 bits of ``md5(seed|sample|d)``; features lie along the sample in md5 order. The
    result depends only on seed and data, never on partitioning. Both the draws and the
    features of one sample are cut into position slots, so a sample of any size is
    spread over many tasks. Draws of a sample with one slot are made where its features are, those of others are dealt to their slots.
    """
    cells = (
        counts.filter(F.col("count") > 0)
        .groupBy("sample", "feature")
        .agg(F.sum("count").alias("count"))
        .withColumn("__h", F.unhex(F.md5(F.col("feature").cast("string"))))  # sixteen bytes sort like their digits
    )
    # 52 bits of the hash are exact in the double that orders the buckets
    cells = with_buckets(cells, ["sample"], F.conv(F.substring(F.hex("__h"), 1, 13), 16, 10).cast("bigint"))
    placed = running_total(cells, ["sample"], "__bucket", ["__h", "feature"], "count", "__end")
    sizes = cells.groupBy("sample").agg(
        F.sum("count").alias("total"), F.count(F.lit(1)).alias("n_features")
    )
    plan = sizes.withColumn("depth", sizes.agg(F.min("total")).scalar())
    slots = F.expr(f"greatest(depth, n_features) div {slot_draws} + 1")
    plan = plan.withColumn("slots", slots).select(
        "sample", "total", "depth", "slots", "n_features", F.expr("(total + slots - 1) div slots").alias("width")
    )
    rows = plan.agg(F.coalesce(F.sum(F.col("depth") + F.col("n_features")), F.lit(0))).first()[0]
    parts = max(task_count(counts.sparkSession), -(-int(rows) // ROWS_PER_TASK))

    chunks = plan.filter("slots > 1").select(
        "*",
        F.explode(F.expr(f"sequence(0L, (depth - 1) div {slot_draws})")).alias("chunk"),
    ).repartition(task_count(counts.sparkSession), "sample", "chunk")
    draws = chunks.select(
        "sample",
        "total",
        "width",
        F.explode(
            F.expr(f"sequence(chunk * {slot_draws}, least((chunk + 1) * {slot_draws}, depth) - 1)")
        ).alias("d"),
    )
    key = F.concat_ws("|", F.lit(str(seed)), F.col("sample").cast("string"), F.col("d").cast("string"))
    place = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")
    draws = (
        draws.withColumn("h", place)
        .withColumn("u", _scaled("h", "total"))
        .select(
            "sample",
            F.expr("u div width").alias("slot"),
            "u",
            F.lit(None).cast("string").alias("feature"),
            F.lit(1).cast("bigint").alias("n"),
        )
    )
    start = F.col("__end") - F.col("count")
    pieces = (
        placed.withColumn("__start", start)
        .join(plan.select("sample", "width"), "sample")
        .withColumn("slot", F.explode(F.expr("sequence(__start div width, (__end - 1) div width)")))
        .select(
            "sample",
            "slot",
            F.greatest(F.col("__start"), F.col("slot") * F.col("width")).alias("u"),
            F.col("feature").cast("string").alias("feature"),
            F.lit(0).cast("bigint").alias("n"),
        )
    )
    upto = (
        W.partitionBy("sample", "slot")
        .orderBy("u", F.col("feature").isNull())
        .rowsBetween(W.unboundedPreceding, 0)
    )
    none = F.lit(None).cast("bigint")
    # one row stands for all draws of its sample until it is in the task of the sample
    whole = plan.filter("slots = 1").select(
        "sample", F.lit(0).cast("bigint").alias("slot"), none.alias("u"), F.lit(None).cast("string").alias("feature"),
        F.lit(1).cast("bigint").alias("n"), "total", "depth",
    )
    dealt = pieces.unionByName(draws).withColumns({"total": none, "depth": none}).unionByName(whole).repartition(parts, "sample", "slot")
    made = dealt.withColumn("d", F.explode(F.when(F.col("depth").isNull(), F.array(none)).otherwise(F.expr("sequence(0L, depth - 1)"))))
    made = made.withColumn("h", F.when(F.col("d").isNotNull(), place)).withColumn("u", F.when(F.col("d").isNull(), F.col("u")).otherwise(_scaled("h", "total")))
    located = made.select("sample", F.last("feature", ignorenulls=True).over(upto).alias("feature"), "n")
    drawn = located.groupBy("sample", "feature").agg(F.sum("n").alias("count"))
    feature_type = counts.schema["feature"].dataType
    return drawn.filter(F.col("count") > 0).withColumn("feature", F.col("feature").cast(feature_type))
