"""Average-linkage clustering of a distance table ``(id_a, id_b, dist)``.

Each round merges every pair of clusters that are nearest to one another. Average
linkage is reducible, so this gives the tree of the one-pair-at-a-time method
(Murtagh 1983, The Computer Journal 26(4)).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biotables.session import materialize, scratch_path


_LINK = ["lo", "hi", "d", "tie", "w_lo", "w_hi", "v_lo", "v_hi"]


def _with_tie(links: DataFrame, round_no: int) -> DataFrame:
    """Equal distances are ordered by a hash of the pair and the round it arose in, which both ends see alike.

    So a set of tied clusters pairs off by a constant share in a round, instead of queueing at the smallest id.
    """
    return links.withColumn("tie", F.xxhash64("lo", "hi", F.lit(round_no)))


def _ends(links: DataFrame) -> DataFrame:
    """Every link at both of its clusters: cluster, version, and the link as a struct that sorts by distance."""
    m = F.struct("d", "tie", *[c for c in _LINK if c in links.columns and c not in ("d", "tie")]).alias("m")
    ends = F.array(*[F.struct(F.col(s).alias("c"), F.lit(s).alias("side")) for s in ("lo", "hi")])
    return links.select(F.inline(ends), m).select("c", "m")


def _nearest(ends: DataFrame) -> DataFrame:
    return ends.groupBy("c").agg(F.min("m").alias("m"))


def _mutual(nearest: DataFrame) -> DataFrame:
    return nearest.groupBy("m").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("m.*")


def _mutual_pairs(links: DataFrame, round_no: int) -> DataFrame:
    """Pairs of clusters that are each other's nearest."""
    return _mutual(_nearest(_ends(_with_tie(links, round_no)))).drop("tie")


def _touched(links: DataFrame, moved: DataFrame, round_no: int) -> DataFrame:
    """Distances between each cluster made in a round and all others; size-weighted means of the links it replaces."""
    weighted = links.withColumn("w", F.col("w_lo") * F.col("w_hi"))
    for side in ("lo", "hi"):
        names = moved.select(F.col("old").alias(side), F.col("new").alias(f"new_{side}"), F.col("new_w").alias(f"nw_{side}"))
        weighted = weighted.join(names, side, "left")
    weighted = weighted.where("new_lo IS NOT NULL OR new_hi IS NOT NULL")
    end = {
        s: F.struct(
            F.coalesce(f"new_{s}", s).alias("c"), F.coalesce(f"nw_{s}", f"w_{s}").alias("w"),
            F.when(F.col(f"new_{s}").isNotNull(), F.lit(round_no)).otherwise(F.col(f"v_{s}")).alias("v"),
        )
        for s in ("lo", "hi")
    }
    ends = weighted.select(F.least(end["lo"], end["hi"]).alias("a"), F.greatest(end["lo"], end["hi"]).alias("b"), "d", "w")
    means = ends.filter("a.c <> b.c").groupBy("a", "b").agg((F.sum(F.col("d") * F.col("w")) / F.sum("w")).alias("d"))
    named = means.selectExpr("a.c AS lo", "b.c AS hi", "d", "a.w AS w_lo", "b.w AS w_hi", "a.v AS v_lo", "b.v AS v_hi")
    return _with_tie(named, round_no).select(_LINK)


def _living(links: DataFrame, clusters: DataFrame) -> DataFrame:
    """Links whose two clusters still are what they were when the link was written."""
    for side in ("lo", "hi"):
        links = links.join(clusters.select(F.col("c").alias(side), F.col("v").alias(f"v_{side}")), [side, f"v_{side}"], "left_semi")
    return links.select(_LINK)


def average_linkage(dist: DataFrame) -> DataFrame:
    """Merge list ``(merge_left, merge_right, height, size, left_size, right_size)``.

    A cluster is named by its smallest member; ``size`` counts the members after the merge, the other two
    those of its parts. Every round merges all mutual nearest pairs, for any number of clusters.

    A round writes the links of the clusters that it makes, their merges and the nearest neighbour of each cluster. Other
    links stay where they are; those of a merged cluster are dead, and the stored links are written anew
    only when over three quarters of them are. So all rounds together write as many rows as there are pairs, by a
    constant. A cluster whose neighbour is still there keeps it, unless a new cluster is as near.
    """
    spark = dist.sparkSession
    first = dist.select(
        F.least("id_a", "id_b").alias("lo"), F.greatest("id_a", "id_b").alias("hi"), F.col("dist").cast("double").alias("d"),
        F.lit(1.0).alias("w_lo"), F.lit(1.0).alias("w_hi"), F.lit(0).alias("v_lo"), F.lit(0).alias("v_hi"),
    )
    links = materialize(_with_tie(first, 0).select(_LINK), "links")
    stored, stored_rows = [links], links.count()
    nearest = materialize(_nearest(_ends(links)), "nearest")
    left = nearest.count()
    folder, round_no = scratch_path(spark, "merges"), 0
    mine, other = (F.when(F.col("c") == F.col("m.lo"), F.col(f"m.{x}")).otherwise(F.col(f"m.{y}")) for x, y in (("v_lo", "v_hi"), ("hi", "lo")))
    while True:
        round_no += 1
        part = f"{folder}/round={round_no}"
        _mutual(nearest).write.parquet(part)
        pairs = spark.read.schema(links.schema).parquet(part)
        made = pairs.count()
        if not made:
            break
        moved = pairs.select(F.explode(F.array("lo", "hi")).alias("old"), F.col("lo").alias("new"), (F.col("w_lo") + F.col("w_hi")).alias("new_w"))
        clusters = nearest.select("c", mine.alias("v"))
        before = spark.read.schema(links.schema).parquet(*[f for t in stored for f in t.inputFiles()])
        fresh = materialize(_touched(_living(before, clusters), moved, round_no), "links")
        rest = nearest.join(moved.select(F.col("old").alias("c")), "c", "left_anti").withColumn("other", other)
        gone = moved.select(F.col("old").alias("other"))
        kept, lost = rest.join(gone, "other", "left_anti").select("c", "m"), rest.join(gone, "other", "left_semi").select("c")
        # clusters that lost their neighbour look through their links to clusters that stayed
        again = _ends(_living(before, rest.select("c", mine.alias("v")))).join(lost, "c", "left_semi")
        nearest = materialize(_nearest(kept.unionByName(again).unionByName(_ends(fresh))), "nearest")
        left -= made
        stored, stored_rows = [*stored, fresh], stored_rows + made * left
        if stored_rows > 2 * left * (left - 1):  # four times the pairs of the clusters that are left
            everything = spark.read.schema(links.schema).parquet(*[f for t in stored for f in t.inputFiles()])
            links = materialize(_living(everything, nearest.select("c", mine.alias("v"))), "links")
            stored, stored_rows = [links], left * (left - 1) // 2
    return (
        spark.read.schema(links.schema).parquet(folder)
        .select(
            F.col("lo").alias("merge_left"), F.col("hi").alias("merge_right"), F.col("d").alias("height"),
            (F.col("w_lo") + F.col("w_hi")).cast("long").alias("size"),
            F.col("w_lo").cast("long").alias("left_size"), F.col("w_hi").cast("long").alias("right_size"),
        )
    )


def leaf_order(merges: DataFrame) -> DataFrame:
    """Dendrogram order ``(leaf, position)``: a single leaf goes before a cluster, a lower cluster first."""
    return node_positions(merges).where("members = 1").select(F.col("name").alias("leaf"), "position")


def node_positions(merges: DataFrame) -> DataFrame:
    """``(name, members, position)``: where the leaves of each node but the root begin in the dendrogram.

    A node is a cluster's name and size. The second part of a merge starts after all leaves of the first one, so
    the position of a leaf is the sum of such starts on its way to the root, which pointer doubling
    adds up in as many rounds as the depth has bits.
    """
    merges = materialize(merges, "tree")
    heights = merges.select(F.col("merge_left").alias("name"), F.col("size").alias("members"), F.col("height").alias("own"))

    def with_height(df: DataFrame, side: str) -> DataFrame:
        found = heights.select(
            F.col("name").alias(f"merge_{side}"), F.col("members").alias(f"{side}_size"), F.col("own").alias(f"{side}_height")
        )
        return df.join(found, [f"merge_{side}", f"{side}_size"], "left")

    both = with_height(with_height(merges, "left"), "right")
    rank = {s: F.struct(F.coalesce(F.col(f"{s}_height"), F.lit(float("-inf"))), F.col(f"{s}_size"), F.col(f"merge_{s}")) for s in ("left", "right")}
    left_first = rank["left"] < rank["right"]

    def child(side: str, first: Column, other: str) -> Column:
        return F.struct(
            F.col(f"merge_{side}").alias("name"), F.col(f"{side}_size").alias("members"),
            F.when(first, F.lit(0)).otherwise(F.col(f"{other}_size")).cast("long").alias("before"),
        )

    state = both.select(
        F.inline(F.array(child("left", left_first, "right"), child("right", ~left_first, "left"))),
        F.col("merge_left").alias("up_name"), F.col("size").alias("up_members"),
    )
    state = materialize(state, "leaf-paths")
    while True:
        above = state.select(
            F.col("name").alias("up_name"), F.col("members").alias("up_members"), F.col("before").alias("more"),
            F.col("up_name").alias("top_name"), F.col("up_members").alias("top_members"),
        )
        moved = materialize(
            state.join(above, ["up_name", "up_members"], "left").select(
                "name", "members", (F.col("before") + F.coalesce("more", F.lit(0))).alias("before"),
                F.coalesce("top_name", "up_name").alias("up_name"), F.coalesce("top_members", "up_members").alias("up_members"),
                F.col("top_name").isNotNull().alias("moved"),
            ),
            "leaf-paths",
        )
        state = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    return state.select("name", "members", (F.col("before") + 1).alias("position"))


def cophenetic(merges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (id_a, id_b and other columns) with the merge that joins the two: ``merge_left, size, height``.

    Leaves of a node are a run of positions, so a leaf meets the parts of merges it belongs to by position; the merge
    of a pair is the one where the two leaves are in different parts. Pairs of no common tree are left out.
    """
    merges = materialize(merges, "tree")
    nodes = materialize(node_positions(merges), "node-positions")
    leaves = nodes.where("members = 1").select(F.col("name").alias("leaf"), F.col("position").alias("at"))

    def part(side: str) -> DataFrame:
        return merges.select(
            F.col(f"merge_{side}").alias("name"), F.col(f"{side}_size").alias("members"), F.lit(side).alias("side"),
            "merge_left", "size", "height",
        )

    parts = part("left").unionByName(part("right")).join(nodes, ["name", "members"])
    run = F.explode(F.sequence("position", F.col("position") + F.col("members") - 1)).alias("at")
    above = materialize(parts.select("side", "merge_left", "size", "height", run).join(leaves, "at").drop("at"), "ancestors")
    first = pairs.join(above.withColumnRenamed("leaf", "id_a"), "id_a")
    second = above.select(F.col("leaf").alias("id_b"), "merge_left", "size", F.col("side").alias("other_side"))
    return first.join(second, ["id_b", "merge_left", "size"]).where("side <> other_side").drop("side", "other_side")
