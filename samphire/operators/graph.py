"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from samphire.checkpoints import cut_lineage


def connected_components(edges: DataFrame, left: str = "src", right: str = "dst") -> DataFrame:
    """(node, component) of every node with an edge to another one; the component is its smallest node.

    Nodes may be of any type that has an order, structs too: a struct that begins with what is wanted of a component's
    smallest node needs no join afterwards. Edges with a null end, of a node to itself and repeated ones add nothing; an
    empty table gives none.

    Alternating large-star and small-star steps, O(log n) rounds whatever the diameter. Rounds are checkpointed in the
    shared folder; each is two shuffles on nodes.
    """
    stars = cut_lineage(edges.where(F.col(left) != F.col(right)).select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct())
    before = None
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: the greater neighbours of each node go to its smallest one
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: the smaller neighbours and the node itself go to its smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        stars = cut_lineage(small.where("u <> v").distinct())
        now = stars.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if before == (now["n"], now["h"]):
            break
        before = (now["n"], now["h"])
    heads = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads)


def community_previews(pair_table: DataFrame, threshold: int = 2, preview: int = 5) -> DataFrame:
    """(preview_tags, size) of the communities of tags that ``threshold`` or more samples join, largest first."""
    edges = pair_table.where(F.col("c") >= max(1, threshold)).select(F.col("left").alias("src"), F.col("right").alias("dst"))
    members = connected_components(edges)
    # ranks instead of one list a community: a community may hold most tags
    ranked = members.withColumn("rank", F.row_number().over(W.partitionBy("component").orderBy("node")))
    first = ranked.where(F.col("rank") <= max(0, preview)).groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("preview_tags"))
    sizes = members.groupBy("component").agg(F.count("*").cast("int").alias("size"))
    table = sizes.join(first, "component", "left").select(F.coalesce("preview_tags", F.array().cast("array<string>")).alias("preview_tags"), "size")
    return table.orderBy(F.desc("size"), F.array_join("preview_tags", "\u0001"))


def community_hint(pair_table: DataFrame, threshold: int = 2) -> DataFrame:
    """One row: community_count and modularity_hint = communities / nodes (0 without edges)."""
    edges = pair_table.where(F.col("c") >= max(1, threshold)).select(F.col("left").alias("src"), F.col("right").alias("dst"))
    row = connected_components(edges).agg(F.countDistinct("component").alias("community_count"), F.count("*").alias("nodes"))
    return row.select("community_count", F.coalesce(F.try_divide("community_count", "nodes"), F.lit(0.0)).alias("modularity_hint"))
