"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.plans.lineage import cut, discard


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges; root is the smallest node reachable.

    Alternating large and small stars: each round hooks the larger neighbours of a node, then the
    smaller ones, to the smallest node around. The rounds grow with the logarithm of the diameter.
    Each star is a grouped minimum (combined before the shuffle) and a join back, so a hub's edges
    are never gathered; the join's large side can be split by AQE. Edges never outnumber the input.
    Null ends and self-loops are ignored; an empty input gives an empty result.
    """
    e = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    before = None
    for _ in range(most_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # the minimum itself stays tied to the node that it was found around
        large = large.union(low.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, cut(small.union(down.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        discard(old)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())


def clusters(nodes: DataFrame, edges: DataFrame, node: str = "node", a: str = "a", b: str = "b") -> DataFrame:
    """node and cluster_id for every node: the smallest node reachable, itself where it has no edge."""
    found = components(edges, a, b).withColumnRenamed("node", "_n")
    return nodes.select(node).distinct().join(found, F.col(node) == F.col("_n"), "left").select(node, F.coalesce("root", node).alias("cluster_id"))


def members(labels: DataFrame, node: str = "node") -> DataFrame:
    """cluster_id, member_count, members (ascending, joined by |) and merged for each cluster."""
    return labels.groupBy("cluster_id").agg(F.count("*").alias("member_count"), F.array_join(F.array_sort(F.collect_list(node)), "|").alias("members"), (F.count("*") > 1).alias("merged"))
