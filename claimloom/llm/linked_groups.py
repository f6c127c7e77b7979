"""Groups of records that pairwise links tie together, by seed-tree pruning.

In each round every vertex tells its neighbours the smallest vertex it knows of; vertices that are nobody's
minimum leave the graph and hang below their minimum in a propagation forest, and the remaining minima are
linked among themselves. When no link is left, the roots (the smallest vertex of each component) are the
seeds, and their names flow down the forest, round by round backwards. The number of rounds grows with the
logarithm of the longest chain. All steps are aggregations (with map-side combining, so a hub costs no more
than its edges) and equi-joins; each round writes its tables to the shared folder and deletes those before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.session import cut, release


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).dropDuplicates()


def _flow(tree: DataFrame, known: DataFrame | None) -> DataFrame:
    """Seeds of the vertices of one round: that of the parent, or the parent itself where it is a root."""
    if known is None:
        return tree.select("v", F.col("parent").alias("seed"))
    up = known.select(F.col("v").alias("parent"), "seed")
    return tree.join(up, "parent", "left").select("v", F.coalesce("seed", "parent").alias("seed"))


def linked_groups(links: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, group_key) for each node in a group of at least two; group_key is the smallest node.

    Rows with a null end are ignored, as are links of a node to itself; repeated and mirrored rows change
    nothing. Nodes may be of any orderable type. An empty table gives an empty result.

    Every round takes at least the larger end of each link's smallest neighbourhood out of the graph, so the loop ends.
    Both sides of each join are tables that are shuffled for it: Spark splits the links of a hub over several tasks.
    """
    edges = links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null and u <> v")
    edges = cut(_both_ways(edges))
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        least = cut(edges.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("least")))
        # each vertex tells itself and its neighbours its minimum
        told = cut(edges.join(least, "u").select(F.col("v").alias("u"), "least").unionByName(least.select("u", "least")).dropDuplicates())
        best = cut(told.groupBy("u").agg(F.min("least").alias("best"), F.bool_or(F.col("least") == F.col("u")).alias("stays")))
        rounds.append(best)
        rest = told.join(best, "u").where("least <> best").select(F.col("least").alias("u"), F.col("best").alias("v"))
        before, edges = edges, cut(_both_ways(rest))
        release(before, least, told)
    release(edges)
    known = None
    for best in reversed(rounds):
        now = _flow(best.where("not stays").select(F.col("u").alias("v"), F.col("best").alias("parent")), known)
        before, known = known, cut(now if known is None else known.unionByName(now))
        release(before, best)
    if known is None:
        return links.select(F.col(left).alias("node"), F.col(left).alias("group_key")).where("false")
    seeds = known.select(F.col("seed").alias("node"), F.col("seed").alias("group_key")).dropDuplicates()
    return known.select(F.col("v").alias("node"), F.col("seed").alias("group_key")).unionByName(seeds)
