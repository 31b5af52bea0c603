"""Connected components of an edge table, by alternating large and small stars.

Each round rewires edges towards the smallest node of a neighbourhood; the result
is a forest of stars: (node, root).  Rounds grow with the logarithm of the
longest path.  Every round is written to the shared folder, which cuts the
lineage and survives lost executors.  A node with very many neighbours is no
special case: its minimum is combined before the shuffle, and the join that hands
it out is one that Spark splits when skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halflife.session import stage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the least of u and its neighbours."""
    around = _both_ways(edges)
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: then each v is the root of its component."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("below")), F.struct(F.col("v").alias("x"), F.lit(0).alias("below")))).alias("e"))
    seen = ends.groupBy("e.x").agg(F.sum("e.below").alias("below"), F.min("e.below").alias("least"))
    return seen.where("below > 1 or (below = 1 and least = 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) -> (node, root): the least node of each component, for every non-root node.

    A node that appears in no edge, or is the root itself, has no row.
    """
    edges = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "cc-edges")
    while not _is_stars(edges):
        edges = stage(_small_star(_large_star(edges)), "cc-edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def between(component: DataFrame | None, links: DataFrame) -> DataFrame:
    """Links (u, v) as links of roots, without those inside a component."""
    if component is None:
        return links.where("u <> v")
    root = lambda x: component.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    ends = links.join(root("u"), "u", "left").join(root("v"), "v", "left")
    return ends.select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v")).where("u <> v")


def join_components(component: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components (node, root), or None, after links (u, v) are added; only roots are worked on."""
    joined = connected_components(between(component, links))
    if component is None:
        return joined
    moved = joined.select(F.col("node").alias("root"), F.col("root").alias("to"))
    old = component.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return stage(old.unionByName(joined), "cc-roots")
