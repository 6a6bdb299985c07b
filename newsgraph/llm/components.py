"""Connected components over an edge table, by large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsgraph.llm.common import Written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hook neighbours of each node to its smallest neighbour (or itself).

    Large star: the neighbours above the node. Small star: those below it, and
    the node. Minima are aggregated map-side and joined back, so the neighbours
    of a hub are never gathered in one place.
    """
    both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    if not large:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("k"), F.least("u", "m").alias("m"))
    joined = both.join(least, both["u"] == least["k"])
    if large:
        hooked = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        hooked = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select("k", "m"))
    return hooked.where("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable over the edges.

    Only nodes with an edge to another node are returned; edges with a null end
    and loops count for nothing. Both stars alternate on written tables until
    the edge set stays as it is; the number of rounds grows with the logarithm
    of the longest path.
    """
    now = Written(
        edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
        .where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(), "edges")
    mark = None
    while True:
        new = F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))
        seen = now.df.agg(F.count("*"), new).first()
        if tuple(seen) == mark or seen[0] == 0:
            return now.df.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = tuple(seen)
        step = Written(_star(_star(now.df, True), False), "edges")
        now.drop()
        now = step
