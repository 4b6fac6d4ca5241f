"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyframe.llm.common import dropped, written

SALTS = 8


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """For edges(a long, b long): node, component (the smallest node that can be reached) of nodes with an edge, but not of the smallest node itself.

    Each round joins nodes to their smallest neighbour. The neighbours of a hub are dealt by salts, and smallest neighbours
    are combined before they are shuffled, so no task sees a whole hub. An edge is one row, from its larger to its smaller node: the smallest
    neighbour of a node is among its smaller ones, or there is none and the node itself is the smallest.
    """

    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")

    def meet(pairs: DataFrame, low: DataFrame, how: str = "inner") -> DataFrame:
        low = low.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(low, (F.col("u") == F.col("w")) & (F.col("salt") == F.col("s")), how)

    def down(star: DataFrame) -> DataFrame:
        return star.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))

    def large(star: DataFrame) -> DataFrame:
        up = star.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        return meet(up, smallest(down(star)), "left").select(F.col("v").alias("a"), F.coalesce("m", "u").alias("b")).distinct()

    def small(star: DataFrame) -> DataFrame:
        pairs = down(star)
        low = smallest(pairs)
        others = meet(pairs, low).filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return others.unionByName(low.select(F.col("w").alias("a"), F.col("m").alias("b"))).distinct()

    star, before = written(edges.select("a", "b").filter("a <> b").distinct(), "links"), None
    for _ in range(most_rounds):
        last, star = star, written(small(large(star)), "stars")
        dropped(last)
        now = tuple(star.agg(F.count(F.lit(1)), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return star.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
    raise RuntimeError("components did not settle")


def joined_components(components: DataFrame, edges: DataFrame) -> DataFrame:
    """For components(node, component) of connected_components() and more edges(a long, b long): the components of all edges, old and new, in the same form.

    The new edges are laid between components, so what was joined before is not joined again.
    """
    ends = edges.select("a", "b")
    for end in ("a", "b"):
        known = components.select(F.col("node").alias("n"), F.col("component").alias("c"))
        ends = ends.join(known, F.col(end) == F.col("n"), "left").withColumn(end, F.coalesce("c", end)).select("a", "b")
    merged = connected_components(ends)
    # a component may hold a large share of all nodes: it meets its new one by salts
    new = merged.select(F.col("node").alias("n"), F.col("component").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    moved = components.join(new, (F.col("component") == F.col("n")) & (salt == F.col("s")), "left").select("node", F.coalesce("c", "component").alias("component"))
    return moved.unionByName(merged)
