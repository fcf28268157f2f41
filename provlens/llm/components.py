"""Connected components by alternating stars, for links of any number and hubs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlens.llm.common import landed


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node sends its larger neighbours to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (both.filter("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node joins its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (``u, v``): the label is the component's smallest node.

    Every round writes its links to the shared folder, so a lost executor costs one round;
    there are about as many rounds as the logarithm of the longest path. No component is
    gathered anywhere: a hub's neighbours meet its minimum in a join that can be split.
    """
    links = landed(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .distinct(), "links")
    while True:
        # Done when all are stars: no centre points anywhere.
        open_ended = links.select(F.col("v").alias("node")).join(links.select(F.col("u").alias("node")), "node", "left_semi")
        twice = links.groupBy("u").count().filter("count > 1")
        if open_ended.isEmpty() and twice.isEmpty():
            break
        links = landed(_small_star(_large_star(links)), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        links.select("v", F.col("v")).distinct())
