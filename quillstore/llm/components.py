"""Connected components by contraction: every node joins its smallest neighbour, chains are followed, what is joined becomes one node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import kept


def components(edges: DataFrame) -> DataFrame:
    """node, component of every node of (a long, b long): component is the smallest node that links reach. Nothing is on the driver but counts.

    Each round at least halves the nodes that still have neighbours. Hubs are aggregated before the shuffle; every round is written.
    """
    links = kept(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    names = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component"))
    while True:
        links = links.where("a <> b")
        if links.isEmpty():
            return names
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = kept(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("x"), F.least("a", "b").alias("y")))
        while True:  # follow y until it points to itself
            next_ = to.select(F.col("x").alias("y"), F.col("y").alias("z"))
            longer = kept(to.join(next_, "y").select("x", F.col("z").alias("y"), (F.col("y") != F.col("z")).alias("moved")))
            to = longer.select("x", "y")
            if longer.where("moved").isEmpty():
                break
        names = kept(names.join(to.select(F.col("x").alias("component"), "y"), "component", "left").select("node", F.coalesce("y", "component").alias("component")))
        left = to.select(F.col("x").alias("a"), F.col("y").alias("na"))
        right = to.select(F.col("x").alias("b"), F.col("y").alias("nb"))
        links = kept(links.join(left, "a").join(right, "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).where("a <> b").distinct())
