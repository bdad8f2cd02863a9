"""Connected components of links, by large and small stars (Kiveris et al., 2014).

A step finds each node's least neighbour with partial minima and hangs the others on it; no task gets a node's list of
neighbours. Each step is written to the shared folder. It ends when a step changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the component's least node. links: columns a, b, of one sortable type."""
    now = materialise(links.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "links")
    sign = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        m = _least(down)
        small = down.join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).unionByName(m.select("a", F.col("m").alias("b"))).distinct()
        after = materialise(small, "links")
        release(now)
        now = after
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == sign:
            break
        sign = new
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
