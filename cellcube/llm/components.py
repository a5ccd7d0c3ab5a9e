"""Connected components of a table of links, by alternating large and small stars.

Each round replaces every node's links by links to the least neighbour; the tables
stay linear in the links.  Minima are hash aggregates and joins, so that a node with
very many links is pre-aggregated and its join can be split.  Every round's table is
written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcube.llm.common import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (node, near) by which each node's neighbours meet at its least one."""
    both = links.select("a", "b")
    if large:
        both = both.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        out = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        out = both.join(least, "a")
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links(a, b)`` except the roots; root is the least node reachable."""
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(links, "links")
    while True:
        after = stored(_star(_star(links, True), False), "links")
        # done when every node has one link and no root has any
        tall = after.groupBy("a").count().filter("count > 1").limit(1).count()
        if not tall and not after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        links = after
