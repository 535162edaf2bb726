"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echogrid.llm.tables import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node reachable over the undirected edges (a, b).

    Alternating large-star and small-star contraction: every round links nodes to their smallest neighbour, so the number of
    rounds grows with the logarithm of the longest path and no neighbourhood is gathered. The smallest neighbours are written
    before each join, so both join sides are plain shuffles that adaptive execution can split when a hub is hot. An empty
    edge table gives no rows.
    """
    links = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = stored(links.unionByName(turned).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = stored(turned.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(
            least.select("a", F.col("m").alias("b")))
        after = stored(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if mark(after) == mark(links):
            break
        links = after
    # at the fixed point every other node points at the smallest of its component
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
