"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemason.sources.tables import cut_lineage


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root): the smallest node of each node's component, for every node of an edge.

    Alternates large-star and small-star steps until nothing changes: a number of rounds
    that grows with the logarithm of the size, each a few shuffles of the edges. A node's
    smallest neighbour comes from an aggregate with partial aggregation; it is joined back as
    one row a node, by merge join, where the adaptive planner splits a node with very many
    edges. Null ends and loops are dropped; an empty graph has no rows.
    """
    links = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    links = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        links = cut_lineage(small.where("a <> b").distinct())
        mark = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == before:
            break
        before = mark
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
