"""Connected components of a graph given by its links, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm.common import written


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b, both long); root is the smallest node of its component.

    Alternating large-star and small-star steps; each step's links are cut to the
    shared folder, and the links of a step never outnumber those before it.
    """
    edges = written(spark, links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", few=True)
    mark = None
    while True:
        # Large star: every larger neighbour moves to the smallest member of the neighbourhood.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        edges = (both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # Small star: a node and its smaller neighbours meet at the smallest of them.
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(spark, moved.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "links", few=True)
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 31))).collect()[0]
        if seen == mark:
            break
        mark = seen
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
