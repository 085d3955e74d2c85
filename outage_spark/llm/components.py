"""Connected components of a large graph, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outage_spark.llm.text import store


def _larger_to_smallest(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours point to its smallest neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("m").alias("a"), "b")


def _smaller_to_smallest(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b")
    smaller = joined.select(F.col("m").alias("a"), F.col("a").alias("b"))
    own = least.select(F.col("m").alias("a"), "b")
    return smaller.unionByName(own).where(F.col("a") < F.col("b"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` (smallest node) for every node of ``edges (a, b)`` that is not itself a root.

    Each round is two aggregations and joins by node, stored; the number of rounds grows with the
    logarithm of the longest path. Directions and repeats of edges do not matter.
    """
    now = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now = store(now.distinct())
    mark = None
    while True:
        now = store(_smaller_to_smallest(_larger_to_smallest(now)).distinct())
        # Edges are stars once no node is both a centre and a leaf; the sums notice any other change.
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        mark = tuple(seen)
