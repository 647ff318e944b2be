"""Connected components by alternating large and small stars, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.store import drop, materialize


def _settled(links: DataFrame) -> bool:
    """Whether each node that links start from has one, to a node that none starts from: stars, with nothing left to do."""
    ends = links.select("a", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(links.select(F.col("b").alias("a"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    seen = ends.groupBy("a").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return seen.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))).isEmpty()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links of any ordered type -> (node, component); component is the smallest node that can be reached.

    Only nodes with a link to another node are returned, and each of them once. Links may repeat and point either way;
    links with a null end, or from a node to itself, say nothing. A round replaces every link by one to the smallest
    neighbour, so a hub costs as many rows as it has links, its minimum is partially aggregated before the shuffle,
    and the joins can be split where a hub is large. Rounds grow with the logarithm of the longest chain.
    """
    spark = edges.sparkSession
    ends = edges.where("a is not null and b is not null and a != b")
    now, path = materialize(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(rounds):
        if _settled(now):
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new, where = materialize(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), "links")
        drop(spark, path)
        now, path = new, where
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
