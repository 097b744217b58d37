"""Connected components of an undirected graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges -> (node, root): root is the smallest node reachable.

    Alternating star contraction: every node hands its larger neighbours to
    the smallest one it knows ("large star"), then its smaller neighbours
    ("small star"), until nothing changes: a number of rounds that grows with
    the logarithm of the graph. Each round is written to the shared checkpoint
    folder; only two numbers per round come to the driver. Minima are grouped
    aggregates with map-side combination, so a node with any number of
    neighbours is no single task's work. Self loops and repeated edges are
    harmless; nodes without an edge are not in the result."""
    edges = written(edges.filter(F.col("a") != F.col("b"))
                    .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _signature(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = (both.filter(F.col("b") > F.col("a")).join(lowest, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(lowest, "a").filter(F.col("b") != F.col("m"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.toDF("a", "b")).distinct())
        edges = written(small, "edges")
        after = _signature(edges)
        if after == before:
            break
        before = after
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.toDF("node", "root").unionByName(roots)
