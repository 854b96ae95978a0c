"""Connected components of a graph in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); a component is named by its smallest node.

    Two steps alternate until nothing changes. The first hangs all larger neighbours of a node on the smallest node
    around it, the second hangs a node and its smaller neighbours on the smallest of them. Neither makes edges, and long
    chains shorten by half a round. Each step is a partial aggregate and a join on thin rows, written to the shared
    folder. Loops and repeated edges are of no account; without edges there are no rows.
    """
    edges = written(_directed(edges), "edges")
    before = None
    while True:
        last, edges = edges, written(_small_star(_large_star(edges)), "edges")
        discard(last)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _directed(edges: DataFrame) -> DataFrame:
    """From the larger node to the smaller, once."""
    return edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    # Only neighbours larger than the node move, so one direction of the edges is enough here.
    moved = edges.join(least.withColumnRenamed("a", "b"), "b").select("a", F.least("b", "m").alias("b"))
    return _directed(moved)


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _directed(moved.unionByName(least.select("a", F.col("m").alias("b"))))
