"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skyloom.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of an edge: the smallest node it is connected with.

    ``edges`` has two columns of one type; loops, repeats and nulls are ignored. Each round hangs
    nodes on smaller ones until only stars are left, which takes a logarithmic number of rounds. A
    round is written to the shared folder; only a count and a checksum reach the driver.
    """
    a, b = edges.columns
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("component"))
    now = stored(now.distinct(), "edges")
    seen = None
    while True:
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", "component").cast("decimal(38,0)")).alias("h"))
        state = tuple(found.first())
        if state == seen or not state[0]:
            return now
        seen = state
        now = stored(_small(_large(now)), "edges")


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node hangs on the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("component").alias("node"), F.col("node").alias("component")))
    least = both.groupBy("node").agg(F.min("component").alias("least"))
    larger = both.where(F.col("component") > F.col("node"))
    return larger.join(least, "node").select(
        F.col("component").alias("node"), F.least("node", "least").alias("component")
    ).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and the node, hang on the smallest of them."""
    least = edges.groupBy("node").agg(F.min("component").alias("least"))
    moved = edges.join(least, "node").where(F.col("component") != F.col("least"))
    moved = moved.select(F.col("component").alias("node"), F.col("least").alias("component"))
    return moved.unionByName(least.select("node", F.col("least").alias("component"))).distinct()
