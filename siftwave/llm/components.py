"""Connected components as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of the nodes in ``edges(a, b)``: the smallest id that a node reaches.

    Alternates the large-star and small-star steps: every node hangs its larger
    neighbours, then all but the smallest of its neighbours, on the smallest one.
    The number of edges never grows and the rounds are logarithmic in the longest
    path. Each step is a grouped minimum (combined before the shuffle), written, and a
    join with it that Spark can split, so a node with very many neighbours is no
    single task's work.
    """
    edges = stored(edges.filter("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct(), "edges")
    before = None
    while True:
        edges = stored(_small_star(_large_star(edges)), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()  # two numbers
        if state == before:
            break
        before = state
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(stored(least, "least"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Here ``b < a`` always holds, so a node's row list is its smaller neighbours."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(stored(least, "least"), "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return hung.distinct()
