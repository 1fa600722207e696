"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._spark import checkpoint


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hang each node's neighbours (small: those below it) on the smallest node of them and itself."""
    pairs = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = checkpoint(pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))  # written: Spark splits a hub's rows only where both sides of a join are shuffled for it
    joined = pairs.join(least, "a")
    moved = joined.where("b != m" if small else "b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if small:
        moved = moved.unionByName(least.where("a != m").select("a", F.col("m").alias("b")))
    return moved.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    """The number of distinct edges and two sums of their hashes: equal for equal tables."""
    sums = [F.sum(F.xxhash64("a", "b", F.lit(k)).bitwiseAND(0xFFFFFFFF)).alias(f"s{k}") for k in range(2)]
    return tuple(edges.agg(F.count("*").alias("n"), *sums).first())


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id it is linked with, over any number of links) of the ids in links (a, b).

    Null ends and links of an id with itself are left out; repeated links count once.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = checkpoint(edges)
    state = _state(edges)
    while True:
        new = checkpoint(_star(_star(edges, False), True), edges)
        before, state, edges = state, _state(new), new
        if state == before:
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
