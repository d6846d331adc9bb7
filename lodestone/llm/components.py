"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _minimum(pairs: DataFrame) -> DataFrame:
    """Of pairs (u, v): each u with the least of itself and its v."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for all nodes of ``edges`` (columns a and b, longs).

    Rounds go on until nothing changes; their number grows with the logarithm of the longest chain. Each is written to the
    shared folder. A node
    with very many neighbours is summed up before the shuffle, and its join can be split. An empty table has no nodes.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_minimum(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = _minimum(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = materialise(small.where("u <> v").distinct(), "edges")
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == before:
            break
        before = state
    star = now.groupBy("u").agg(F.min("v").alias("m"))
    return star.select(F.col("u").alias("node"), F.col("m").alias("component")).union(now.select("v", "v").distinct())
