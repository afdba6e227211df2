"""Connected components of an undirected graph by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import cut, release


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest of them: the larger ones (both_ways), or the smaller ones."""
    one = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pairs = one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else one
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("center"), F.least("u", "m").alias("m"))
    met = pairs.join(least, F.col("u") == F.col("center"))
    if both_ways:
        out = met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(met.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(a, b); the component is its smallest node.

    No neighbour list is collected: minima are aggregates, links go back by a join. Rounds end when nothing changes;
    their number grows with the logarithm of the longest chain. Each round is a table in the shared folder and replaces the one before. Nulls and
    self loops are dropped, repeated edges count once, no edges give no rows.
    """
    now = cut(edges.dropna(subset=["a", "b"]).filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (seen["n"], seen["x"]) == mark or not seen["n"]:
            break
        mark = (seen["n"], seen["x"])
        before, now = now, cut(_star(_star(now, True), False))
        release(before)
    linked = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return linked.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
