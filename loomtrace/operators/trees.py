"""Trees of any depth by pointer doubling: rounds grow with the logarithm of the depth, no path is carried.

Before round k every node points at its ancestor 2^k steps above (null where there is none). What a node knows about its
nearest 2^k ancestors, or about the descendants less than 2^k steps below, is put together with what the node it points
at (or the nodes that point at it) know; the two parts never overlap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.operators.ordered import lookup
from loomtrace.session import cut_lineage

Joined = Callable[[Column, Column], Column]


def double(
    nodes: DataFrame,
    keys: list[str],
    node: str,
    parent: str,
    *,
    above: dict[str, Joined] | None = None,
    below: dict[str, tuple[Callable[[str], Column], Joined]] | None = None,
) -> DataFrame:
    """Columns of `nodes` gathered over all ancestors (`above`) or all descendants (`below`) of each node, itself included.

    `above` maps a column to join(own, the pointed-at node's); `below` to an aggregate over the nodes that point here and
    join(own, aggregate). Parents are rows of `nodes` with the same keys; (keys, node) is unique. Nodes on or below a cycle
    have no end above them and are left out. Each round is one table; star-shaped trees spread their hot parent.
    """
    above, below = above or {}, below or {}
    state = cut_lineage(nodes.withColumn("__jump", F.col(parent)))
    open_before = None
    while True:
        open_now = state.where(F.col("__jump").isNotNull()).count()
        # depths have no gaps: if no node ends between 2^k and 2^(k+1) steps, only cycles are left
        if open_now in (0, open_before):
            break
        open_before = open_now
        climbing, done = state.where(F.col("__jump").isNotNull()), state.where(F.col("__jump").isNull())
        its = state.select(*keys, F.col(node).alias("__jump"), F.col("__jump").alias("__next"), *[F.col(c).alias(f"__its_{c}") for c in above])
        climbed = lookup(climbing, its, [*keys, "__jump"], node, how="inner")
        climbed = climbed.withColumns({c: join(F.col(c), F.col(f"__its_{c}")) for c, join in above.items()})
        moved = climbed.drop("__jump").withColumnRenamed("__next", "__jump").select(*state.columns).unionByName(done)
        if below:
            told = climbing.groupBy(*keys, F.col("__jump").alias(node)).agg(*[gather(c).alias(f"__told_{c}") for c, (gather, _) in below.items()])
            moved = moved.join(told, [*keys, node], "left")
            joined = {c: F.when(F.col(f"__told_{c}").isNull(), F.col(c)).otherwise(join(F.col(c), F.col(f"__told_{c}"))) for c, (_, join) in below.items()}
            moved = moved.withColumns(joined)
        state = cut_lineage(moved.select(*state.columns))
    return state.where(F.col("__jump").isNull()).drop("__jump")


def depths(nodes: DataFrame, keys: list[str], node: str, parent: str) -> DataFrame:
    """Nodes with `depth`: steps up to their root, which has none."""
    steps = nodes.withColumn("depth", F.col(parent).isNotNull().cast("int"))
    return double(steps, keys, node, parent, above={"depth": lambda own, its: own + its})
