"""Order-dependent building blocks that never gather one key into one task.

A running value over a key is computed in two steps: inside spans of a fixed number of order
values, and across the spans' one-row summaries. A key that holds a third of all rows is thus
spread over as many tasks as it has spans.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.session import cut_lineage

SPAN = 1_000_000
SALTS = 32
HOT_ROWS = 5_000_000
TASK_ROWS = 250_000


def _span(order: str, size: int, backwards: bool) -> Column:
    span = F.floor(F.col(order) / F.lit(size)).cast("bigint")
    return -span if backwards else span


def _over_earlier_spans(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)


def _seeded(rows: DataFrame, seeds: DataFrame, keys: Sequence[str], names: Sequence[str], *order: Column):
    """Rows with one leading seed row per span, and the span window that starts at the seed."""
    filled = reduce(or_, [F.col(f"__v_{n}").isNotNull() for n in names])
    seeds = seeds.where(filled)
    united = rows.withColumn("__row", F.lit(1)).unionByName(
        seeds.withColumn("__row", F.lit(0)), allowMissingColumns=True
    )
    return united, Window.partitionBy(*keys, "__span").orderBy("__row", *order)


def enough_parts(table: DataFrame, rows: int = TASK_ROWS) -> int | None:
    """Partitions that keep a task of a stored table at about `rows` rows; none while the session's own number is enough."""
    parts = -(-table.count() // rows)
    return parts if parts > int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    return rows.repartition(parts, *keys) if parts else rows


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: dict[str, Column],
    *,
    inclusive: bool = True,
    backwards: bool = False,
    span: int = SPAN,
    parts: int | None = None,
) -> DataFrame:
    """Add, per row, the latest non-null of each value among the rows before it (or up to it).

    `order` is an integer column, unique per key. `backwards` looks at the following rows
    instead. Keys match null to null. `parts` is the number of tasks the rows are sorted in, the
    session's where it is none.
    """
    names = list(values)
    direction = F.col(order).desc() if backwards else F.col(order).asc()
    work = df.withColumn("__span", _span(order, span, backwards)).withColumns(
        {f"__v_{n}": c for n, c in values.items()}
    )
    nearest = F.min_by if backwards else F.max_by
    summary = work.groupBy(*keys, "__span").agg(
        *[
            nearest(F.col(f"__v_{n}"), F.when(F.col(f"__v_{n}").isNotNull(), F.col(order))).alias(f"__v_{n}")
            for n in names
        ]
    )
    seeds = summary.select(
        *keys, "__span", *[F.last(f"__v_{n}", ignorenulls=True).over(_over_earlier_spans(keys)).alias(f"__v_{n}") for n in names]
    )
    united, window = _seeded(work, seeds, keys, names, direction)
    united = dealt(united, parts, *keys, "__span")
    window = window.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    filled = united.withColumns({f"__l_{n}": F.last(f"__v_{n}", ignorenulls=True).over(window) for n in names})
    keep = [F.col(c) for c in df.columns if c not in names]
    return filled.where(F.col("__row") == 1).select(*keep, *[F.col(f"__l_{n}").alias(n) for n in names])


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column], *, span: int = SPAN
) -> DataFrame:
    """Add the inclusive running sum of each value along the order."""
    names = list(values)
    work = df.withColumn("__span", _span(order, span, False)).withColumns(
        {f"__v_{n}": F.coalesce(c.cast("bigint"), F.lit(0)) for n, c in values.items()}
    )
    summary = work.groupBy(*keys, "__span").agg(*[F.sum(f"__v_{n}").alias(f"__v_{n}") for n in names])
    seeds = summary.select(
        *keys, "__span", *[F.sum(f"__v_{n}").over(_over_earlier_spans(keys)).alias(f"__v_{n}") for n in names]
    )
    united, window = _seeded(work, seeds, keys, names, F.col(order))
    window = window.rowsBetween(Window.unboundedPreceding, 0)
    summed = united.withColumns({f"__l_{n}": F.sum(f"__v_{n}").over(window) for n in names})
    keep = [F.col(c) for c in df.columns if c not in names]
    return summed.where(F.col("__row") == 1).select(*keep, *[F.col(f"__l_{n}").alias(n) for n in names])


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_at: str,
    right_at: str,
    columns: Sequence[str],
    *,
    inclusive: bool,
    backwards: bool = False,
    span: int = SPAN,
) -> DataFrame:
    """Left rows with the nearest right row before `left_at` (after it with `backwards`).

    Both sides are united and the right row is carried to the left ones: linear, no range join.
    `right_at` is unique per key. The result holds `columns`, null where nothing matched.
    """
    # Right rows come first at equal positions when they count, last when they do not.
    early = inclusive != backwards
    here = left.select(
        *keys,
        (F.col(left_at) * 2 + (1 if early else 0)).cast("bigint").alias("__at"),
        F.struct(*[F.col(c) for c in left.columns]).alias("__left"),
        F.lit(None).alias("__right"),
    )
    there = right.select(
        *keys,
        (F.col(right_at) * 2 + (0 if early else 1)).cast("bigint").alias("__at"),
        F.lit(None).alias("__left"),
        F.struct(*[F.col(c) for c in columns]).alias("__right"),
    )
    carried = carry(
        here.unionByName(there), keys, "__at", {"__hit": F.col("__right")}, backwards=backwards, span=2 * span
    ).where(F.col("__left").isNotNull())
    return carried.select("__left.*", *[F.col(f"__hit.{c}").alias(c) for c in columns])


def asof_values(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_at: str,
    right_at: str,
    values: dict[str, Column],
    *,
    inclusive: bool,
    backwards: bool = False,
    span: int = SPAN,
) -> DataFrame:
    """Like `asof`, but each value looks past right rows where it is null.

    Every value comes back as struct<value, at>.
    """
    early = inclusive != backwards
    names = list(values)
    here = left.select(
        *keys,
        (F.col(left_at) * 2 + (1 if early else 0)).cast("bigint").alias("__at"),
        F.struct(*[F.col(c) for c in left.columns]).alias("__left"),
    )
    there = right.select(
        *keys,
        (F.col(right_at) * 2 + (0 if early else 1)).cast("bigint").alias("__at"),
        *[F.when(v.isNotNull(), F.struct(v.alias("value"), F.col(right_at).alias("at"))).alias(n) for n, v in values.items()],
    )
    united = here.unionByName(there, allowMissingColumns=True)
    carried = carry(
        united, keys, "__at", {f"__c_{n}": F.col(n) for n in names}, backwards=backwards, span=2 * span
    ).where(F.col("__left").isNotNull())
    return carried.select("__left.*", *[F.col(f"__c_{n}").alias(n) for n in names])


def lookup(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread: str,
    *,
    how: str = "left",
    salts: int = SALTS,
    null_safe: bool = False,
    weight: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Shuffle join of rows to facts by key that spreads every hot key over `salts` tasks.

    Keys with at least `hot_rows` rows are counted (or read off `weight`, a column of `small`),
    and only their facts are repeated per salt. At most rows / hot_rows keys can be hot, which
    bounds the broadcast list of them. `spread` is a column of `big` that varies within a key.
    """
    counted = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")) if weight is None else small.withColumn("__n", F.col(weight))
    hot = counted.where(F.col("__n") >= hot_rows).select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.lit(True).alias("__hot"))

    def marked(df: DataFrame) -> DataFrame:
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__h_{k}")) for k in keys])
        return df.join(F.broadcast(hot), same, "left").drop(*[f"__h_{k}" for k in keys])

    salt = F.pmod(F.xxhash64(F.col(spread)), F.lit(salts)).cast("int")
    left = marked(big).withColumn("__salt", F.when(F.col("__hot"), salt).otherwise(0)).drop("__hot")
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = marked(small).select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], *[F.col(c) for c in small.columns if c not in keys], F.explode(every).alias("__k_salt")
    )
    match = F.col("__salt") == F.col("__k_salt")
    for k in keys:
        pair = F.col(f"__k_{k}")
        match = match & (F.col(k).eqNullSafe(pair) if null_safe else F.col(k) == pair)
    return left.join(right, match, how).drop("__salt", "__k_salt", *[f"__k_{k}" for k in keys])


def row_index(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str = "idx") -> DataFrame:
    """Number the rows of each key from 0 along `order`.

    `bucket` is a coarse, order-preserving function of the leading sort column (a day, an hour):
    rows are numbered inside their bucket, starting at the size of the earlier buckets.
    """
    work = df.withColumn("__span", bucket).withColumn("__v_n", F.lit(1).cast("bigint"))
    sizes = work.groupBy(*keys, "__span").agg(F.sum("__v_n").alias("__v_n"))
    seeds = sizes.select(*keys, "__span", F.sum("__v_n").over(_over_earlier_spans(keys)).alias("__v_n"))
    united, window = _seeded(work, seeds, keys, ["n"], *order)
    numbered = united.withColumn("__l_n", F.sum("__v_n").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.where(F.col("__row") == 1).select(
        *[F.col(c) for c in df.columns], (F.col("__l_n") - 1).cast("bigint").alias(name)
    )


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float], *, accuracy: int = 10_000
) -> DataFrame:
    """Exact interpolated percentiles per key, without holding a key's values in one task.

    A bounded sketch brackets each wanted rank; values outside the bracket are folded onto its
    ends before they are counted, so the final exact percentile sees few distinct values. Keys
    smaller than the sketch's accuracy skip the folding.
    """
    names = list(fractions)
    margin = 3.0 / accuracy
    points = [q for n in names for q in (max(fractions[n] - margin, 0.0), min(fractions[n] + margin, 1.0))]
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__x"))
    counted = rows.groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__n"))
    brackets = rows.groupBy(*keys).agg(
        F.percentile_approx("__x", points, accuracy).alias("__ends"), F.count(F.lit(1)).alias("__size")
    )
    folded = lookup(counted, brackets, keys, "__x", how="inner", null_safe=True, weight="__size")
    low = F.element_at("__ends", F.col("__which") * 2 + 1)
    high = F.element_at("__ends", F.col("__which") * 2 + 2)
    folded = folded.withColumn("__which", F.explode(F.array(*[F.lit(i) for i in range(len(names))])))
    clamped = F.when(F.col("__size") <= accuracy, F.col("__x")).otherwise(F.least(F.greatest(F.col("__x"), low), high))
    folded = folded.groupBy(*keys, "__which", clamped.alias("__c")).agg(F.sum("__n").alias("__n"))
    result = folded.groupBy(*keys).agg(
        *[
            F.expr(
                f"percentile(CASE WHEN __which = {i} THEN __c END, {fractions[n]!r}D, CASE WHEN __which = {i} THEN __n ELSE 0 END)"
            ).alias(n)
            for i, n in enumerate(names)
        ]
    )
    return result


def spread_levels(edges: DataFrame, start: DataFrame, step) -> DataFrame:
    """Union of `start` and repeated `step(frontier, edges)` until a level is empty, however deep that is.

    Each level is checkpointed; the driver only learns whether another level is needed.
    """
    edges = cut_lineage(edges)
    frontier = cut_lineage(start)
    levels = [frontier]
    while not (frontier := cut_lineage(step(frontier, edges))).isEmpty():
        levels.append(frontier)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out
