"""Median slope of long series, exactly, by counting inversions.

A slope between two points is at most c where the later point of y - c x does not lie above the earlier one: slopes are
inversions of the order of y - c x against the order of x. So the rank of a slope is found without looking at pairs:

1. Points of a series are packed in blocks of consecutive x. For each pivot slope a block sorts its points into value
   ranges (cuts from a sample of the series). Inversions across blocks and ranges are products of counts, those across
   ranges inside a block and those inside a range are counted by merging. All pivots of a round share one pass.
2. Pivots are slopes of sampled pairs inside the bracket left by the last round, so a rank can end on one exactly; where
   the sample holds none, the bracket is halved in the order of doubles.
3. Once a bracket holds at most `most` slopes, and no more than a few a point, they are listed: the orders at its two ends
   differ in exactly these pairs, a point has to look at no more positions than it moves, and all moves together are at most
   twice the pairs. This is an equality join on positions; both sides are shuffled, since the planner does not see how many
   positions a small table of points lists.

A series of one block with at most `most` pairs needs none of this: its slopes are computed where its block is.

Counts of y - c x are taken in doubled precision at half a unit in the last place beside the pivot, so `at most c` means
what it means for slopes rounded to doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.operators.ordered import lookup
from loomtrace.session import cut_lineage

KEYS = ["project", "series"]
MOST = 1 << 21  # slopes of a bracket that are listed
LISTED = 4  # slopes of a bracket that are listed, per point of its series
BLOCK = 100_000  # points of a block, and of a value range on average
SAMPLE = 2_000  # points whose pairs give pivots
PIVOTS = (-0.2, -0.04, 0.0, 0.04, 0.2)  # places around the wanted rank, as shares of the bracket
SPLIT = float((1 << 27) + 1)


def _two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = a + b
    v = s - a
    return s, (a - (s - v)) + (b - v)


def _product_rest(a: float, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """a * b - p exactly, for p = a * b rounded."""
    t = SPLIT * a
    a1 = t - (t - a)
    t = SPLIT * b
    b1 = t - (t - b)
    return ((a1 * b1 - p) + a1 * (b - b1) + (a - a1) * b1) + (a - a1) * (b - b1)


def order_at(x: np.ndarray, y: np.ndarray, slope: float, upto: bool) -> tuple[np.ndarray, np.ndarray]:
    """y - c x as two doubles, for c half a unit above the slope (upto) or below it."""
    half = max(np.spacing(abs(slope)) / 2, 5e-324)
    product = slope * x
    value, rest = _two_sum(y, -product)
    rest = rest - _product_rest(slope, x, product) - (half if upto else -half) * x
    return _two_sum(value, rest)


def sorted_places(x: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Places by value; of equal values the later point comes first, since equal counts as `at most`."""
    return np.lexsort((-x, low, high))


def inversions(ranks: np.ndarray) -> int:
    """Pairs i < j with ranks[j] < ranks[i], by merging runs of doubling length; equal ranks do not count."""
    n = len(ranks)
    if n < 2:
        return 0
    step = int(ranks.max()) + 1
    size, total, run = 1, 0, ranks.astype(np.int64)
    place = np.arange(n)
    while size < n:
        pair = place // (2 * size)
        left = place // size % 2 == 0
        key = run + pair * step  # runs are sorted, so the left halves are too, one after another
        mine, other = key[left], key[~left]
        upto = np.searchsorted(mine, other, side="right")
        ends = np.minimum((pair[~left] + 1) * size, len(mine))  # every pair but the last has a whole left half
        total += int((ends - upto).sum())
        merged = np.empty(n, np.int64)
        merged[np.arange(len(other)) + upto] = run[~left]
        rest = np.ones(n, bool)
        rest[np.arange(len(other)) + upto] = False
        merged[rest] = run[left]
        run, size = merged, 2 * size
    return total


def _labels(x: np.ndarray, high: np.ndarray, low: np.ndarray, ends: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Value range of each point; ranges start at the sampled points `ends`."""
    n, m = len(x), len(ends[0])
    if not m:
        return np.zeros(n, np.int64)
    both = [np.concatenate(z) for z in zip((x, high, low), ends)]
    order = np.lexsort((np.arange(n + m) < n, -both[0], both[2], both[1]))
    label = np.empty(n + m, np.int64)
    label[order] = np.cumsum(order >= n)
    return label[:n]


def _ends(sample_x: np.ndarray, sample_y: np.ndarray, ranges: int, slope: float, upto: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if ranges < 2 or not len(sample_x):
        return (np.empty(0),) * 3
    high, low = order_at(sample_x, sample_y, slope, upto)
    order = sorted_places(sample_x, high, low)
    chosen = order[np.unique(np.arange(1, ranges) * len(order) // ranges)]
    return sample_x[chosen], high[chosen], low[chosen]


SPREAD = "project string, series string, slope double, upto boolean, block bigint, range bigint, n bigint, inner bigint, points binary"


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per order asked for and value range of one block: its points by x, and the block's inversions across ranges."""
    for batch in batches:
        for row in range(len(batch)):
            get = lambda c: batch[c][row]  # noqa: B023, E731
            x, y = (get("points").values.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("idx", "y"))
            sample = [get("sample").values.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("idx", "y")]
            ranges = get("ranges").as_py()
            for asked in get("asked").as_py():
                slope, upto = asked["slope"], asked["upto"]
                high, low = order_at(x, y, slope, upto)
                label = _labels(x, high, low, _ends(*sample, ranges, slope, upto))
                inner = inversions(label) if ranges > 1 else 0
                order = np.argsort(label, kind="stable")
                edges = np.searchsorted(label[order], np.arange(ranges + 1))
                packed = [np.stack([z[order[a:b]] for z in (x, y, high, low)]).tobytes() for a, b in zip(edges, edges[1:])]
                same = lambda value, kind: pa.array([value] * ranges, kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        same(get("project").as_py(), pa.string()), same(get("series").as_py(), pa.string()), same(slope, pa.float64()), same(upto, pa.bool_()),
                        same(get("block").as_py(), pa.int64()), pa.array(range(ranges), pa.int64()), pa.array(np.diff(edges)),
                        pa.array([inner] + [0] * (ranges - 1), pa.int64()), pa.array(packed, pa.binary()),
                    ],
                    ["project", "series", "slope", "upto", "block", "range", "n", "inner", "points"],
                )


ORDER = ["slope", "upto"]


def _unpacked(part: pa.Table) -> np.ndarray:
    part = part.sort_by("block")
    return np.concatenate([np.frombuffer(p.as_buffer(), float).reshape(4, -1) for p in part["points"]], axis=1)


def _range_inversions(part: pa.Table) -> pa.Table:
    x, _, high, low = _unpacked(part)
    ranks = np.empty(len(x), np.int64)
    ranks[sorted_places(x, high, low)] = np.arange(len(x))
    first = part.select([*KEYS, *ORDER]).slice(0, 1)
    return first.append_column("inside", pa.array([inversions(ranks)], pa.int64()))


def _range_ranks(part: pa.Table) -> pa.Table:
    x, y, high, low = _unpacked(part)
    order = sorted_places(x, high, low)
    n = len(x)
    first = part.select([*KEYS, *ORDER, "range"]).take(pa.array(np.zeros(n, np.int64)))
    return first.append_column("x", pa.array(x[order])).append_column("y", pa.array(y[order])).append_column("local", pa.array(np.arange(n)))


def _dealt(blocks: DataFrame) -> DataFrame:
    """Blocks over all shuffle partitions, however few bytes they hold: what is done with a block costs more than moving it."""
    return blocks.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEYS, "block")


def _asked_of_blocks(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """Blocks of the series in asked(project, series, n, sample, ranges, asked), spread over value ranges; a table."""
    met = lookup(blocks, asked, KEYS, "block", how="inner", weight="n_blocks")
    return cut_lineage(_dealt(met.select(*KEYS, "block", "points", "sample", "ranges", "asked")).mapInArrow(_spread, SPREAD))


def _short_medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Median slope of series of one block with few pairs: a row per series in, one out."""
    for batch in batches:
        medians = []
        for points in batch["points"]:
            x, y = (points.values.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("idx", "y"))
            i, j = np.triu_indices(len(x), 1)
            slopes = (y[j] - y[i]) / (x[j] - x[i])
            middle = [(len(slopes) - 1) // 2, len(slopes) // 2]
            first, last = np.partition(slopes, middle)[middle]
            medians.append((first + last) / 2)
        yield pa.RecordBatch.from_arrays([batch["project"], batch["series"], pa.array(medians, pa.float64())], [*KEYS, "slope"])


def _counts(spread: DataFrame) -> DataFrame:
    """(project, series, slope, upto, count): slopes at most (below) each pivot."""
    cells = spread.select(*KEYS, *ORDER, "block", "range", "n", "inner")
    lower = Window.partitionBy(*KEYS, *ORDER, "block").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*KEYS, *ORDER, "range").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("lower", F.coalesce(F.sum("n").over(lower), F.lit(0)))
    cells = cells.withColumn("across", F.col("n") * F.coalesce(F.sum("lower").over(later), F.lit(0)))
    across = cells.groupBy(*KEYS, *ORDER).agg((F.sum("across") + F.sum("inner")).alias("part"))
    inside = spread.where("n > 0").groupBy(*KEYS, *ORDER, "range").applyInArrow(
        _range_inversions, "project string, series string, slope double, upto boolean, inside bigint"
    )
    inside = inside.groupBy(*KEYS, *ORDER).agg(F.sum("inside").alias("part"))
    return across.unionByName(inside).groupBy(*KEYS, *ORDER).agg(F.sum("part").alias("count"))


def _ordinal(value: float) -> int:
    """Doubles as integers in the same order."""
    bits = int(np.float64(value).view(np.int64))
    return bits if bits >= 0 else -(bits & (2**63 - 1))


def _double(ordinal: int) -> float:
    return float(np.int64(ordinal).view(np.float64)) if ordinal >= 0 else -float(np.int64(-ordinal).view(np.float64))


def pivots_of(x: np.ndarray, y: np.ndarray, low: float, high: float, share: float) -> list[float]:
    """Slopes of sampled pairs strictly inside the bracket, around the share of it that is wanted."""
    found = []
    for i in range(len(x) - 1):
        slopes = (y[i + 1 :] - y[i]) / (x[i + 1 :] - x[i])
        found.append(slopes[(slopes > low) & (slopes < high)])
    inside = np.sort(np.concatenate(found)) if found else np.empty(0)
    if len(inside):
        places = np.clip(((share + np.array(PIVOTS)) * len(inside)).astype(int), 0, len(inside) - 1)
        return sorted(set(inside[places].tolist()))
    a, b = _ordinal(low), _ordinal(high)
    return sorted({_double(a + (b - a) * t // 4) for t in (1, 2, 3)} - {low, high})


ROUND = "project string, series string, n bigint, n_blocks bigint, ranges int, sample array<struct<idx: bigint, y: double>>, asked array<struct<slope: double, upto: boolean>>"


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pivots of the next round of each series: a row per series in, one out."""
    kind = pa.list_(pa.struct([("slope", pa.float64()), ("upto", pa.bool_())]))
    for batch in batches:
        asked = []
        for row in batch.select(["sample", "low", "high", "below", "under", "first", "last"]).to_pylist():
            x, y = (np.array([p[c] for p in row["sample"]], float) for c in ("idx", "y"))
            share = ((row["first"] + row["last"]) / 2 - row["below"]) / (row["under"] - row["below"])
            asked.append([{"slope": p, "upto": u} for p in pivots_of(x, y, row["low"], row["high"], share) for u in (False, True)])
        kept = batch.select([*KEYS, "n", "n_blocks", "ranges", "sample"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(asked, kind)], [*kept.schema.names, "asked"])


def _narrowed(state: DataFrame, counts: DataFrame) -> DataFrame:
    """Brackets after a round. A rank between the counts below and up to a pivot is that pivot."""
    by_pivot = counts.groupBy(*KEYS, "slope").agg(
        F.max(F.when(~F.col("upto"), F.col("count"))).alias("less"), F.max(F.when(F.col("upto"), F.col("count"))).alias("most")
    )
    pivots = by_pivot.groupBy(*KEYS).agg(F.collect_list(F.struct("slope", "less", "most")).alias("pivots"))  # five a series
    met = state.join(pivots, KEYS, "left")

    def hit(rank: str):
        return F.get(F.filter("pivots", lambda p: (p["less"] < F.col(rank)) & (p["most"] >= F.col(rank))), F.lit(0))["slope"]

    met = met.withColumn("first_value", F.coalesce("first_value", hit("first"))).withColumn("last_value", F.coalesce("last_value", hit("last")))
    # ranks still open; one that is settled follows the other
    open_first = F.when(F.col("first_value").isNull(), F.col("first")).otherwise(F.col("last"))
    open_last = F.when(F.col("last_value").isNull(), F.col("last")).otherwise(F.col("first"))
    met = met.withColumn("open_first", open_first).withColumn("open_last", open_last)
    under = F.array_max(F.filter("pivots", lambda p: p["most"] < F.col("open_first")))  # the largest slope comes last
    over = F.array_min(F.filter("pivots", lambda p: p["less"] >= F.col("open_last")))
    met = met.withColumn("under_pivot", under).withColumn("over_pivot", over)
    return met.select(
        *[c for c in state.columns if c not in ("low", "high", "below", "under")],
        F.coalesce("under_pivot.slope", "low").alias("low"), F.coalesce("under_pivot.most", "below").alias("below"),
        F.coalesce("over_pivot.slope", "high").alias("high"), F.coalesce("over_pivot.less", "under").alias("under"),
    )


def _listed(blocks: DataFrame, state: DataFrame) -> DataFrame:
    """(project, series, slope, place): the slopes strictly inside each series' bracket, ranked among all of the series."""
    ends = F.array(F.struct(F.col("low").alias("slope"), F.lit(True).alias("upto")), F.struct(F.col("high").alias("slope"), F.lit(False).alias("upto")))
    spread = _asked_of_blocks(blocks, state.select(*KEYS, "n", "n_blocks", "ranges", "sample", ends.alias("asked")))
    ranked = spread.where("n > 0").groupBy(*KEYS, *ORDER, "range").applyInArrow(
        _range_ranks, "project string, series string, slope double, upto boolean, range bigint, x double, y double, local bigint"
    )
    sizes = spread.groupBy(*KEYS, *ORDER, "range").agg(F.sum("n").alias("size"))
    before = Window.partitionBy(*KEYS, *ORDER).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*KEYS, *ORDER, "range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    placed = ranked.join(starts, [*KEYS, *ORDER, "range"]).withColumn("place", F.col("local") + F.col("start"))
    at_low = placed.where("upto").select(*KEYS, "x", "y", F.col("place").alias("p"))
    at_high = placed.where("NOT upto").select(*KEYS, "x", F.col("place").alias("q"))
    points = cut_lineage(at_low.join(at_high, [*KEYS, "x"]))

    other = points.select(*KEYS, *[F.col(c).alias(f"other_{c}") for c in ("x", "y", "p", "q")])
    up = points.where("q > p").withColumn("at", F.explode(F.sequence(F.col("p") + 1, F.col("q"))))
    met_up = up.join(other.withColumn("at", F.col("other_p")).hint("merge"), [*KEYS, "at"]).where("other_q < q")
    down = points.where("q < p").withColumn("at", F.explode(F.sequence(F.col("q"), F.col("p") - 1)))
    met_down = down.join(other.withColumn("at", F.col("other_q")).hint("merge"), [*KEYS, "at"]).where("other_p < p AND p > other_q AND other_q > q")
    slope = ((F.col("other_y") - F.col("y")) / (F.col("other_x") - F.col("x"))).alias("slope")
    slopes = met_up.select(*KEYS, slope).unionByName(met_down.select(*KEYS, slope))
    # at most MOST slopes a series
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy("slope"))
    within = slopes.select(*KEYS, "slope", place.alias("within"))
    met = within.join(state.select(*KEYS, "below", "first", "last"), KEYS)
    at = F.col("within") + F.col("below")
    return met.where((at == F.col("first")) | (at == F.col("last"))).select(*KEYS, "slope", at.alias("place"))


def median_slopes(points: DataFrame, most: int = MOST, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(project, series, slope): the median of the slopes between all points(project, series, idx, y) of each series.

    idx is an integer, unique in its series; y is finite. The median of an even number of slopes is the mean of the two
    middle ones. Series of fewer than two points have no row. Keys match by equality, so null keys have no row.
    """
    known = cut_lineage(points.where(F.col("y").isNotNull()).select(*KEYS, F.col("idx").cast("bigint").alias("idx"), F.col("y").cast("double").alias("y")))
    sizes = known.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), (F.max("y") - F.min("y")).alias("width")).where("n > 1")
    pairs = F.expr("n * (n - 1) div 2")
    state = sizes.select(
        *KEYS, "n", F.expr("width * (1 + 1e-15D) + 1e-300D").alias("high"), pairs.alias("under"),
        F.expr("(n * (n - 1) div 2 - 1) div 2 + 1").alias("first"), F.expr("(n * (n - 1) div 2) div 2 + 1").alias("last"),
        F.ceil(F.col("n") / block).cast("int").alias("ranges"),
    )
    every = F.greatest(F.lit(1), F.floor(F.col("n") / sample))
    sampled = lookup(known, sizes, KEYS, "idx", how="inner", weight="n").where(F.pmod(F.xxhash64("idx"), every) == 0)
    samples = sampled.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("idx", "y"))).alias("sample"))
    grouped = known.groupBy(*KEYS, F.floor(F.col("idx") / block).alias("block"))
    blocks = cut_lineage(grouped.agg(F.sort_array(F.collect_list(F.struct("idx", "y"))).alias("points")))
    # few pairs, all in one block
    short = blocks.withColumn("n", F.size("points").cast("bigint")).join(sizes.select(*KEYS, "n"), [*KEYS, "n"]).where(pairs <= most)
    short = cut_lineage(_dealt(short.select(*KEYS, "block", "points")).mapInArrow(_short_medians, "project string, series string, slope double"))
    held = blocks.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_blocks"))
    state = state.join(held, KEYS).where((F.col("n_blocks") > 1) | (pairs > most)).join(samples, KEYS, "left").select(
        "*", (-F.col("high")).alias("low"), F.lit(0).cast("bigint").alias("below"),
        F.lit(None).cast("double").alias("first_value"), F.lit(None).cast("double").alias("last_value"),
    )
    state = cut_lineage(state.withColumn("sample", F.coalesce("sample", F.array().cast("array<struct<idx: bigint, y: double>>"))))
    unsettled = F.col("first_value").isNull() | F.col("last_value").isNull()
    wide = unsettled & (F.col("under") - F.col("below") > F.least(F.lit(most), LISTED * F.col("n")))
    done = state.where(~wide)
    rest = state.where(wide)
    while not rest.isEmpty():
        asked = rest.mapInArrow(_ask, ROUND)
        state = cut_lineage(_narrowed(rest, _counts(_asked_of_blocks(blocks, asked))))
        done = done.unionByName(state.where(~wide))
        rest = state.where(wide)
    listed = _listed(blocks, done.where(unsettled))
    values = listed.groupBy(*KEYS).agg(F.collect_list(F.struct("place", "slope")).alias("found"))  # two a series
    met = done.join(values, KEYS, "left")

    def value(name: str):
        at = F.get(F.filter("found", lambda p: p["place"] == F.col(name)), F.lit(0))["slope"]
        return F.coalesce(f"{name}_value", at)

    return short.unionByName(met.select(*KEYS, ((value("first") + value("last")) / 2).alias("slope")))
