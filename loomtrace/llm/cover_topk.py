"""Exact top-k by inner product: cover trees over blocks of queries and of candidates, searched together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.llm.common import cut

PIVOTS = 64  # rows whose neighbourhoods are the blocks; at most this many vectors reach the driver
SEEDS = 2048  # rows that give every query its first kth score; at most this many are broadcast
QUERY_ROWS, ROWS = 2048, 8192  # rows of a block, on average
LEAF, WIDE = 128, 32  # points a tree node keeps unsplit, and the most children of a node
LIMIT = 1 << 62
LEAST = -(2**63 - 1)  # no score yet; its negative is an integer too


class CoverTree:
    """Nested balls over points: each node has a centre among its points and the radius that covers them.

    A node's children are picked farthest first, so centres are apart by more than the radius they are split to (half the
    parent's, or as far as WIDE children reach), and every point goes to its nearest centre.
    """

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.center, self.radius, self.low, self.high, self.children = [], [], [], [], []
        self._build(points)
        self.center, self.radius = np.array(self.center), np.array(self.radius)
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.points = points[self.order]
        self.norm = np.sqrt((self.center**2).sum(axis=1))

    def _node(self, center: np.ndarray, radius: float, low: int, high: int) -> int:
        self.center.append(center)
        self.radius.append(radius * (1 + 1e-9))
        self.low.append(low)
        self.high.append(high)
        self.children.append([])
        return len(self.radius) - 1

    def _build(self, points: np.ndarray) -> None:
        away = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
        stack = [(self._node(points[0], float(away.max()), 0, len(points)), away)]
        while stack:
            node, nearest = stack.pop()
            low, high, radius = self.low[node], self.high[node], self.radius[node]
            if high - low <= LEAF or radius == 0:
                continue
            rows = self.order[low:high]
            own, mine, centers = points[rows], np.zeros(high - low, np.int64), [self.center[node]]
            while len(centers) < WIDE and nearest.max() > radius / 2:
                centers.append(own[int(nearest.argmax())])
                away = np.sqrt(((own - centers[-1]) ** 2).sum(axis=1))
                mine, nearest = np.where(away < nearest, len(centers) - 1, mine), np.minimum(nearest, away)
            by = np.argsort(mine, kind="stable")
            self.order[low:high], nearest = rows[by], nearest[by]
            ends = np.cumsum(np.bincount(mine, minlength=len(centers)))
            for i, center in enumerate(centers):
                begin, end = int(ends[i - 1]) if i else 0, int(ends[i])
                if begin == end or end - begin == high - low:  # nothing was split off
                    continue
                child = self._node(center, float(nearest[begin:end].max()), low + begin, low + end)
                self.children[node].append(child)
                stack.append((child, nearest[begin:end]))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point where that is exact."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k highest scores, ties to the smaller id, which may be the largest integer for a null."""
    by = np.lexsort((ids, -score), axis=-1)[:, :k]
    return np.take_along_axis(score, by, 1), np.take_along_axis(ids, by, 1)


def dual_search(queries: np.ndarray, floor: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids), k a query, padded with the least integer; scores under a query's floor may be missing.

    Pairs of nodes go on while the best inner product their balls allow reaches the worst kth score in the query node.
    """
    q, c = CoverTree(queries.astype(np.float64)), CoverTree(points.astype(np.float64))
    queries, worst = queries[q.order], floor[q.order].copy()
    points, ids = points[c.order], ids[c.order]
    top, named = np.full((len(queries), k), LEAST), np.full((len(queries), k), np.iinfo(np.int64).max)

    def bounds(qs, cs):
        return (
            q.center[qs] @ c.center[cs].T + q.radius[qs][:, None] * c.norm[cs] + q.norm[qs][:, None] * c.radius[cs] + q.radius[qs][:, None] * c.radius[cs]
        )

    slack = 1e-9 * float((q.norm[0] + q.radius[0]) * (c.norm[0] + c.radius[0])) + 1e-6
    stack = [(0, 0, float(bounds([0], [0])[0, 0]))]
    while stack:
        a, b, bound = stack.pop()
        low, high = q.low[a], q.high[a]
        if bound + slack < worst[low:high].min():
            continue
        split_q, split_c = q.children[a], c.children[b]
        if split_q and (not split_c or q.radius[a] >= c.radius[b]):
            reach = bounds(split_q, [b])[:, 0]
            stack.extend((x, b, float(r)) for x, r in zip(split_q, reach))
        elif split_c:
            reach = bounds([a], split_c)[0]
            by = np.argsort(reach)  # the most promising is taken first
            stack.extend((a, split_c[i], float(reach[i])) for i in by)
        else:
            own = ids[c.low[b] : c.high[b]]
            found = scores(queries[low:high], points[c.low[b] : c.high[b]])
            rows = np.flatnonzero((found >= worst[low:high, None]).any(axis=1))
            if len(rows):
                at = rows + low
                merged = np.concatenate((top[at], found[rows]), axis=1), np.concatenate((named[at], np.broadcast_to(own, (len(rows), len(own)))), axis=1)
                top[at], named[at] = best(*merged, k)
                worst[at] = np.maximum(worst[at], top[at][:, -1])
    back = np.argsort(q.order)
    return top[back], named[back]


def whole_numbers(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, vector): floor(scale * x) as packed 64-bit integers; rows with a null or non-finite component are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for x in batch["vector"]:
                v = np.clip(np.floor(scale * x.values.to_numpy(zero_copy_only=False)), -LIMIT, LIMIT)
                packed.append(v.astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(packed, pa.binary())], ["vec_id", "vector"])

    wide = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return wide.filter(F.col("vector").isNotNull() & ~bad & (F.size("vector") > 0)).mapInArrow(run, "vec_id bigint, vector binary")


def _placed(rows: DataFrame, sample: list[bytes], size: int, name: str) -> DataFrame:
    """Blocks of rows near one pivot, of about `size` rows: (<name>, dim, <name>_members)."""
    pivots = sample[: min(PIVOTS, -(-rows.count() // size))]
    by_dim = {}
    for p in pivots:
        by_dim.setdefault(len(p), []).append(np.frombuffer(p, np.int64).astype(np.float64))

    def run(batches):
        for batch in batches:
            near = []
            for x in batch["vector"]:
                raw = x.as_buffer()
                own = by_dim.get(len(raw))
                near.append(0 if own is None else int(((np.array(own) - np.frombuffer(raw, np.int64)) ** 2).sum(axis=1).argmin()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int64())], [*batch.schema.names, "near"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    near = rows.mapInArrow(run, f"{kinds}, near bigint").withColumn("dim", F.length("vector"))
    sizes = near.groupBy("dim", "near").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
    part = F.pmod(F.xxhash64("vec_id", "vector"), F.col("parts"))
    members = F.struct(*[F.col(c) for c in rows.columns])
    blocks = near.join(sizes, ["dim", "near"]).groupBy("dim", "near", part.alias("part")).agg(F.collect_list(members).alias(f"{name}_members"))
    return cut(blocks.select(F.concat_ws(".", "dim", "near", "part").alias(name), "dim", f"{name}_members"))


def top_k(vectors: DataFrame, k: int = 10, scale: int = 1024, every: int = 100) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each row whose vec_id is divisible by `every`, its k best other rows.

    Components become floor(scale * x), scores are integer inner products, ties go to the smaller vec_id, nulls last.
    Vectors that are null, empty, or hold null or non-finite components take no part; vectors of different lengths are
    not compared. A repeated row is another row, so it finds its copies (and one list stands for equal queries). Other
    columns are ignored.

    Rows are grouped around pivots and cut into blocks of bounded size; every block of queries meets every block of
    candidates, pair by pair in a task of its own, and leaves k + 1 rows a query. The scores of a bounded set of rows give
    each query a kth score to start from, so most pairs end at their roots.
    """
    rows = cut(whole_numbers(vectors, scale))
    sample = [(r[0], bytes(r[1])) for r in rows.orderBy(F.xxhash64("vec_id", "vector")).limit(SEEDS).collect()]
    seeds = {}
    for _, raw in sample:
        seeds.setdefault(len(raw), []).append(np.frombuffer(raw, np.int64))
    seeds = rows.sparkSession.sparkContext.broadcast({d: np.array(v) for d, v in seeds.items()})

    def floors(batches):
        for batch in batches:
            out = []
            for x in batch["vector"]:
                raw = x.as_buffer()
                own = seeds.value.get(len(raw))
                found = np.sort(scores(np.frombuffer(raw, np.int64)[None, :], own)[0])[::-1] if own is not None else []
                # one of the seeds may be the query itself
                out.append(int(found[k]) if len(found) > k else LEAST)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], ["vec_id", "vector", "floor"])

    asked = rows.filter(F.col("vec_id") % every == 0).distinct().mapInArrow(floors, "vec_id bigint, vector binary, floor bigint")
    vectors_seen = [raw for _, raw in sample]
    query_blocks = _placed(cut(asked), vectors_seen, QUERY_ROWS, "query")
    blocks = _placed(rows, vectors_seen, ROWS, "block")

    def search(batches):
        for batch in batches:
            for asked, members in zip(batch["query_members"], batch["block_members"]):
                asked, members = asked.values.flatten(), members.values.flatten()
                (q_id, q_raw, floor), (c_id, c_raw) = asked, members
                q = np.frombuffer(b"".join(q_raw.to_pylist()), np.int64).reshape(len(q_raw), -1)
                c = np.frombuffer(b"".join(c_raw.to_pylist()), np.int64).reshape(len(c_raw), -1)
                ids = c_id.fill_null(np.iinfo(np.int64).max).to_numpy()
                top, named = dual_search(q, floor.to_numpy(), c, ids, k + 1)
                here = set(zip(c_id.to_pylist(), c_raw.to_pylist()))
                for i, own in enumerate(zip(q_id.to_pylist(), q_raw.to_pylist())):
                    if own in here:  # the query is one of the candidates: one row with its id and product goes
                        at = np.flatnonzero((named[i] == own[0]) & (top[i] == scores(q[i : i + 1], q[i : i + 1])[0, 0]))[:1]
                        top[i, at] = LEAST
                real = top > LEAST
                at = pa.array(np.repeat(np.arange(len(q)), real.sum(axis=1)))
                named = pa.array(named[real], mask=named[real] == np.iinfo(np.int64).max)
                yield pa.RecordBatch.from_arrays([q_id.take(at), q_raw.take(at), named, pa.array(top[real])], ["query_id", "query", "vec_id", "score"])

    # every pair of blocks is named first, then each name fetches its members
    names = query_blocks.groupBy("dim").agg(F.collect_list("query").alias("queries"))
    pairs = blocks.select("block", "dim").join(names, "dim").select("block", F.explode("queries").alias("query"))
    pairs = pairs.join(query_blocks.drop("dim"), "query").join(blocks.drop("dim"), "block").select("query_members", "block_members")
    found = pairs.mapInArrow(search, "query_id bigint, query binary, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
