"""Order-dependent helpers against brute force, with spans far smaller than the data."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.operators import ordered as R
from loomtrace.operators import series as S


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    # One key holds most rows, one key is null.
    data = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.choice([None, None, rng.randint(0, 9)])) for i in range(1, 400)]
    return data, spark.createDataFrame(data, "k string, seq bigint, v bigint")


def brute(data, inclusive, backwards):
    out, last = {}, {}
    for k, seq, v in sorted(data, key=lambda r: r[1], reverse=backwards):
        if inclusive and v is not None:
            last[k] = v
        out[seq] = last.get(k)
        if v is not None:
            last[k] = v
    return out


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("backwards", [True, False])
def test_carry_crosses_spans(rows, inclusive, backwards):
    data, df = rows
    got = R.carry(df, ["k"], "seq", {"c": F.col("v")}, inclusive=inclusive, backwards=backwards, span=10)
    assert {r.seq: r.c for r in got.collect()} == brute(data, inclusive, backwards)


def test_running_total_and_row_index_cross_spans(rows):
    data, df = rows
    total = {r.seq: r.t for r in R.running_total(df, ["k"], "seq", {"t": F.col("v")}, span=10).collect()}
    index = {r.seq: r.idx for r in R.row_index(df, ["k"], F.floor(F.col("seq") / 10), [F.col("seq")]).collect()}
    sums, counts = {}, {}
    for k, seq, v in data:
        sums[k] = sums.get(k, 0) + (v or 0)
        counts[k] = counts.get(k, -1) + 1
        assert (total[seq], index[seq]) == (sums[k], counts[k])


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("backwards", [True, False])
def test_asof_finds_the_nearest_row(spark, inclusive, backwards):
    rng = random.Random(3)
    left = [(rng.choice("ab"), rng.randint(1, 60), i) for i in range(80)]
    right = [(k, at, at * 10) for k in "ab" for at in rng.sample(range(1, 60), 12)]
    got = R.asof(
        spark.createDataFrame(left, "k string, at bigint, id int"), spark.createDataFrame(right, "k string, rat bigint, x bigint"),
        ["k"], "at", "rat", ["x"], inclusive=inclusive, backwards=backwards, span=7,
    )
    found = {r.id: r.x for r in got.collect()}
    for k, at, i in left:
        side = [r for r in right if r[0] == k and ((r[1] == at and inclusive) or (r[1] > at if backwards else r[1] < at))]
        best = (min if backwards else max)(side, key=lambda r: r[1], default=None)
        assert found[i] == (best[2] if best else None)


@pytest.mark.parametrize("hot_rows", [20, 500, 10_000])
def test_lookup_keeps_hot_and_unmatched_rows(spark, hot_rows):
    big = spark.range(1000).select(F.when(F.col("id") < 900, "hot").when(F.col("id") < 950, "b").alias("k"), "id")
    small = spark.createDataFrame([("hot", 1), (None, 2)], "k string, x int")
    got = R.lookup(big, small, ["k"], "id", null_safe=True, hot_rows=hot_rows)
    assert {(r.k, r.x, r["count"]) for r in got.groupBy("k", "x").count().collect()} == {("hot", 1, 900), ("b", None, 50), (None, 2, 50)}


def test_exact_percentiles_bracket_large_groups(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(size=5000), np.zeros(700), rng.integers(0, 5, 900).astype(float)])
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 3.0), ("b", 4.0), ("b", None)], "k string, v double")
    wanted = {"q1": 0.25, "q2": 0.5, "q9": 0.93}
    got = {r.k: r for r in R.exact_percentiles(df, ["k"], "v", wanted, accuracy=100).collect()}
    for name, q in wanted.items():
        assert got["a"][name] == pytest.approx(np.quantile(values, q), abs=1e-12)
        assert got["b"][name] == pytest.approx(np.quantile([3.0, 4.0], q))


def points(spark, n, seed=5):
    rng = np.random.default_rng(seed)
    y = rng.normal(size=n).cumsum()
    rows = [("p", "s", i, None if i % 11 == 3 else float(v)) for i, v in enumerate(y)]
    return rows, spark.createDataFrame(rows, "project string, series string, idx bigint, processed double")


def test_moving_values_cross_chunks(spark):
    rows, df = points(spark, 60)
    got = {r.idx: r for r in S.moving_values(df, S.smoothing_window(df), chunk=7).collect()}
    assert len(got) == 60
    for _, _, i, v in rows:
        near = [r[3] for r in rows if abs(r[2] - i) <= 4 and r[3] is not None]
        assert got[i].moving_average == (None if v is None else pytest.approx(np.mean(near)))
        assert got[i].moving_median == (None if v is None else pytest.approx(np.median(near)))


@pytest.mark.parametrize("n", [60, 61])
def test_long_series_trend_equals_all_pairs(spark, n):
    rows, df = points(spark, n)
    known = [(r[2], r[3]) for r in rows if r[3] is not None]
    slopes = [(b[1] - a[1]) / (b[0] - a[0]) for i, a in enumerate(known) for b in known[i + 1 :]]
    got = S.theil_sen_slopes(df).first()
    assert got.slope == pytest.approx(np.median(slopes), abs=1e-9)
