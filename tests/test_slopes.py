"""Median slopes by inversion counting against all pairs."""

import random

import numpy as np
import pytest

from loomtrace.operators import slopes


def brute(points):
    x, y = (np.array(z, float) for z in zip(*sorted(points)))
    i, j = np.triu_indices(len(x), 1)
    return float(np.median((y[j] - y[i]) / (x[j] - x[i])))


def test_inversions():
    draw = random.Random(1)
    for _ in range(300):
        ranks = [draw.randrange(draw.choice([2, 5, 60])) for _ in range(draw.randrange(70))]
        want = sum(ranks[j] < ranks[i] for i in range(len(ranks)) for j in range(i + 1, len(ranks)))
        assert slopes.inversions(np.array(ranks, np.int64)) == want


@pytest.mark.parametrize("c", [0.0, 1 / 3, 2.0, -0.1, 7e-9])
@pytest.mark.parametrize("upto", [True, False])
def test_order_counts_rounded_slopes(c, upto):
    draw = np.random.default_rng(3)
    x, y = np.arange(300.0), draw.integers(-4, 5, 300).astype(float) + np.round(c * np.arange(300))
    order = slopes.sorted_places(x, *slopes.order_at(x, y, c, upto))
    ranks = np.empty(300, np.int64)
    ranks[order] = np.arange(300)
    i, j = np.triu_indices(300, 1)
    real = (y[j] - y[i]) / (x[j] - x[i])
    assert slopes.inversions(ranks) == (real <= c if upto else real < c).sum()


SERIES = {
    "walk": lambda r, n: np.cumsum(r.normal(size=n)),
    "counts": lambda r, n: r.integers(0, 4, n).astype(float),
    "flat": lambda r, n: np.full(n, 7.0),
    "line": lambda r, n: np.arange(n) / 3,
    "steps": lambda r, n: np.floor(np.arange(n) / 10) * 5,
    "fall": lambda r, n: -1e9 * np.arange(n) + r.integers(0, 10**9, n),
    "spikes": lambda r, n: np.where(r.random(n) < 0.02, 1e12, r.random(n)),
    "tiny": lambda r, n: r.random(n) * 1e-200,
}


def frame(spark, series):
    rows = [("p", s, int(i), float(v)) for s, points in series.items() for i, v in points]
    return spark.createDataFrame(rows + [("p", "lone", 3, 1.0), ("p", "walk", 10**6, None)], "project string, series string, idx bigint, y double")


@pytest.mark.parametrize("most,block,sample", [(300, 37, 20), (1 << 21, 100_000, 2_000)])
def test_all_kinds_of_series(spark, most, block, sample):
    r = np.random.default_rng(11)
    series = {}
    for k, (name, make) in enumerate(SERIES.items()):
        n = 150 + k
        at = np.sort(r.choice(3 * n, n, replace=False))
        series[name] = list(zip(at.tolist(), make(r, n).tolist()))
    series["two"] = [(4, 1.0), (9, 3.0)]
    series["three"] = [(0, 1.0), (1, 5.0), (5, 0.0)]
    got = {x.series: x.slope for x in slopes.median_slopes(frame(spark, series), most, block, sample).collect()}
    assert got == {s: brute(p) for s, p in series.items()}


def test_two_thousand_points_in_blocks(spark):
    r = np.random.default_rng(5)
    series = {"walk": list(enumerate(np.cumsum(r.normal(size=2001)).tolist())), "counts": list(enumerate(r.integers(0, 50, 2000).astype(float).tolist()))}
    got = {x.series: x.slope for x in slopes.median_slopes(frame(spark, series), 5_000, 300, 200).collect()}
    assert got == {s: brute(p) for s, p in series.items()}


def test_no_points(spark):
    assert slopes.median_slopes(frame(spark, {}).limit(0)).collect() == []


def test_pivots_without_sampled_pairs_halve_the_bracket():
    low, high, rounds = -1.0, 1e300, 0
    while np.nextafter(low, np.inf) < high and rounds < 60:
        pivots = slopes.pivots_of(np.empty(0), np.empty(0), low, high, 0.5)
        assert all(low < p < high for p in pivots)
        below = [p for p in pivots if p < 1e-9]
        low, high, rounds = max([low, *below]), min([high, *[p for p in pivots if p >= 1e-9]]), rounds + 1
    assert rounds < 40


def test_listed_positions_are_never_broadcast(spark):
    r = np.random.default_rng(7)
    found = slopes.median_slopes(frame(spark, {"walk": list(enumerate(np.cumsum(r.normal(size=400)).tolist()))}), 5_000, 100, 50)
    joins = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    at = [line for line in joins if " at#" in line]
    assert at and all("SortMergeJoin" in line for line in at)


def test_bracket_is_listed_at_a_few_slopes_a_point(spark, monkeypatch):
    r = np.random.default_rng(9)
    asked = []
    real = slopes._listed
    monkeypatch.setattr(slopes, "_listed", lambda blocks, state: asked.extend(state.collect()) or real(blocks, state))
    points = list(enumerate(r.normal(size=600).tolist()))
    got = slopes.median_slopes(frame(spark, {"noise": points}), 100_000, 200, 100).collect()
    assert [x.slope for x in got if x.series == "noise"] == [brute(points)]
    assert all(s.under - s.below <= slopes.LISTED * s.n for s in asked)
