"""Betweenness from random paths against all shortest paths."""

import math

import pytest
from test_graph import brute_betweenness

import __spark_entry__ as entry
from weftgraph.operators import paths
from weftgraph.plans.fixture import Fixture


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "u long, v long")


def worst(got, want):
    n = len(want)
    assert got.keys() == want.keys()
    return max(abs(got[i] - want[i]) / (n * (n - 1) / 2) for i in want)


def test_bounds():
    assert paths.pairs_by_length(12, 0.01, 0.1) == math.ceil(5000 * (3 + 1 + math.log(10)))
    assert paths.pairs_by_length(2, 0.1, 0.1) == math.ceil(50 * (0 + 1 + math.log(10)))
    r = 5000
    assert paths.bernstein(0, r, 1000, 0.1) < paths.bernstein(50 * (r - 50), r, 1000, 0.1) < paths.bernstein(50 * (r - 50), r // 2, 1000, 0.1)
    assert paths.bernstein(0, 1, 10, 0.1) == 1


def test_grid(spark):
    """Many shortest paths a pair, of many lengths; a second part, a loop, a repeated edge, few pairs at a time."""
    grid = [(6 * i + j, 6 * i + j + d) for i in range(6) for j in range(6) for d in (1, 6) if (d == 6 and i < 5) or (d == 1 and j < 5)]
    pairs = [*grid, (0, 1), (1, 0), (7, 7), (100, 101), (101, 102), (200, 200)]
    got = {r.node: r.betweenness for r in paths.sampled_betweenness(frame(spark, pairs), 0.05, seed=1, pairs=700).collect()}
    assert worst(got, brute_betweenness(pairs)) < 0.05 / 2 and got[200] == got[100] == 0


def test_query(spark, small):
    """Within 0.01 of the exact values of the fixture graph; the same in every run."""
    pairs = [(r.u, r.v) for r in Fixture(spark, small).edges.collect()]
    got = {r.node: r.betweenness for r in entry.queries()["betweenness_sampled"](spark, small).collect()}
    want = brute_betweenness(pairs)
    assert worst(got, want) < 0.01
    top = sorted(want, key=want.get)[-20:]
    assert sum(got[i] for i in top) == pytest.approx(sum(want[i] for i in top), rel=0.1)


def test_small_graphs(spark):
    assert paths.sampled_betweenness(frame(spark, []), 0.1).count() == 0
    assert {r.betweenness for r in paths.sampled_betweenness(frame(spark, [(1, 2)]), 0.1).collect()} == {0.0}
    star = {r.node: r.betweenness for r in paths.sampled_betweenness(frame(spark, [(0, i) for i in range(1, 30)]), 0.1).collect()}
    assert abs(star[0] / 435 - 28 / 30) < 0.1 and {v for k, v in star.items() if k} == {0.0}


def test_longest_path(spark):
    assert paths.longest_path(frame(spark, [(i, i + 1) for i in range(8)] + [(50, 51)])) == (9, 17)
    low, high = paths.longest_path(frame(spark, [(0, i) for i in range(1, 9)]))
    assert low == 3 and high in (3, 5)
    assert paths.longest_path(frame(spark, [])) == (0, 0)
