"""Draws that are counted side by side against plain Python, one digest at a time."""

import hashlib

import pyarrow as pa
import pytest

from weftgraph.functions.digests import Tails, heads
from weftgraph.operators import draws, ier
from weftgraph.plans.tables import written

TAUS = (0.0, 0.3)


def hexed(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


@pytest.mark.parametrize("texts", [["0", "7", "123456789012", "", "ä"], ["x" * 60, "1"]])
def test_heads(texts):
    for prefixes in ([b"42:perm:hv_s1:%d:" % i for i in (1, 5)], [b"abcd"]):
        want = [[hashlib.md5(p + t.encode()).hexdigest() for t in texts] for p in prefixes]
        assert heads(prefixes, Tails.of(pa.array(texts))).tolist() == [[int(h[:8], 16) for h in row] for row in want]
        assert heads(prefixes, Tails.of(pa.array(texts)), both=True).tolist() == [[int(h[:16], 16) for h in row] for row in want]
    assert heads([b"a:"], Tails.numbers(8, 1001)).tolist() == [[int(hashlib.md5(b"a:%d" % i).hexdigest()[:8], 16) for i in range(8, 1002)]]


@pytest.fixture(scope="module")
def ranked_sets(spark):
    """Sets, inter-degrees and quartiles of 300 nodes; set b is a whole bin and some nodes of another."""
    nodes = [(i, 1 + i % 7, f"Q{1 + i * i % 4}") for i in range(300)]
    sets = {"a": [i * 7 % 300 for i in range(60)], "b": [n for n, _, q in nodes if q == "Q2"] + [0, 2, 4]}
    inter = {(t, n): (n * (1 + 3 * k)) % (d + 1) for k, t in enumerate(TAUS) for n, d, _ in nodes}
    tables = (
        spark.createDataFrame([(s, n, p) for s, own in sets.items() for p, n in enumerate(own)], "strategy string, node long, place long"),
        spark.createDataFrame([(t, n, x) for (t, n), x in inter.items()], "tau double, node long, inter_deg long"),
        spark.createDataFrame(nodes, "node long, degree long, bin string"),
    )
    return nodes, sets, inter, [written(t, "t") for t in tables]


def ratios(inter, degree, tau, picked):
    x = [inter[tau, n] for n in picked]
    return sum(x) / sum(degree[n] for n in picked), sum(y / degree[n] for y, n in zip(x, picked, strict=True)) / len(picked)


def test_resampled_sets(monkeypatch, ranked_sets):
    monkeypatch.setattr(draws, "BLOCK", 16)
    nodes, sets, inter, tables = ranked_sets
    degree = {n: d for n, d, _ in nodes}
    table = draws.node_values(tables[2], tables[1], (), list(TAUS))
    got = {(r.tau, r.strategy, r.rep): r for r in draws.bootstrap_sums(tables[0], table, list(TAUS), 12, 42).collect()}
    assert len(got) == 2 * 2 * 12
    for (tau, strategy, rep), r in got.items():
        own = sets[strategy]
        picked = [own[int(hexed(42, "boot", strategy, rep, j)[:12], 16) % len(own)] for j in range(1, len(own) + 1)]
        assert (r.n, r.d, r.s) == (len(own), sum(degree[n] for n in picked), sum(inter[tau, n] for n in picked))
        assert r.s / r.d == pytest.approx(ratios(inter, degree, tau, picked)[0]) and r.r / r.n == pytest.approx(ratios(inter, degree, tau, picked)[1])


def test_often_drawn():
    import numpy as np

    for times in ([0, 3, 255], [1, 256, 70_000]):
        assert draws._unpacked(draws._packed(np.array(times, np.uint32))).tolist() == times


def test_no_row_for_each_draw(spark, ranked_sets):
    """Draws are counted, not made into rows that are sent to other tasks."""
    *_, tables = ranked_sets
    plan = ier.bootstrap(*tables, repeats=12)._jdf.queryExecution().toString()
    assert "md5" not in plan


@pytest.mark.parametrize("slack", [None, 0.5, 0.0])
def test_null_sets(ranked_sets, slack, monkeypatch):
    """With little slack, many repetitions' last nodes lie outside of the brackets and are drawn again."""
    nodes, sets, inter, tables = ranked_sets
    if slack is not None:
        monkeypatch.setattr(draws, "SLACK", slack)
    degree, where = {n: d for n, d, _ in nodes}, {n: q for n, _, q in nodes}
    got = {(r.tau, r.strategy, r.rep): r for r in ier.null_statistics(*tables, repeats=12).collect()}
    assert len(got) == 2 * 2 * 12
    for strategy, own in sets.items():
        for rep in range(1, 13):
            picked = []
            for q in ier.BINS:
                pool = sorted((n for n in where if where[n] == q), key=lambda n: (hexed(42, "perm", strategy, rep, n), n))
                picked += pool[: sum(where[n] == q for n in own)]
            for tau in TAUS:
                r = got[tau, strategy, rep]
                assert (r.stub, r.nm) == (pytest.approx(ratios(inter, degree, tau, picked)[0]), pytest.approx(ratios(inter, degree, tau, picked)[1]))


def test_few_nodes_are_sorted(spark, monkeypatch):
    """Of 20,000 nodes, only those around the last of the smallest are rows of a repetition."""
    kept = {}
    monkeypatch.setattr(draws, "written", lambda df, name: kept.setdefault(name, written(df, name)))
    quartiles = written(spark.range(20_000).selectExpr("id as node", "1 + id % 5 as degree", "'Q1' as bin"), "t")
    inter = quartiles.selectExpr("0.0D as tau", "node", "node % 2 as inter_deg")
    sets = quartiles.where("node < 2000").selectExpr("'a' as strategy", "node", "node as place")
    assert ier.null_statistics(sets, inter, quartiles, repeats=5).count() == 5
    assert 0 < kept["null-parts"].where("key is not null").count() < 5 * 20_000 / 20
    assert kept["missed"].isEmpty()


def test_inter_degrees_in_columns(spark):
    """Edges aren't multiplied by the taus."""
    edges = written(spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 3)], "u long, v long"), "t")
    members = written(spark.createDataFrame([(0, 1), (1, 1), (1, 2), (2, 3), (4, 1)], "node long, comm int"), "t")
    got = ier.inter_degrees(edges, members, edges.selectExpr("explode(array(u, v)) as node").distinct(), (0.0, 0.6))
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == [(0.0, 0, 1), (0.0, 1, 1), (0.0, 2, 2), (0.0, 3, 0), (0.6, 0, 2), (0.6, 1, 2), (0.6, 2, 2), (0.6, 3, 0)]
