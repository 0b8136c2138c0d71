"""Rows of published tables, tables of several datasets and tables that go on; small helpers of curves and readers."""

import duckdb
import pytest

import __spark_entry__ as entry
from weftgraph.operators import curves, published
from weftgraph.plans import oracle
from weftgraph.sources import text


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_resumed(spark):
    nodes = spark.createDataFrame([(1,), (2,), (2,)], "node long")
    new = spark.createDataFrame([(1, 0.5), (3, 0.7)], "node long, hv double")
    old = spark.createDataFrame([(1, 9.0, "a"), (4, 8.0, "b")], "node long, hv double, x string")
    assert {(r.node, r.hv) for r in published.resumed(nodes, None, new).collect()} == {(1, 0.5), (2, None)}
    assert {(r.node, r.x, r.hv) for r in published.resumed(nodes, old, new).collect()} == {(1, "a", 0.5), (4, "b", None)}


def test_memberships(spark):
    cover = spark.createDataFrame([(1, 7), (1, 7), (2, 8)], "node long, comm int")
    held = spark.createDataFrame([(1, [5, 6, 5]), (3, [])], "node long, comms array<int>")
    assert rows(published.memberships(cover, None), "node", "comm") == [(1, 7), (2, 8)]
    assert rows(published.memberships(cover, held), "node", "comm") == [(1, 5), (1, 6)]
    with pytest.raises(ValueError):
        published.memberships(None, None)


def test_all_datasets(spark):
    a = spark.createDataFrame([(1, 0.5)], "k int, x double")
    b = spark.createDataFrame([(2, "own"), (3, None)], "k int, dataset string")
    got = published.all_datasets({"a": a, "b": b})
    assert {(r.dataset, r.k, r.x) for r in got.collect()} == {("a", 1, 0.5), ("own", 2, None), ("b", 3, None)}
    with pytest.raises(ValueError):
        published.all_datasets({})


def test_curve_helpers(spark):
    h = spark.createDataFrame([(0.0, 1.0), (0.02, 0.8), (0.04, 0.5)], "p double, h_hat double")
    assert curves.h_hat_at(h, 0.03).first().h_hat_p0 == 0.8
    t = spark.createDataFrame([("GCC size", 0.1, 0.9), ("homophily", 0.1, 0.2)], "metric string, Fraction_Removed double, metric_value double")
    assert rows(curves.component_curve(t, "d"), "p", "rho_gcc", "dataset") == [(0.1, 0.9, "d")]
    d = spark.createDataFrame([("LFR_mid", 1), ("LFR_low", 2), ("real", 3)], "dataset string, n int")
    assert rows(curves.one_benchmark(d), "n") == [(1,), (3,)]


def test_reader_helpers(spark):
    held = spark.createDataFrame([(1, [5, 6]), (3, [])], "node long, comms array<int>")
    assert {tuple(r) for r in text.wide_memberships(held, 2).collect()} == {(1, 5, 6), (3, None, None)}
    assert text.id_column(["hv", "_ID"]) == "_ID" and text.id_column(["hv", "x"]) == "hv"


@pytest.mark.parametrize("name", ["hc_metrics", "hc_summary", "he_metrics", "hv_resumed", "ier_by_degree_rows"])
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{small}/lineitem.parquet'")
    got = entry.queries()[name](spark, small)
    order = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(order)} FROM ({oracle.ORACLES[name]})").fetchall()
    key = lambda t: tuple(map(repr, t))
    assert sorted(map(tuple, got.select(*order).collect()), key=key) == sorted(want, key=key)
