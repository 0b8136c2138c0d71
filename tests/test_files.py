"""Readers, writers and small helpers, each on a file or table of its own."""

import pytest

from weftgraph.operators import curves, graph, published, removal, scalars, structure
from weftgraph.sources import sinks, text
from weftgraph.streaming import edges as stream

TOY = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5), (5, 6), (1, 4)]
COVER = [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (2, 2), (3, 2)]


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame(TOY, "u long, v long"), spark.createDataFrame(COVER, "node long, comm int")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_curve_files(spark, tmp_path):
    write = lambda name, s: (tmp_path / name).write_text(s)
    with pytest.raises(FileNotFoundError, match="processed_curves_homophily_a.csv, .*_covgcc.csv"):
        text.homophily_curves(spark, str(tmp_path), "a")
    write("processed_curves_homophily_a_covgcc.csv", "strategy,metric,fraction_removed,metric_value\nlow_hv,homophily,0.0,0.5\n")
    assert rows(text.homophily_curves(spark, str(tmp_path), "a")) == [("low_hv", "homophily", 0.0, 0.5)]
    write("processed_curves_homophily_a.csv", "strategy,metric,fraction_removed,metric_value\nlow_hv,homophily,0.0,0.7\n")
    assert rows(text.homophily_curves(spark, str(tmp_path), "a"))[0][3] == 0.7
    assert text.component_curves(spark, str(tmp_path), "a") is None
    write("processed_curves_a.csv", "metric,fraction_removed,metric_value\nhomophily,0.1,0.3\n")
    assert text.component_curves(spark, str(tmp_path), "a") is None
    write("processed_curves_a.csv", "metric,fraction_removed,metric_value\nhomophily,0.1,0.3\nrho_GCC,0.1,0.9\n")
    assert rows(curves.component_curve(text.component_curves(spark, str(tmp_path), "a"), "a")) == [(0.1, 0.9, "a")]
    write("processed_curves_gcc_a.csv", "strategy,percent,largest_gcc\nx,0.2,0.8\n")
    assert rows(curves.component_curve(text.component_curves(spark, str(tmp_path), "a"), "a")) == [(0.2, 0.8, "a")]
    odd = spark.createDataFrame([(0.5, 0.25)], "`removed fraction` double, `gcc.value` double")
    assert rows(curves.component_curve(odd, "b")) == [(0.5, 0.25, "b")]
    with pytest.raises(ValueError, match="no point or value"):
        curves.component_curve(spark.createDataFrame([(1.0, 2.0)], "a double, b double"), "b")


def test_ratio_summaries(spark, tmp_path):
    for key, lines in {"a": "dataset,tau,strategy\na,0.1,hv_s1\n", "c": "tau,strategy,extra\n0.3,bridgecc,1\n"}.items():
        (tmp_path / key).mkdir()
        (tmp_path / key / f"edge_ratio_summary_{key}.csv").write_text(lines)
    with pytest.raises(FileNotFoundError, match="edge_ratio_summary_b.csv"):
        text.ratio_summaries(spark, str(tmp_path), ["a", "b"])
    got = text.ratio_summaries(spark, str(tmp_path), ["a", "c"])
    assert rows(got.select("dataset", "tau", "extra")) == [("a", 0.1, None), ("c", 0.3, 1)]
    (tmp_path / "summary_all_datasets_standard.csv").write_text("dataset,tau,strategy\nz,0.2,hv_s1\n")
    assert rows(text.ratio_summaries(spark, str(tmp_path), ["a"])) == [("z", 0.2, "hv_s1")]


def test_style_tables(spark, toy, tmp_path):
    (tmp_path / "n.csv").write_text("Node ID,pluralistic_homophily,num_communities\n3,0.5,2\n4,,1\n")
    assert rows(text.style_nodes(spark, str(tmp_path / "n.csv"))) == [(3, 0.5, 2.0), (4, None, 1.0)] and text.style_nodes(spark, str(tmp_path / "n.csv")).columns == ["node", "hv_s1", "m"]
    edges, members = toy
    sinks.write_edge_homophily(published.edge_rows(edges, scalars.scalar("s1", edges, members)), f"{tmp_path}/e")
    assert spark.read.csv(f"{tmp_path}/e", header=True).columns[:4] == ["Edge ID", "Node 1 ID", "Node 2 ID", "he_s1"]
    back = text.style_edges(spark, f"{tmp_path}/e")
    assert sorted((r.u, r.v) for r in back.collect()) == sorted(TOY) and back.where("h_e is null").count() == 0
    with pytest.raises(ValueError, match="he_s1"):
        text.style_edges(spark, str(tmp_path / "n.csv"))


def test_other_readers(spark, tmp_path):
    (tmp_path / "net.dat").write_text("1 2\n2 1\n2 2\n3\t1\n\n")
    (tmp_path / "com.dat").write_text("1 7\n2 7 8\n3\n")
    edges, members = text.read_generated(spark, str(tmp_path / "net.dat"), str(tmp_path / "com.dat"))
    assert rows(edges) == [(0, 1), (0, 2)] and rows(members) == [(0, 7), (1, 7), (1, 8)]
    assert rows(text.typed(members.withColumn("x", members.node).selectExpr("cast(node as int) node", "string(comm) comm"), text.CANONICAL["members"])) == rows(members)
    for i, d in enumerate((";", "\t", " ")):
        (tmp_path / f"m{i}").write_text(f"1{d}2{d}3\n4\n\n5{d}1\n")
        assert {r.node: r.comms for r in text.read_node_communities(spark, str(tmp_path / f"m{i}")).collect()} == {1: [2, 3], 4: [], 5: [1]}, d
    with pytest.raises(ValueError, match="no paths"):
        text.read_curves(spark)
    table = spark.createDataFrame([("a", 1), ("b", 2)], "g string, x int")
    sinks.write_table(table, f"{tmp_path}/t", by="g")
    assert rows(spark.read.csv(f"{tmp_path}/t", header=True, inferSchema=True).select("g", "x")) == [("a", 1), ("b", 2)]
    assert sinks.markdown(table.where("x = 1"), "T") == "# T\n\n- **g**: a\n- **x**: 1\n"


def test_small_helpers(spark, toy):
    edges, members = toy
    gaps = spark.createDataFrame([(0, 4), (2, 2)], "u long, v long")
    assert rows(graph.contiguous(gaps)) == [(i,) for i in range(5)] and graph.contiguous(gaps.where("false")).count() == 0
    assert [graph.is_connected(e).first().connected for e in (edges, gaps, gaps.where("false"))] == [True, False, False]
    base = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, None), (9, float("inf"))], "node long, x double")
    assert rows(structure.finite_only(base, "x")) == [(0, 1.0)]
    assert rows(structure.with_metric(base.select("node"), graph.degrees(edges))) == [(0, 2), (1, 3), (2, 3), (9, None)]
    ensured = structure.ensure_bridgecc(edges, graph.vertices(edges))
    assert {r.node: r.bridgecc for r in ensured.collect()}[6] == 1 and structure.ensure_bridgecc(edges, ensured) is ensured
    alike = spark.createDataFrame([(0, 1), (1, 1)], "node long, s long")
    with pytest.raises(Exception, match="zero variance"):
        scalars.require_variance(alike).collect()
    assert scalars.require_variance(scalars.scalar("s1", edges, members)).count() == 7
    ranks = removal.strategy_ranks(base.withColumnRenamed("x", "degree"), "degree")
    assert rows(ranks) == [("degree", 0, 0)] and removal.strategy_ranks(base, "ci") is None
    assert rows(removal.strategy_ranks(graph.degrees(edges), "degree", reverse=True).where("rank = 0").select("node")) == [(6,)]
    assert sorted(r.rank for r in removal.strategy_ranks(base, "random", edges.selectExpr("u as node").distinct()).collect()) == [0, 1, 2]
    with pytest.raises(NotImplementedError):
        removal.strategy_ranks(base, "luck")
    marks = spark.createDataFrame([("a", 0.256), ("b", None)], "dataset string, psi double")
    names = spark.createDataFrame([("a", "Alpha")], "dataset string, name string")
    assert rows(curves.legend(marks, names)) == [("a", "Alpha (psi=0.26)"), ("b", "b")]


def test_streams(spark, toy, tmp_path):
    """Degrees over growing files, and each batch's inter-community edges, counted once also when a batch comes again."""
    edges, members = toy
    folder = f"{tmp_path}/in"
    edges.where("u < 3").coalesce(1).write.parquet(folder)
    growing = stream.edge_stream(spark, folder)
    assert growing.isStreaming
    run = lambda: stream.weigh_batches(growing, members, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    assert run()
    edges.where("u >= 3").coalesce(1).write.mode("append").parquet(folder)
    assert run() and run()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert rows(got.select("u", "v", "w")) == rows(removal.inter_edges(edges, members))
    query = stream.degree_stream(stream.edge_stream(spark, folder)).writeStream.format("memory").queryName("degrees_so_far").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert rows(spark.table("degrees_so_far")) == rows(graph.degrees(edges))


def test_cut_marker(spark, toy):
    """Median of an odd and an even number of values, and of none."""
    edges, members = toy
    metrics = spark.createDataFrame([(i, float(i)) for i in range(7)], "node long, hv_s1 double")
    inter = {(r.u, r.v) for r in removal.inter_edges(edges, members).collect()}
    for share, k in ((0.43, 3), (0.57, 4), (1.0, 7)):
        ends = [sum(x in e for e in inter) / sum(x in e for e in TOY) for x in range(k)]
        got = curves.cut_marker(edges, members, metrics, share).first()
        middle = sorted(ends)[(k - 1) // 2 : k // 2 + 1]
        assert got.n_cut == k and got.s_mean == pytest.approx(sum(ends) / k) and got.s_median == pytest.approx(sum(middle) / len(middle))
    assert tuple(curves.cut_marker(edges, members, metrics.where("node > 90"), 0.5).first()) == (0, None, None, None)
