"""Several graphs in one job against each graph alone."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from weftgraph.operators import datasets, graph, homophily, ier, removal, scalars, structure
from weftgraph.plans import oracle
from weftgraph.plans.fixture import Fixture
from weftgraph.plans.rank import first_in
from weftgraph.plans.tables import written


def rows(df):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def graphs(spark, small):
    """The fixture graph, one of two parts with other nodes, and a tiny one with the same ids."""
    g = Fixture(spark, small)
    two = spark.createDataFrame([(i, j) for i in range(0, 40) for j in range(i + 1, 40) if (i < 25) == (j < 25) and (i * j + i + j) % 3 == 0], "u long, v long")
    tiny = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5), (5, 6), (1, 4)], "u long, v long")
    cover = lambda n, k: spark.createDataFrame([(i, (i * i + c) % k) for i in range(n) for c in range(1 + i % 2)], "node long, comm int").distinct()
    return {"fixture": (g.edges, g.members), "two": (two, cover(40, 5)), "tiny": (tiny, cover(7, 2))}


@pytest.fixture(scope="module")
def together(graphs):
    return written(datasets.keyed({k: e for k, (e, _) in graphs.items()}, "u", "v"), "edges"), written(datasets.keyed({k: m for k, (_, m) in graphs.items()}, "node"), "members")


def alone(graphs, one):
    return sorted(r for name, (e, m) in graphs.items() for r in rows(one(e, m).selectExpr(f"'{name}' as dataset", "*")))


def test_moments_components_and_curves(graphs, together):
    edges, members = together
    assert rows(datasets.hv(edges, members)) == alone(graphs, lambda e, m: homophily.hv(e, scalars.scalar("s1", e, m)))
    assert rows(datasets.assortativity(edges, members)) == alone(graphs, lambda e, m: homophily.assortativity(e, scalars.scalar("s1", e, m)))
    assert rows(datasets.components(edges)) == alone(graphs, lambda e, m: graph.components(e))
    got = {r.dataset: r for r in datasets.component_summary(edges, graph.vertices(edges)).collect()}
    assert (got["two"].n_nodes, got["two"].n_components, got["tiny"].giant_size, got["tiny"].giant) == (graphs["two"][0].selectExpr("explode(array(u, v)) as x").distinct().count(), graph.components(graphs["two"][0]).select("component").distinct().count(), 7, 0)

    def curve(e, m):
        low = removal.metric_ranks(homophily.hv(e, scalars.scalar("s1", e, m)), "hv", True, "low_hv")
        return low, removal.random_ranks(graph.vertices(e), 2)

    ranks = datasets.low_ranks(datasets.hv(edges, members), "hv", True, "low_hv").unionByName(datasets.random_ranks(datasets.flat(graph.vertices(edges)), 2))
    assert rows(datasets.weight_curves(edges, members, ranks)) == alone(graphs, lambda e, m: (lambda r: removal.weight_curve(removal.inter_edges(e, m), r[0].unionByName(r[1])))(curve(e, m)))


def test_ratios(graphs, together):
    """The summary of three graphs in one plan is that of three runs."""
    r = datasets.Ratios(*together)

    def single(e, m, what):
        nodes = graph.vertices(e)
        metrics = homophily.hv(e, scalars.scalar("s1", e, m)).selectExpr("node", "hv as hv_s1").join(structure.bridgecc(e, nodes), "node")
        sets, quartiles, inter = (written(t, "t") for t in (ier.target_sets(written(metrics, "m")), ier.degree_quartiles(graph.degrees(e)), ier.inter_degrees(e, m, nodes)))
        null, obs = written(ier.null_statistics(sets, inter, quartiles, 40), "null"), ier.observed(sets, inter, quartiles)
        if what == "deltas":
            return ier.deltas(null, obs, "x").drop("dataset")
        return ier.summary(obs, ier.bootstrap(sets, inter, quartiles, 30), ier.permutation_p(null, obs), "x", 40).drop("dataset")

    assert rows(r.summary(30, 40)) == alone(graphs, lambda e, m: single(e, m, "summary"))
    assert rows(r.deltas(40)) == alone(graphs, lambda e, m: single(e, m, "deltas"))


def test_first_in(spark):
    df = spark.range(3000).selectExpr("id % 3 as g", "id as node", "if(id % 50 = 0, md5('same'), md5(string(id))) as key", "case id % 3 when 0 then 7 when 1 then 400 else 5000 end as need")
    table = [tuple(r) for r in df.collect()]
    want = sorted((g, n) for part in range(3) for g, n in [(r[0], r[1]) for r in sorted((r for r in table if r[0] == part), key=lambda r: (r[2], r[1]))][: {0: 7, 1: 400, 2: 5000}[part]])
    assert sorted(tuple(r) for r in first_in(df, ("g",), "key", "node", "need").collect()) == want


@pytest.mark.parametrize("name", ["name_dictionary", "named_hv_metrics", "hv_s1_datasets", "assortativity_datasets", "components_datasets", "w_inter_curve_datasets", "ier_observed_datasets"])
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from read_parquet('{small}/lineitem.parquet')")
    cursor = con.execute(oracle.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    got = entry.queries()[name](spark, small)
    assert sorted(got.columns) == sorted(columns)
    tidy = lambda row: tuple(f"{float(v):.8g}" if isinstance(v, float) or hasattr(v, "as_tuple") else str(v) for v in row)
    assert sorted(tidy([r[c] for c in columns]) for r in got.collect()) == sorted(map(tidy, cursor.fetchall()))
    assert all(not math.isnan(v) for r in got.collect() for v in r if isinstance(v, float))
