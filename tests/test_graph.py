"""Graph operators on a toy graph with exact values, and queries against SQL."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from weftgraph.operators import graph, homophily, removal, scalars, structure
from weftgraph.plans import oracle
from weftgraph.sources import sinks, text

TOY = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5), (5, 6), (1, 4)]
COVER = [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (2, 2), (3, 2)]


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame(TOY, "u long, v long"), spark.createDataFrame(COVER, "node long, comm int")


def by_node(df, column):
    return {r.node: r[column] for r in df.collect()}


def test_scalars(toy):
    edges, members = toy
    want = {"s0": [2, 3, 3, 3, 3, 3, 1], "s1": [1, 1, 2, 2, 1, 1, 0], "s2": [1, 1, 2, 2, 1, 1, 0], "s3": [2, 2, 3, 3, 2, 2, 0]}
    for method, values in want.items():
        assert by_node(scalars.scalar(method, edges, members), "s") == dict(enumerate(values)), method
    with pytest.raises(ValueError):
        scalars.scalar("s9", edges, members)


def test_homophily(toy):
    edges, members = toy
    s = scalars.scalar("s1", edges, members)
    want = [-10 / 909, -5 / 1212, 13 / 1212, 13 / 1212, -5 / 1212, 25 / 1212, 115 / 3636]
    got = by_node(homophily.hv(edges, s), "hv")
    assert all(math.isclose(got[i], w, abs_tol=1e-12) for i, w in enumerate(want))
    ghv = by_node(homophily.ghv(edges, s), "ghv")
    assert all(math.isclose(ghv[i], w / 101, abs_tol=1e-12) for i, w in enumerate([-20, -5, 13, 13, -5, 25, 115]))
    whole = graph.simplified(edges.unionByName(edges.select(edges.v.alias("u"), edges.u.alias("v"))))
    alike = members.select("node").distinct().selectExpr("node", "1L as s")
    assert whole.count() == 9
    with pytest.raises(Exception, match="zero variance"):
        homophily.hv(edges.where("v < 6"), alike).collect()


def test_structure(toy):
    edges, _ = toy
    assert by_node(structure.triangles(edges), "triangles") == dict(enumerate([1, 1, 1, 1, 1, 1, 0]))
    got = by_node(structure.bridgecc(edges), "bridgecc")
    assert all(math.isclose(got[i], w, abs_tol=1e-12) for i, w in enumerate([0, 2, 2, 2, 2, 2, 0]))
    assert by_node(structure.bridgecc(edges, low_degree="degree"), "bridgecc")[6] == 1
    assert by_node(structure.collective_influence(edges, 2), "ci") == dict(enumerate([4, 8, 8, 6, 6, 8, 0]))


def test_eigenvector_and_components(spark, toy):
    import numpy as np

    edges, _ = toy
    a = np.zeros((7, 7))
    for u, v in TOY:
        a[u, v] = a[v, u] = 1
    x = np.abs(np.linalg.eigh(a)[1][:, -1])
    got = by_node(structure.eigenvector(edges, tol=1e-7), "eigenvector")
    assert all(abs(got[i] - x[i]) < 1e-4 for i in range(7))
    fixed = by_node(structure.eigenvector(edges, rounds=12), "eigenvector")
    assert math.isclose(sum(v * v for v in fixed.values()), 1, rel_tol=1e-9)
    two = spark.createDataFrame([(3, 2), (1, 0), (4, 4), (0, 1)], "u long, v long")
    assert by_node(graph.components(two), "component") == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    assert sorted(r.node for r in graph.giant(two).collect()) == [0, 1]
    assert graph.components(two.where("false")).count() == 0


def brute_betweenness(pairs):
    """Paths counted pair by pair: a node on a shortest path between two others gets its share of them."""
    ids, near = sorted({x for p in pairs for x in p}), {}
    for u, v in pairs:
        if u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    far, paths = {}, {}
    for s in ids:
        far[s], paths[s], front = {s: 0}, {s: 1}, [s]
        while front:
            ahead = {}
            for x in front:
                for y in near.get(x, ()):
                    if y not in far[s]:
                        ahead[y] = ahead.get(y, 0) + paths[s][x]
            far[s] |= dict.fromkeys(ahead, far[s][front[0]] + 1)
            paths[s] |= ahead
            front = list(ahead)
    on = lambda s, v, t: v in far[s] and t in far[v] and far[s][v] + far[v][t] == far[s][t]
    return {v: sum(paths[s][v] * paths[v][t] / paths[s][t] for s in ids for t in far[s] if s < t and v not in (s, t) and on(s, v, t)) for v in ids}


def test_betweenness(spark, small):
    from weftgraph.plans.fixture import Fixture

    same = lambda got, want: got.keys() == want.keys() and all(math.isclose(got[i], w, rel_tol=1e-9, abs_tol=1e-9) for i, w in want.items())
    odd = [*TOY, (0, 1), (1, 0), (6, 7), (7, 8), (20, 21), (21, 22), (30, 30)]
    edges = spark.createDataFrame(odd, "u long, v long")
    want = brute_betweenness(odd)
    assert same(by_node(structure.betweenness(edges), "betweenness"), want)
    assert same(by_node(structure.betweenness(edges, block_rows=100), "betweenness"), want)  # in blocks of four
    some = by_node(structure.betweenness(edges, spark.createDataFrame([(0,), (20,)], "node long")), "betweenness")
    assert some[21] == 13 / 2 / 2 and some[30] == 0
    assert set(by_node(structure.betweenness(edges.where("v > 29")), "betweenness").values()) == {0.0}
    assert structure.betweenness(edges.where("false")).count() == 0
    pairs = [(r.u, r.v) for r in Fixture(spark, small).edges.collect()]
    assert same(by_node(structure.betweenness(spark.createDataFrame(pairs, "u long, v long"), epsilon=0.01), "betweenness"), brute_betweenness(pairs))


def test_sources_for():
    assert structure.sources_for(20_000, 0.01) == 20_000
    assert structure.sources_for(10**6, 0.01) == math.ceil(math.log(2e7) * 5000) < 10**6
    assert structure.sources_for(0, 0.01) == 0


def test_eigenvector_settles(spark, small):
    import numpy as np

    from weftgraph.plans.fixture import Fixture

    path = spark.createDataFrame([(i, i + 1) for i in range(30)], "u long, v long")
    with pytest.raises(RuntimeError, match="did not settle"):
        structure.eigenvector(path, most=3)
    got = by_node(entry.queries()["eigenvector_centrality"](spark, small), "eigenvector")
    ids, pairs = sorted(got), [(r.u, r.v) for r in Fixture(spark, small).edges.collect()]
    x, u, v = np.array([got[i] for i in ids]), *np.searchsorted(ids, np.array(pairs)).T
    new = x + np.bincount(u, x[v], len(x)) + np.bincount(v, x[u], len(x))
    assert np.abs(new / np.linalg.norm(new) - x).max() < 1.1e-9  # another round moves nothing by the tolerance


@pytest.mark.parametrize("hub", [0, 2, 5, 4096])
def test_collective_influence_beside_hubs(spark, hub):
    """By bitmaps, by rows, and by both in one graph; loops and repeated edges count in degrees only."""
    pairs = [(0, i) for i in range(1, 12)] + [(i, i + 1) for i in range(5, 20)] + [(20, 25), (25, 26), (3, 3), (1, 0), (30, 31), (2, 40_000_000_000)]
    near, degree = {}, {}
    for u, v in pairs:
        for a, b in ((u, v), (v, u)):
            degree[a] = degree.get(a, 0) + 1
            if u != v:
                near.setdefault(a, set()).add(b)
    two = lambda v: {w for u in near.get(v, ()) for w in near[u]} - near.get(v, set()) - {v}
    want = {v: (d - 1) * sum(degree[w] - 1 for w in two(v)) for v, d in degree.items()}
    assert by_node(structure.collective_influence(spark.createDataFrame(pairs, "u long, v long"), 2, hub), "ci") == want


def test_collective_influence_of_a_star(spark):
    """A hundred thousand leaves: their pairs are ten billion."""
    edges = spark.range(1, 100_001).selectExpr("0L as u", "id as v").unionByName(spark.createDataFrame([(7, 200_000), (200_000, 200_001)], "u long, v long"))
    got = structure.collective_influence(edges, 2)
    some = by_node(got.where("node IN (0, 1, 7, 200000, 200001)"), "ci")
    # only node 7 (degree 2) and 200000 (degree 2) weigh anything besides the hub
    assert some == {0: 99_999 * 1, 1: 0, 7: 0, 200_000: 99_999, 200_001: 0}
    assert got.count() == 100_003


def test_component_trajectory(spark):
    """Every step by a plain search, for rankings of all nodes and of some."""
    import random

    rng = random.Random(5)
    pairs = [(rng.randint(0, 59), rng.randint(0, 59)) for _ in range(75)] + [(3, 3), (4, 5), (5, 4)]
    ids = sorted({x for p in pairs for x in p})
    orders = {"all": rng.sample(ids, len(ids)), "some": rng.sample(ids, 7), "low": ids}
    ranks = spark.createDataFrame([(s, v, i) for s, o in orders.items() for i, v in enumerate(o)], "strategy string, node long, rank long")
    edges = spark.createDataFrame(pairs, "u long, v long")
    got = {(r.strategy, r.step): (r.removed_frac, r.rho, r.nodes_left, r.edges_left) for r in removal.component_trajectory(edges, graph.vertices(edges), ranks, 0.05, 0.9).collect()}
    n, size, want = len(ids), max(1, round(0.05 * len(ids))), {}
    for s, order in orders.items():
        for step in range(min(18, -(-len(order) // size)) + 1):
            left = set(ids) - set(order[: step * size])
            kept, parts = [p for p in pairs if set(p) <= left], {v: {v} for v in left}
            for u, v in kept:
                if parts[u] is not parts[v]:
                    parts[u] |= parts[v]
                    for x in parts[v]:
                        parts[x] = parts[u]
            want[s, step] = (round(1 - len(left) / n, 6), max(map(len, parts.values()), default=0) / n, len(left), len(kept))
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want), {k: (got[k], want[k]) for k in want if got[k] != pytest.approx(want[k], abs=1e-6)}


def test_bags_of_edges(spark):
    edges = spark.createDataFrame([(0, 1), (0, 1), (1, 1), (1, 2)], "u long, v long")
    assert by_node(graph.degrees(edges), "degree") == {0: 2, 1: 5, 2: 1}
    assert sorted(tuple(r) for r in graph.simplified(edges).collect()) == [(0, 1), (1, 2)]


def test_files(spark, tmp_path):
    lines = tmp_path / "c.txt"
    lines.write_text("1\t2\n\n2\t3\n")
    pairs = lambda **how: sorted(tuple(r) for r in text.read_communities(spark, str(lines), **how).collect())
    assert pairs() == [(1, 0), (2, 0), (2, 1), (3, 1)]
    assert pairs(count_blank=True) == [(1, 0), (2, 0), (2, 2), (3, 2)]
    ragged = tmp_path / "n.csv"
    ragged.write_text("7,1\n8\n7,2\n9,3,1\n")
    assert {r.node: r.comms for r in text.read_node_communities(spark, str(ragged)).collect()} == {7: [2], 8: [], 9: [1, 3]}
    edges = spark.createDataFrame(TOY, "u long, v long")
    sinks.write_edges(edges, str(tmp_path / "e"))
    assert sorted(tuple(r) for r in text.read_edges(spark, str(tmp_path / "e")).collect()) == sorted(TOY)


SOME = ["degree", "hv_s1", "ghv_s2", "assortativity_s1", "edge_homophily", "local_clustering", "overlap_neigh", "community_isolation", "internal_edge_density", "inter_edges", "w_inter_total", "w_inter_curve_low_hv", "degree_quartiles", "inter_degree_tau"]


@pytest.mark.parametrize("name", [n for n in SOME if n in oracle.ORACLES])
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from read_parquet('{small}/lineitem.parquet')")
    cursor = con.execute(oracle.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    got = entry.queries()[name](spark, small)
    assert sorted(got.columns) == sorted(columns)
    tidy = lambda row: tuple(f"{float(v):.8g}" if isinstance(v, float) or hasattr(v, "as_tuple") else str(v) for v in row)
    assert sorted(tidy([r[c] for c in columns]) for r in got.collect()) == sorted(map(tidy, cursor.fetchall()))


def test_trajectory_searches_most_edges_once(spark, monkeypatch):
    """Edges that no strategy removes are in one search, not in one for each strategy and halving."""
    import random

    rng, given = random.Random(7), []
    edges = spark.createDataFrame([(rng.randint(0, 199), rng.randint(0, 199)) for _ in range(1000)], "u long, v long").where("u < v")
    ranks = spark.createDataFrame([(s, v, i) for s in ("x", "y") for i, v in enumerate(rng.sample(range(200), 20))], "strategy string, node long, rank long")
    search = removal.stars
    monkeypatch.setattr(removal, "stars", lambda e: (given.append(e.count()), search(e))[1])
    assert removal.component_trajectory(edges, graph.vertices(edges), ranks).where("step = 10").count() == 2
    assert sum(given) < 1.5 * edges.count()
