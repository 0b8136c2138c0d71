"""Whitening and nearest neighbours against dense and brute-force versions."""

import math
import random

import duckdb
import numpy as np
import pytest

from weftgraph.llm import ann, queries, whitening
from weftgraph.llm.ann import build_graph, build_index, candidates, nearest, search_index
from weftgraph.llm.whitening import folded, jacobi, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, id int, vec string, `q.x` string"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows, schema=SCHEMA, partitions=5):
    return spark.createDataFrame([(i, v, 1, 7, "x", None) for i, v in rows], schema).repartition(partitions)


def expected(vectors):
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    centred = np.array([[(n * r[j] - sums[j]) / n for j in range(d)] for r in x])
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    return n, [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x], centred, values[::-1], parts[:, ::-1]


@pytest.mark.parametrize("partitions", [1, 40])
def test_whiten(spark, partitions):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1 + j) + (rng.random() if j else 0) for j in range(6)]) for i in range(400)]
    rows += [(500, rows[3][1]), (500, rows[3][1]), (None, rows[7][1])]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [NAN] * 6), (903, [INF] + [0.0] * 5), (904, []), (905, [1.0, 2.0])]
    n, deviation, centred, values, parts = expected([v for _, v in rows])
    got = whiten(frame(spark, rows + bad, partitions=partitions), components=4).collect()
    assert len(got) == 4 * len(rows) and {r.component for r in got} == {1, 2, 3, 4} and {r.n for r in got} == {n}
    assert sorted((r.vec_id or -1, r.deviation) for r in got if r.component == 1) == sorted((i or -1, d) for (i, _), d in zip(rows, deviation, strict=True))
    assert max(r.identity_error for r in got) < 1e-9
    for c in range(4):
        want = centred @ parts[:, c] / math.sqrt(values[c])
        mine = {r.vec_id: r.whitened for r in got if r.component == c + 1}
        sign = np.sign(mine[0] * want[0])
        assert all(abs(mine[i] - sign * w) < 1e-8 for (i, _), w in zip(rows, want, strict=True))
        assert all(abs(r.explained - values[c] / values.sum()) < 1e-9 for r in got if r.component == c + 1)


def test_whiten_without_spread(spark):
    assert whiten(frame(spark, [])).count() == 0
    assert whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    assert whiten(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(9)])).count() == 0
    line = whiten(frame(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 9 and abs(line[0].explained - 1) < 1e-12


def test_whiten_large_numbers(spark):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0]), (4, [1.0, -1e20])]
    got = whiten(frame(spark, rows)).collect()
    assert {r.vec_id for r in got} == {1, 2, 3, 4} and all(r.deviation is None for r in got)
    model = whitening.fit_whitening(whitening.usable(frame(spark, rows), "vec_id", "embedding"))
    top = 1 << 62
    assert model.sums == (4 * 1_000_000 + 64, 3 * 1_000_000 + 192 + (-top + 1_000_000)) and model.n == 4


@pytest.mark.parametrize("shape", [(60, 12), (5, 9), (40, 40), (80, 7)])
def test_jacobi(shape):
    rng = np.random.default_rng(sum(shape))
    a = rng.normal(size=shape) * np.logspace(0, -9, shape[1])
    a[:, -1] = a[:, 0]
    sigma, v = jacobi(np.linalg.qr(a, mode="r"))
    want = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(sigma[: len(want)], want, atol=1e-14 * want[0]) and np.allclose(v.T @ v, np.eye(shape[1]), atol=1e-12)
    u = a @ v
    assert np.abs(u.T @ u - np.diag(sigma**2)).max() < 1e-13 * want[0] ** 2


def test_folded_in_several_rounds(spark):
    parts = spark.range(600).selectExpr("cast(id as int) as at", "cast(cast(id as string) as binary) as part")
    assert folded(parts, lambda p: b",".join(p), "t") == b",".join(str(i).encode() for i in range(600))
    assert folded(parts.limit(0), lambda p: b"", "t") is None


def brute(rows, k, every):
    rows = sorted({(i, tuple(map(float, np.float32(v)))) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)})
    out = []
    for qid, q in rows:
        if qid % every == 0:
            near = sorted((math.sqrt(sum_in_order(q, v)), i) for i, v in rows if i != qid and len(v) == len(q))[:k]
            out += [(qid, at + 1, i, s) for at, (s, i) in enumerate(near)]
    return sorted(out)


def sum_in_order(a, b):
    t = 0.0
    for x, y in zip(a, b, strict=True):
        t += (x - y) * (x - y)
    return t


def result(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("shard", [30, 8192])
def test_nearest_of_few(spark, shard):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, rows[20][1]) for i in range(40)] + [(1010, rows[20][1]), (2000, rows[20][1])]  # many copies of a query's vector
    rows += [(3000, [0.0] * 8), (3001, None), (3002, [NAN] * 8), (3003, [1.0, None]), (3004, []), (None, rows[5][1]), (4000, [1.0, 2.0]), (4001, [1.0, 2.0]), (5000, [3.0]), (6003, [3e38] * 8), (6001, [-3e38] * 8), (6002, [1e-30] * 8)]
    assert result(nearest(frame(spark, rows), 10, 20, shard=shard)) == brute(rows, 10, 20)


def test_nearest_of_none(spark):
    assert nearest(frame(spark, [])).count() == 0
    assert nearest(frame(spark, [(0, [1.0])])).count() == 0
    assert nearest(frame(spark, [(1, [1.0]), (2, [2.0])])).count() == 0


def test_nearest_of_a_query_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 7)
    rows = [(i, [math.sin(i), math.cos(i * i)]) for i in range(200)]
    assert result(nearest(frame(spark, rows), 5, 5, shard=50)) == brute(rows, 5, 5)


def test_recall_and_sql(spark):
    sf = "/root/testdata/sf0.1"
    got = result(queries.op12_nearest(spark, sf))
    duckdb.sql(f"create or replace view embeddings as select * from '{sf}/embeddings.parquet'")
    want = sorted((r[0], r[1], r[2], r[3]) for r in duckdb.sql("select query_id, rank, vec_id, score from (" + queries.ORACLES["op12_nearest"] + ")").fetchall())
    assert len(got) == len(want) and len({(r[0], r[2]) for r in got} & {(r[0], r[2]) for r in want}) >= 0.99 * len(want)


def test_every_node_is_reached():
    """Every vector of a shard is found from the entry, clusters and near copies included."""
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=(900, 16)), rng.normal(size=(1, 16)) + 1e-4 * rng.normal(size=(900, 16))]).astype(np.float32)
    v = v[rng.permutation(len(v))]
    layers = build_graph(v)
    assert [len(x) for x in layers] == [1800, 75, 3] and all(x.max() < len(x) for x in layers)
    found = [nodes[r, 0] for at, nodes in ann.search_graph(v, layers, v) for r in range(len(nodes))]
    assert np.mean(np.array(found) == np.arange(len(v))) > 0.995


def test_index_is_stored(spark):
    rows = candidates(frame(spark, [(i, [float(i), 1.0]) for i in range(100)]))
    index = build_index(rows, 4, 20)
    assert sum(r.n for r in index.collect()) == 100 and index.count() >= 4
    asked = spark.createDataFrame([(0, 500, [50.2, 1.0])], "q long, id long, vec array<float>")
    assert [r.vec_id for r in search_index(index, asked, 3).orderBy("rank").collect()] == [50, 51, 49]
