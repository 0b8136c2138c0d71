"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, in flat neighbour arrays.

Different vectors are hashed into shards of bounded size. A shard's graph is built by one task and stored as one row:
vectors, ids, and an array of neighbours for each layer. Nodes are numbered from the top layer down, so that the first
ones are the layers above. Queries are searched in every shard, in blocks, and the shards' results are merged. Many
nodes or queries walk a graph side by side, so that the work of a step is a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, written

#: Different vectors of a shard, about, and bytes of its vectors at most, about.
SHARD, SHARD_BYTES = 8192, 32 << 20
#: Links of a node: above the base layer; twice as many in it.
LINKS = 24
#: Nodes that a walk remembers, when links are made and when queries are answered.
BUILD_WIDTH, SEARCH_WIDTH = 96, 256
#: Nodes that a walk expands at a time, and walks side by side.
AHEAD, SIDE = 4, 256
#: Queries of a block.
BLOCK = 8192
#: Candidates that links are chosen from.
CHOICE = 64
INDEX = "dims int, shard int, n int, kind string, vectors binary, layers array<binary>, firsts binary, ids binary"


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...d,...d->...", d, d)


def walk(vectors: np.ndarray, near: np.ndarray, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest nodes that best-first walks from ``start`` find for each row of ``q``: ids (-1: none) and squares, nearest first."""
    b, w = len(q), near.shape[1]
    seen = np.zeros((b, len(near)), bool)
    ids, dist, fresh = np.full((b, width), -1), np.full((b, width), np.inf, vectors.dtype), np.zeros((b, width), bool)
    ids[:, 0], dist[:, 0], fresh[:, 0] = start, _squares(vectors[start], q), True
    seen[np.arange(b), start] = True
    ahead, live = min(AHEAD, width), np.arange(b)
    while len(live):
        waiting = np.where(fresh[live], dist[live], np.inf)
        pick = np.argpartition(waiting, ahead - 1, axis=1)[:, :ahead]
        good = np.take_along_axis(fresh[live], pick, 1)
        fresh[live[:, None], pick] = False
        found = np.where(good[:, :, None], near[np.where(good, ids[live[:, None], pick], 0)], -1).reshape(len(live), ahead * w)
        found.sort(axis=1)
        new = found >= 0
        new[:, 1:] &= found[:, 1:] != found[:, :-1]
        new &= ~seen[live[:, None], found]
        r, c = np.nonzero(new)
        seen[live[r], found[r, c]] = True
        far = np.full(found.shape, np.inf, vectors.dtype)
        far[r, c] = _squares(vectors[found[r, c]], q[live[r]])
        all_ids, all_dist = np.hstack([ids[live], found]), np.hstack([dist[live], far])
        best = np.argpartition(all_dist, width - 1, axis=1)[:, :width]
        ids[live], dist[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_dist, best, 1)
        fresh[live] = np.take_along_axis(np.hstack([fresh[live], new]), best, 1)
        live = live[fresh[live].any(1)]
    ids = np.where(np.isfinite(dist), ids, -1)
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def _chosen(vectors: np.ndarray, ids: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """``most`` links of each row from candidates, nearest first: those nearer to the row than to links before them, then the nearest others."""
    ids, dist = ids[:, :CHOICE], dist[:, :CHOICE]
    v = vectors[np.maximum(ids, 0)]
    square = np.einsum("bcd,bcd->bc", v, v)
    pair = square[:, :, None] + square[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
    kept, count = np.zeros(ids.shape, bool), np.zeros(len(ids), int)
    for j in range(ids.shape[1]):
        ok = (ids[:, j] >= 0) & (count < most) & ~(kept & (pair[:, :, j] < dist[:, j, None])).any(1)
        kept[:, j] = ok
        count += ok
    rank = np.where(kept, 0, np.where(ids >= 0, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
    out = np.full((len(ids), most), -1, np.int32)
    order = np.argsort(rank, axis=1)[:, :most]
    out[:, : order.shape[1]] = np.take_along_axis(ids, order, 1)
    return out


def _linked_back(vectors: np.ndarray, near: np.ndarray, nodes: np.ndarray) -> None:
    """Links back to ``nodes`` from all that they link to; where there is no room, links are chosen anew."""
    w = near.shape[1]
    new, to = np.repeat(nodes, w), near[nodes].ravel()
    new, to = new[to >= 0], to[to >= 0]
    there = (near[to] == new[:, None]).any(1)
    new, to = new[~there], to[~there]
    order = np.argsort(to, kind="stable")
    new, to = new[order], to[order]
    who, first, count = np.unique(to, return_index=True, return_counts=True)
    if not len(who):
        return
    row = np.repeat(np.arange(len(who)), count)
    more = np.full((len(who), int(count.max())), -1)
    more[row, np.arange(len(new)) - first[row]] = new
    ids = np.hstack([near[who], more])
    dist = np.full(ids.shape, np.inf, vectors.dtype)
    r, c = np.nonzero(ids >= 0)
    dist[r, c] = _squares(vectors[ids[r, c]], vectors[who[r]])
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    full = (ids >= 0).sum(1) > w
    near[who[~full]] = ids[~full, :w]
    if full.any():
        near[who[full]] = _chosen(vectors, ids[full], dist[full], w)


def _descended(vectors: np.ndarray, layers: list[np.ndarray], above: int, q: np.ndarray) -> np.ndarray:
    """Where walks in layer ``above`` begin: the nearest node that is found in each layer over it, from the top."""
    start = np.zeros(len(q), int)
    for near in layers[:above:-1]:
        start = walk(vectors, near, q, start, 1)[0][:, 0]
    return start


def build_graph(vectors: np.ndarray) -> list[np.ndarray]:
    """Neighbours (-1: none) of each node in each layer, base layer first; layer l has the first n / LINKS^l nodes."""
    n, sizes = len(vectors), [len(vectors)]
    while sizes[-1] > LINKS:
        sizes.append(sizes[-1] // LINKS)
    layers = [np.full((m, LINKS * (2 if at == 0 else 1)), -1, np.int32) for at, m in enumerate(sizes)]
    for at in range(len(sizes) - 1, -1, -1):
        near, above = layers[at], sizes[at + 1] if at + 1 < len(sizes) else 0
        done = 1
        while done < sizes[at]:
            upto = min(done + max(1, min(SIDE, done // 4)), sizes[at], above if done < above else n)
            nodes = np.arange(done, upto)
            q = vectors[nodes]
            # nodes of the layer above are linked here one after the other: a walk can't begin at one that isn't yet
            start = _descended(vectors, layers, at, q) if done >= above else np.zeros(len(q), int)
            ids, dist = walk(vectors, near[:done], q, start, min(BUILD_WIDTH, done))
            mates = np.broadcast_to(nodes, (len(nodes), len(nodes)))
            apart = _squares(q[:, None], q[None])
            np.fill_diagonal(apart, np.inf)
            ids, dist = np.hstack([ids, np.where(np.isfinite(apart), mates, -1)]), np.hstack([dist, apart])
            order = np.argsort(dist, axis=1, kind="stable")[:, :CHOICE]
            near[nodes, :LINKS] = _chosen(vectors, np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1), LINKS)
            _linked_back(vectors, near, nodes)
            done = upto
    return layers


def _unit(vectors: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Vectors for walks, in units of the largest number of a shard's vectors ``like``: in floats, or in doubles where those differ much in size."""
    sizes = np.abs(like).max(1).astype(np.float64)
    top = float(sizes.max())
    kind, most = (np.float32, 1e15) if top <= 1e6 * sizes.min() else (np.float64, 1e150)
    return np.clip(vectors.astype(np.float64) / top, -most, most).astype(kind)


def search_graph(vectors: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, width: int = SEARCH_WIDTH) -> Iterator[tuple[int, np.ndarray]]:
    """First query and the nodes found (-1: none), for each ``SIDE`` queries."""
    unit = _unit(vectors, vectors)
    for at in range(0, len(queries), SIDE):
        q = _unit(queries[at : at + SIDE], vectors)
        yield at, walk(unit, layers[0], q, _descended(unit, layers, 0, q), min(width, len(vectors)))[0]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances in doubles; squares are added in order."""
    d = a.astype(np.float64) - b.astype(np.float64)
    return np.sqrt(np.add.accumulate(d * d, axis=-1)[..., -1])


def candidates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, vec: the different rows whose id isn't null and whose vector isn't null or zero and has no null or non-finite component."""
    kind = "array<float>" if dict(df.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = df.select(col(id_col).cast("long").alias("id"), col(vector_col).cast(kind).alias("vec"))
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return rows.where(F.col("id").isNotNull() & F.coalesce(F.forall("vec", fine) & F.exists("vec", lambda c: c != 0), F.lit(False))).distinct()


def build_index(rows: DataFrame, ids: int, shard: int = SHARD) -> DataFrame:
    """A written index of ``candidates``: one row a shard, of ``shard`` different vectors or less.

    Equal vectors are one node, which keeps the ``ids`` smallest of their ids: no answer of up to so many has others.
    """
    first = Window.partitionBy("vec").orderBy("id")
    nodes = written(rows.withColumn("at", F.row_number().over(first)).where(F.col("at") <= ids).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")), "nodes")
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    shards = max(1, -(-size.n // max(1, min(shard, SHARD_BYTES // (8 * (size.d or 1))))))
    kind = "f4" if dict(rows.dtypes)["vec"] == "array<float>" else "f8"

    def build(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        d, n, vec = t.column("dims")[0].as_py(), t.num_rows, t.column("vec").combine_chunks()
        flat = vec.flatten().to_numpy(zero_copy_only=False).reshape(n, d).astype(kind)
        # the order of nodes, and so their layers, is random, but depends on nothing but the vectors
        order = np.lexsort(flat.T[::-1])[np.random.default_rng(n).permutation(n)]
        flat = np.ascontiguousarray(flat[order])
        members = t.column("ids").combine_chunks().take(pa.array(order))
        layers = [x.tobytes() for x in build_graph(_unit(flat, flat))]
        firsts = np.concatenate([[0], np.cumsum(members.value_lengths().to_numpy())]).astype(np.int64)
        row = {"dims": d, "shard": t.column("shard")[0].as_py(), "n": n, "kind": kind, "vectors": flat.tobytes(), "layers": layers, "firsts": firsts.tobytes(), "ids": members.flatten().to_numpy().astype(np.int64).tobytes()}
        return pa.Table.from_pylist([row], schema=_INDEX)

    dealt = nodes.withColumns({"dims": F.size("vec"), "shard": F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int")})
    return written(dealt.groupBy("dims", "shard").applyInArrow(build, INDEX), "index")


_INDEX = pa.schema([("dims", pa.int32()), ("shard", pa.int32()), ("n", pa.int32()), ("kind", pa.string()), ("vectors", pa.binary()), ("layers", pa.list_(pa.binary())), ("firsts", pa.binary()), ("ids", pa.binary())])


def search_index(index: DataFrame, queries: DataFrame, k: int, width: int = SEARCH_WIDTH) -> DataFrame:
    """q, query_id, rank, vec_id, score: the ``k`` nearest of each written query (q, id, vec; q is unique), its own id aside.

    Each block of queries meets each shard once; both are sent as often as there are blocks of the other.
    """
    found = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    sent = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1)))).alias(name)
    shards, blocks = 1 + (index.agg(F.max("shard")).first()[0] or 0), -(-queries.count() // BLOCK)

    def search(graph: pa.Table, block: pa.Table) -> pa.Table:
        if not graph.num_rows or not block.num_rows:
            return found.empty_table()
        g, out = graph.to_pylist()[0], []
        n, d = g["n"], g["dims"]
        vectors = np.frombuffer(g["vectors"], g["kind"]).reshape(n, d)
        sizes = [n]
        while sizes[-1] > LINKS:
            sizes.append(sizes[-1] // LINKS)
        layers = [np.frombuffer(b, np.int32).reshape(m, -1) for b, m in zip(g["layers"], sizes, strict=True)]
        firsts, ids = np.frombuffer(g["firsts"], np.int64), np.frombuffer(g["ids"], np.int64)
        block = block.combine_chunks()
        names, own = block.column("q").to_numpy(), block.column("id").to_numpy()
        q = block.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        for at, nodes in search_graph(vectors, layers, q, width):
            nodes = nodes[:, : max(4 * k, 64)]
            row, c = np.nonzero(nodes >= 0)
            node = nodes[row, c]
            score = distances(vectors[node], q[at + row])
            times = firsts[node + 1] - firsts[node]
            each = np.repeat(np.arange(len(node)), times)
            vec_id = ids[firsts[node][each] + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)]
            row, score = row[each], score[each]
            other = vec_id != own[at + row]
            row, score, vec_id = row[other], score[other], vec_id[other]
            order = np.lexsort((vec_id, score, row))
            row, score, vec_id = row[order], score[order], vec_id[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            top = place < k
            out.append(pa.table([names[at + row[top]], own[at + row[top]], vec_id[top], score[top]], schema=found))
        return pa.concat_tables(out) if out else found.empty_table()

    left = index.select("*", sent("block", blocks)).groupBy("dims", "shard", "block")
    block = F.pmod(F.xxhash64("q"), F.lit(max(1, blocks))).cast("int").alias("block")
    right = queries.select(F.size("vec").alias("dims"), sent("shard", shards), block, "q", "id", "vec").groupBy("dims", "shard", "block")
    hits = left.cogroup(right).applyInArrow(search, "q long, query_id long, vec_id long, score double")
    best = Window.partitionBy("q").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", width: int = SEARCH_WIDTH, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row whose id is divisible by ``every``, among all other rows.

    Nearness is the Euclidean distance in doubles on the given vectors; ties go to the smaller id. Vectors that are
    null, empty, zero or hold null or non-finite components, and rows with null ids, take no part. Rows repeated whole
    count once; an id with several vectors is a candidate, and a query, with each. Vectors of another length than the
    query's are no candidates. Equal vectors are all found, in order of their ids. Other columns are ignored.
    """
    rows = candidates(df, id_col, vector_col)
    index = build_index(rows, k + 1, shard)
    queries = written(rows.where(F.pmod("id", F.lit(every)) == 0).withColumn("q", F.monotonically_increasing_id()), "queries")
    return search_index(index, queries, k, width).select("query_id", "rank", "vec_id", "score")
