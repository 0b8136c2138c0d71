"""Structural metrics of nodes and communities."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import draw_key, is_finite
from ..plans.rank import ranked
from ..plans.tables import dropped, new_folder, written
from . import graph
from .homophily import internal_edges

#: Rows that a block of sources makes when its walks cross every edge, about; a block has one source at least.
BLOCK_ROWS = 100_000_000
#: A node with more neighbours is a hub, whose pairs of neighbours go by bitmaps; bits of a bitmap's bucket (a power of
#: two, as large as Spark's bitmaps); tasks that a bucket's bitmaps are dealt to.
HUB, BITS, DEALS = 4096, 15, 16


def oriented(edges: DataFrame) -> DataFrame:
    """a, b, da, db: the simple graph's edges, from the lower to the higher (degree, id), with both degrees; written once.

    A hub then has few outgoing edges, and wedges stay few.
    """
    simple = written(graph.simplified(edges), "simple")
    d = graph.degrees(simple)
    both = simple.join(d.select(F.col("node").alias("u"), F.col("degree").alias("du")), "u").join(d.select(F.col("node").alias("v"), F.col("degree").alias("dv")), "v")
    up = F.struct("du", "u") < F.struct("dv", "v")
    pick = lambda x, y, name: F.when(up, F.col(x)).otherwise(F.col(y)).alias(name)
    return written(both.select(pick("u", "v", "a"), pick("v", "u", "b"), pick("du", "dv", "da"), pick("dv", "du", "db")), "oriented")


def _triangles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, degree (of the simple graph), triangles."""
    out = oriented(edges)
    links = out.select("a", "b")
    wedges = out.join(out.select("a", F.col("b").alias("c"), F.col("db").alias("dc")), "a")
    closed = wedges.where(F.struct("db", "b") < F.struct("dc", "c")).select("a", "b", "c").join(links.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"])
    corner = lambda node, degree, n: F.struct(F.col(node).alias("node"), degree.alias("degree"), F.lit(n).alias("n"))
    none = F.lit(None).cast("long")
    seen = out.select(F.explode(F.array(corner("a", F.col("da"), 0), corner("b", F.col("db"), 0))).alias("x"))
    found = closed.select(F.explode(F.array(*(corner(x, none, 1) for x in "abc"))).alias("x"))
    counted = seen.unionByName(found).groupBy(F.col("x.node").alias("node")).agg(F.max("x.degree").alias("degree"), F.sum("x.n").alias("triangles"))
    return nodes.select("node").join(counted, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("triangles", F.lit(0)).alias("triangles"))


def triangles(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, triangles on the simple graph."""
    return _triangles(edges, graph.vertices(edges) if nodes is None else nodes).select("node", "triangles")


def clustering(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, degree (of the simple graph), clustering: 2 triangles / (d (d-1)), null under degree 2."""
    t = _triangles(edges, graph.vertices(edges) if nodes is None else nodes)
    return t.select("node", "degree", F.when(F.col("degree") >= 2, 2 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).alias("clustering"))


def bridgecc(edges: DataFrame, nodes: DataFrame | None = None, low_degree: str = "zero") -> DataFrame:
    """node, bridgecc = d (1 - clustering); under degree 2 it is 0, the degree, or NaN."""
    low = {"zero": F.lit(0.0), "degree": F.col("degree").cast("double"), "nan": F.lit(float("nan"))}
    if low_degree not in low:
        raise ValueError(f"low_degree is one of {sorted(low)}")
    return clustering(edges, nodes).select("node", F.when(F.col("degree") < 2, low[low_degree]).otherwise(F.col("degree") * (1 - F.col("clustering"))).alias("bridgecc"))


def ensure_bridgecc(edges: DataFrame, metrics: DataFrame) -> DataFrame:
    """``metrics`` with bridgecc: as it is, or computed (degree under degree 2) if the column is missing."""
    return metrics if "bridgecc" in metrics.columns else metrics.join(bridgecc(edges, low_degree="degree"), "node", "left")


def collective_influence(edges: DataFrame, radius: int = 2, hub: int = HUB) -> DataFrame:
    """node, ci = (d-1) sum of (d_u - 1) over nodes at distance exactly ``radius``; degrees of the bag of edges.

    With radius 2, nodes beside one of more than ``hub`` neighbours go by bitmaps: the pairs that a hub makes are never rows.
    """
    near = written(graph.adjacency(graph.simplified(edges)).withColumnsRenamed({"u": "node", "v": "at"}), "near")
    d = written(graph.degrees(edges), "degrees")
    hubs = near.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hub).select("node")
    hubs = written(hubs, "hubs") if radius == 2 else hubs.where("false")
    if radius == 2 and not hubs.isEmpty():
        beside = written(near.join(hubs.withColumnRenamed("node", "at"), "at", "left_semi").select("node").distinct(), "beside")
        reach = _reach(near.join(beside, "node", "left_anti"), near, d, radius).unionByName(_reach_by_bitmaps(near, d, hubs, beside))
    else:
        reach = _reach(near, near, d, radius)
    return d.join(reach, "node", "left").select("node", ((F.col("degree") - 1) * F.coalesce("reach", F.lit(0))).alias("ci"))


def _reach(start: DataFrame, near: DataFrame, d: DataFrame, radius: int) -> DataFrame:
    """node, reach: sum of (d_u - 1) at distance exactly ``radius``; start: the adjacency (node, at) of the nodes that are asked for."""
    seen, front = None, start
    for step in range(1, radius):
        seen = front if seen is None else seen.unionByName(front)
        ahead = front.join(near.select(F.col("node").alias("at"), F.col("at").alias("next")), "at").select("node", F.col("next").alias("at")).where("node <> at").distinct()
        front = ahead.join(seen, ["node", "at"], "left_anti")
        if step > 1:
            front = written(front, "front")
    return front.join(d.select(F.col("node").alias("at"), F.col("degree").alias("da")), "at").groupBy("node").agg(F.sum(F.col("da") - 1).alias("reach"))


def _reach_by_bitmaps(near: DataFrame, d: DataFrame, hubs: DataFrame, beside: DataFrame) -> DataFrame:
    """node, reach: as ``_reach`` with radius 2, for the nodes ``beside`` hubs.

    Nodes have places, and a place is a bit of a bucket's bitmap. A hub's neighbours are made into bitmaps once and
    or-ed into those of each node beside it, with what other neighbours lead to, the neighbours and the node itself.
    What all these weigh, less what is nearer than distance 2, is the reach.
    """
    places = written(ranked(d, [F.col("node").asc()], name="place").select("node", F.shiftright("place", BITS).cast("int").alias("bucket"), F.col("place").bitwiseAND(F.lit((1 << BITS) - 1)).alias("bit"), (F.col("degree") - 1).alias("weight")), "places")
    at = places.select(F.col("node").alias("to"), "bucket", "bit")
    own = near.join(beside, "node", "left_semi")
    mine = own.select("node", F.col("at").alias("to")).unionByName(beside.select("node", F.col("node").alias("to")))
    light = own.join(hubs.withColumnRenamed("node", "at"), "at", "left_anti").join(near.select(F.col("node").alias("at"), F.col("at").alias("to")), "at").select("node", "to")
    few = mine.unionByName(light).join(at, "to").groupBy("node", "bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    of_hubs = near.join(hubs, "node", "left_semi").select(F.col("node").alias("at"), F.col("at").alias("to")).join(at, "to").groupBy("at", "bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    many = own.join(written(of_hubs, "hub-maps"), "at").select("node", "bucket", "map")
    maps = few.unionByName(many).groupBy("node", "bucket").agg(F.bitmap_or_agg("map").alias("map"))
    # a bucket's weights go before its bitmaps, to each of the tasks that these are dealt to
    weights = places.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("bit", "weight"))).alias("weights"))  # a bucket's size is fixed
    weights = weights.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("deal"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("binary").alias("map"), "weights")
    rows = maps.select("bucket", F.pmod(F.xxhash64("node"), F.lit(DEALS)).cast("int").alias("deal"), "node", "map", F.lit(None).cast(weights.schema["weights"].dataType).alias("weights"))
    rows = weights.unionByName(rows).repartition("bucket", "deal").sortWithinPartitions("bucket", "deal", F.col("node").asc_nulls_first())
    sums = rows.mapInArrow(_weighed, "node long, reach long").groupBy("node").agg(F.sum("reach").alias("whole"))
    nearer = mine.join(places.select(F.col("node").alias("to"), "weight"), "to").groupBy("node").agg(F.sum("weight").alias("nearer"))
    return sums.join(nearer, "node").select("node", (F.col("whole") - F.col("nearer")).alias("reach"))


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the set bits of each bitmap weigh; the bucket's weights come before its bitmaps."""
    weight = np.zeros(1 << BITS, np.int64)
    for b in batches:
        nodes, sums = [], []
        for node, map_, weights in zip(b.column("node").to_pylist(), b.column("map"), b.column("weights"), strict=True):
            if node is None:
                entries = weights.values
                weight = np.zeros(1 << BITS, np.int64)
                weight[entries.field("bit").to_numpy()] = entries.field("weight").to_numpy()
            else:
                bits = np.unpackbits(np.frombuffer(map_.as_py(), np.uint8), bitorder="little")
                nodes.append(node)
                sums.append(int(weight[np.flatnonzero(bits)].sum()))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sums, pa.int64())], names=["node", "reach"])


def overlap_rank(edges: DataFrame, members: DataFrame) -> DataFrame:
    """node, degree, overlap_neigh of neighbours of overlapping nodes: the highest score for the highest degree (ties: smaller id)."""
    near = graph.adjacency(edges).join(graph.overlapping(members).withColumnRenamed("node", "u"), "u", "left_semi").select(F.col("v").alias("node")).distinct()
    order = ranked(near.join(graph.degrees(edges), "node"), [F.col("degree").desc(), F.col("node").asc()])
    total = order.agg(F.count(F.lit(1)).alias("n"))
    return order.crossJoin(F.broadcast(total)).select("node", "degree", (F.col("n") - F.col("rank")).alias("overlap_neigh"))


def num_communities(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """node, num_communities: null for nodes without any."""
    return nodes.select("node").join(members.distinct().groupBy("node").agg(F.count(F.lit(1)).alias("num_communities")), "node", "left")


def with_metric(table: DataFrame, metric: DataFrame) -> DataFrame:
    """``table`` with another metric by node; null where it is missing."""
    return table.join(metric, "node", "left")


def restricted(table: DataFrame, nodes: DataFrame) -> DataFrame:
    return table.join(nodes.select("node"), "node", "left_semi")


def finite_only(table: DataFrame, column: str) -> DataFrame:
    return table.where(is_finite(F.col(column)))


def with_delta(table: DataFrame) -> DataFrame:
    """delta_hv = hv_s1 - hv_s0, and its size."""
    return table.withColumn("delta_hv", F.col("hv_s1") - F.col("hv_s0")).withColumn("abs_delta_hv", F.abs("delta_hv"))


def isolation(edges: DataFrame, members: DataFrame) -> DataFrame:
    """comm, internal (edges), external (edge ends that leave), isolation = internal / (internal + external), 0 without edges.

    For communities with two nodes of the graph at least.
    """
    held = members.select("node", "comm").distinct().join(graph.vertices(edges), "node", "left_semi")
    sizes = held.groupBy("comm").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    ends = held.join(graph.degrees(edges), "node").groupBy("comm").agg(F.sum("degree").alias("ends"))
    inner = internal_edges(edges, held).groupBy("comm").agg(F.count(F.lit(1)).alias("internal"))
    t = sizes.join(ends, "comm").join(inner, "comm", "left").select("comm", F.coalesce("internal", F.lit(0)).alias("internal"), "ends")
    t = t.select("comm", "internal", (F.col("ends") - 2 * F.col("internal")).alias("external"))
    return t.withColumn("isolation", F.coalesce(F.try_divide(F.col("internal"), F.col("internal") + F.col("external")), F.lit(0.0)))


def mean_isolation(edges: DataFrame, members: DataFrame) -> DataFrame:
    return isolation(edges, members).agg(F.avg("isolation").alias("isolation"), F.count(F.lit(1)).alias("n_communities"))


def internal_density(edges: DataFrame, members: DataFrame) -> DataFrame:
    """comm, n, density: internal edges / (n (n-1) / 2), for communities of two nodes at least."""
    held = members.select("node", "comm").distinct()
    sizes = held.groupBy("comm").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    inner = internal_edges(graph.simplified(edges), held).groupBy("comm").agg(F.count(F.lit(1)).alias("e"))
    return sizes.join(inner, "comm", "left").select("comm", "n", (F.coalesce("e", F.lit(0)) / (F.col("n") * (F.col("n") - 1) / 2)).alias("density"))


def eigenvector(edges: DataFrame, tol: float = 1e-9, most: int = 200, rounds: int | None = None) -> DataFrame:
    """node, eigenvector: power iteration from equal values on A + I (which converges on bipartite graphs too), norm 1.

    Stops when no value moves by ``tol``, or after exactly ``rounds`` rounds; without ``rounds``, values that still
    move after ``most`` rounds raise RuntimeError. A round reads the values once; they are
    written (and brought back to norm 1) after every round, or every fifth where nothing is compared, so that lineage
    and plans stay short and values finite.
    """
    nodes = graph.vertices(edges)
    near = written(graph.adjacency(edges).unionByName(nodes.select(F.col("node").alias("u"), F.col("node").alias("v"))), "near")
    now = nodes.select("node", F.lit(1.0).alias("x"))
    for k in range(1, (rounds if rounds is not None else most) + 1):
        raw = near.join(now.select(F.col("node").alias("u"), "x"), "u").groupBy(F.col("v").alias("node")).agg(F.sum("x").alias("x"))
        if rounds is not None and k % 5 and k < rounds:
            now = raw
            continue
        raw = written(raw, "eigenvector")
        norm = raw.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0]
        new = raw.select("node", (F.col("x") / F.lit(norm)).alias("x"))
        if rounds is None:
            moved = new.join(now.withColumnRenamed("x", "old"), "node").agg(F.max(F.abs(F.col("x") - F.col("old")))).first()[0]
            if moved is None or moved < tol:
                now = new
                break
        now = new
    else:
        if rounds is None:
            raise RuntimeError(f"eigenvector centrality did not settle within {tol} in {most} rounds")
    return now.select("node", F.col("x").alias("eigenvector"))


def sources_for(n: int, epsilon: float, delta: float = 0.1) -> int:
    """How many sources of ``n`` nodes keep every node's normalised betweenness within ``epsilon``, with chance 1 - ``delta``.

    A source's share of a node's normalised betweenness lies between 0 and 1, so that Hoeffding's bound holds for one
    node and the union bound for all; where that asks for more sources than there are, all are walked.
    """
    return min(n, math.ceil(math.log(2 * n / delta) / (2 * epsilon * epsilon))) if n else 0


def _levels(near: DataFrame, start: DataFrame, name: str) -> list[DataFrame]:
    """source, node, paths for each distance from the sources: how many shortest paths lead there.

    Neighbours of a level lie in it, in the one before or in the next, so that only two levels are held against it.
    """
    levels = [start]
    while True:
        met = levels[-1].join(near, "node").select("source", F.col("next").alias("node"), "paths", F.lit(False).alias("old"))
        for level in levels[-2:]:
            met = met.unionByName(level.select("source", "node", F.lit(0.0).alias("paths"), F.lit(True).alias("old")))
        ahead = met.groupBy("source", "node").agg(F.sum("paths").alias("paths"), F.max("old").alias("old")).where("not old")
        ahead = written(ahead.select("source", "node", "paths"), f"{name}/level")
        if ahead.isEmpty():
            return levels
        levels.append(ahead)


def _dependencies(near: DataFrame, levels: list[DataFrame], name: str) -> list[DataFrame]:
    """source, node, paths, dep for each level between the sources and the farthest nodes, the farthest first."""
    out, below = [], levels[-1].withColumn("dep", F.lit(0.0))
    for level in levels[-2:0:-1]:
        up = below.select("source", "node", ((1 + F.col("dep")) / F.col("paths")).alias("share")).join(near, "node")
        up = up.select("source", F.col("next").alias("node"), "share", F.lit(None).cast("double").alias("paths"))
        own = level.select("source", "node", F.lit(0.0).alias("share"), "paths")
        here = up.unionByName(own).groupBy("source", "node").agg(F.sum("share").alias("share"), F.max("paths").alias("paths")).where("paths is not null")
        below = written(here.select("source", "node", "paths", (F.col("paths") * F.col("share")).alias("dep")), f"{name}/dependencies")
        out.append(below)
    return out


def betweenness(edges: DataFrame, sources: DataFrame | None = None, epsilon: float | None = None, delta: float = 0.1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """node, betweenness: shortest-path dependencies from the sources, scaled to all sources; each pair of ends counts once.

    Without ``sources``, all nodes are walked from (exact), or with ``epsilon`` as many random ones as ``sources_for``
    says: then betweenness / (n (n-1) / 2) is right within ``epsilon`` for all nodes at once, with chance 1 - ``delta``.
    Sources go in blocks that make about ``block_rows`` rows in each direction; each level of a block is joined to
    the adjacency and written to the shared folder, and a block's tables go when it has been added up.
    """
    spark = edges.sparkSession
    nodes = written(graph.vertices(edges), "nodes")
    near = written(graph.adjacency(graph.simplified(edges)).withColumnsRenamed({"u": "node", "v": "next"}), "near")
    n, links = nodes.count(), near.count()
    chosen = ranked((nodes if sources is None else sources).select("node"), [draw_key("sources", F.col("node")).asc(), F.col("node").asc()], name="source")
    if sources is None and epsilon is not None:
        chosen = chosen.where(F.col("source") < sources_for(n, epsilon, delta))
    chosen = written(chosen.select("source", "node", F.lit(1.0).alias("paths")), "sources")
    n_sources = chosen.count()
    step, total, any_dep = max(1, block_rows // max(links, 1)), new_folder(spark, "betweenness"), False
    for first in range(0, n_sources, step):
        name = f"walk-{uuid.uuid4().hex}"
        levels = _levels(near, chosen.where((F.col("source") >= first) & (F.col("source") < first + step)), name)
        found = _dependencies(near, levels, name)
        if found:
            reduce(DataFrame.unionByName, found).groupBy("node").agg(F.sum("dep").alias("x")).write.mode("append").parquet(total)
            any_dep = True
        dropped(spark, name)
    if not any_dep:
        return nodes.select("node", F.lit(0.0).alias("betweenness"))
    parts = spark.read.parquet(total).groupBy("node").agg(F.sum("x").alias("x"))
    return nodes.join(parts, "node", "left").select("node", (F.coalesce("x", F.lit(0.0)) * (n / n_sources) / 2).alias("betweenness"))
