"""Descriptors of a dataset, checks of a network, and unified metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import sign_class
from ..plans.tables import written
from ..schema import require_columns
from . import graph
from .homophily import assortativity, degree_assortativity
from .scalars import scalar
from .structure import clustering


def plurality(members: DataFrame, nodes: DataFrame, distinct: bool = True) -> DataFrame:
    """One row: n_in (nodes in a community), n_overlapped, m_sum, max_m, n_comms, c_sum, max_c over present nodes.

    ``distinct=False`` counts a node as often as a community lists it.
    """
    held = members.select("node", "comm").join(nodes.select("node"), "node", "left_semi")
    held = held.distinct() if distinct else held
    m = held.groupBy("node").agg(F.count(F.lit(1)).alias("m")).agg(F.count(F.lit(1)).alias("n_in"), F.coalesce(F.sum((F.col("m") > 1).cast("long")), F.lit(0)).alias("n_overlapped"), F.coalesce(F.sum("m"), F.lit(0)).alias("m_sum"), F.coalesce(F.max("m"), F.lit(0)).alias("max_m"))
    c = held.groupBy("comm").agg(F.count(F.lit(1)).alias("c")).agg(F.count(F.lit(1)).alias("n_comms"), F.coalesce(F.sum("c"), F.lit(0)).alias("c_sum"), F.coalesce(F.max("c"), F.lit(0)).alias("max_c"))
    return m.crossJoin(c)  # one row each


def average_clustering(edges: DataFrame) -> DataFrame:
    """One row: avg_clustering over nodes of degree 2 at least, 0 if there are none."""
    return clustering(edges).agg(F.coalesce(F.avg("clustering"), F.lit(0.0)).alias("avg_clustering"))


def density(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: n, e, density = e / (n (n-1) / 2), 0 for one node or none."""
    n, e = nodes.agg(F.count(F.lit(1)).alias("n")), edges.agg(F.count(F.lit(1)).alias("e"))
    return n.crossJoin(e).withColumn("density", F.when(F.col("n") > 1, F.col("e") / (F.col("n") * (F.col("n") - 1) / 2)).otherwise(F.lit(0.0)))


def descriptors(edges: DataFrame, members: DataFrame, dataset: str, methods: tuple[str, ...] = ("s1",), largest: bool = True, community_sizes: bool = True, distinct: bool = True) -> DataFrame:
    """One row that describes a dataset, on its largest component or all of it, rounded as in published tables.

    Each part is a single row; they are put side by side.
    """
    # every part reads these, each for itself
    nodes = written(graph.giant(edges) if largest else graph.vertices(edges), "nodes")
    own = written(graph.induced(edges, nodes), "own") if largest else edges
    members = written(members.join(nodes, "node", "left_semi"), "held")
    t = density(own, nodes).crossJoin(plurality(members, nodes, distinct)).crossJoin(average_clustering(own)).crossJoin(degree_assortativity(own, 4))
    for m in methods:
        t = t.crossJoin(assortativity(own, scalar(m, own, members, nodes), 4).withColumnRenamed("r", f"h_{m}"))
    ratio = lambda a, b, d: F.bround(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), d)
    sizes = [ratio("c_sum", "n_comms", 2).alias("avg_comm_size"), F.col("max_c").alias("max_comm_size")] if community_sizes else []
    mean_degree = F.bround(F.coalesce(F.try_divide(2 * F.col("e"), F.col("n")), F.lit(0.0)), 2)
    return t.select(
        F.lit(dataset).alias("dataset"), "n", "e", mean_degree.alias("mean_degree"), F.bround("density", 5).alias("density"), "n_comms", ratio("m_sum", "n_in", 2).alias("mean_m"), "max_m", *sizes,
        ratio("n_in", "n", 4).alias("prop_nodes_in_comms"), ratio("n_overlapped", "n_in", 4).alias("prop_overlapped"), ratio("n_overlapped", "n", 4).alias("prop_overlapped_all"), "r", F.bround("avg_clustering", 4).alias("avg_clustering"), *[f"h_{m}" for m in methods],
    )


def network_check(edges: DataFrame) -> DataFrame:
    """One row of counts and flags: ids 0 to the largest against ids with edges, components, loops, parallel edges.

    Loops and parallel edges are counted apart: a loop that occurs twice is two loops and no parallel edge.
    """
    seen = graph.vertices(edges)
    own = seen.agg(F.count(F.lit(1)).alias("n_nodes"), (F.coalesce(F.max("node"), F.lit(-1)) + 1).alias("n_ids"), F.coalesce(F.sum((F.col("node") < 0).cast("long")), F.lit(0)).alias("n_outside"))
    e = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.coalesce(F.sum((F.col("u") == F.col("v")).cast("long")), F.lit(0)).alias("n_self_loops"))
    simple = graph.simplified(edges).agg(F.count(F.lit(1)).alias("n_simple"))
    parts = graph.components(edges, seen).groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_components"), F.coalesce(F.max("n"), F.lit(0)).alias("giant_size"))
    t = own.crossJoin(e).crossJoin(simple).crossJoin(parts)
    multi = F.col("n_edges") - F.col("n_self_loops") - F.col("n_simple")
    return t.select(
        "n_ids", "n_nodes", (F.col("n_ids") - (F.col("n_nodes") - F.col("n_outside"))).alias("n_isolated"), "n_edges", "n_components", "giant_size",
        "n_self_loops", (F.col("n_self_loops") > 0).alias("has_self_loops"), multi.alias("n_multiedges"), (multi > 0).alias("has_multiedges"), "n_outside",
    )


def unified(*tables: DataFrame) -> DataFrame:
    """Metric tables side by side by node (full outer); of columns that several have, the first one's stay."""
    out = require_columns(tables[0], "node")
    for t in tables[1:]:
        require_columns(t, "node")
        new = [c for c in t.columns if c == "node" or c not in out.columns]
        if len(new) > 1:
            out = out.join(t.select(*new), "node", "full_outer")
    return out


def styled(edges: DataFrame, of_edges: DataFrame, eps: float = 1e-3) -> DataFrame:
    """u, v, h_e, class (by sign), width (relative to the largest size); joined by unordered pairs of nodes."""
    pair = [F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")]
    t = edges.select("u", "v", *pair).join(of_edges.select(*pair, "h_e"), ["a", "b"], "left")
    top = t.agg(F.max(F.abs("h_e")).alias("top"))
    return t.crossJoin(F.broadcast(top)).select("u", "v", "h_e", sign_class(F.col("h_e"), eps).alias("class"), F.try_divide(F.abs("h_e"), "top").alias("width"))
