"""Assortativity of a scalar over edge ends, and what single nodes, edges and communities add to it.

Sums of degrees and scalars are exact integers; one double expression at the end uses them, so that results don't
depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import written
from . import graph


def with_neighbours(edges: DataFrame, values: DataFrame) -> DataFrame:
    """node, s, d (degree), near (sum of s over neighbours); values: node, s. Nodes without edges have 0."""
    of = values.select(F.col("node").alias("v"), F.col("s").alias("sv"))
    sums = graph.adjacency(edges).join(of, "v").groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("d"), F.sum("sv").alias("near"))
    return values.join(sums, "node", "left").select("node", "s", F.coalesce("d", F.lit(0)).alias("d"), F.coalesce("near", F.lit(0)).alias("near"))


def moments(table: DataFrame, of: Column | None = None) -> DataFrame:
    """One row: ends (edge ends), mu, var of the scalar over them, sum_cross of products over both directions.

    With ``of``, an expression of the node that names its graph: one row a graph, with that name as ``of``.
    """
    by = [] if of is None else [of.alias("of")]
    sums = table.groupBy(*by).agg(F.sum("d").alias("ends"), F.sum(F.col("d") * F.col("s")).alias("ds"), F.sum(F.col("d") * F.col("s") * F.col("s")).alias("dss"), F.sum(F.col("s") * F.col("near")).alias("cross"))
    mean = F.try_divide("ds", "ends")
    return sums.select(*(["of"] if by else []), "ends", mean.alias("mu"), (F.try_divide("dss", "ends") - mean * mean).alias("var"), F.try_divide("cross", "ends").alias("cross"))


def _checked(m: DataFrame) -> DataFrame:
    bad = F.col("ends").isNull() | (F.col("ends") == 0) | (F.col("var") <= 1e-15)
    return m.withColumn("var", F.when(bad, F.raise_error(F.lit("no edges, or the scalar has zero variance over edge ends")).cast("double")).otherwise(F.col("var")))


def _beside_moments(table: DataFrame, of: Column | None) -> DataFrame:
    """``table`` with the moments of its graph in each row."""
    if of is None:
        return table.crossJoin(F.broadcast(_checked(moments(table))))  # one row
    return table.withColumn("of", of).join(_checked(moments(table, of)), "of")  # one row a graph


def hv(edges: DataFrame, values: DataFrame, of: Column | None = None) -> DataFrame:
    """node, s, hv: each node's part of the assortativity, (s-mu) (near - d mu) / (4 M var). They sum to r / 2.

    Sums over neighbours are written, as the moments and the rows both read them. With ``of`` as in ``moments``, each
    node's part of its own graph's.
    """
    t = written(with_neighbours(edges, values), "neighbours")
    return _beside_moments(t, of).select("node", "s", F.expr("(s - mu) * (near - d * mu) / (2 * ends * var)").alias("hv"))


def ghv(edges: DataFrame, values: DataFrame, of: Column | None = None) -> DataFrame:
    """node, s, ghv: (s-mu) (near - d mu) / (d var), 0 without edges. Weighted by degree they average to r."""
    t = written(with_neighbours(edges, values), "neighbours")
    return _beside_moments(t, of).select("node", "s", F.expr("if(d = 0, 0D, (s - mu) * (near - d * mu) / (d * var))").alias("ghv"))


def assortativity(edges: DataFrame, values: DataFrame, digits: int | None = None, of: Column | None = None) -> DataFrame:
    """One row (with ``of``, one a graph): r, the correlation of the scalar over both directions of edges; null if its variance is 0."""
    r = F.when(F.col("var") > 1e-15, (F.col("cross") - F.col("mu") * F.col("mu")) / F.col("var"))
    return moments(with_neighbours(edges, values), of).select(*([] if of is None else ["of"]), (F.bround(r, digits) if digits is not None else r).alias("r"))


def degree_assortativity(edges: DataFrame, digits: int | None = None) -> DataFrame:
    return assortativity(edges, graph.degrees(edges).withColumnRenamed("degree", "s"), digits)


def edge_homophily(edges: DataFrame, values: DataFrame) -> DataFrame:
    """u, v, h_e = (s_u - mu)(s_v - mu) / (M var): own definition, so that the edges' values sum to r."""
    m = _checked(moments(with_neighbours(edges, values)))
    a, b = (values.select(F.col("node").alias(n), F.col("s").alias(f"s_{n}")) for n in ("u", "v"))
    return edges.join(a, "u").join(b, "v").crossJoin(F.broadcast(m)).select("u", "v", F.expr("(s_u - mu) * (s_v - mu) / (ends / 2 * var)").alias("h_e"))


def internal_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """comm, u, v: edges with both ends in a community, once for each such community."""
    held = members.select("node", "comm").distinct()
    return edges.join(held.withColumnRenamed("node", "u"), "u").join(held.withColumnRenamed("node", "v"), ["v", "comm"]).select("comm", "u", "v")


def community_homophily(edges: DataFrame, values: DataFrame, members: DataFrame) -> DataFrame:
    """comm, n_members, h_c: mean of (s_u - mu)(s_v - mu) / var over internal edges, null without any (own definition).

    Sums of s_u + s_v and of s_u s_v are exact integers.
    """
    m = _checked(moments(with_neighbours(edges, values)))
    a, b = (values.select(F.col("node").alias(n), F.col("s").alias(f"s_{n}")) for n in ("u", "v"))
    inner = internal_edges(edges, members).join(a, "u").join(b, "v").groupBy("comm").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("s_u") * F.col("s_v")).alias("p"), F.sum(F.col("s_u") + F.col("s_v")).alias("t"))
    sizes = members.select("node", "comm").distinct().groupBy("comm").agg(F.count(F.lit(1)).alias("n_members"))
    return sizes.join(inner, "comm", "left").crossJoin(F.broadcast(m)).select("comm", "n_members", F.expr("(p - mu * t + n * mu * mu) / (n * var)").alias("h_c"))


def community_summary(of_communities: DataFrame) -> DataFrame:
    """One row: hc_weighted (by size; communities without a value count in the denominator), n_communities."""
    return of_communities.agg((F.sum(F.coalesce(F.col("h_c") * F.col("n_members"), F.lit(0.0))) / F.sum("n_members")).alias("hc_weighted"), F.count(F.lit(1)).alias("n_communities"))


def by_method(edges: DataFrame, members: DataFrame, methods: tuple[str, ...], measure: str = "hv") -> DataFrame:
    """node, and for each method its scalar and hv_<method> (or ghv_<method>), joined by node."""
    from .scalars import scalar

    out = graph.vertices(edges)
    for m in methods:
        one = (hv if measure == "hv" else ghv)(edges, scalar(m, edges, members))
        out = out.join(one.select("node", F.col(measure).alias(f"{measure}_{m}"), F.col("s").alias(m)), "node", "left")
    return out
