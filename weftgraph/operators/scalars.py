"""Scalars that communities give to nodes: s0 to s4."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph


def _shared(edges: DataFrame, members: DataFrame) -> DataFrame:
    """u, comm for each edge end u and each community that it shares with the other end."""
    held = members.select("node", "comm").distinct()
    near = graph.adjacency(edges).join(held.withColumnRenamed("node", "u"), "u")
    return near.join(held.withColumnRenamed("node", "v"), ["v", "comm"]).select("u", "comm")


def _on(nodes: DataFrame, counted: DataFrame) -> DataFrame:
    return nodes.select("node").join(counted, "node", "left").select("node", F.coalesce("s", F.lit(0)).alias("s"))


def degree(edges: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    return graph.degrees(edges, nodes).select("node", F.col("degree").alias("s"))


def shared_communities(edges: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Own communities that at least one neighbour has."""
    return _on(nodes, _shared(edges, members).distinct().groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("s")))


def own_communities(edges: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    return _on(nodes, members.select("node", "comm").distinct().groupBy("node").agg(F.count(F.lit(1)).alias("s")))


def overlap_total(edges: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Communities shared with a neighbour, summed over neighbours; parallel edges count each."""
    return _on(nodes, _shared(edges, members).groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("s")))


METHODS: dict[str, Callable[[DataFrame, DataFrame, DataFrame], DataFrame]] = {
    "s0": degree,
    "s1": shared_communities,
    "s2": own_communities,
    "s3": overlap_total,
    "s4": shared_communities,
}


def scalar(method: str, edges: DataFrame, members: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, s of every node. ValueError for an unknown method."""
    if method not in METHODS:
        raise ValueError(f"unknown scalar {method!r}; there are {sorted(METHODS)}")
    return METHODS[method](edges, members, graph.vertices(edges) if nodes is None else nodes)


def require_variance(values: DataFrame) -> DataFrame:
    """``values`` with a check that s isn't the same everywhere; reading it fails otherwise."""
    range_ = values.agg(F.min("s").alias("lo_"), F.max("s").alias("hi_"))
    checked = range_.withColumn("ok_", F.when(F.col("lo_") == F.col("hi_"), F.raise_error(F.lit("the scalar has zero variance")).cast("boolean")).otherwise(F.lit(True)))
    return values.crossJoin(F.broadcast(checked.select("ok_"))).where("ok_").drop("ok_")  # one row
