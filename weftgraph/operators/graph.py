"""Undirected graphs as tables: edges(u, v) is a bag, so that loops and parallel edges count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import stars


def adjacency(edges: DataFrame) -> DataFrame:
    """u, v in both directions; a loop gives two rows."""
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def vertices(edges: DataFrame) -> DataFrame:
    """node: every end of an edge."""
    return edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()


def contiguous(edges: DataFrame) -> DataFrame:
    """node: 0 to the largest id, ids without edges included; made in parallel."""
    largest = edges.agg(F.max(F.greatest("u", "v"))).first()[0]
    return edges.sparkSession.range(0 if largest is None else largest + 1).select(F.col("id").alias("node"))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, degree: edge ends of each node; a loop counts two, nodes without edges have 0."""
    d = edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return d if nodes is None else nodes.join(d, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def simplified(edges: DataFrame) -> DataFrame:
    """Each pair of different nodes once, the smaller id first."""
    return edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    kept = nodes.select("node")
    return edges.join(kept.withColumnRenamed("node", "u"), "u", "left_semi").join(kept.withColumnRenamed("node", "v"), "v", "left_semi").select("u", "v")


def members_from_arrays(node_comms: DataFrame) -> DataFrame:
    """node, comm of node, comms; each pair once."""
    return node_comms.select("node", F.explode("comms").alias("comm")).distinct()


def communities_of(members: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, comms: the sorted set of each node's communities; with ``nodes``, empty for those without any."""
    out = members.groupBy("node").agg(F.array_sort(F.collect_set("comm")).alias("comms"))
    return out if nodes is None else nodes.select("node").join(out, "node", "left").withColumn("comms", F.coalesce("comms", F.array().cast(dict(out.dtypes)["comms"])))


def overlapping(members: DataFrame) -> DataFrame:
    """node: those of more than one community."""
    return members.distinct().groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, component (its smallest node); nodes without edges are their own."""
    found = stars(edges)
    return found if nodes is None else nodes.select("node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def giant(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node: those of the largest component; of equally large ones, that with the smallest node."""
    of = components(edges, nodes)
    largest = of.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
    return of.join(F.broadcast(largest), "component", "left_semi").select("node")  # one row


def is_connected(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row: connected (a graph without nodes isn't)."""
    return components(edges, nodes).agg((F.count_distinct("component") == 1).alias("connected"))
