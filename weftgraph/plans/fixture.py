"""The fixture graph that queries run on: parts that share an order, with suppliers as overlapping communities."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import datasets, graph, homophily, removal, scalars, structure
from ..sources import names, sinks, text
from .tables import new_folder, written


def rounded(df: DataFrame, digits: int = 10) -> DataFrame:
    """All doubles rounded: sums of doubles differ in their last digits with the order of rows."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@dataclass
class Fixture:
    """Lazily made tables of one scale. Edges and members, which everything is made from, are written once a query."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/lineitem.parquet")

    @cached_property
    def edges(self) -> DataFrame:
        """Distinct pairs u < v of parts with returned lines in one order; an order has a few lines."""
        r = self.lineitem.where("l_returnflag = 'R'").select("l_orderkey", "l_partkey")
        a, b = r.withColumnRenamed("l_partkey", "u"), r.withColumnRenamed("l_partkey", "v")
        return written(a.join(b, "l_orderkey").where("u < v").select("u", "v").distinct(), "edges")

    @cached_property
    def members(self) -> DataFrame:
        return written(self.lineitem.where("l_quantity >= 45").select(F.col("l_partkey").alias("node"), F.col("l_suppkey").cast("int").alias("comm")).distinct(), "members")

    @cached_property
    def nodes(self) -> DataFrame:
        return graph.vertices(self.edges)

    @cached_property
    def degrees(self) -> DataFrame:
        return graph.degrees(self.edges)

    def scalar(self, method: str) -> DataFrame:
        return scalars.scalar(method, self.edges, self.members, self.nodes)

    def hv(self, method: str = "s1") -> DataFrame:
        return homophily.hv(self.edges, self.scalar(method))

    @cached_property
    def metrics(self) -> DataFrame:
        """node, hv_s1, bridgecc."""
        return self.hv("s1").select("node", F.col("hv").alias("hv_s1")).join(structure.bridgecc(self.edges, self.nodes), "node")

    @cached_property
    def inter(self) -> DataFrame:
        return removal.inter_edges(self.edges, self.members)

    @cached_property
    def low_hv(self) -> DataFrame:
        return removal.metric_ranks(self.hv("s1").withColumnRenamed("hv", "hv_s1"), "hv_s1", True, "low_hv")

    def random(self, repeats: int = 20) -> DataFrame:
        return removal.random_ranks(self.nodes, repeats)

    @cached_property
    def datasets(self) -> tuple[DataFrame, DataFrame]:
        """Edges and members of three graphs, of which the fixture graph is one: parts whose lines in one order have the same return flag."""
        r = self.lineitem.select(F.col("l_returnflag").alias("dataset"), "l_orderkey", "l_partkey")
        a, b = r.withColumnRenamed("l_partkey", "u"), r.withColumnRenamed("l_partkey", "v")
        edges = a.join(b, ["dataset", "l_orderkey"]).where("u < v").select("dataset", "u", "v").distinct()
        members = self.members.withColumn("dataset", F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))))
        return written(datasets.key_nodes(edges, "u", "v").drop("dataset"), "edges"), datasets.key_nodes(members, "node").drop("dataset")

    def named(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The fixture graph with names for nodes, by way of files: dictionary, and edges and members with ids from it."""
        path = new_folder(self.spark, "named")
        name = lambda c: F.concat(F.lit("part-"), F.col(c).cast("string")).alias(c)
        sinks.write_edges(self.edges.select(name("u"), name("v")), f"{path}/network")
        sinks.write_communities(self.members.select(name("node"), "comm"), f"{path}/communities")
        edges, members = text.read_edges(self.spark, f"{path}/network", kind="string"), text.read_communities(self.spark, f"{path}/communities", kind="string")
        ids = names.dictionary(names.names_in((edges, ("u", "v")), (members, ("node",))))
        return ids, written(names.encoded(edges, ids, "u", "v"), "edges"), written(names.encoded(members, ids, "node"), "members")
