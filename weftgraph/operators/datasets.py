"""Many graphs in one job: nodes are keyed by graph, and what is per graph (moments, ranks, quartiles, draws) is grouped by it.

Side by side in one table, graphs are one graph whose components never meet: operators that join, count and compare
nodes hold for it as they are. A node is a struct (dataset, node), which is ordered by dataset first. What is taken
over a whole graph elsewhere is taken over each here, in the same jobs, so that many small graphs cost no more rounds
than one, and a large one among them is spread like any large key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import written
from . import graph, homophily, ier, removal, scalars, structure

BY = ("dataset",)


def keyed(tables: dict[str, DataFrame], *columns: str) -> DataFrame:
    """The tables of several datasets as one, with (dataset, node) structs in place of the node ids in ``columns``."""
    if not tables:
        raise ValueError("no datasets given")
    return reduce(DataFrame.unionByName, [key_nodes(t.withColumn("dataset", F.lit(name)), *columns).drop("dataset") for name, t in tables.items()])


def key_nodes(table: DataFrame, *columns: str) -> DataFrame:
    """``table``, which has a column dataset, with (dataset, node) structs in place of the node ids in ``columns``."""
    return table.withColumns({c: F.struct("dataset", F.col(c).alias("node")) for c in columns})


def flat(table: DataFrame, column: str = "node") -> DataFrame:
    """dataset and the plain node id in place of the struct."""
    rest = [c for c in table.columns if c != column]
    return table.select(F.col(f"{column}.dataset").alias("dataset"), F.col(f"{column}.node").alias(column), *rest)


def hv(edges: DataFrame, members: DataFrame, method: str = "s1") -> DataFrame:
    """dataset, node, s, hv: each node's part of its own graph's assortativity."""
    return flat(homophily.hv(edges, scalars.scalar(method, edges, members), of=F.col("node.dataset")))


def assortativity(edges: DataFrame, members: DataFrame, method: str = "s1") -> DataFrame:
    """dataset, r of each graph; null where its scalar's variance is 0."""
    return homophily.assortativity(edges, scalars.scalar(method, edges, members), of=F.col("node.dataset")).withColumnRenamed("of", "dataset")


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """dataset, node, component (the smallest node id in it): one search for all graphs."""
    return flat(graph.components(edges, nodes)).withColumn("component", F.col("component.node"))


def component_summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """dataset, n_nodes, n_components, giant (smallest node of the largest component), giant_size."""
    sizes = components(edges, nodes).groupBy("dataset", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = F.max(F.struct("n", (-F.col("component")).alias("minus")))
    return sizes.groupBy("dataset").agg(F.sum("n").alias("n_nodes"), F.count(F.lit(1)).alias("n_components"), (-largest["minus"]).alias("giant"), largest["n"].alias("giant_size"))


def metrics(edges: DataFrame, members: DataFrame) -> DataFrame:
    """dataset, node, hv_s1, bridgecc."""
    return hv(edges, members).select("dataset", "node", F.col("hv").alias("hv_s1")).join(flat(structure.bridgecc(edges)), ["dataset", "node"])


def weight_curves(edges: DataFrame, members: DataFrame, ranks: DataFrame, step: float = 0.02) -> DataFrame:
    """dataset, strategy, k, p, value: inter-community weight with k of each graph's nodes removed (``removal.weight_curve``, exact).

    ranks: dataset, strategy, node, rank; all strategies of a graph rank the same nodes. Points of the curves are few
    for each graph and strategy; an edge adds to the last point that it survives.
    """
    inter = removal.inter_edges(edges, members).select(F.col("u.dataset").alias("dataset"), F.col("u.node").alias("u"), F.col("v.node").alias("v"), "w")
    a, b = (ranks.select("dataset", "strategy", F.col("node").alias(x), F.col("rank").alias(f"r{x}")) for x in ("u", "v"))
    deaths = inter.join(a, ["dataset", "u"]).join(b, ["dataset", "strategy", "v"]).select("dataset", "strategy", F.least("ru", "rv").alias("death"), "w")
    sizes = ranks.groupBy("dataset", "strategy").agg(F.count(F.lit(1)).alias("n"))
    points = int(1 / step + 1e-9) + 1
    ks = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.least(F.greatest(F.bround(i * F.lit(step) * F.col("n"), 0), F.lit(0.0)), F.col("n").cast("double")).cast("long")))
    frame = sizes.select("dataset", "strategy", "n", F.array_sort(ks).alias("ks"))
    at = F.size(F.filter("ks", lambda k: k <= F.col("death"))) - 1
    alive = deaths.join(frame, ["dataset", "strategy"]).groupBy("dataset", "strategy", at.alias("i")).agg(F.sum("w").alias("w"))
    return removal.survived(frame.select("dataset", "strategy", "n", F.posexplode("ks").alias("i", "k")), alive, ("dataset", "strategy"))


class Ratios:
    """Inter-edge ratios of several graphs in one job; tables that several statistics read are written once.

    ``edges`` and ``members`` are read several times and aren't written again: give tables that are cheap to read.
    """

    def __init__(self, edges: DataFrame, members: DataFrame, budget: float = 0.10, taus: tuple[float, ...] = ier.TAUS):
        self.sets = written(ier.target_sets(written(metrics(edges, members), "metrics"), budget, BY), "sets")
        self.quartiles = written(ier.degree_quartiles(flat(graph.degrees(edges)), BY), "quartiles")
        self.inter = written(flat(ier.inter_degrees(edges, members, graph.vertices(edges), taus)), "inter-degrees")

    def observed(self) -> DataFrame:
        return ier.observed(self.sets, self.inter, self.quartiles, BY)

    def null(self, repeats: int = 500, seed: int = 42) -> DataFrame:
        return written(ier.null_statistics(self.sets, self.inter, self.quartiles, repeats, seed, BY), "null")

    def summary(self, boot: int = 300, repeats: int = 500, seed: int = 42) -> DataFrame:
        """The standard rows: one for each dataset, tau and strategy."""
        obs = written(self.observed(), "observed")
        return ier.summary(obs, ier.bootstrap(self.sets, self.inter, self.quartiles, boot, seed, BY), ier.permutation_p(self.null(repeats, seed), obs, BY), None, repeats, BY)

    def deltas(self, repeats: int = 500, seed: int = 42) -> DataFrame:
        return ier.deltas(self.null(repeats, seed), written(self.observed(), "observed"), None, BY)


def low_ranks(table: DataFrame, column: str, ascending: bool, strategy: str) -> DataFrame:
    """dataset, strategy, node, rank within each graph by a metric (ties: smaller node)."""
    return removal.metric_ranks(table, column, ascending, strategy, BY)


def random_ranks(nodes: DataFrame, repeats: int, seed: int = 12345) -> DataFrame:
    """dataset, strategy, node, rank: each graph's own random permutations, the same as when it is alone."""
    return removal.random_ranks(nodes, repeats, seed, BY)
