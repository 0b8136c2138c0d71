"""One query for each operator, over the fixture graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, curves, datasets, describe, graph, homophily, ier, paths, published, removal, scalars, structure
from ..sources import names, sinks
from ..sources.text import DatasetPaths
from .fixture import Fixture, rounded
from .project import DatasetProject
from .tables import new_folder, written

REPEATS, BOOT, PERM = 20, 300, 500


def _curve(g: Fixture, repeats: int = REPEATS) -> DataFrame:
    return removal.weight_curve(g.inter, g.low_hv.unionByName(g.random(repeats)))


def _normal(g: Fixture) -> DataFrame:
    # 21 curves of 51 points: written once, read by the band and by the target
    return curves.normalised(written(_curve(g), "curves"))


def _h_curve(g: Fixture) -> DataFrame:
    n = g.nodes.count()
    h = removal.homophily_trajectory(g.edges, g.scalar("s1"), g.low_hv, removal.grid(n))
    return h.select("strategy", F.lit("homophily").alias("metric"), (F.col("k") / F.lit(n)).alias("fraction_removed"), F.col("h").alias("metric_value"))


class Ier:
    """What the statistics of ranked sets share; sets and degrees are small and are written once."""

    def __init__(self, g: Fixture):
        self.sets = written(ier.target_sets(written(g.metrics, "metrics")), "sets")
        self.quartiles = written(ier.degree_quartiles(g.degrees), "quartiles")
        self.inter = written(ier.inter_degrees(g.edges, g.members, g.nodes), "inter-degrees")

    def observed(self) -> DataFrame:
        return ier.observed(self.sets, self.inter, self.quartiles)

    def seen(self) -> DataFrame:
        """``observed`` for plans that read it several times: a few rows, written once."""
        return written(self.observed(), "observed")

    def boot(self) -> DataFrame:
        return ier.bootstrap(self.sets, self.inter, self.quartiles, BOOT)

    def null(self) -> DataFrame:
        return written(ier.null_statistics(self.sets, self.inter, self.quartiles, PERM), "null")

    def legacy(self) -> DataFrame:
        return published.legacy_rows(self.null(), self.seen(), self.boot(), "fixture")

    def summary(self) -> DataFrame:
        obs = self.seen()
        return ier.summary(obs, self.boot(), ier.permutation_p(self.null(), obs), "fixture", PERM)


def _trajectory(g: Fixture) -> DataFrame:
    m = written(g.metrics, "metrics")
    ranks = removal.metric_ranks(m, "hv_s1", True, "low_hv").unionByName(removal.metric_ranks(m, "bridgecc", False, "bridgecc"))
    return removal.component_trajectory(g.edges, g.nodes, written(ranks, "ranks"))


def _all_metrics(g: Fixture) -> DataFrame:
    hv = homophily.by_method(g.edges, g.members, ("s1", "s0"))
    t = describe.unified(hv, structure.bridgecc(g.edges, g.nodes), g.degrees, structure.num_communities(g.nodes, g.members), structure.overlap_rank(g.edges, g.members).drop("degree"))
    return structure.with_delta(structure.restricted(t, g.nodes))


def _markers(g: Fixture) -> DataFrame:
    m = written(g.hv("s1").withColumnRenamed("hv", "hv_s1"), "hv")
    return published.sensitivity_markers(g.edges, g.members, m, curves.relative_homophily(written(_h_curve(g), "h-curve")), "fixture")


def _resumed(g: Fixture) -> DataFrame:
    old = homophily.by_method(g.edges, g.members, ("s1",))
    return published.resumed(g.nodes, old, homophily.by_method(g.edges, published.memberships(g.members, None), ("s0", "s1")))


def _named_hv(g: Fixture) -> DataFrame:
    ids, edges, members = g.named()
    return names.decoded(homophily.hv(edges, scalars.scalar("s1", edges, members)), ids)


def _project(g: Fixture) -> DataFrame:
    folder = new_folder(g.spark, "project")
    paths = DatasetPaths(f"{folder}/files", "fixture")
    named = lambda c: F.concat(F.lit("part-"), F.col(c).cast("string")).alias(c)
    sinks.write_edges(g.edges.select(named("u"), named("v")), paths.network)
    sinks.write_communities(g.members.select(named("node"), "comm"), paths.communities)
    return DatasetProject(g.spark, f"{folder}/tables", paths, named=True).run("published").table("published", "all_metrics")


def _dataset_curves(g: Fixture) -> DataFrame:
    edges, members = g.datasets
    low = datasets.low_ranks(datasets.hv(edges, members).withColumnRenamed("hv", "hv_s1"), "hv_s1", True, "low_hv")
    ranks = low.unionByName(datasets.random_ranks(datasets.flat(graph.vertices(edges)), 2))
    return datasets.weight_curves(edges, members, written(ranks, "ranks"))


TABLES: dict[str, Callable[[Fixture], DataFrame]] = {
    "edges_canonical": lambda g: graph.simplified(g.edges),
    "adjacency": lambda g: graph.adjacency(g.edges),
    "degree": lambda g: g.degrees,
    "members_by_node": lambda g: graph.communities_of(g.members).select("node", F.array_join(F.transform("comms", lambda c: c.cast("string")), ",").alias("comms")),
    **{f"scalar_{m}": (lambda g, m=m: g.scalar(m)) for m in scalars.METHODS},
    **{f"hv_{m}": (lambda g, m=m: g.hv(m)) for m in ("s0", "s1", "s2", "s3")},
    **{f"ghv_{m}": (lambda g, m=m: homophily.ghv(g.edges, g.scalar(m))) for m in ("s1", "s2")},
    "assortativity_s1": lambda g: homophily.assortativity(g.edges, g.scalar("s1")),
    "assortativity_degree": lambda g: homophily.degree_assortativity(g.edges),
    "edge_homophily": lambda g: homophily.edge_homophily(g.edges, g.scalar("s1")),
    "community_homophily": lambda g: homophily.community_homophily(g.edges, g.scalar("s1"), g.members),
    "community_homophily_summary": lambda g: homophily.community_summary(homophily.community_homophily(g.edges, g.scalar("s1"), g.members)),
    "triangles": lambda g: structure.triangles(g.edges, g.nodes),
    "local_clustering": lambda g: structure.clustering(g.edges, g.nodes),
    "bridgecc": lambda g: structure.bridgecc(g.edges, g.nodes),
    "collective_influence_r1": lambda g: structure.collective_influence(g.edges, 1),
    "collective_influence_r2": lambda g: structure.collective_influence(g.edges, 2),
    "overlapping_nodes": lambda g: graph.overlapping(g.members),
    "overlap_neigh": lambda g: structure.overlap_rank(g.edges, g.members),
    "num_communities": lambda g: structure.num_communities(g.nodes, g.members),
    "delta_hv": lambda g: structure.with_delta(homophily.by_method(g.edges, g.members, ("s1", "s0"))).select("node", "delta_hv", "abs_delta_hv"),
    "community_isolation": lambda g: structure.isolation(g.edges, g.members),
    "mean_isolation": lambda g: structure.mean_isolation(g.edges, g.members),
    "internal_edge_density": lambda g: structure.internal_density(g.edges, g.members),
    "eigenvector_centrality": lambda g: structure.eigenvector(g.edges),
    "betweenness_sampled": lambda g: paths.sampled_betweenness(g.edges, epsilon=0.01),
    "connected_components": lambda g: graph.components(g.edges, g.nodes),
    "giant_component": lambda g: graph.giant(g.edges, g.nodes),
    "induced_subgraph": lambda g: graph.induced(g.edges, g.degrees.where("degree >= 10")),
    "inter_edges": lambda g: g.inter,
    "w_inter_total": lambda g: removal.total_weight(g.inter),
    "inter_edge_sample": lambda g: removal.edge_sample(g.edges, 0.1),
    "w_inter_curve_low_hv": lambda g: removal.weight_curve(g.inter, g.low_hv),
    "w_inter_curve_random": lambda g: removal.weight_curve(g.inter, g.random()),
    "w_inter_curve_compat": lambda g: removal.weight_curve(g.inter, g.low_hv, "compat"),
    "w_inter_band": lambda g: curves.band(removal.weight_curve(g.inter, g.random())),
    "w_inter_normalized": _normal,
    "w_inter_auc": lambda g: curves.auc_difference(_normal(g)),
    "w_inter_p_sep": lambda g: curves.separation(_normal(g)),
    "rho_gcc_trajectory": _trajectory,
    "rho_gcc_summary": lambda g: removal.snapshots(_trajectory(g)),
    "h_curve": _h_curve,
    "h_hat_curve": lambda g: curves.relative_homophily(written(_h_curve(g), "h-curve"), 0.9),
    "s_cut_marker": lambda g: curves.cut_marker(g.edges, g.members, g.hv("s1").withColumnRenamed("hv", "hv_s1")),
    "overlap_summary": lambda g: curves.overlap_summary(g.nodes, g.members),
    "degree_quartiles": lambda g: ier.degree_quartiles(g.degrees),
    "inter_degree_tau": lambda g: ier.inter_degrees(g.edges, g.members, g.nodes),
    "ier_targets": lambda g: ier.target_sets(written(g.metrics, "metrics")),
    "ier_observed": lambda g: Ier(g).observed(),
    "ier_by_degree_bin": lambda g: (lambda x: ier.by_degree_bin(x.sets, x.inter, x.quartiles))(Ier(g)),
    "ier_bootstrap_ci": lambda g: Ier(g).boot(),
    "ier_permutation_p": lambda g: (lambda x: ier.permutation_p(x.null(), x.seen()))(Ier(g)),
    "ier_summary": lambda g: Ier(g).summary(),
    "ier_deltas": lambda g: (lambda x: ier.deltas(x.null(), x.seen(), "fixture"))(Ier(g)),
    "ier_forest": lambda g: ier.forest(Ier(g).summary()),
    "unified_metrics": lambda g: describe.unified(homophily.by_method(g.edges, g.members, ("s1",)), homophily.by_method(g.edges, g.members, ("s2",), "ghv")),
    "all_metrics": _all_metrics,
    "global_metrics": lambda g: describe.descriptors(g.edges, g.members, "fixture"),
    "dataset_descriptives": lambda g: describe.descriptors(g.edges, g.members, "fixture", community_sizes=False),
    "network_check": lambda g: describe.network_check(g.edges),
    "separation_metrics": lambda g: published.separation_metrics(_normal(g), "fixture", "Fixture"),
    "ier_by_degree_rows": lambda g: (lambda x: published.degree_bin_rows(x.sets, x.inter, x.quartiles, "fixture"))(Ier(g)),
    "ier_legacy": lambda g: Ier(g).legacy(),
    "hc_metrics": lambda g: published.community_rows(g.edges, g.scalar("s1"), g.members),
    "hc_summary": lambda g: published.community_summary_row(written(published.community_rows(g.edges, g.scalar("s1"), g.members), "hc"), "fixture"),
    "he_metrics": lambda g: published.edge_rows(g.edges, g.scalar("s1")),
    "sensitivity_markers": _markers,
    "rho_summary_all": lambda g: published.all_datasets({"fixture": published.component_rows(removal.snapshots(_trajectory(g)), "fixture")}),
    "hv_resumed": _resumed,
    "name_dictionary": lambda g: g.named()[0],
    "named_hv_metrics": _named_hv,
    "project_metrics": _project,
    "hv_s1_datasets": lambda g: datasets.hv(*g.datasets),
    "assortativity_datasets": lambda g: datasets.assortativity(*g.datasets),
    "components_datasets": lambda g: datasets.component_summary(g.datasets[0], graph.vertices(g.datasets[0])),
    "w_inter_curve_datasets": _dataset_curves,
    "ier_observed_datasets": lambda g: datasets.Ratios(*g.datasets).observed(),
    "ier_summary_datasets": lambda g: datasets.Ratios(*g.datasets).summary(BOOT, PERM),
    "misaligned_ids": lambda g: align.misaligned(network=graph.adjacency(g.edges).select(F.col("u").alias("node")), communities=g.members),
    "edge_styles": lambda g: describe.styled(g.edges, homophily.edge_homophily(g.edges, g.scalar("s1")), 1e-6),
}


def _query(table: Callable[[Fixture], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(table(Fixture(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(table) for name, table in TABLES.items()}
