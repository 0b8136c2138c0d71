"""Rows of the published tables, put together from results of the other operators, and what lets a run go on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import curves, graph, homophily, ier


def separation_metrics(norm: DataFrame, dataset: str, name: str, target: str = "low_hv", run: int = 3) -> DataFrame:
    """One row: where a normalised curve leaves the random band, and its area against the random median."""
    both = curves.auc_difference(norm).crossJoin(F.broadcast(curves.separation(norm, run)))  # one row each
    return both.select(
        F.lit(dataset).alias("dataset"), F.lit(name).alias("name"), F.lit(target).alias("target_strategy"), F.col("p_sep").alias("p_separation"),
        F.col("auc_difference").alias("AUC_difference"), F.col("auc_depletion").alias("AUC_depletion"),
    )


def degree_bin_rows(sets: DataFrame, inter: DataFrame, quartiles: DataFrame, dataset: str) -> DataFrame:
    """For each tau, strategy and degree bin that a set reaches: sums of both degrees, and both ratios."""
    rows = sets.join(quartiles, "node").join(inter, "node")
    return rows.groupBy("tau", "strategy", F.col("bin").alias("degree_bin")).agg(
        F.first(F.lit(dataset)).alias("dataset"),
        F.count(F.lit(1)).alias("n_nodes"),
        F.sum("inter_deg").alias("sum_inter_deg"),
        F.sum("degree").alias("sum_deg"),
        F.avg(F.col("inter_deg") / F.greatest(F.lit(1), F.col("degree"))).alias("IER_node_mean"),
        F.try_divide(F.sum("inter_deg").cast("double"), F.sum("degree").cast("double")).alias("IER_stub"),
    )


def legacy_rows(null: DataFrame, obs: DataFrame, intervals: DataFrame, dataset: str) -> DataFrame:
    """Three rows a tau: both strategies with intervals and both p-values, and their difference without intervals.

    ``null``, ``obs`` and ``intervals`` are what ``ier.null_statistics``, ``ier.observed`` and ``ier.bootstrap`` give.
    """
    own = obs.join(intervals, ["tau", "strategy"]).join(ier.permutation_p(null, obs), ["tau", "strategy"]).select(
        "tau", "strategy", F.col("n_selected").alias("k"),
        F.col("ier_stub").alias("IER_stub"), F.col("stub_low").alias("IER_stub_ci_low"), F.col("stub_high").alias("IER_stub_ci_high"),
        F.col("ier_node_mean").alias("IER_node_mean"), F.col("nm_low").alias("IER_nm_ci_low"), F.col("nm_high").alias("IER_nm_ci_high"),
        F.col("p_stub_one").alias("p_one_stub"), F.col("p_stub_two").alias("p_two_stub"), F.col("p_nm_one").alias("p_one_nm"), F.col("p_nm_two").alias("p_two_nm"),
    )
    k = obs.groupBy("tau").agg(F.max("n_selected").alias("k"))
    none = F.lit(None).cast("double")
    delta = ier.delta_statistics(null, obs).join(k, "tau").select(
        "tau", F.lit("delta(hv-bridgecc)").alias("strategy"), "k",
        F.col("stub").alias("IER_stub"), none.alias("IER_stub_ci_low"), none.alias("IER_stub_ci_high"),
        F.col("nm").alias("IER_node_mean"), none.alias("IER_nm_ci_low"), none.alias("IER_nm_ci_high"),
        F.col("p_stub_one").alias("p_one_stub"), F.col("p_stub_two").alias("p_two_stub"), F.col("p_nm_one").alias("p_one_nm"), F.col("p_nm_two").alias("p_two_nm"),
    )
    return own.unionByName(delta).select(F.lit(dataset).alias("dataset"), "*")


def community_rows(edges: DataFrame, values: DataFrame, members: DataFrame, method: str = "s1") -> DataFrame:
    """comm, hc_<method>, num_nodes, h_global (the graph's assortativity, the same in every row)."""
    whole = homophily.assortativity(edges, values).select(F.col("r").alias("h_global"))
    own = homophily.community_homophily(edges, values, members)
    return own.crossJoin(F.broadcast(whole)).select("comm", F.col("h_c").alias(f"hc_{method}"), F.col("n_members").alias("num_nodes"), "h_global")  # one row


def community_summary_row(rows: DataFrame, dataset: str, method: str = "s1") -> DataFrame:
    """One row of ``community_rows``: hc_weighted, h_global, n_communities."""
    own = rows.select(F.col(f"hc_{method}").alias("h_c"), F.col("num_nodes").alias("n_members"), "h_global")
    whole = own.agg(F.max("h_global").alias("h_global"))
    return homophily.community_summary(own).crossJoin(F.broadcast(whole)).select(F.lit(dataset).alias("dataset"), "hc_weighted", "h_global", "n_communities")  # one row


def edge_rows(edges: DataFrame, values: DataFrame, method: str = "s1") -> DataFrame:
    """edge_id (from 0, by both ends), node_1, node_2, he_<method>, and the scalar of both ends."""
    from ..plans.rank import ranked

    a, b = (values.select(F.col("node").alias(n), F.col("s").alias(f"{method}_{m}")) for n, m in (("u", "node1"), ("v", "node2")))
    own = homophily.edge_homophily(edges, values).join(a, "u").join(b, "v")
    return ranked(own, [F.col("u").asc(), F.col("v").asc()], name="edge_id").select(
        "edge_id", F.col("u").alias("node_1"), F.col("v").alias("node_2"), F.col("h_e").alias(f"he_{method}"), f"{method}_node1", f"{method}_node2"
    )


def sensitivity_markers(edges: DataFrame, members: DataFrame, metrics: DataFrame, h_curve: DataFrame, dataset: str, p0: float = 0.01, column: str = "hv_s1") -> DataFrame:
    """One row of ten columns; ``h_curve`` is ``curves.relative_homophily``'s, h_hat_p0 its last h_hat at or before p0."""
    nodes = graph.vertices(edges)
    parts = [
        curves.cut_marker(edges, members, metrics, p0, column),
        curves.overlap_summary(nodes, members),
        nodes.agg(F.count(F.lit(1)).alias("n")),
        edges.agg(F.count(F.lit(1)).alias("e")),
        curves.h_hat_at(h_curve, p0),
    ]
    row = reduce(lambda x, y: x.crossJoin(F.broadcast(y)), parts)  # one row each
    return row.select(
        F.lit(dataset).alias("dataset"), F.lit(p0).alias("p0"), F.col("s_mean").alias("S_cut_mean"), F.col("s_median").alias("S_cut_median"), F.col("s_std").alias("S_cut_std"),
        "m_mean", "psi", "n", "e", "h_hat_p0",
    )


def component_rows(snapshots: DataFrame, dataset: str) -> DataFrame:
    """dataset, strategy, p, rho_GCC from ``removal.snapshots``."""
    return snapshots.select(F.lit(dataset).alias("dataset"), "strategy", "p", F.col("rho").alias("rho_GCC"))


def all_datasets(tables: dict[str, DataFrame]) -> DataFrame:
    """The tables of several datasets as one, by column name, with their key as ``dataset``; what one lacks is null there.

    A table that has a column ``dataset`` keeps it, where that isn't null. No tables at all raise ValueError.
    """
    if not tables:
        raise ValueError("no datasets given")

    def named(key: str, t: DataFrame) -> DataFrame:
        return t.withColumn("dataset", F.coalesce("dataset", F.lit(key)) if "dataset" in t.columns else F.lit(key))

    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [named(k, t) for k, t in tables.items()])


def resumed(nodes: DataFrame, existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """A metric table that goes on: columns of ``new`` beside those of ``existing``, which they replace where names agree.

    One row a node of ``existing``, or of ``nodes`` where there is no table yet; all three have a column ``node``.
    """
    base = nodes.select("node").distinct() if existing is None else existing.drop(*[c for c in new.columns if c != "node"])
    return base.join(new, "node", "left")


def memberships(members: DataFrame | None, node_comms: DataFrame | None) -> DataFrame:
    """node, comm, each pair once: from the map of nodes to communities where there is one, else from the cover; neither raises ValueError."""
    if node_comms is not None:
        return node_comms.select("node", F.explode("comms").alias("comm")).distinct()
    if members is None:
        raise ValueError("neither a cover nor a map of nodes to communities is given")
    return members.select("node", "comm").distinct()
