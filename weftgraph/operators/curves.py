"""Curves over removal: random bands, normalisation, areas, separation points, sensitivity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import half_even, plain_name
from ..plans.rank import ranked
from ..schema import require_columns
from . import graph


def band(curve: DataFrame, prefix: str = "rand_") -> DataFrame:
    """k, p, p05, median, p95 over the strategies of the prefix; exact, linear between values."""
    q = F.percentile("value", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return curve.where(F.col("strategy").startswith(prefix)).groupBy("k", "p").agg(q.alias("q")).select("k", "p", F.col("q")[0].alias("p05"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p95"))


def normalised(curve: DataFrame, target: str = "low_hv", prefix: str = "rand_") -> DataFrame:
    """k, p, target, p05, median, p95, all over the random median at the first point; reading fails if that is 0."""
    mine = curve.where(F.col("strategy") == target).groupBy("k").agg(F.avg("value").alias("target"))
    both = band(curve, prefix).join(mine, "k")
    base = both.agg(F.min_by("median", "k").alias("base"))
    base = base.select(F.when(F.col("base") == 0, F.raise_error(F.lit("the first random median is 0")).cast("double")).otherwise(F.col("base")).alias("base"))
    return both.crossJoin(F.broadcast(base)).select("k", "p", *((F.col(c) / F.col("base")).alias(c) for c in ("target", "p05", "median", "p95")))  # one row


def auc_difference(norm: DataFrame) -> DataFrame:
    """One row: auc_difference (target minus median, trapezoids), auc_depletion (its negative). A curve has few points."""
    w = Window.partitionBy(F.lit(1)).orderBy("k")
    d = F.col("target") - F.col("median")
    parts = norm.select(((F.col("p") - F.lag("p").over(w)) * (d + F.lag(d).over(w)) / 2).alias("a"))
    return parts.agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("auc_difference")).select("auc_difference", (-F.col("auc_difference")).alias("auc_depletion"))


def separation(norm: DataFrame, run: int = 3, at: str = "end") -> DataFrame:
    """One row: p_sep, the first point at which the target has been under the band ``run`` points on end (or where that run began)."""
    w = Window.partitionBy(F.lit(1)).orderBy("k")
    last = w.rowsBetween(-(run - 1), 0)
    rows = norm.select("p", F.sum((F.col("target") < F.col("p05")).cast("int")).over(last).alias("n"), F.lag("p", run - 1).over(w).alias("began"))
    return rows.where(F.col("n") == run).agg(F.min("p" if at == "end" else "began").alias("p_sep"))


def relative_homophily(curve: DataFrame, most: float = 1.0) -> DataFrame:
    """p, h, h_hat of low_hv or low_hv_s1: h over its first value (taken before ``most`` cuts), in the order of p.

    ``curve``: strategy, metric, fraction_removed, metric_value.
    """
    require_columns(curve, "strategy", "metric", "fraction_removed", "metric_value")
    own = curve.where(plain_name(F.col("strategy")).isin("low_hv", "low_hv_s1") & (plain_name(F.col("metric")) == "homophily")).dropna(subset=["fraction_removed", "metric_value"])
    rows = own.select(F.col("fraction_removed").alias("p"), F.col("metric_value").alias("h"))
    first = rows.agg(F.min_by("h", "p").alias("h0"))
    return rows.crossJoin(F.broadcast(first)).where(F.col("p") <= most).select("p", "h", F.try_divide("h", "h0").alias("h_hat"))


def h_hat_at(curve: DataFrame, p0: float) -> DataFrame:
    """One row: the last h_hat at or before ``p0``."""
    return curve.where(F.col("p") <= p0).agg(F.max_by("h_hat", "p").alias("h_hat_p0"))


def cut_marker(edges: DataFrame, members: DataFrame, metrics: DataFrame, p0: float = 0.01, column: str = "hv_s1") -> DataFrame:
    """One row: n_cut, s_mean, s_median, s_std of inter-community edge ends over degree of the p0 lowest nodes."""
    from .removal import inter_edges

    k = max(1, half_even(p0 * metrics.count()))
    low = ranked(metrics.select("node", column), [F.col(column).asc(), F.col("node").asc()]).where(F.col("rank") < k).select("node")
    ends = inter_edges(edges, members).select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("x"))
    ratio = low.join(graph.degrees(edges), "node").join(ends, "node", "left").where("degree > 0").select((F.coalesce("x", F.lit(0)) / F.col("degree")).alias("r"))
    # the median is what lies in the middle of the ranks: no task holds all values
    placed = ranked(ratio, [F.col("r").asc()])
    whole = placed.agg(F.count(F.lit(1)).alias("n_cut"), F.avg("r").alias("s_mean"), F.stddev_samp("r").alias("std"))
    n, at = F.col("n_cut"), F.col("rank")
    middle = placed.crossJoin(F.broadcast(whole.select("n_cut"))).where((at == F.floor((n - 1) / 2)) | (at == F.floor(n / 2))).agg(F.avg("r").alias("s_median"))
    return whole.crossJoin(F.broadcast(middle)).select("n_cut", "s_mean", "s_median", F.when(n > 0, F.coalesce("std", F.lit(0.0))).alias("s_std"))  # one row each


def overlap_summary(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """One row: m_mean over all nodes, psi (share of nodes in more than one community)."""
    m = nodes.select("node").join(members.distinct().groupBy("node").agg(F.count(F.lit(1)).alias("m")), "node", "left").select(F.coalesce("m", F.lit(0)).alias("m"))
    return m.agg((F.sum("m") / F.count(F.lit(1))).alias("m_mean"), (F.sum((F.col("m") > 1).cast("long")) / F.count(F.lit(1))).alias("psi"))


def component_curve(table: DataFrame, dataset: str) -> DataFrame:
    """p, rho_gcc, dataset of a table of curves; with a column metric, of its rows that say gcc.

    The usual names first; else the first column with ``fraction`` in its name or that begins with p, and the first
    with ``value`` or gcc in it.
    """
    names = {c.lower(): c for c in table.columns}
    if "metric" in names:
        table = table.where(F.lower(names["metric"]).contains("gcc"))
    loose = [c for n, c in names.items() if n != "metric"]
    p = next((names[n] for n in ("fraction_removed", "p", "removed_frac") if n in names), None) or next((c for c in loose if "fraction" in c.lower() or c.lower().startswith("p")), None)
    y = next((names[n] for n in ("rho_gcc", "gcc_norm", "rho", "metric_value", "value") if n in names), None) or next((c for c in loose if c != p and ("value" in c.lower() or "gcc" in c.lower())), None)
    if p is None or y is None:
        raise ValueError(f"no point or value column among {table.columns}")
    return table.select(F.col(f"`{p}`").cast("double").alias("p"), F.col(f"`{y}`").cast("double").alias("rho_gcc"), F.lit(dataset).alias("dataset"))


def one_benchmark(table: DataFrame, keep: str = "mid") -> DataFrame:
    """Rows of the real datasets, and of the generated ones (LFR_...) the kept one only."""
    return table.where(~F.col("dataset").startswith("LFR_") | (F.lower("dataset") == f"lfr_{keep}".lower()))


def legend(markers: DataFrame, names: DataFrame) -> DataFrame:
    """dataset, label: the name with its share of overlapping nodes, where that is known."""
    return markers.join(names, "dataset", "left").select("dataset", F.concat(F.coalesce("name", "dataset"), F.when(F.col("psi").isNotNull(), F.format_string(" (psi=%.2f)", "psi")).otherwise("")).alias("label"))
