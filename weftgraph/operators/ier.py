"""Inter-edge ratio of ranked node sets, with bootstrap intervals and degree-stratified permutation tests.

Draws are counter-based hashes of (seed, statistic, repetition, item): they don't depend on the order of rows or on
retries, and any engine can repeat them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import half_even, plain_name
from ..plans.rank import ranked
from ..plans.tables import written
from . import draws, graph

TAUS = (0.0, 0.1, 0.2, 0.3)
BINS = ("Q1", "Q2", "Q3", "Q4")
SETS = {"hv_s1": ("hv_s1", True), "bridgecc": ("bridgecc", False)}


def degree_quartiles(degrees: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """node, degree, bin: Q1 to Q4 by the exact quartiles of the degrees (linear), upper edges included.

    ``by``, here and below, are columns that name a graph: everything is then taken within each, and they are in the result.
    """
    # degrees are counted first: as many rows as there are different degrees
    counts = degrees.groupBy(*by, "degree").agg(F.count(F.lit(1)).alias("n"))
    q = counts.groupBy(*by).agg(F.percentile("degree", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("q"))
    d = F.col("degree")
    label = F.when(d <= F.col("q")[0], "Q1").when(d <= F.col("q")[1], "Q2").when(d <= F.col("q")[2], "Q3").otherwise("Q4")
    both = degrees.join(q, list(by)) if by else degrees.crossJoin(F.broadcast(q))  # one row, or one a graph
    return both.select(*by, "node", "degree", label.alias("bin"))


def inter_degrees(edges: DataFrame, members: DataFrame, nodes: DataFrame, taus: tuple[float, ...] = TAUS) -> DataFrame:
    """tau, node, inter_deg: edge ends whose edge is inter at tau (0: no shared community; else Jaccard under tau).

    Edges with an end without communities never count. Shares are compared in whole thousandths.
    """
    c = graph.communities_of(members)
    a, b = (c.select(F.col("node").alias(n), F.col("comms").alias(f"c{n}")) for n in ("u", "v"))
    each = edges.join(a, "u").join(b, "v").select("u", "v", F.size(F.array_intersect("cu", "cv")).alias("i"), (F.size("cu") + F.size("cv")).alias("t"))
    # an edge has a column for each tau; taus become rows when nodes have been counted
    grid = [(float(t), half_even(1000 * t)) for t in taus]
    hits = [F.expr("i = 0" if m == 0 else f"1000 * i < {m} * (t - i)").cast("int").alias(f"h{k}") for k, (_, m) in enumerate(grid)]
    marked = [F.col(f"h{k}") for k in range(len(grid))]
    ends = each.select("u", "v", *hits).where(F.greatest(*marked, F.lit(0)) > 0 if len(marked) else F.lit(False)).select(F.explode(F.array("u", "v")).alias("node"), *marked)
    counts = ends.groupBy("node").agg(*[F.sum(h).alias(f"h{k}") for k, h in enumerate(marked)], F.count(F.lit(1)).alias("n_"))
    rows = F.array(*[F.struct(F.lit(t).alias("tau"), F.coalesce(f"h{k}", F.lit(0).cast("long")).alias("inter_deg")) for k, (t, _) in enumerate(grid)])
    return nodes.select("node").join(counts, "node", "left").select("node", F.explode(rows).alias("x")).select("x.tau", "node", "x.inter_deg")


def target_sets(metrics: DataFrame, budget: float = 0.10, by: tuple[str, ...] = ()) -> DataFrame:
    """strategy, node, place (0-based): the most boundary-like nodes by each strategy, a share ``budget`` of all."""
    size = F.greatest(F.lit(1.0), F.bround(F.lit(budget) * F.count(F.lit(1)), 0)).cast("long")
    sizes = metrics.groupBy(*by).agg(size.alias("k"))
    out = None
    for name, (column, ascending) in SETS.items():
        order = F.col(column).asc() if ascending else F.col(column).desc()
        places = ranked(metrics.select(*by, "node", column), [order, F.col("node").asc()], by, name="place")
        places = places.join(sizes, list(by)) if by else places.crossJoin(F.broadcast(sizes))  # one row, or one a graph
        top = places.where("place < k").select(*by, F.lit(name).alias("strategy"), "node", "place")
        out = top if out is None else out.unionByName(top)
    return out


def _stats(by: list[str]):
    def of(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*by).agg(
            F.try_divide(F.sum("inter_deg").cast("double"), F.sum("degree").cast("double")).alias("ier_stub"),
            F.avg(F.col("inter_deg") / F.greatest(F.lit(1), F.col("degree"))).alias("ier_node_mean"),
            F.count(F.lit(1)).alias("n_selected"),
        )

    return of


def observed(sets: DataFrame, inter: DataFrame, quartiles: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """tau, strategy, ier_stub (edge ends), ier_node_mean, n_selected."""
    return _stats([*by, "tau", "strategy"])(sets.join(quartiles, [*by, "node"]).join(inter, [*by, "node"]))


def by_degree_bin(sets: DataFrame, inter: DataFrame, quartiles: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """As ``observed`` for each degree bin that a set reaches."""
    return _stats([*by, "tau", "strategy", "bin"])(sets.join(quartiles, [*by, "node"]).join(inter, [*by, "node"]))


def bootstrap(sets: DataFrame, inter: DataFrame, quartiles: DataFrame, repeats: int = 300, seed: int = 42, by: tuple[str, ...] = ()) -> DataFrame:
    """tau, strategy, and the 2.5 and 97.5 percentiles of both statistics over resampled sets.

    Draw j of repetition r is the set's member number hash(seed, strategy, r, j) mod k.
    """
    taus = draws.taus_of(inter)
    sums = draws.bootstrap_sums(sets, draws.node_values(quartiles, inter, by, taus), taus, repeats, seed, by)
    each = _ratios(sums, by)
    ends = F.array(F.lit(0.025), F.lit(0.975))
    q = each.groupBy(*by, "tau", "strategy").agg(F.percentile("stub", ends).alias("s"), F.percentile("nm", ends).alias("m"))
    return q.select(*by, "tau", "strategy", F.col("s")[0].alias("stub_low"), F.col("s")[1].alias("stub_high"), F.col("m")[0].alias("nm_low"), F.col("m")[1].alias("nm_high"))


def null_statistics(sets: DataFrame, inter: DataFrame, quartiles: DataFrame, repeats: int = 500, seed: int = 42, by: tuple[str, ...] = ()) -> DataFrame:
    """tau, strategy, rep, stub, nm of random sets with as many nodes of each degree bin as the strategy's set.

    Without replacement: the first nodes of a bin in the order of hash(seed, strategy, rep, node). A set is part of
    the nodes, so that a bin always suffices. Only nodes around the last one are sorted, see ``draws.null_sums``.
    """
    need = sets.join(quartiles, [*by, "node"]).groupBy(*by, "strategy", "bin").agg(F.count(F.lit(1)).alias("need"))
    taus = draws.taus_of(inter)
    table = written(draws.node_values(quartiles, inter, by, taus), "node-values")
    return _ratios(draws.null_sums(written(need, "need"), quartiles, table, taus, repeats, seed, by), by)


def _ratios(sums: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, tau, strategy, rep, stub, nm of the sums of a repetition."""
    stub = F.try_divide(F.col("s").cast("double"), F.col("d").cast("double"))
    return sums.select(*by, "tau", "strategy", "rep", stub.alias("stub"), (F.col("r") / F.col("n")).alias("nm"))


def _p_values(null: DataFrame, obs: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """by, <out>_one, <out>_two: ((number at least as extreme) + 1) / (N + 1), two-tailed by distance from the median."""
    middle = null.groupBy(*by).agg(F.percentile(value, 0.5).alias("mid"), F.count(value).alias("n"))
    rows = null.join(middle, by).join(obs.select(*by, F.col(value).alias("seen")), by)
    # differences that rounding alone makes don't count
    one = F.sum((F.col(value) >= F.col("seen") - 1e-12).cast("long"))
    two = F.sum((F.abs(F.col(value) - F.col("mid")) >= F.abs(F.col("seen") - F.col("mid")) - 1e-12).cast("long"))
    p = rows.groupBy(*by).agg(((one + 1) / (F.max("n") + 1)).alias("one"), ((two + 1) / (F.max("n") + 1)).alias("two"))
    return p.select(*by, F.least(F.lit(1.0), "one").alias(f"{out}_one"), F.least(F.lit(1.0), "two").alias(f"{out}_two"))


def permutation_p(null: DataFrame, obs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """tau, strategy and p-values of both statistics; null: ``null_statistics``, obs: ``observed``."""
    own = [*by, "tau", "strategy"]
    seen = obs.select(*own, F.col("ier_stub").alias("stub"), F.col("ier_node_mean").alias("nm"))
    return _p_values(null, seen, own, "stub", "p_stub").join(_p_values(null, seen, own, "nm", "p_nm"), own)


def _named(dataset: str | None):
    """The given name, or with several graphs in one table their own column."""
    return F.col("dataset") if dataset is None else F.lit(dataset).alias("dataset")


def summary(obs: DataFrame, intervals: DataFrame, p: DataFrame, dataset: str | None, repeats: int = 500, by: tuple[str, ...] = ()) -> DataFrame:
    """The standard rows: one for each tau and strategy (and graph)."""
    own = [*by, "tau", "strategy"]
    t = obs.join(intervals, own).join(p, own)
    return t.select(
        _named(dataset), "tau", "strategy", "ier_node_mean", F.col("nm_low").alias("ier_node_mean_ci_low"), F.col("nm_high").alias("ier_node_mean_ci_high"), F.col("p_nm_two").alias("p_perm_nm"),
        "ier_stub", F.col("stub_low").alias("ier_stub_ci_low"), F.col("stub_high").alias("ier_stub_ci_high"), F.col("p_stub_two").alias("p_perm_stub"), "n_selected", F.lit(repeats).alias("k_permutations"),
    )


def delta_statistics(null: DataFrame, obs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """tau and hv_s1 minus bridgecc of both statistics (stub, nm), with p-values against the differences of paired repetitions."""

    def minus(df: DataFrame, keys: list[str], cols: dict[str, str]) -> DataFrame:
        pick = lambda c, s: F.max(F.when(F.col("strategy") == s, F.col(c)))
        return df.groupBy(*keys).agg(*((pick(c, "hv_s1") - pick(c, "bridgecc")).alias(n) for c, n in cols.items()))

    own = [*by, "tau"]
    d0 = minus(null, [*own, "rep"], {"stub": "stub", "nm": "nm"})
    d1 = minus(obs, own, {"ier_stub": "stub", "ier_node_mean": "nm"})
    p = _p_values(d0, d1, own, "stub", "p_stub").join(_p_values(d0, d1, own, "nm", "p_nm"), own)
    return d1.join(p, own)


def deltas(null: DataFrame, obs: DataFrame, dataset: str | None, by: tuple[str, ...] = ()) -> DataFrame:
    """The published rows of ``delta_statistics``, with two-tailed p-values."""
    return delta_statistics(null, obs, by).select(_named(dataset), "tau", F.col("nm").alias("delta_ier_node_mean"), F.col("p_nm_two").alias("p_perm_nm_delta"), F.col("stub").alias("delta_ier_stub"), F.col("p_stub_two").alias("p_perm_stub_delta"))


def at_tau(rows: DataFrame, tau: float) -> DataFrame:
    """Rows within 0.0005 of ``tau``, strategies in lower case without outer blanks; column names in lower case."""
    lower = rows.select(*[F.col(c).alias(c.lower()) for c in rows.columns])
    return lower.where(F.col("tau").isNotNull() & ~F.isnan("tau") & (F.abs(F.col("tau") - tau) < 5e-4)).withColumn("strategy", plain_name(F.col("strategy")))


def forest(rows: DataFrame, tau: float = 0.3) -> DataFrame:
    """dataset, delta_pp, ci_low_pp, ci_high_pp, nm_hv, nm_br: hv against bridgecc, in percentage points.

    The half width is 1.96 times the root of both half widths over 1.96, squared and added.
    """
    own = at_tau(rows, tau)

    def pick(c: str, names: tuple[str, ...]):
        return F.max(F.when(F.col("strategy").isin(*names), F.col(c)))

    hv, br = ("hv_s1", "hv"), ("bridgecc", "bridge_cc", "br")
    low, high = "ier_node_mean_ci_low", "ier_node_mean_ci_high"
    t = own.groupBy("dataset").agg(pick("ier_node_mean", hv).alias("nm_hv"), pick("ier_node_mean", br).alias("nm_br"), ((pick(high, hv) - pick(low, hv)) / 2).alias("wh"), ((pick(high, br) - pick(low, br)) / 2).alias("wb"))
    half = 1.96 * F.sqrt((F.col("wh") / 1.96) ** 2 + (F.col("wb") / 1.96) ** 2)
    d = F.col("nm_hv") - F.col("nm_br")
    return t.select("dataset", (100 * d).alias("delta_pp"), (100 * (d - half)).alias("ci_low_pp"), (100 * (d + half)).alias("ci_high_pp"), "nm_hv", "nm_br").orderBy(F.abs("delta_pp").desc(), "dataset")
