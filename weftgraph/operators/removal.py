"""Node removal: weight of inter-community edges, largest component and homophily of what survives.

Ranks are 0-based removal positions. No removal is simulated: an edge dies at a rank that its ends tell, so that one
aggregation serves all strategies and all points of a curve.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import draw_key, half_even, is_finite, is_inter
from ..plans.rank import ranked
from ..plans.tables import written
from . import graph
from .components import stars

STRATEGIES = {"low_hv": ("hv_s1", True), "high_hv": ("hv_s1", False), "bridgecc": ("bridgecc", False), "degree": ("degree", False), "ci": ("ci", False), "overlap_neigh": ("overlap_neigh", False), "betweenness": ("betweenness", False), "eigenvector": ("eigenvector", False)}


def inter_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """u, v, w: edges whose ends both have communities and share none; w is the product of their numbers."""
    c = graph.communities_of(members)
    a, b = (c.select(F.col("node").alias(n), F.col("comms").alias(f"c{n}")) for n in ("u", "v"))
    both = edges.join(a, "u").join(b, "v").where(is_inter(F.col("cu"), F.col("cv")))
    return both.select("u", "v", (F.size("cu") * F.size("cv")).cast("long").alias("w"))


def edge_sample(edges: DataFrame, fraction: float, seed: int = 12345) -> DataFrame:
    """An exact-size sample of the edges without replacement, the same in every run; weights aren't rescaled."""
    if fraction >= 1:
        return edges.select("u", "v")
    take = max(1, half_even(fraction * edges.count()))
    keyed = edges.select("u", "v", draw_key(seed, F.col("u"), F.col("v")).alias("key"))
    return ranked(keyed, [F.col("key").asc(), F.col("u").asc(), F.col("v").asc()]).where(F.col("rank") < take).select("u", "v")


def total_weight(inter: DataFrame) -> DataFrame:
    """One row: w0, n_inter."""
    return inter.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("w0"), F.count(F.lit(1)).alias("n_inter"))


def metric_ranks(metrics: DataFrame, column: str, ascending: bool, strategy: str, by: tuple[str, ...] = ()) -> DataFrame:
    """strategy, node, rank by a metric (ties: smaller node), within each value of ``by``; nodes without a finite value are left out."""
    own = metrics.where(is_finite(F.col(column)))
    order = [F.col(column).asc() if ascending else F.col(column).desc(), F.col("node").asc()]
    return ranked(own.select(*by, "node", column), order, by).select(*by, F.lit(strategy).alias("strategy"), "node", "rank")


def strategy_ranks(metrics: DataFrame, strategy: str, nodes: DataFrame | None = None, reverse: bool = False, seed: int = 12345) -> DataFrame | None:
    """Ranks by a registered strategy, of ``nodes`` only if given; None if the metrics lack its column."""
    table = metrics if nodes is None else metrics.join(nodes.select("node"), "node", "left_semi")
    if strategy == "random":
        return random_ranks(table, 1, seed)
    if strategy not in STRATEGIES:
        raise NotImplementedError(f"no strategy {strategy!r}; there are {sorted(STRATEGIES)}")
    column, ascending = STRATEGIES[strategy]
    return metric_ranks(table, column, ascending != reverse, strategy) if column in table.columns else None


def random_ranks(nodes: DataFrame, repeats: int, seed: int = 12345, by: tuple[str, ...] = ()) -> DataFrame:
    """strategy rand_1.. , node, rank: random permutations of the nodes (of each value of ``by``), the same in every engine."""
    reps = nodes.select(*by, "node").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    keyed = reps.select(*by, F.concat(F.lit("rand_"), F.col("rep").cast("string")).alias("strategy"), "node", draw_key(seed, F.col("rep"), F.col("node")).alias("key"))
    return ranked(keyed, [F.col("key").asc(), F.col("node").asc()], (*by, "strategy")).select(*by, "strategy", "node", "rank")


def grid(n: int, step: float = 0.02) -> list[int]:
    """How many nodes are removed at the points of a curve: p n to the even neighbour, from 0 to n, each once."""
    points = int(1 / step + 1e-9) + 1
    return sorted({min(max(half_even(i * step * n), 0), n) for i in range(points)})


def _curve(deaths: DataFrame, ranks: DataFrame, n: int, points: list[int]) -> DataFrame:
    """strategy, k, p, value: weight of what dies at rank k or later; deaths: strategy, death, w."""
    ks = F.array(*[F.lit(k).cast("long") for k in points])
    alive = deaths.select("strategy", F.size(F.filter(ks, lambda k: k <= F.col("death"))).alias("at"), "w").groupBy("strategy", "at").agg(F.sum("w").alias("w"))
    frame = ranks.select("strategy").distinct().select("strategy", F.lit(n).alias("n"), F.posexplode(ks).alias("i", "k"))
    return survived(frame, alive.select("strategy", (F.col("at") - 1).alias("i"), "w"), ("strategy",))


def survived(frame: DataFrame, alive: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, k, p, value: the points ``frame`` (by, n, i, k) of curves with all the weight whose last point isn't before them; alive: by, i, w.

    There are as many rows as curves have points.
    """
    later = Window.partitionBy(*by).orderBy(F.desc("i"))
    joined = frame.join(alive, [*by, "i"], "left")
    return joined.select(*by, "k", (F.col("k") / F.greatest("n", F.lit(1))).alias("p"), F.sum(F.coalesce("w", F.lit(0))).over(later).cast("double").alias("value"))


def weight_curve(inter: DataFrame, ranks: DataFrame, semantics: str = "exact", step: float = 0.02, n: int | None = None) -> DataFrame:
    """strategy, k, p, value: inter-community weight with k nodes removed.

    ``exact``: an edge dies with its first end. ``compat``: it dies only if its smaller end is removed first (at
    that end's rank), else never. All strategies must rank the same number of nodes; edges of unranked ones are left out.
    """
    if semantics not in ("exact", "compat"):
        raise ValueError("semantics is 'exact' or 'compat'")
    if n is None:
        n = ranks.groupBy("strategy").count().agg(F.max("count")).first()[0] or 0
    # all ranks of a node in one row: an edge is shuffled once for each end, not once for each strategy
    of = ranks.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("strategy", "rank"))).alias("ranks"))
    a, b = (of.select(F.col("node").alias(x), F.col("ranks").alias(f"r{x}")) for x in ("u", "v"))
    if semantics == "exact":
        death = lambda _, ru, rv: F.when(ru.isNotNull() & rv.isNotNull(), F.least(ru, rv))
    else:

        def death(_, ru, rv):
            low, high = F.when(F.col("u") < F.col("v"), ru).otherwise(rv), F.when(F.col("u") < F.col("v"), rv).otherwise(ru)
            return F.when(low < high, low).when(low.isNotNull() & high.isNotNull(), F.lit(n).cast("long"))

    both = inter.join(a, "u").join(b, "v")
    deaths = both.select(F.explode(F.map_zip_with("ru", "rv", death)).alias("strategy", "death"), "w").where("death IS NOT NULL")
    return _curve(deaths, ranks, n, grid(n, step))


def component_trajectory(edges: DataFrame, nodes: DataFrame, ranks: DataFrame, step: float = 0.01, most: float = 0.10) -> DataFrame:
    """strategy, step, removed_frac, rho, nodes_left, edges_left while nodes are removed step by step.

    rho is the largest component over all nodes. Nodes without a rank stay. What is left at a step is what dies at it
    or later, so that the graph isn't copied for any step: see ``largest_components``. A trajectory ends when nothing
    is left to remove.
    """
    n = nodes.count()
    size, steps = max(1, half_even(step * n)), half_even(most / step)
    lasts = ranks.groupBy("strategy").agg(F.count(F.lit(1)).alias("ranked")).select("strategy", F.explode(F.sequence(F.lit(0), F.least(F.lit(steps), F.ceil(F.col("ranked") / size).cast("int")))).alias("step"))
    strategies = sorted(r.strategy for r in lasts.select("strategy").distinct().collect())
    if not strategies:
        return lasts.select("strategy", "step", F.lit(None).cast("double").alias("removed_frac"), F.lit(None).cast("double").alias("rho"), F.lit(0).cast("long").alias("nodes_left"), F.lit(0).cast("long").alias("edges_left"))
    # the last step at which a node is there, by all strategies in one row
    of = nodes.select("node").join(ranks.groupBy("node").agg(*[F.max(F.when(F.col("strategy") == s, F.col("rank"))).alias(f"t{i}") for i, s in enumerate(strategies)]), "node", "left")
    until = written(of.select("node", *(F.least(F.coalesce(F.floor(F.col(f"t{i}") / size), F.lit(steps)), F.lit(steps)).cast("int").alias(f"t{i}") for i in range(len(strategies)))), "until")
    a, b = (until.select(F.col("node").alias(x), *(F.col(f"t{i}").alias(f"{x}{i}") for i in range(len(strategies)))) for x in ("u", "v"))
    held = written(edges.join(a, "u").join(b, "v").select("u", "v", *(F.least(f"u{i}", f"v{i}").alias(f"t{i}") for i in range(len(strategies)))), "held")
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(f"t{i}").alias("until")) for i, s in enumerate(strategies)])).alias("x")
    counts = [t.select(each).groupBy("x.strategy", F.col("x.until").alias("step")).agg(F.count(F.lit(1)).alias(c)) for t, c in ((until, "nodes"), (held, "edges"))]
    # what no strategy removes is searched once for all of them; the rest, between the components found, for each
    stays = reduce(lambda x, y: x & y, [F.col(f"t{i}") == steps for i in range(len(strategies))])
    core = written(stars(held.where(stays & (F.col("u") != F.col("v"))).select("u", "v")), "core")
    sizes = written(core.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "core-sizes")
    to = core.join(sizes, "component")
    rest = held.where(~stays)
    for c in ("u", "v"):
        rest = rest.join(to.select(F.col("node").alias(c), F.col("component").alias(f"to_{c}"), F.col("size").alias(f"s{c}")), c, "left").withColumns({c: F.coalesce(f"to_{c}", c), f"s{c}": F.coalesce(f"s{c}", F.lit(1).cast("long"))})
    rest = rest.where("u <> v").select("u", "su", "v", "sv", each).select("x.*", "u", "su", "v", "sv")
    whole = ranks.select("strategy").distinct().crossJoin(F.broadcast(sizes.agg(F.max("size").alias("largest")).where("largest IS NOT NULL"))).select("strategy", F.lit(steps).alias("step"), "largest")  # one row
    largest_at = largest_components(rest, steps).unionByName(whole).groupBy("strategy", "step").agg(F.max("largest").alias("largest"))
    # (strategies x steps) rows from here on; what is left at a step is what later steps have, and its own
    frame = ranks.select("strategy").distinct().select("strategy", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    for t in (*counts, largest_at):
        frame = frame.join(t, ["strategy", "step"], "left")
    later = Window.partitionBy("strategy").orderBy(F.desc("step"))
    left, kept, largest = F.sum(F.coalesce("nodes", F.lit(0))).over(later), F.sum(F.coalesce("edges", F.lit(0))).over(later), F.max("largest").over(later)
    out = frame.select("strategy", "step", left.alias("nodes_left"), kept.alias("edges_left"), largest.alias("largest")).join(lasts, ["strategy", "step"])
    size_of = F.coalesce("largest", F.when(F.col("nodes_left") > 0, 1).otherwise(0))
    return out.select("strategy", "step", F.bround(1 - F.col("nodes_left") / F.lit(n), 6).alias("removed_frac"), (size_of / F.lit(n)).alias("rho"), "nodes_left", "edges_left")


def _once(edges: DataFrame) -> DataFrame:
    """strategy, lo, hi, until, u, su, v, sv: of edges between the same two different ends, one that dies last."""
    apart = edges.where("u <> v").select("strategy", "lo", "hi", "until", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), F.when(F.col("u") < F.col("v"), F.col("su")).otherwise(F.col("sv")).alias("sa"), F.when(F.col("u") < F.col("v"), F.col("sv")).otherwise(F.col("su")).alias("sb"))
    last = apart.groupBy("strategy", "lo", "hi", "a", "b").agg(F.max("until").alias("until"), F.max("sa").alias("su"), F.max("sb").alias("sv"))
    return last.select("strategy", "lo", "hi", "until", F.col("a").alias("u"), "su", F.col("b").alias("v"), "sv")


def largest_components(held: DataFrame, steps: int) -> DataFrame:
    """strategy, step, largest: the size of the largest component that edges which live until ``step`` or later make.

    A step is left out if none of its edges joins anything that later steps don't join. held: strategy, u, su, v, sv,
    until (0 to ``steps``), su and sv being how many nodes an end stands for. Most edges live to the end and are searched
    first. Then the range of steps is halved again and again: components at the middle step come from edges that live so
    long; those that live longer are searched on in the upper half, the others in the lower half, between the
    components that they join. So every edge is in one search at a time, all halves are one job, and there are as many
    jobs as halvings; edges within a component drop out, and of those between the same two the last to die is kept.
    """
    now = _once(held.withColumns({"lo": F.lit(0), "hi": F.lit(steps)})).withColumn("mid", F.lit(steps))
    found = []
    while True:
        now = written(now, "halves")
        if now.isEmpty():
            break
        upper = now.where("until >= mid")
        key = lambda c: F.struct("strategy", F.col("mid").alias("step"), F.col(c).alias("node"))
        joined = written(stars(upper.select(key("u").alias("u"), key("v").alias("v"))), "joined")
        ends = upper.select(F.explode(F.array(F.struct(key("u").alias("node"), F.col("su").alias("size")), F.struct(key("v").alias("node"), F.col("sv").alias("size")))).alias("x")).select("x.*").distinct()
        sizes = written(joined.join(ends, "node").groupBy("component").agg(F.sum("size").alias("size")), "sizes")
        found.append(sizes.groupBy(F.col("component.strategy").alias("strategy"), F.col("component.step").alias("step")).agg(F.max("size").alias("largest")))
        to = joined.join(sizes, "component").select(F.col("node.strategy").alias("strategy"), F.col("node.step").alias("mid"), F.col("node.node").alias("at"), F.col("component.node").alias("to"), "size")
        lower = now.where("until < mid")
        for c in ("u", "v"):
            here = to.select("strategy", "mid", F.col("at").alias(c), F.col("to").alias(f"to_{c}"), F.col("size").alias(f"size_{c}"))
            lower = lower.join(here, ["strategy", "mid", c], "left").withColumns({c: F.coalesce(f"to_{c}", c), f"s{c}": F.coalesce(f"size_{c}", f"s{c}")})
        columns = ("strategy", "lo", "hi", "until", "u", "su", "v", "sv")
        low = _once(lower.withColumn("hi", F.col("mid") - 1))
        now = upper.where("until > mid").withColumn("lo", F.col("mid") + 1).select(*columns).unionByName(low.select(*columns))
        now = now.withColumn("mid", F.floor((F.col("lo") + F.col("hi")) / 2).cast("int"))
    return reduce(DataFrame.unionByName, found) if found else held.select("strategy", F.col("until").alias("step"), F.lit(1).cast("long").alias("largest")).where("false")


def snapshots(trajectory: DataFrame, points: tuple[float, ...] = (0.05, 0.10), step: float = 0.01) -> DataFrame:
    """strategy, p, rho at the steps of the given points; by whole steps, so that no rounding merges points."""
    spark = trajectory.sparkSession
    at = spark.createDataFrame([(half_even(p / step), float(p)) for p in points], "step int, p double")
    return trajectory.join(F.broadcast(at), "step").select("strategy", "p", "rho")


def homophily_trajectory(edges: DataFrame, values: DataFrame, ranks: DataFrame, points: list[int]) -> DataFrame:
    """strategy, k, h: assortativity of the scalar on what survives k removals, null where its variance is 0.

    Own definition. Each edge adds its moments to every point that it survives, so that one aggregation does.
    """
    of = values.select("node", "s")
    a, b = (ranks.join(of, "node").select("strategy", F.col("node").alias(x), F.col("rank").alias(f"r{x}"), F.col("s").alias(f"s{x}")) for x in ("u", "v"))
    ks = F.array(*[F.lit(k).cast("long") for k in points])
    both = edges.join(a, "u").join(b, ["strategy", "v"]).withColumn("death", F.least("ru", "rv"))
    each = both.groupBy("strategy", F.size(F.filter(ks, lambda k: k <= F.col("death"))).alias("at")).agg(
        (2 * F.count(F.lit(1))).alias("n"), F.sum(F.col("su") + F.col("sv")).alias("t"), F.sum(F.col("su") * F.col("su") + F.col("sv") * F.col("sv")).alias("q"), (2 * F.sum(F.col("su") * F.col("sv"))).alias("x")
    )
    frame = ranks.select("strategy").distinct().select("strategy", F.posexplode(ks).alias("i", "k"))
    later = Window.partitionBy("strategy").orderBy(F.desc("i"))
    joined = frame.join(each.withColumn("i", F.col("at") - 1), ["strategy", "i"], "left")
    sums = joined.select("strategy", "k", *(F.sum(F.coalesce(c, F.lit(0))).over(later).alias(c) for c in ("n", "t", "q", "x")))
    # n x - t^2 over n q - t^2, in whole numbers
    return sums.select("strategy", "k", F.try_divide((F.col("n") * F.col("x") - F.col("t") * F.col("t")).cast("double"), (F.col("n") * F.col("q") - F.col("t") * F.col("t")).cast("double")).alias("h"))
