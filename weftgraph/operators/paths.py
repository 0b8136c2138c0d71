"""Betweenness from random shortest paths: bidirectional walks of many pairs at once, path counts, and walks back.

Each of r random pairs of nodes gives one of its shortest paths, every one with the same chance; a node's share of
paths that pass through it estimates its normalised betweenness. How many pairs are needed doesn't depend on the
size of the graph but by a logarithm: pairs are added until an empirical Bernstein bound holds for all nodes at once,
or until their number suffices by the length of the longest shortest path alone.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import draw_index
from ..plans.rank import ranked
from ..plans.tables import dropped, written
from . import graph

#: Pairs that are walked at a time.
PAIRS = 4096
#: Times that the bound may be looked at, and the share of it that is left to what pairs pass through nodes.
LOOKS, ROOM = 16, 0.3


def pairs_by_length(vertices: int, epsilon: float, delta: float) -> int:
    """How many random paths keep all nodes within ``epsilon`` with chance 1 - ``delta``, if no shortest path has more vertices."""
    return math.ceil(0.5 / epsilon**2 * (math.floor(math.log2(max(vertices - 2, 1))) + 1 + math.log(1 / delta)))


def bernstein(counts_product: float, r: int, n: int, delta: float) -> float:
    """How far any of n means of r zeros and ones may be from what was seen, if c (r - c) is at most ``counts_product`` for all counts c."""
    if r < 2:
        return 1.0
    log = math.log(4 * n * LOOKS / delta)
    return math.sqrt(2 * counts_product / (r * (r - 1)) * log / r) + 7 * log / (3 * (r - 1))


def _farthest(near: DataFrame, start: DataFrame) -> DataFrame:
    """part, node, far: of each start's part (part, node) a node at the greatest distance, and that distance."""
    name = f"sweep-{uuid.uuid4().hex}"
    front = written(start.select("part", "node", F.lit(0).alias("far")), f"{name}/level")
    levels = [front]
    while True:
        ahead = levels[-1].join(near, "node").select("part", F.col("next").alias("node"), (F.col("far") + 1).alias("far")).distinct()
        for level in levels[-2:]:
            ahead = ahead.join(level.select("node"), "node", "left_anti")
        ahead = written(ahead.select("part", "node", "far"), f"{name}/level")
        if ahead.isEmpty():
            break
        levels.append(ahead)
    found = written(reduce(DataFrame.unionByName, levels).groupBy("part").agg(F.max(F.struct("far", "node")).alias("x")).select("part", F.col("x.node").alias("node"), F.col("x.far").alias("far")), "farthest")
    dropped(near.sparkSession, name)
    return found


def longest_path(edges: DataFrame) -> tuple[int, int]:
    """Bounds of the number of vertices on the longest shortest path, by two sweeps of every component at once.

    A second sweep begins where the first one ended: its length is a lower bound, and twice the shorter of both an
    upper one. A sweep takes a round for each level.
    """
    near = written(graph.adjacency(graph.simplified(edges)).withColumnsRenamed({"u": "node", "v": "next"}), "near")
    of = written(graph.components(edges).withColumnRenamed("component", "part"), "parts")
    first = _farthest(near, of.where("node = part"))
    second = _farthest(near, first.select("part", "node"))
    both = first.select("part", F.col("far").alias("a")).join(second.select("part", F.col("far").alias("b")), "part")
    r = both.agg(F.coalesce(F.max("b"), F.lit(-1)).alias("low"), F.coalesce(F.max(2 * F.least("a", "b")), F.lit(-1)).alias("high")).first()
    return r.low + 1, max(r.low, r.high) + 1


def _chance(seed: int, *parts: Column | str) -> Column:
    """A random number between 0 and 1, neither of them, from a counter."""
    return (draw_index(F.lit(1 << 40), seed, *parts) + 0.5) / float(1 << 40)


def _one_of(value: Column, weight: Column, *parts: Column | str, seed: int) -> Column:
    """An aggregate that picks a value of a group, each with a chance in proportion to its weight: the first of exponential clocks to ring."""
    return F.min_by(value, -F.log(_chance(seed, *parts)) / weight)


def _walked(near: DataFrame, links: DataFrame, pairs: DataFrame, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Walks from both ends (side 0 and 1) of each pair (i, s, t) until they meet.

    In a round each pair's side with fewer links ahead goes on by one level. Neighbours of a level lie in it, in the
    one before or in the next, so that only two levels are held against what is new (age 0 and 1). Returned are the
    levels (i, side, step, node, paths) and where walks met (i, node, step0, step1, weight).
    """
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("s").alias("node")), F.struct(F.lit(1).alias("side"), F.col("t").alias("node"))))
    state = written(pairs.select("i", ends.alias("x")).select("i", "x.side", "x.node", F.lit(0).alias("step"), F.lit(1.0).alias("paths"), F.lit(0).alias("age")), f"{name}/state")
    levels, meets = [state.select("i", "side", "step", "node", "paths")], []
    while not state.isEmpty():
        front = state.where("age = 0")
        ahead = front.join(links, "node", "left").groupBy("i").agg(*(F.sum(F.when(F.col("side") == x, F.coalesce("degree", F.lit(0))).otherwise(0)).alias(f"d{x}") for x in (0, 1)))
        moved = state.join(ahead.select("i", F.when(F.col("d0") <= F.col("d1"), 0).otherwise(1).alias("side")), ["i", "side"])
        reached = moved.where("age = 0").join(near, "node").select("i", "side", F.col("next").alias("node"), (F.col("step") + 1).alias("step"), "paths", F.lit(False).alias("old"))
        known = moved.select("i", "side", "node", "step", F.lit(0.0).alias("paths"), F.lit(True).alias("old"))
        new = reached.unionByName(known).groupBy("i", "side", "node").agg(F.max("step").alias("step"), F.sum("paths").alias("paths"), F.max("old").alias("old")).where("not old")
        new = written(new.select("i", "side", "step", "node", "paths"), f"{name}/level")
        levels.append(new)
        other = front.select("i", (1 - F.col("side")).alias("side"), "node", F.col("step").alias("step_"), F.col("paths").alias("paths_"))
        both = new.join(other, ["i", "side", "node"])
        step = lambda x: F.when(F.col("side") == x, F.col("step")).otherwise(F.col("step_")).alias(f"step{x}")
        met = written(both.select("i", "node", step(0), step(1), (F.col("paths") * F.col("paths_")).alias("weight")), f"{name}/met")
        meets.append(met)
        # pairs that have met are done, and so are those whose walk has nowhere to go
        on = new.select("i").distinct().join(met.select("i").distinct(), "i", "left_anti")
        kept = state.join(new.select("i", "side").distinct().withColumn("went", F.lit(True)), ["i", "side"], "left")
        kept = kept.where("went IS NULL OR age = 0").select("i", "side", "node", "step", "paths", F.when(F.col("went"), 1).otherwise(F.col("age")).alias("age"))
        state = written(kept.unionByName(new.withColumn("age", F.lit(0)).select(*kept.columns)).join(on, "i", "left_semi"), f"{name}/state")
    return levels, meets


def _inner_nodes(near: DataFrame, levels: list[DataFrame], meets: list[DataFrame], seed: int, name: str) -> DataFrame:
    """i, node: the nodes between the ends of one shortest path of each pair that has any, all with the same chance."""
    every = reduce(DataFrame.unionByName, levels)
    met = reduce(DataFrame.unionByName, meets)
    at = met.groupBy("i").agg(_one_of(F.struct("node", "step0", "step1"), F.col("weight"), "meet", F.col("i"), F.col("node"), seed=seed).alias("x")).select("i", "x.*")
    at = written(at, f"{name}/at")
    out = [at.where("step0 > 0 AND step1 > 0").select("i", "node")]
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("step0").alias("step")), F.struct(F.lit(1).alias("side"), F.col("step1").alias("step"))))
    at = at.select("i", "node", sides.alias("x")).select("i", "x.side", "x.step", "node")
    while True:
        back = at.where("step > 1").join(near, "node").select("i", "side", (F.col("step") - 1).alias("step"), F.col("next").alias("node"))
        back = back.join(every, ["i", "side", "step", "node"]).groupBy("i", "side", "step").agg(_one_of(F.col("node"), F.col("paths"), "back", F.col("i"), F.col("side"), F.col("node"), seed=seed).alias("node"))
        at = written(back, f"{name}/at")
        if at.isEmpty():
            return reduce(DataFrame.unionByName, out)
        out.append(at.select("i", "node"))


def sampled_betweenness(edges: DataFrame, epsilon: float = 0.01, delta: float = 0.1, seed: int = 42, pairs: int = PAIRS) -> DataFrame:
    """node, betweenness: how many of all pairs' shortest paths pass through a node, each pair's shared by its paths.

    Divided by n (n-1) / 2, all values are within ``epsilon`` at once with chance 1 - ``delta`` (half of it for either
    way to stop). Ends of a path don't count; loops and repeated edges change nothing. The same seed gives the same
    result, whatever the partitions. ``pairs`` are walked at a time, and their tables deleted then.
    """
    spark = edges.sparkSession
    nodes = written(ranked(graph.vertices(edges), [F.col("node").asc()], name="at").select("node", "at"), "nodes")
    near = written(graph.adjacency(graph.simplified(edges)).withColumnsRenamed({"u": "node", "v": "next"}), "near")
    links = written(near.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "links")
    n = nodes.count()
    if n < 3:
        return nodes.select("node", F.lit(0.0).alias("betweenness"))
    # the fewest with which a node that no path passes through is known to be within epsilon
    least = math.ceil(7 * math.log(8 * n * LOOKS / delta) / (3 * epsilon * (1 - ROOM)))
    most, wanted, done, looks, hits = None, least, 0, 0, []
    while True:
        while done < wanted:
            name, upto = f"paths-{uuid.uuid4().hex}", min(wanted, done + pairs)
            i = spark.range(done, upto).withColumnRenamed("id", "i")
            s, t = draw_index(F.lit(n), seed, "from", F.col("i")), draw_index(F.lit(n - 1), seed, "to", F.col("i"))
            drawn = i.select("i", s.alias("a"), t.alias("b")).select("i", "a", (F.col("b") + (F.col("b") >= F.col("a")).cast("long")).alias("b"))
            ends = drawn.join(nodes.select(F.col("node").alias("s"), F.col("at").alias("a")), "a").join(nodes.select(F.col("node").alias("t"), F.col("at").alias("b")), "b").select("i", "s", "t")
            levels, meets = _walked(near, links, ends, name)
            hits.append(written(_inner_nodes(near, levels, meets, seed, name).groupBy("node").agg(F.count(F.lit(1)).alias("c")), "path-hits"))
            dropped(spark, name)
            done = upto
        counts = written(reduce(DataFrame.unionByName, hits).groupBy("node").agg(F.sum("c").alias("c")), "path-counts")
        hits, looks = [counts], looks + 1
        largest = counts.agg(F.coalesce(F.max(F.col("c").cast("double") * (done - F.col("c"))), F.lit(0.0))).first()[0]
        if bernstein(largest, done, n, delta / 2) <= epsilon:
            break
        if most is None:
            most = pairs_by_length(longest_path(edges)[1], epsilon, delta / 2)
        if done >= most or looks >= LOOKS:
            wanted = max(done, most)
            if done >= most:
                break
        else:
            wanted = min(most, math.ceil(1.5 * done))
    share = F.coalesce(F.col("c"), F.lit(0)) / F.lit(done)
    return nodes.join(counts, "node", "left").select("node", (share * (n * (n - 1) / 2)).alias("betweenness"))
