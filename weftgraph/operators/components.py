"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import dropped, written


def _mark(edges: DataFrame) -> tuple:
    """Count and sum of hashes: equal for equal sets of edges."""
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def stars(edges: DataFrame, u: str = "u", v: str = "v", most: int = 100) -> DataFrame:
    """node, component of every node that an edge touches; the component is its smallest node.

    Rounds go on until no edge changes; each is written to the shared folder, so that lineage stays short, and then the
    round before it is deleted. A hub's
    edges meet its minimum in a join that Spark splits if it is skewed. Loops and repeated edges change nothing; a
    node with loops only is its own component.
    """
    src = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null")
    own = src.where("u = v").select(F.col("u").alias("node"))
    name = f"components-{uuid.uuid4().hex}"
    now = written(src.where("u <> v").distinct(), f"{name}/0/edges")
    before = _mark(now)
    for k in range(1, most + 1):
        if not before[0]:
            break
        now = written(_small_star(_large_star(now)), f"{name}/{k}/edges")
        dropped(edges.sparkSession, f"{name}/{k - 1}")
        after = _mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")))
    loops = own.select("node", F.col("node").alias("component"))
    return nodes.unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
