"""Ranks over whole tables without one task that sees every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import written

#: Rows of a table of groups that is sent to all tasks, at most.
SENT = 200_000


def ranked(df: DataFrame, order: list[Column], groups: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """``df`` with a 0-based rank by ``order`` within ``groups``.

    Rows are range-partitioned by groups and order, sorted and numbered as they are written: the only shuffle. What
    lies in earlier partitions is added from counts, one row a partition and group; only those meet in a window.
    ``order`` must be total for the ranks to be reproducible.
    """
    by = [F.col(g).asc() for g in groups] + order
    # the id has the partition in its upper bits and the row's place in the lower ones
    dealt = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at_", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at_", 33).alias("part_")
    counts = dealt.groupBy(*groups, part).agg(F.count(F.lit(1)).alias("n_"), F.min("at_").alias("from_"))
    before = Window.partitionBy(*groups).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*groups, "part_", (F.coalesce(F.sum("n_").over(before), F.lit(0)) - F.col("from_")).alias("first_"))
    return dealt.withColumn("part_", part).join(first, [*groups, "part_"]).withColumn(name, (F.col("first_") + F.col("at_")).cast("long")).drop("part_", "at_", "first_")


def first_in(df: DataFrame, groups: tuple[str, ...], key: str, tie: str, need: str, digits: int = 1) -> DataFrame:
    """The ``need`` first rows of each group by ``key`` (ties: ``tie``), without ``need`` and ``key``. Exact.

    ``key`` is a hash in hexadecimal digits, ``need`` the same within a group. A first pass counts rows by the key's
    first digits. Rows with smaller digits than those with which a group has enough are taken as they are; only rows
    with just these digits, one in 16^``digits`` of all, are shuffled and sorted. Both passes read ``df``. The counts'
    result, a row a group, goes to all tasks where it has ``SENT`` rows at most.
    """
    head = F.substring(key, 1, digits)
    counts = df.groupBy(*groups, head.alias("head_")).agg(F.count(F.lit(1)).alias("n_"), F.max(need).alias("need_"))
    upto = Window.partitionBy(*groups).orderBy("head_")
    summed = counts.withColumn("sum_", F.sum("n_").over(upto))
    # the first digits with which there are enough; a group with too few rows keeps all
    enough = F.col("sum_") >= F.col("need_")
    cut = summed.groupBy(*groups).agg(F.min(F.when(enough, F.col("head_"))).alias("cut_"), F.coalesce(F.max(F.when(~enough, F.col("sum_"))), F.lit(0)).alias("sure_"))
    cut = written(cut, "cuts")
    held = df.join(F.broadcast(cut) if cut.count() <= SENT else cut, list(groups))
    sure = held.where(F.col("cut_").isNull() | (head < F.col("cut_"))).drop("sure_", "cut_", need, key)
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(key, tie))
    edge = held.where(head == F.col("cut_")).withColumn("place_", place).where(F.col("place_") + F.col("sure_") <= F.col(need))
    return sure.unionByName(edge.drop("place_", "sure_", "cut_", need, key))
