"""Nodes with names: a distributed dictionary of names and ids, joined into tables and out of them.

Operators compare, hash and shuffle node ids all the time; 8-byte ids keep their shuffles narrow whatever names look
like. A name's id is its rank among all names in the order of their bytes, so that the same names always get the same
ids, and ties that go to the smaller id go to the smaller name. Names that come later are ranked after all that are
there, so that what has been computed stays valid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.rank import ranked
from ..plans.tables import written
from ..schema import require_columns


def names_in(*tables: tuple[DataFrame, tuple[str, ...]]) -> DataFrame:
    """name: every name in the given columns of the tables, once; nulls are none."""
    if not tables:
        raise ValueError("no tables given")
    each = [t.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("name")) for t, columns in tables]
    return reduce(DataFrame.unionByName, each).where("name IS NOT NULL").distinct()


def dictionary(names: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node, name: the ``known`` ones, and new names ranked after them; written once, as every join reads it.

    Ranks come from a range partition and its counts: no task sees all names.
    """
    names = names.select("name").where("name IS NOT NULL").distinct()
    if known is None:
        return written(ranked(names, [F.col("name").asc()], name="node").select("node", "name"), "names")
    first = known.agg(F.coalesce(F.max("node") + 1, F.lit(0)).alias("first"))
    new = ranked(names.join(known, "name", "left_anti"), [F.col("name").asc()], name="node")
    later = new.crossJoin(F.broadcast(first)).select((F.col("node") + F.col("first")).alias("node"), "name")  # one row
    return written(known.select("node", "name").unionByName(later), "names")


def encoded(table: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """``table`` with ids in place of the names in ``columns``. Rows with a name that the dictionary lacks fail the job; nulls stay.

    A name that very many rows have makes a skewed join, which Spark splits: the dictionary's side has one row a name.
    """
    return _swapped(table, names, columns, "name", "node", "long")


def decoded(table: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """``table`` with names in place of the ids in ``columns`` (``node``, if none are given)."""
    return _swapped(table, names, columns or ("node",), "node", "name", "string")


def _swapped(table: DataFrame, names: DataFrame, columns: tuple[str, ...], old: str, new: str, kind: str) -> DataFrame:
    require_columns(table, *columns)
    order = table.columns
    for c in columns:
        found = names.select(F.col(old).alias("old_"), F.col(new).alias("new_"))
        joined = table.withColumnRenamed(c, "own_").join(found, F.col("own_") == F.col("old_"), "left")
        missing = F.col("own_").isNotNull() & F.col("new_").isNull()
        swapped: Column = F.when(missing, F.raise_error(F.concat(F.lit(f"not in the dictionary: {c} "), F.col("own_").cast("string"))).cast(kind)).otherwise(F.col("new_"))
        table = joined.withColumn(c, swapped).select(*order)
    return table


def store(names: DataFrame, path: str, mode: str = "error") -> None:
    """The dictionary as a table beside what was computed with it, in the order of ids."""
    names.select("node", "name").repartitionByRange("node").sortWithinPartitions("node").write.mode(mode).parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(spark.read.parquet(path), "node", "name").select("node", "name")
