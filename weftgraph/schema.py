"""Schemas of the canonical tables, and fail-fast checks of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

EDGES = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
MEMBERS = T.StructType([T.StructField("node", T.LongType()), T.StructField("comm", T.IntegerType())])
NODE_COMMS = T.StructType([T.StructField("node", T.LongType()), T.StructField("comms", T.ArrayType(T.IntegerType()))])
CURVE = T.StructType([T.StructField("strategy", T.StringType()), T.StructField("k", T.LongType()), T.StructField("p", T.DoubleType()), T.StructField("value", T.DoubleType())])


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """The table itself; ValueError if a column is missing (case ignored)."""
    have = {c.lower() for c in df.columns}
    missing = [n for n in names if n.lower() not in have]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df
