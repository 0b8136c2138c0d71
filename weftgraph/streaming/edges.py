"""Degrees and inter-community weight of a growing edge stream. Both are sums, so that batches only add."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.removal import inter_edges
from ..schema import EDGES


def edge_stream(spark: SparkSession, folder: str) -> DataFrame:
    """u, v from Parquet files that arrive in a folder."""
    return spark.readStream.schema(EDGES).parquet(folder)


def degree_stream(edges: DataFrame) -> DataFrame:
    """node, degree so far: for ``complete`` or ``update`` mode."""
    return edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def weigh_batches(edges: DataFrame, members: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's inter-community edges and weights under ``sink``, in a folder by batch.

    A batch that is repeated after a failure overwrites its own folder, so that nothing counts twice.
    """

    def each(batch: DataFrame, number: int) -> None:
        inter_edges(batch, members).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return edges.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
