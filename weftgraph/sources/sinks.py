"""Writers. Tables are written by Spark in parallel; a mode other than ``overwrite`` never replaces what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import Files


def write_metrics(df: DataFrame, path: str, mode: str = "error") -> None:
    """A metric table as CSV with header; ``node`` is written first, as ``Node ID``."""
    df.select(F.col("node").alias("Node ID"), *[c for c in df.columns if c != "node"]).write.mode(mode).csv(path, header=True)


def write_table(df: DataFrame, path: str, mode: str = "error", by: str | None = None) -> None:
    """Any table as CSV with header, in folders by one column if given."""
    out = df.write.mode(mode).option("header", True)
    (out.partitionBy(by) if by else out).csv(path)


def write_edge_homophily(rows: DataFrame, path: str, mode: str = "error") -> None:
    """What ``published.edge_rows`` gives, as CSV with the published header."""
    named = {"edge_id": "Edge ID", "node_1": "Node 1 ID", "node_2": "Node 2 ID"}
    rows.withColumnsRenamed(named).write.mode(mode).csv(path, header=True)


def _write_lines(lines: DataFrame, path: str, mode: str, single: bool) -> None:
    """Lines (value) in their order: a folder of part files, or ``single``, one file by that name, made of ordered parts."""
    if not single:
        lines.write.mode(mode).text(path)
        return
    folder, _, name = path.rpartition("/")
    files = Files(lines.sparkSession, folder)
    if mode != "overwrite" and files.exists(name):
        raise FileExistsError(path)
    parts = f".{uuid.uuid4().hex}"
    lines.write.text(f"{folder}/{parts}")
    files.joined(parts, name)
    files.delete(parts)


def write_edges(edges: DataFrame, path: str, mode: str = "error", single: bool = False) -> None:
    """An edge a line, ends parted by a tab; a ``single`` file is sorted by both ends."""
    if single:
        edges = edges.repartitionByRange("u", "v").sortWithinPartitions("u", "v")
    _write_lines(edges.select(F.concat_ws("\t", "u", "v").alias("value")), path, mode, single)


def write_communities(members: DataFrame, path: str, mode: str = "error", single: bool = False) -> None:
    """One community a line, by its number; empty ones have no line."""
    lines = members.groupBy("comm").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    in_order = lines.repartitionByRange("comm").sortWithinPartitions("comm")
    _write_lines(in_order.select(F.array_join(F.transform("nodes", lambda x: x.cast("string")), "\t").alias("value")), path, mode, single)


def write_node_communities(node_comms: DataFrame, path: str, mode: str = "error", single: bool = False) -> None:
    """Lines of a node and its communities, by node; nodes without any have a line of their own id."""
    cells = F.concat(F.array(F.col("node").cast("string")), F.transform("comms", lambda c: c.cast("string")))
    in_order = node_comms.repartitionByRange("node").sortWithinPartitions("node")
    _write_lines(in_order.select(F.array_join(cells, ",").alias("value")), path, mode, single)


def markdown(row: DataFrame, title: str) -> str:
    """A one-row table as a list."""
    r = row.first().asDict()
    return f"# {title}\n\n" + "".join(f"- **{k}**: {v}\n" for k, v in r.items())
