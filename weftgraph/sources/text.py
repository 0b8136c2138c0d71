"""Readers of edge lists, covers, memberships and metric tables, and of raw generator output."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.published import all_datasets
from ..plans.tables import Files
from ..schema import EDGES, MEMBERS, NODE_COMMS, require_columns

#: Names of the id column in metric tables, the likeliest first.
ID_NAMES = ("Node ID", "node", "node_id", "nid", "id", "_id", "name", "vertex", "index")
DELIMITERS = (",", ";", "\t", " ")


@dataclass(frozen=True)
class DatasetPaths:
    """Where the files of one dataset lie."""

    folder: str
    key: str

    def _file(self, what: str) -> str:
        return f"{self.folder}/{self.key}/{self.key}_{what}"

    @property
    def network(self) -> str:
        return self._file("network.txt")

    @property
    def communities(self) -> str:
        return self._file("communities.txt")

    @property
    def node_communities(self) -> str:
        return self._file("node_to_communities.csv")


def numbered_lines(spark: SparkSession, path: str, count_blank: bool = True) -> DataFrame:
    """n (0-based line number), value, for files whose line numbers mean something; with blank lines, or without them.

    Partitions of a text scan follow the file; their counts, one row each, give each partition its first number, and
    lines are numbered within their partition.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("i"), "value").withColumn("part", F.shiftright("i", 33))
    if not count_blank:
        lines = lines.where(F.trim("value") != "")
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = lines.groupBy("part").agg(F.count(F.lit(1)).alias("c")).select("part", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("part").orderBy("i")) - 1
    return lines.withColumn("at", at).join(first, "part").select((F.col("before") + F.col("at")).alias("n"), "value")


def read_edges(spark: SparkSession, path: str, weighted: bool = False, kind: str = "bigint") -> DataFrame:
    """u, v (and w): an edge list, split at any white space; blank lines are skipped, edges are kept as they are.

    ``kind`` is the type of node ids, here and in the other readers: with ``string``, they are names (see ``names``).
    """
    parts = F.split(F.trim(F.regexp_replace("value", "\\s+", " ")), " ")
    rows = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("p"))
    out = [F.col("p")[i].cast(kind).alias(n) for i, n in enumerate(("u", "v"))]
    if weighted:
        out.append(F.coalesce(F.get(F.col("p"), F.lit(2)).try_cast("double"), F.lit(1.0)).alias("w"))
    return rows.select(*out)


def read_communities(spark: SparkSession, path: str, separator: str = "\t", count_blank: bool = False, kind: str = "bigint") -> DataFrame:
    """node, comm: one community a line; its number is the line's, blank lines not counted unless ``count_blank``."""
    separator = "\t" if separator == "\\t" else separator
    full = numbered_lines(spark, path, count_blank).where(F.trim("value") != "")
    items = full.select(F.col("n").cast("int").alias("comm"), F.explode(F.split(F.trim("value"), separator)).alias("x"))
    return items.where(F.trim("x") != "").select(F.trim("x").cast(kind).alias("node"), "comm")


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter by which most lines of the whole file have two fields or more; a comma where no line has (nodes without communities)."""
    full = lambda d: F.filter(F.split(F.trim("value"), "\\Q" + d + "\\E"), lambda x: F.trim(x) != "")
    counts = spark.read.text(path).agg(*(F.coalesce(F.sum((F.size(full(d)) > 1).cast("long")), F.lit(0)).alias(f"d{i}") for i, d in enumerate(DELIMITERS))).first()
    return DELIMITERS[max(range(len(DELIMITERS)), key=lambda i: (counts[i], -i))]


def read_node_communities(spark: SparkSession, path: str, delimiter: str | None = None, kind: str = "bigint") -> DataFrame:
    """node, comms: lines of a node and its communities (maybe none); of repeated nodes the last line holds, sets are sorted."""
    delimiter = delimiter or sniff_delimiter(spark, path)
    cells = F.filter(F.transform(F.split("value", "\\Q" + delimiter + "\\E"), lambda x: F.trim(x)), lambda x: x != "")
    rows = numbered_lines(spark, path).where(F.trim("value") != "").select("n", cells.alias("c"))
    comms = F.array_sort(F.array_distinct(F.transform(F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(0))), lambda x: x.cast("int"))))
    return rows.select(F.col("c")[0].cast(kind).alias("node"), "n", comms.alias("comms")).groupBy("node").agg(F.max_by("comms", "n").alias("comms"))


def wide_memberships(node_comms: DataFrame, width: int) -> DataFrame:
    """node, c0 .. : the first ``width`` communities of each node in columns of their own."""
    return node_comms.select("node", *(F.get("comms", F.lit(i)).alias(f"c{i}") for i in range(width)))


def id_column(columns: list[str]) -> str:
    """The column that holds node ids: by name, else the first."""
    lower = {c.lower(): c for c in columns}
    return next((lower[n.lower()] for n in ID_NAMES if n.lower() in lower), columns[0])


def read_metrics(spark: SparkSession, path: str, types: dict[str, str] | None = None, kind: str = "bigint") -> DataFrame:
    """A metric table with header; its id column becomes ``node``, all others double unless ``types`` says otherwise."""
    raw = spark.read.csv(path, header=True)
    own, types = id_column(raw.columns), types or {}
    rest = [F.expr(f"try_cast(`{c}` as {types.get(c, 'double')})").alias(c) for c in raw.columns if c != own]
    return raw.select(F.col(f"`{own}`").cast(kind).alias("node"), *rest)


def read_curves(spark: SparkSession, *paths: str) -> DataFrame:
    """Curve tables, by name; what one lacks is null there."""
    out = None
    for p in paths:
        t = spark.read.csv(p, header=True, inferSchema=True)
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    if out is None:
        raise ValueError("no paths given")
    return out


def first_there(spark: SparkSession, what: str, *paths: str) -> str:
    """The first of the paths at which there is something, in whatever store; FileNotFoundError, with all of them, if there is nothing."""
    for p in paths:
        if Files(spark, p).exists():
            return p
    raise FileNotFoundError(f"{what}: {', '.join(paths)}")


def homophily_curves(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """The processed homophily curves of a dataset: its own file, or that with components as well."""
    names = (f"processed_curves_homophily_{key}.csv", f"processed_curves_homophily_{key}_covgcc.csv")
    return read_curves(spark, first_there(spark, "homophily curves", *(f"{folder}/{n}" for n in names)))


def component_curves(spark: SparkSession, folder: str, key: str) -> DataFrame | None:
    """The processed curves of the largest component of a dataset, from its own file or one of several metrics; None if there are none."""
    names = (f"processed_curves_gcc_{key}.csv", f"processed_curves_gcc_{key}_covgcc.csv", f"processed_curves_{key}.csv")
    try:
        table = read_curves(spark, first_there(spark, "component curves", *(f"{folder}/{n}" for n in names)))
    except FileNotFoundError:
        return None
    metric = next((c for c in table.columns if c.lower() == "metric"), None)
    own = table if metric is None else table.where(F.lower(metric).contains("gcc"))
    return None if own.isEmpty() else own


def ratio_summaries(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The summary rows of several datasets: of one table of all of them, or else of each one's own, which must all be there."""
    whole = f"{folder}/summary_all_datasets_standard.csv"
    if Files(spark, whole).exists():
        return read_curves(spark, whole)
    return all_datasets({k: read_curves(spark, first_there(spark, "summary", f"{folder}/{k}/edge_ratio_summary_{k}.csv")) for k in keys})


def style_nodes(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """A metric table for figures: node, with ``pluralistic_homophily`` as hv_s1 and ``num_communities`` as m."""
    return read_metrics(spark, path, kind=kind).withColumnsRenamed({"pluralistic_homophily": "hv_s1", "num_communities": "m"})


def style_edges(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """u, v (the smaller id first), h_e of an edge metric table, whatever case and blanks its header has; ValueError if it lacks one of its columns."""
    raw = spark.read.csv(path, header=True)
    table = raw.toDF(*(c.strip().lower().replace(" ", "_") for c in raw.columns))
    require_columns(table, "node_1_id", "node_2_id", "he_s1")
    a, b = F.col("node_1_id").cast(kind), F.col("node_2_id").cast(kind)
    return table.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), F.col("he_s1").try_cast("double").alias("h_e"))


def read_generated(spark: SparkSession, network: str, communities: str) -> tuple[DataFrame, DataFrame]:
    """edges and members of a benchmark generator: ids from 1 become ids from 0, loops and repeated edges go."""
    raw = read_edges(spark, network)
    edges = raw.select((F.col("u") - 1).alias("u"), (F.col("v") - 1).alias("v")).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    cells = F.split(F.trim(F.regexp_replace("value", "\\s+", " ")), " ")
    rows = spark.read.text(communities).where(F.trim("value") != "").select(cells.alias("c"))
    members = rows.select((F.col("c")[0].cast("long") - 1).alias("node"), F.explode(F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(0)))).alias("x")).select("node", F.col("x").cast("int").alias("comm")).distinct()
    return edges, members


def typed(df: DataFrame, schema) -> DataFrame:
    """Columns of a canonical schema, cast to its types; what is missing raises."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


CANONICAL = {"edges": EDGES, "members": MEMBERS, "node_comms": NODE_COMMS}
