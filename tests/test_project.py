"""A project that is killed and goes on, and files in the published layout."""

import json
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from weftgraph.operators import align, graph, homophily, scalars
from weftgraph.plans import oracle
from weftgraph.plans.project import DatasetProject, Project, Stage
from weftgraph.plans.tables import Files
from weftgraph.sources import sinks, text
from weftgraph.sources.text import DatasetPaths

FEW = {"named": True, "repeats": 3, "boot": 5, "perm": 7}
#: A run in another process, which ends at once when a stage's tables are whole but not yet at their place.
KILLED = """
import os, sys
from pyspark.sql import SparkSession
from weftgraph.plans.project import DatasetProject
from weftgraph.plans.tables import Files
from weftgraph.sources.text import DatasetPaths
folder, stage = sys.argv[1:]
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
move = Files.move
def dies(self, old, new, replace=False):
    if new.startswith(stage + "-"):
        os._exit(9)
    move(self, old, new, replace)
Files.move = dies
DatasetProject(spark, folder + "/tables", DatasetPaths(folder, "g"), named=True, repeats=3, boot=5, perm=7).run()
"""


@pytest.fixture
def folder(spark, tmp_path):
    pairs = [(i, (i * 7 + j * j + 1) % 60) for i in range(60) for j in range(3)]
    lines = "".join(f"n{u} n{v}\n" for u, v in pairs if u != v)
    (tmp_path / "g").mkdir()
    (tmp_path / "g/g_network.txt").write_text(lines)
    (tmp_path / "g/g_communities.txt").write_text("".join("\t".join(f"n{i}" for i in range(60) if i % 9 in (c, (c * c + 1) % 9)) + "\n" for c in range(9)))
    return tmp_path


def rows(df):
    return sorted(str(tuple(f"{v:.9g}" if isinstance(v, float) else v for v in r)) for r in df.collect())


def tables(p):
    return {(s, t): rows(p.table(s, t)) for s in p.stages for t in p.files.names(p.folder(s)) if t[0] != "_"}


def test_killed_and_resumed(spark, folder):
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    paths = DatasetPaths(str(folder), "g")
    ended = subprocess.run([sys.executable, "-c", KILLED, str(folder), "curves"], env=env, capture_output=True, timeout=300)
    assert ended.returncode == 9, ended.stderr.decode()[-2000:]
    p = DatasetProject(spark, f"{folder}/tables", paths, **FEW)
    before = {s: Files(spark, f"{folder}/tables").marks(p.folder(s)) for s in p.stages if p.done(s)}
    assert list(before) == ["names", "network", "alignment", "node_communities", "homophily", "metrics"] and not p.files.exists("manifest.json")
    assert any(n.startswith(".curves-") for n in p.files.names())
    p.run()
    assert p.made == ["curves", "separation", "sets", "null", "ratios", "published"]
    assert {s: p.files.marks(p.folder(s)) for s in before} == before and not any(n.startswith(".curves-") for n in p.files.names())
    whole = DatasetProject(spark, f"{folder}/other", paths, **FEW)
    assert tables(whole.run()) == tables(p) and len(whole.made) == 12
    # the map that was missing is there, one line a node, and changes no key
    read = {r.node: r.comms for r in text.read_node_communities(spark, paths.node_communities, kind="string").collect()}
    assert read == {f"n{i}": sorted({c for c in range(9) if i % 9 in (c, (c * c + 1) % 9)}) for i in range(60)}
    again = DatasetProject(spark, f"{folder}/tables", paths, **FEW).run()
    assert again.made == [] and again.keys == p.keys
    assert json.loads(p.files.read("manifest.json"))["ratios"]["tables"] == ["deltas", "summary"]
    # other settings make only what reads them; a changed file makes everything
    more = DatasetProject(spark, f"{folder}/tables", paths, **FEW | {"boot": 6}).run()
    assert more.made == ["ratios"]
    assert more.swept() == [p.folder("ratios")] and more.done("ratios")
    os.remove(paths.node_communities)
    assert DatasetProject(spark, f"{folder}/tables", paths, **FEW).run("published").made == [] and os.path.exists(paths.node_communities)
    with open(paths.network, "a") as f:
        f.write("n0 new\n")
    assert DatasetProject(spark, f"{folder}/tables", paths, **FEW).run("homophily").made == ["names", "network", "homophily"]


def test_given_map_and_numbers(spark, folder):
    """A map that is given is preferred to the cover, and stays as it is."""
    (folder / "g/g_network.txt").write_text("0 1\n0 2\n1 2\n2 3\n3 4\n3 5\n4 5\n5 6\n1 4\n")
    (folder / "g/g_communities.txt").write_text("0\t1\t2\t3\t4\t5\t6\n")
    given = "0,0\n1,0\n2,0,2\n3,1,2\n4,1\n5,1\n6\n"
    (folder / "g/g_node_to_communities.csv").write_text(given)
    p = DatasetProject(spark, f"{folder}/tables", DatasetPaths(str(folder), "g")).run("published")
    want = [-10 / 909, -5 / 1212, 13 / 1212, 13 / 1212, -5 / 1212, 25 / 1212, 115 / 3636]
    assert {r.node: round(r.hv_s1, 12) for r in p.table("published", "hv_metrics").collect()} == {i: round(w, 12) for i, w in enumerate(want)}
    assert (folder / "g/g_node_to_communities.csv").read_text() == given


def test_alignment(spark, folder):
    sides = {"left": [(1,), (1,), (2,), (None,)], "right": [(2,), (3,)], "more": [(1,), (2,), (4,), (4,)]}
    found = align.misaligned(**{k: spark.createDataFrame(v, "node long") for k, v in sides.items()})
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [(1, "right", 3), (3, "left", 1), (3, "more", 1), (4, "left", 2), (4, "right", 2), (None, "any", 1)]))
    edges = spark.createDataFrame([(1, 2), (2, 9), (7, 1)], "u long, v long")
    nodes = spark.createDataFrame([(1,), (2,), (2,)], "node long")
    with pytest.raises(ValueError, match="e: 1 rows are unknown_u, 1 rows are unknown_v, such as 7, 9"):
        align.aligned(edges, nodes, "e", "u", "v")
    assert sorted(map(tuple, align.aligned(edges.where("u < 7 AND v < 9"), nodes, "e", "u", "v").collect())) == [(1, 2)]
    with pytest.raises(ValueError, match="2 rows are large"):
        align.gated(edges, "e", large=edges.u + edges.v > 7, small=edges.u < 0)
    with open(folder / "g/g_communities.txt", "a") as f:
        f.write("n1\tstranger\n")
    paths = DatasetPaths(str(folder), "g")
    p = DatasetProject(spark, f"{folder}/tables", paths, **FEW).run("alignment")
    assert [tuple(r) for r in p.table("alignment", "misaligned").collect()] == [("stranger", "network", 1)]
    with pytest.raises(ValueError, match="members: 1 rows are unknown_node"):
        DatasetProject(spark, f"{folder}/strict", paths, strict=True, **FEW).run("alignment")


def test_stage_that_fails(spark, tmp_path):
    good, calls = spark.range(3), []

    def bad(t):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("once")
        return {"x": t("a", "x")}

    stages = [Stage("a", lambda t: {"x": good}), Stage("b", bad, ("a",))]
    with pytest.raises(RuntimeError, match="once"):
        Project(spark, str(tmp_path / "p"), stages).run()
    p = Project(spark, str(tmp_path / "p"), stages).run()
    assert p.made == ["b"] and p.table("b", "x").count() == 3
    newer = Project(spark, str(tmp_path / "p"), [stages[0], Stage("b", bad, ("a",), version=2)])
    assert newer.folder("a") == p.folder("a") and not newer.done("b")


def test_single_files(spark, tmp_path):
    """One file each, in order, that the readers take line by line."""
    edges = spark.createDataFrame([(5, 1), (0, 3), (0, 2), (11, 4)], "u long, v long").repartition(3)
    members = spark.createDataFrame([(7, 1), (3, 0), (10, 1), (2, 2), (3, 2)], "node long, comm int").repartition(3)
    sinks.write_edges(edges, f"{tmp_path}/e.txt", single=True)
    assert (tmp_path / "e.txt").read_text() == "0\t2\n0\t3\n5\t1\n11\t4\n"
    sinks.write_communities(members, f"{tmp_path}/c.txt", single=True)
    assert (tmp_path / "c.txt").read_text() == "3\n7\t10\n2\t3\n"
    assert sorted(map(tuple, text.read_communities(spark, f"{tmp_path}/c.txt").collect())) == [(2, 2), (3, 0), (3, 2), (7, 1), (10, 1)]
    sinks.write_node_communities(graph.communities_of(members, spark.range(12).withColumnRenamed("id", "node")), f"{tmp_path}/n.csv", single=True)
    assert (tmp_path / "n.csv").read_text().splitlines()[:5] == ["0", "1", "2,2", "3,0,2", "4"]
    assert {r.node: r.comms for r in text.read_node_communities(spark, f"{tmp_path}/n.csv").collect()}[3] == [0, 2]
    with pytest.raises(FileExistsError):
        sinks.write_edges(edges, f"{tmp_path}/e.txt", single=True)
    sinks.write_edges(edges.where("false"), f"{tmp_path}/e.txt", mode="overwrite", single=True)
    assert (tmp_path / "e.txt").read_text() == "" and sorted(os.listdir(tmp_path)) == [".c.txt.crc", ".e.txt.crc", ".n.csv.crc", "c.txt", "e.txt", "n.csv"]


def test_degree_weighted_average(spark):
    """Weighted by degree, ghv averages to the assortativity, and hv sums to half of it."""
    edges = spark.createDataFrame([(i, (i * i + 3) % 23) for i in range(23)] + [(i, i + 1) for i in range(22)], "u long, v long")
    members = spark.createDataFrame([(i, (i + c) % 4) for i in range(23) for c in range(i % 3)], "node long, comm int")
    values = scalars.scalar("s1", edges, members)
    r = homophily.assortativity(edges, values).first().r
    both = homophily.ghv(edges, values).join(graph.degrees(edges), "node").selectExpr("sum(degree * ghv) / sum(degree) as mean").first().mean
    assert abs(both - r) < 1e-12 and abs(homophily.hv(edges, values).selectExpr("sum(hv) as t").first().t - r / 2) < 1e-12


def test_project_query(spark, small):
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from read_parquet('{small}/lineitem.parquet')")
    want = con.execute(oracle.ORACLES["project_metrics"])
    columns = [d[0] for d in want.description]
    got = entry.queries()["project_metrics"](spark, small)
    assert sorted(got.columns) == sorted(columns)
    tidy = lambda r: tuple(f"{v:.8g}" if isinstance(v, float) else str(v) for v in r)
    assert sorted(tidy([r[c] for c in columns]) for r in got.collect()) == sorted(map(tidy, want.fetchall()))
