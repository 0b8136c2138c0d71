"""From the files of a dataset to its published tables, in named stages that are made once.

A stage's key is a digest of its name, version and settings, of the keys of the stages that it reads, and, for files,
of their paths, lengths and times of change. Its tables lie in a folder named by that key: written under a hidden
name, moved when whole, and marked then. So a stage whose inputs haven't changed is read, not made, and a run that is
killed at any time leaves whole stages, and hidden folders that the next run deletes. The manifest says where the
tables of the last whole run lie and is replaced at once.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, curves, describe, graph, homophily, ier, published, removal, scalars, structure
from ..sources import names, sinks, text
from ..sources.text import DatasetPaths
from .tables import Files, written

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    """Named tables made from those of other stages. ``version`` goes up whenever ``make`` comes to give other results."""

    name: str
    make: Callable[[Callable[[str, str], DataFrame]], Tables]
    needs: tuple[str, ...] = ()
    files: tuple[str, ...] = ()
    settings: dict[str, Any] = field(default_factory=dict)
    version: int = 1


class Project:
    """Stages whose tables lie under ``root``. Several runs may share it: equal stages are the same folder."""

    def __init__(self, spark: SparkSession, root: str, stages: list[Stage]):
        self.spark, self.files = spark, Files(spark, root)
        self.stages = {s.name: s for s in stages}
        self.made: list[str] = []  # stages that this run has made, in order

    @cached_property
    def keys(self) -> dict[str, str]:
        """Each stage's key; a stage must come after those that it reads."""
        out: dict[str, str] = {}
        for s in self.stages.values():
            marks = [Files(self.spark, f).marks() for f in s.files]
            told = json.dumps([s.name, s.version, sorted(s.settings.items()), [out[n] for n in s.needs], marks], default=str)
            out[s.name] = hashlib.sha256(told.encode()).hexdigest()[:24]
        return out

    def folder(self, stage: str) -> str:
        return f"{stage}-{self.keys[stage]}"

    def done(self, stage: str) -> bool:
        return self.files.exists(f"{self.folder(stage)}/_DONE")

    def table(self, stage: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.files.folder}/{self.folder(stage)}/{name}")

    def run(self, *stages: str) -> Project:
        """Make what the given stages (all, if none) need and isn't there; then the manifest."""

        def make(name: str) -> None:
            if not self.done(name):
                for n in self.stages[name].needs:
                    make(n)
                self._make(self.stages[name])

        for n in stages or self.stages:
            make(n)
        kept = json.loads(self.files.read("manifest.json")) if self.files.exists("manifest.json") else {}
        kept |= {n: {"folder": self.folder(n), "tables": [t for t in self.files.names(self.folder(n)) if t[0] != "_"]} for n in self.stages if self.done(n)}
        self.files.write("manifest.json", json.dumps(kept, indent=1, sort_keys=True))
        return self

    def _make(self, stage: Stage) -> None:
        hidden, final = f".{stage.name}-{uuid.uuid4().hex}", self.folder(stage.name)
        for old in self.files.names():  # of runs that were killed
            if old.startswith(f".{stage.name}-"):
                self.files.delete(old)
        for name, df in stage.make(self.table).items():
            df.write.parquet(f"{self.files.folder}/{hidden}/{name}")
        self.files.delete(final)  # moved by a run that was killed before its mark
        self.files.move(hidden, final)
        self.files.write(f"{final}/_DONE", self.keys[stage.name])
        self.made.append(stage.name)

    def swept(self) -> list[str]:
        """Delete folders of stages that the manifest doesn't name: of earlier keys, or of runs that were killed. Not while others run."""
        kept = {v["folder"] for v in json.loads(self.files.read("manifest.json")).values()}
        gone = [n for n in self.files.names() if n not in kept and not n.endswith(".json")]
        for n in gone:
            self.files.delete(n)
        return gone


class DatasetProject(Project):
    """The project of one dataset; a map of nodes to communities that is missing among its files is made from the cover.

    A map that a run has made doesn't count as one of the files that are given, as long as nobody changes it.
    """

    MADE = "made-map.json"

    def __init__(self, spark: SparkSession, root: str, paths: DatasetPaths, **settings: Any):
        self.map, self.paths, files = Files(spark, paths.node_communities), paths, Files(spark, root)
        made = json.loads(files.read(self.MADE)) if files.exists(self.MADE) else None
        self.given = self.map.exists() and made not in (self._marks(), "being written")
        super().__init__(spark, root, dataset_stages(spark, paths, self.given, **settings))

    def _marks(self) -> list[list]:
        return [list(m) for m in self.map.marks()]

    def run(self, *stages: str) -> DatasetProject:
        super().run(*stages)
        if self.done("published") and not self.given and ("published" in self.made or not self.map.exists()):
            self.files.write(self.MADE, json.dumps("being written"))  # a run that is killed here is still known to have made it
            sinks.write_node_communities(self.table("published", "node_communities"), self.paths.node_communities, mode="overwrite", single=True)
            self.files.write(self.MADE, json.dumps(self._marks()))
        return self


def dataset_stages(spark: SparkSession, paths: DatasetPaths, has_map: bool, named: bool = False, repeats: int = 20, boot: int = 300, perm: int = 500, budget: float = 0.10, strict: bool = False) -> list[Stage]:
    """The stages of one dataset, from its edge list and its cover, or its map of nodes to communities, to all published tables.

    ``named``: nodes have names; tables have ids inside, and names again in the stage ``published``. ``strict``: a
    community's node without an edge stops the run; such nodes are named in the stage ``alignment`` otherwise.
    """
    kind = "string" if named else "bigint"
    has_cover = Files(spark, paths.communities).exists()

    def raw_members() -> DataFrame:
        cover = text.read_communities(spark, paths.communities, kind=kind) if has_cover else None
        known = text.read_node_communities(spark, paths.node_communities, kind=kind) if has_map else None
        return published.memberships(cover, known)

    def dictionary(_) -> Tables:
        edges = text.read_edges(spark, paths.network, kind=kind)
        return {"names": names.dictionary(names.names_in((edges, ("u", "v")), (raw_members(), ("node",))))}

    def network(t) -> Tables:
        edges, members = text.read_edges(spark, paths.network, kind=kind), raw_members()
        if named:
            edges, members = names.encoded(edges, t("names", "names"), "u", "v"), names.encoded(members, t("names", "names"), "node")
        # an edge without an end, or a member without a node, stops the run
        edges = align.gated(edges, "edges", without_an_end=F.col("u").isNull() | F.col("v").isNull())
        members = align.aligned(members, graph.vertices(edges), "members", "node") if strict else align.gated(members, "members", without_a_node=F.col("node").isNull())
        return {"edges": edges, "members": members, "nodes": graph.vertices(edges), "degrees": graph.degrees(edges)}

    def out(t, table: DataFrame, *columns: str) -> DataFrame:
        return names.decoded(table, t("names", "names"), *columns) if named else table

    def alignment(t) -> Tables:
        return {"misaligned": out(t, align.misaligned(network=t("network", "nodes"), communities=t("network", "members")), "node")}

    def node_communities(t) -> Tables:
        every = graph.communities_of(t("network", "members"), t("network", "nodes").unionByName(t("network", "members").select("node")).distinct())
        return {"node_communities": every}

    def homophilies(t) -> Tables:
        edges, members = t("network", "edges"), t("network", "members")
        values = written(scalars.scalar("s1", edges, members, t("network", "nodes")), "s1")
        return {"hv": homophily.hv(edges, values), "ghv": homophily.ghv(edges, values)}

    def metrics(t) -> Tables:
        edges, members, nodes = t("network", "edges"), t("network", "members"), t("network", "nodes")
        hv = t("homophily", "hv").select("node", F.col("hv").alias("hv_s1"), F.col("s").alias("s1"))
        return {"metrics": describe.unified(hv, structure.bridgecc(edges, nodes), t("network", "degrees"), structure.num_communities(nodes, members))}

    def removals(t) -> Tables:
        low = removal.metric_ranks(t("metrics", "metrics"), "hv_s1", True, "low_hv")
        ranks = written(low.unionByName(removal.random_ranks(t("network", "nodes"), repeats)), "ranks")
        return {"curves": removal.weight_curve(removal.inter_edges(t("network", "edges"), t("network", "members")), ranks)}

    def separation(t) -> Tables:
        return {"separation": published.separation_metrics(written(curves.normalised(t("curves", "curves")), "norm"), paths.key, paths.key)}

    def sets(t) -> Tables:
        edges, members, nodes = t("network", "edges"), t("network", "members"), t("network", "nodes")
        return {"sets": ier.target_sets(t("metrics", "metrics").select("node", "hv_s1", "bridgecc"), budget), "quartiles": ier.degree_quartiles(t("network", "degrees")), "inter": ier.inter_degrees(edges, members, nodes)}

    def null(t) -> Tables:
        return {"null": ier.null_statistics(*(t("sets", n) for n in ("sets", "inter", "quartiles")), perm)}

    def ratios(t) -> Tables:
        own = [t("sets", n) for n in ("sets", "inter", "quartiles")]
        obs, given = written(ier.observed(*own), "observed"), t("null", "null")
        return {"summary": ier.summary(obs, ier.bootstrap(*own, boot), ier.permutation_p(given, obs), paths.key, perm), "deltas": ier.deltas(given, obs, paths.key)}

    def publish(t) -> Tables:
        return {"hv_metrics": out(t, t("homophily", "hv").select("node", F.col("hv").alias("hv_s1"), F.col("s").alias("s1")), "node"), "all_metrics": out(t, t("metrics", "metrics"), "node"), "node_communities": out(t, t("node_communities", "node_communities"), "node")}

    ids = ("names",) if named else ()
    own = {"named": named, "strict": strict}
    source = (paths.network, *([paths.communities] if has_cover else []), *([paths.node_communities] if has_map else []))
    return [
        *([Stage("names", dictionary, files=source, settings=own)] if named else []),
        Stage("network", network, ids, source, own),
        Stage("alignment", alignment, ("network", *ids), settings=own),
        Stage("node_communities", node_communities, ("network",)),
        Stage("homophily", homophilies, ("network",)),
        Stage("metrics", metrics, ("network", "homophily")),
        Stage("curves", removals, ("network", "metrics"), settings={"repeats": repeats}),
        Stage("separation", separation, ("curves",), settings={"key": paths.key}),
        Stage("sets", sets, ("network", "metrics"), settings={"budget": budget}),
        Stage("null", null, ("sets",), settings={"perm": perm}),
        Stage("ratios", ratios, ("sets", "null"), settings={"boot": boot, "key": paths.key}),
        Stage("published", publish, ("homophily", "metrics", "node_communities", *ids), settings=own),
    ]
