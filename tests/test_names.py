"""Names of nodes from file to result, and back."""

import pytest

from weftgraph.operators import homophily, scalars
from weftgraph.sources import names, sinks, text

EDGES = "anna bob\nanna\tcarl\n\nbob  carl\ncarl Élan\nÉlan 10\nÉlan 9\n10 9\n9 zoe\nbob 10\n"
COVER = "anna\tbob\tcarl\n\nÉlan\t10\t9\ncarl\tÉlan\n"


@pytest.fixture
def named(spark, tmp_path):
    (tmp_path / "n.txt").write_text(EDGES)
    (tmp_path / "c.txt").write_text(COVER)
    (tmp_path / "m.csv").write_text("anna,0\ncarl,0,2\nÉlan,1,2\nnobody\n")
    return text.read_edges(spark, str(tmp_path / "n.txt"), kind="string"), text.read_communities(spark, str(tmp_path / "c.txt"), kind="string"), text.read_node_communities(spark, str(tmp_path / "m.csv"), kind="string")


def pairs(df):
    return {r.name: r.node for r in df.collect()}


def test_dictionary(spark, named, tmp_path):
    edges, members, map_ = named
    ids = names.dictionary(names.names_in((edges, ("u", "v")), (members, ("node",)), (map_, ("node",))))
    every = sorted(["anna", "bob", "carl", "Élan", "10", "9", "zoe", "nobody"], key=str.encode)
    assert pairs(ids) == {n: i for i, n in enumerate(every)}
    names.store(ids, str(tmp_path / "ids"))
    again = names.stored(spark, str(tmp_path / "ids"))
    assert pairs(again) == pairs(ids)
    more = spark.createDataFrame([("aaron",), ("zoe",), (None,), ("zack",), ("aaron",)], "name string")
    assert pairs(names.dictionary(more, again)) == pairs(ids) | {"aaron": 8, "zack": 9}
    assert pairs(names.dictionary(more, again.where("false"))) == {"aaron": 0, "zack": 1, "zoe": 2}
    back = names.decoded(names.encoded(edges, ids, "u", "v"), ids, "u", "v")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, edges.collect())) and back.columns == ["u", "v"]
    loose = edges.unionByName(spark.createDataFrame([(None, "anna")], "u string, v string"))
    assert names.encoded(loose, ids, "u", "v").where("u is null").count() == 1
    with pytest.raises(Exception, match="not in the dictionary: v zoe"):
        names.encoded(edges, ids.where("name <> 'zoe'"), "u", "v").collect()


def test_hv_of_names(spark, named, tmp_path):
    """The same values as with numbers for names."""
    edges, members, _ = named
    ids = names.dictionary(names.names_in((edges, ("u", "v")), (members, ("node",))))
    e, m = names.encoded(edges, ids, "u", "v"), names.encoded(members, ids, "node")
    got = names.decoded(homophily.hv(e, scalars.scalar("s1", e, m)), ids).select("node", "hv")
    sinks.write_metrics(got, str(tmp_path / "hv"))
    read = {r.node: r.hv for r in text.read_metrics(spark, str(tmp_path / "hv"), kind="string").collect()}
    number = {n: i for i, n in enumerate(["zoe", "9", "10", "Élan", "carl", "bob", "anna"])}
    plain = spark.createDataFrame([(number[r.u], number[r.v]) for r in edges.collect()], "u long, v long")
    cover = spark.createDataFrame([(number[r.node], r.comm) for r in members.collect()], "node long, comm int")
    want = {r.node: r.hv for r in homophily.hv(plain, scalars.scalar("s1", plain, cover)).collect()}
    assert {number[n]: round(v, 12) for n, v in read.items()} == {n: round(v, 12) for n, v in want.items()}
