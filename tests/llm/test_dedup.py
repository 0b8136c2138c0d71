"""Exact and near duplicates against brute force."""

import math
import random
import re
from collections import defaultdict

import pytest

from weftgraph.llm import near
from weftgraph.llm.exact import exact_groups, without_copies
from weftgraph.llm.near import near_components, without_near_copies

SCHEMA = "doc_id long, text string, norm string, SHA int, `keep.id` string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], SCHEMA)


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


AWKWARD = [
    (5, None), (3, ""), (9, " "), (8, "\t\n"), (7, "a b"), (6, "a  b"), (6, "a b"), (None, "a\tb"), (None, None), (2, "A b"),
    (11, "x" * 30_000), (10, "x" * 30_000), (12, "x" * 30_000 + "y"), (13, "a b"), (4, "same words here"), (4, "same words here"),
]


@pytest.mark.parametrize("partitions", [1, 7])
def test_exact_groups(spark, small, partitions):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    rows = AWKWARD + [(1000 + i, t) for i, t in real] + [(5000 + i, "many copies") for i in range(300)]
    random.Random(1).shuffle(rows)
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    got = exact_groups(frame(spark, rows), partitions=partitions).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=key) == sorted(((i, keep[normal(t)], len(groups[normal(t)])) for i, t in rows), key=key)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    left = without_copies(frame(spark, rows), partitions=partitions)
    assert left.columns == ["doc_id", "text", "norm", "SHA", "keep.id"]
    assert sorted((normal(r.text), r.doc_id) for r in left.collect()) == sorted((t, i) for t, i in keep.items())


def test_exact_common_beginning(spark):
    """Texts that splitters can't tell apart, with copies that lie in several partitions."""
    rows = [(1000 * (i % 17) + i, "h" * 64 + str(i % 17)) for i in range(900)] + [(90_000 + i, "h" * 64) for i in range(700)]
    random.Random(2).shuffle(rows)
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    for partitions in (3, 13):
        got = exact_groups(frame(spark, rows), partitions=partitions).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == sorted((i, min(groups[t]), len(groups[t]), i == min(groups[t])) for i, t in rows)
        assert sorted(r.doc_id for r in without_copies(frame(spark, rows), partitions=partitions).collect()) == sorted(map(min, groups.values()))


def test_exact_empty(spark):
    assert exact_groups(frame(spark, [])).count() == 0
    assert without_copies(frame(spark, [])).count() == 0


def shingles(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    k = min(k, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(rows, k, percent):
    """Components over every pair."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {i: (len(x), root(i)) for i, x in sets}


def varied(seed, families, copies):
    """Families of texts, each changed a little in chains, so that links don't always close."""
    rng, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(300)]
    for f in range(families):
        text = [rng.choice(words) for _ in range(rng.randint(8, 120))]
        for _ in range(copies):
            text = list(text)
            for _ in range(max(1, len(text) // 25)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows) + 100 * f, " ".join(text)))
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near_components(spark, small, k):
    real = [(r.doc_id + 100_000, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    rows = real + varied(k, 6, 40) + [(90_001, None), (90_002, ""), (90_003, "one"), (90_004, "ONE"), (90_005, "a b"), (90_006, "A  B")]
    want = brute(rows, k, 80)
    got = near_components(frame(spark, rows), k, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_query_finds_every_link(spark):
    """Recall of the near-duplicate query on a thousand documents against all pairs."""
    from weftgraph.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()], 2, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op8_minhash"](spark, sf).collect()} == want
    assert sum(i != c for i, (_, c) in want.items()) > 100


def test_near_awkward(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None), (7, "a b c")]
    got = near_components(frame(spark, rows), 5, 80).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("1", "1", True), ("1", "1", True), ("7", "1", False), ("None", "None", True), ("None", "None", True)]
    left = without_near_copies(frame(spark, rows), 5, 80)
    assert left.columns == ["doc_id", "text", "norm", "SHA", "keep.id"] and left.count() == 4
    assert near_components(frame(spark, []), 5, 80).count() == 0


def test_near_unlucky_pairs(spark):
    """Pairs of similarity 0.8 that shared none of 32 bands of 5 minima, and were found in 2,400,000 such pairs."""
    unlucky = [293111, 692784, 822254, 1532753, 1563335, 1587238, 1639252, 1689988, 1811334, 2336719]
    rows = [(2 * n + side, " ".join(f"{i}.{j}" for j in range(11 - 2 * side))) for n, i in enumerate(unlucky) for side in range(2)]
    got = near_components(frame(spark, rows), 2, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (10 - 2 * (i % 2), i - i % 2) for i, _ in rows}


@pytest.mark.parametrize("percent", [1, 20, 50, 80, 95, 100])
def test_near_chances(percent):
    """Bands and signatures miss a pair that is just similar enough with a chance of 1e-15 at most."""
    h, s = near.Hashes(percent), min(percent / 100, 1 - 1e-9)
    assert (1 - s**h.rows) ** h.bands <= 1e-15
    assert sum(math.comb(h.signed, k) * s**k * (1 - s) ** (h.signed - k) for k in range(h.least)) <= 1e-15


def test_near_rows_of_one_id(spark):
    """The rows of an id are one document: what either of them links with is reached."""
    rows = [(3, "a b c d e"), (5, "a b c d e"), (5, "p q r s t"), (7, "p q r s t"), (8, "other words")]
    got = near_components(frame(spark, rows), 2, 80).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 3), (5, 3), (7, 3), (8, 8)]


def test_near_blocks(spark, monkeypatch):
    """Buckets that are dealt to many blocks, with pivots that leave much to them."""
    monkeypatch.setattr(near, "BLOCK", 3)
    monkeypatch.setattr(near, "PIVOTS", 1)
    rows = varied(9, 5, 40)
    got = near_components(frame(spark, rows), 2, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 2, 80)


def test_near_blocks_with_sets(spark, monkeypatch):
    """The same where no pair is put out, so that all of them meet in blocks with their sets."""
    monkeypatch.setattr(near, "PAIRS", 0)
    test_near_blocks(spark, monkeypatch)


def test_near_group_of_half_links(spark, monkeypatch):
    """A group whose pairs are mostly just not similar enough: no written table has rows for its pairs."""
    rng, base, rows = random.Random(3), [f"w{i}" for i in range(100)], []
    for i in range(240):
        text = list(base)
        for at in rng.sample(range(2, 98), 4):
            text[at] = f"x{i}.{at}"
        rows.append((i, " ".join(text)))
    most, write = {}, near.written

    def counted(df, name):
        out = write(df, name)
        if {"a", "b"} <= set(out.columns):
            most[name] = max(most.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near, "written", counted)
    got = near_components(frame(spark, rows), 2, 80).collect()
    want = brute(rows, 2, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert 20 < len({c for _, c in want.values()}) < 230
    assert max(most.values()) <= (near.PIVOTS + 1) * len(rows) < len(rows) * (len(rows) - 1) / 4


@pytest.mark.parametrize("kind", ["long", "string"])
def test_near_wanted_rows(spark, kind):
    """Sets are fetched for all rows of the wanted ids, and other texts aren't shuffled, but for few."""
    docs = spark.range(20_000).selectExpr(f"cast(id % 19000 as {kind}) as doc_id", "concat('t', id) as text")
    docs = docs.unionByName(spark.sql(f"select cast(null as {kind}) as doc_id, 'none' as text"))
    ids = spark.range(0, 19_000, 38).selectExpr(f"cast(id as {kind}) as id")
    got = [(r.id, bytes(r.text).decode()) for r in near._wanted(docs, ids, "doc_id", "text").collect()]
    wanted = {str(i) for i in range(0, 19_000, 38)}
    assert sorted(t for i, t in got if str(i) in wanted) == sorted(f"t{i}" for i in range(20_000) if str(i % 19_000) in wanted)
    assert len(wanted) < len(got) < 4000
    assert near._wanted(docs, ids.limit(0), "doc_id", "text").count() == 0


def test_held_sets():
    """Runs and loose sets say the same as pairs do."""
    import numpy as np

    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, n)).astype(np.uint64) for n in rng.integers(30, 200, 150)]
    held = near.Held()
    for i, x in enumerate(sets):
        if i:
            assert held.similar(x, 80).tolist() == [j for j in range(i) if near.similar_sets(x, sets[j], 80)]
        held.add(x)
    assert held.runs and held.loose
