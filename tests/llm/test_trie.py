"""The conversation trie against a dictionary of all prefixes, and its merge against a plain sort."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from weftgraph.llm import queries, trie
from weftgraph.llm.trie import TURN, merged, prefix_trie, shared

SCHEMA = "conv_id long, turn int, role string, text string, c long, seq string, `a.b` int"


def frame(spark, rows, partitions=7):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(partitions)


def brute(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        full[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    out = []
    for p in sorted(members, key=len, reverse=True):
        below = [q for q in members if q[: len(p)] == p]
        ends = sorted(c for c in members[p] if len(full[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), sum(not kids[q] for q in below),
                    sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def conversations(rng, n, words, turns):
    rows = []
    for c in rng.sample(range(-20, 3 * n), n):
        rows += [(c, t, rng.choice(["user", "bot", None]), rng.choice(words)) for t in range(rng.randint(1, turns))]
    return rows


@pytest.mark.parametrize("few", [5, 2048])
def test_trie(spark, monkeypatch, few):
    """Small runs, buckets and fans make every merge happen."""
    rng = random.Random(few)
    rows = conversations(rng, 150, ["a", "b", "", None, "é" * 40], 12)
    rows += [(2000 + 5 * i, t, "user", f"same {t}") for i in range(120) for t in range(3)]  # one conversation that many are
    rows += [(4000, t, "user", "long") for t in range(300)] + [(4005, t, "user", "long") for t in range(320)]
    rows += [(5000, None, "user", "first"), (5000, 1, "user", "then"), (5000, 1, "user", "then"), (5003, 1, None, None), (None, 1, "x", "y"), (6001, 0, "bot", "z" * 100_000)]
    monkeypatch.setattr(trie, "FEW", few)
    monkeypatch.setattr(trie, "FAN", 3 if few == 5 else 64)
    monkeypatch.setattr(trie, "RUN", 11 if few == 5 else 16_384)
    monkeypatch.setattr(trie, "PIECE", 4)
    assert result(prefix_trie(frame(spark, rows))) == brute(rows)


def test_trie_of_little(spark):
    assert prefix_trie(frame(spark, [])).count() == 0
    assert prefix_trie(frame(spark, [(None, 1, "a", "b")])).count() == 0
    for rows in ([(7, 0, "a", "b")], [(0, 0, "a", "b")], [(0, 0, None, None), (0, 0, None, None)], [(3, t, "r", "t") for t in range(3)]):
        assert result(prefix_trie(frame(spark, rows))) == brute(rows)


def test_trie_by_sql(spark):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"create or replace view conversations as select * from '{sf}/conversations.parquet'")
    df = queries.op13_prefix_trie(spark, sf)
    assert result(df) == sorted(duckdb.sql("select " + ", ".join(df.columns) + " from (" + queries.ORACLES["op13_prefix_trie"] + ")").fetchall(), key=str)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 8, 13])
def test_merged(k):
    rng = random.Random(k)
    runs, every = [], []
    for _ in range(k):
        seqs = sorted({b"".join(bytes([rng.randint(0, 2)]) * TURN for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 30))})
        every += seqs
        runs.append(iter([(s, shared(seqs[i - 1], s) if i else 0, 1, 0, b"") for i, s in enumerate(seqs)]))
    got = list(merged(runs))
    assert [g[0] for g in got] == sorted(every)
    assert all(g[1] == (shared(got[i - 1][0], g[0]) if i else 0) for i, g in enumerate(got))
