"""Prefix trie of conversations by an external mergesort whose runs carry the lengths of shared prefixes.

A turn is 20 bytes (a digest of role and text, and the text's length), a conversation the bytes of its turns, so that
equal conversations are collapsed first. Tasks sort bounded runs and send each conversation without the turns that it
shares with the one before it. A bucket's runs are merged by a tree of losers that compares shared lengths before turns
and so never looks at a shared turn again. The merged stream keeps the open path in a stack: what a conversation
leaves of it is finished and emitted. Only the paths at a bucket's two ends stay open; those are merged in the same
way, a few buckets at a time.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, hot_join, in_arrow, values, written

#: Bytes of a turn: its digest, then the length of its text.
DIGEST, TURN = 16, 20
#: A conversation begins with fewer turns than this of the one that its id is taken from, which is one in ``FAMILY``.
HEADS, FAMILY = 9, 5
#: Conversations and bytes of a sorted run, at most, about.
RUN, RUN_BYTES = 16_384, 8 << 20
#: Different conversations of a bucket, about: the first while there are no more than ``BUCKETS`` of them.
FEW, BUCKETS, MANY = 2048, 1024, 65_536
#: Sampled conversations for each bucket, and turns of them that splitters look at.
SAMPLED, SPLIT_TURNS = 16, 64
#: Buckets whose open paths one task merges.
FAN = 64
#: Ids of one piece of a list that is hashed.
PIECE = 4096
NONE = hashlib.sha256(b"").digest()
ROOT = bytes(DIGEST)

GROUP = pa.schema([("digest", pa.binary()), ("seq", pa.binary()), ("c", pa.int64()), ("n", pa.int64()), ("ends", pa.binary()), ("ids", pa.string())])
SORTED = pa.schema([("bucket", pa.int32()), ("run", pa.int64()), ("at", pa.int32()), ("lcp", pa.int32()), ("tail", pa.binary()), ("n", pa.int64()), ("c", pa.int64()), ("ends", pa.binary())])
NODE = pa.schema([
    ("bucket", pa.int32()), ("at", pa.int32()), ("left", pa.bool_()), ("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int32()), ("size", pa.int64()),
    ("n", pa.int64()), ("c", pa.int64()), ("kids", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.binary()),
])
GROUP_DDL = "digest binary, seq binary, c long, n long, ends binary, ids string"
SORTED_DDL = "bucket int, run long, at int, lcp int, tail binary, n long, c long, ends binary"
NODE_DDL = "bucket int, at int, left boolean, key binary, parent binary, depth int, size long, n long, c long, kids long, leaves long, saved long, ends binary"


def own_turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """c, seq: each conversation's turns in order, ``TURN`` bytes each."""
    rows = df.select(col(conv_col).cast("long").alias("c"), col(turn_col).alias("t"), F.coalesce(col(role_col), F.lit("")).alias("r"), F.coalesce(col(text_col), F.lit("")).alias("x")).where("c IS NOT NULL")
    named = F.sha2(F.concat(F.octet_length("r").cast("string"), F.lit(":"), F.col("r"), F.col("x")), 256)
    label = F.concat(F.substring(named, 1, 2 * DIGEST), F.lpad(F.hex(F.octet_length("x").cast("long")), 2 * (TURN - DIGEST), "0"))
    in_order = F.sort_array(F.collect_list(F.struct("t", label.alias("label"))))
    return rows.groupBy("c").agg(F.unhex(F.array_join(F.transform(in_order, lambda s: s["label"]), "")).alias("seq"))


def rebuilt(own: DataFrame) -> DataFrame:
    """c, seq: conversations with the first turns of their family's first one in place of their own first turns."""
    head = own.select(F.col("c").alias("b"), F.substring("seq", 1, TURN * (HEADS - 1)).alias("head"))
    rows = own.withColumns({"b": F.col("c") - F.col("c") % FAMILY, "h": (TURN * (F.crc32(F.col("c").cast("string").cast("binary")) % HEADS)).cast("int")}).join(head, "b", "left")
    first = F.coalesce(F.substring(F.col("head"), F.lit(1), F.col("h")), F.unhex(F.lit("")))
    return rows.select("c", F.concat(first, F.substring(F.col("seq"), F.col("h") + 1, F.octet_length("seq"))).alias("seq"))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal digests within a sorted partition; ids in pieces where a group may go on in another."""

    def pieces(key: bytes, seq: bytes, ids: list[int]) -> list[tuple]:
        return [(key, None if at else seq, ids[at], len(ids[at : at + PIECE]), None, ",".join(map(str, ids[at : at + PIECE]))) for at in range(0, len(ids), PIECE)]

    rows = ((d, s, c) for b in batches for d, s, c in zip(values(b.column("digest")), values(b.column("seq")), b.column("c").to_pylist(), strict=True))
    out, before = [], None
    for at, (key, group) in enumerate(groupby(rows, key=lambda r: r[0])):
        seq, ids = None, []
        for _, s, c in group:
            seq = s if seq is None else seq
            ids.append(c)
        if before is not None:
            # no first group any more, and no last one either, as another follows
            out += pieces(*before) if at == 1 else [(before[0], before[1], before[2][0], len(before[2]), _hashed(before[2]), None)]
        before = (key, seq, ids)
        if len(out) >= 1000:
            yield _batch(out, GROUP)
            out = []
    if before is not None:
        out += pieces(*before)
    for at in range(0, len(out), 1000):
        yield _batch(out[at : at + 1000], GROUP)


def _hashed(ids: list[int]) -> bytes:
    return hashlib.sha256(",".join(map(str, ids)).encode()).digest()


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups whose pieces follow each other, hashed piece by piece."""
    rows = (r for b in batches for r in zip(*(values(b.column(c)) for c in ("digest", "seq", "c", "n", "ids")), strict=True))
    for key, group in groupby(rows, key=lambda r: r[0]):
        h, seq, first, n = hashlib.sha256(), None, None, 0
        for _, s, c, m, ids in group:
            h.update(("" if first is None else ",").encode() + ids.encode())
            seq, first, n = (s if seq is None else seq), (c if first is None else first), n + m
        yield _batch([(key, seq, first, n, h.digest(), None)], GROUP)


def distinct_conversations(rows: DataFrame) -> DataFrame:
    """seq, n, c, ends: each different conversation, how many are it, the smallest of their ids, and the digest of all.

    Ids are sorted by all tasks together, so that a conversation that very many are is spread over tasks; of those at
    the edges of tasks, pieces of joined ids meet in one task, which hashes them one after the other.
    """
    keyed = rows.withColumn("digest", F.substring(F.unhex(F.sha2("seq", 256)), 1, DIGEST))
    groups = written(in_arrow(keyed.select("digest", "c", "seq").repartitionByRange("digest", "c").sortWithinPartitions("digest", "c"), _grouped, GROUP_DDL), "equal")
    cut = groups.where("ids IS NOT NULL").repartition("digest").sortWithinPartitions("digest", "c")
    whole = groups.where("ids IS NULL").unionByName(in_arrow(cut, _joined, GROUP_DDL))
    return written(whole.select("seq", "n", "c", "ends"), "conversations")


def shared(a: bytes, b: bytes, turns: int = 0) -> int:
    """Turns that both begin with; the first ``turns`` are known to be the same."""
    at, end = turns * TURN, min(len(a), len(b))
    while at < end and a[at : at + TURN] == b[at : at + TURN]:
        at += TURN
    return at // TURN


def _runs(splitters: list[bytes]):
    """Sorted runs of a partition, dealt to buckets. A row is what follows its ``lcp`` turns in the row of the run before it."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, held = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            for r in zip(*(values(b.column(c)) for c in ("seq", "n", "c", "ends")), strict=True):
                rows.append(r)
                held += len(r[0])
                if len(rows) >= RUN or held >= RUN_BYTES:
                    yield from run(number, rows)
                    number, rows, held = number + 1, [], 0
        yield from run(number, rows)

    def run(number: int, rows: list) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: r[0])
        out, before, last = [], b"", -1
        for at, (seq, n, c, ends) in enumerate(rows):
            bucket = bisect_right(splitters, seq)
            lcp = shared(before, seq) if bucket == last else 0
            out.append((bucket, number, at, lcp, seq[lcp * TURN :], n, c, ends))
            before, last = seq, bucket
            if len(out) == 1000:
                yield _batch(out, SORTED)
                out = []
        if out:
            yield _batch(out, SORTED)

    return sort


Item = tuple[bytes, int, int, int, bytes]  # a conversation, turns shared with the one before it, how many are it, smallest id, digest of ids


def _run_items(rows: Iterable[tuple]) -> Iterator[Item]:
    seq = b""
    for lcp, tail, n, c, ends in rows:
        seq = seq[: lcp * TURN] + tail
        yield seq, lcp, n, c, ends


def merged(runs: list[Iterator[Item]]) -> Iterator[Item]:
    """All conversations of sorted runs in order, with the turns shared with the one before in the merged stream.

    ``losers[i]`` lost the match at node i of a tree over the runs, with ``lcp[run]`` turns shared with the winner of
    that match, which is what was put out last on every path to the top. So the one that shares more turns with it is
    smaller; only equal ones are compared, from there on.
    """
    k = len(runs)
    heads: list[Item | None] = [next(r, None) for r in runs]
    lcp, losers = [0] * k, [-1] * max(k, 1)

    def match(a: int, b: int) -> tuple[int, int]:
        """Winner and loser, whose lcp is set to what it shares with the winner."""
        if a < 0 or heads[a] is None:
            return b, a
        if b < 0 or heads[b] is None:
            return a, b
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        x, y = heads[a][0], heads[b][0]
        both = shared(x, y, lcp[a])
        if x[both * TURN :] <= y[both * TURN :]:
            lcp[b] = both
            return a, b
        lcp[a] = both
        return b, a

    # leaves k .. 2k-1 are the runs; node i plays the winners of 2i and 2i+1
    won = [-1] * k + list(range(k))
    for i in range(k - 1, 0, -1):
        won[i], losers[i] = match(won[2 * i], won[2 * i + 1])
    top = won[1] if k > 1 else 0
    while k and heads[top] is not None:
        seq, _, n, c, ends = heads[top]
        yield seq, lcp[top], n, c, ends
        heads[top] = next(runs[top], None)
        lcp[top] = heads[top][1] if heads[top] is not None else 0
        i = (top + k) // 2
        while i:
            top, losers[i] = match(top, losers[i])
            i //= 2


@dataclass(slots=True)
class Open:
    """A node of the open path: what its finished children and the conversations that end in it add up to."""

    key: bytes
    depth: int
    size: int
    left: bool
    n: int = 0
    c: int | None = None
    kids: int = 0
    leaves: int = 0
    saved: int = 0
    ends: bytes | None = None

    def add(self, n: int, c: int | None, kids: int, leaves: int, saved: int, ends: bytes | None) -> None:
        self.n, self.kids, self.leaves, self.saved = self.n + n, self.kids + kids, self.leaves + leaves, self.saved + saved
        self.c = c if self.c is None else self.c if c is None else min(self.c, c)
        self.ends = self.ends or ends

    def row(self, bucket: int, at: int | None, parent: bytes | None) -> tuple:
        return bucket, at, self.left, self.key, parent, self.depth, self.size, self.n, self.c, self.kids, self.leaves, self.saved, self.ends


class Path:
    """The open path of a stretch of the sorted stream. Nodes of its first path (``left``) may have begun before it: they stay open."""

    def __init__(self, bucket: int):
        self.bucket, self.stack, self.lefts, self.out = bucket, [], [], []

    def push(self, key: bytes, size: int, left: bool) -> Open:
        node = Open(key, len(self.stack), size, left)
        self.stack.append(node)
        if left:
            self.lefts.append(node)
        return node

    def cut(self, length: int) -> None:
        """Finish all nodes of the path beyond ``length``: row, and sums for the parent."""
        while len(self.stack) > length:
            node = self.stack.pop()
            if not node.left:
                self.finish(node)

    def finish(self, node: Open) -> None:
        node.leaves, node.saved, node.ends = node.leaves if node.kids else 1, node.saved + (node.n - 1) * node.size, node.ends or NONE
        if self.stack:
            self.stack[-1].add(node.n, node.c, 1, node.leaves, node.saved, None)
        self.out.append(node.row(self.bucket, None, self.stack[-1].key if self.stack else None))

    def finished(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.out), 1000):
            yield _batch(self.out[at : at + 1000], NODE)
        self.out = []

    def ended(self) -> None:
        """All nodes that are open still: the first path, then what the last one doesn't share with it."""
        rest = [n for n in self.stack if not n.left]
        self.out += [n.row(self.bucket, at, None) for at, n in enumerate(self.lefts + rest)]


def _scanned(bucket: int, items: Iterator[Item]) -> Iterator[pa.RecordBatch]:
    path, first = Path(bucket), True
    path.push(ROOT, 0, True)
    for seq, lcp, n, c, ends in items:
        path.cut(lcp + 1)
        for at in range(lcp * TURN, len(seq), TURN):
            turn = seq[at : at + TURN]
            key = hashlib.blake2b(path.stack[-1].key + turn, digest_size=DIGEST).digest()
            path.push(key, int.from_bytes(turn[DIGEST:], "big"), first)
        path.stack[-1].add(n, c, 0, 0, 0, ends)
        first = False
        if len(path.out) >= 1000:
            yield from path.finished()
    path.ended()
    yield from path.finished()


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each bucket, whose runs follow each other; one bucket is held at a time."""
    rows = (r for b in batches for r in zip(*(values(b.column(c)) for c in ("bucket", "run", "lcp", "tail", "n", "c", "ends")), strict=True))
    for bucket, group in groupby(rows, key=lambda r: r[0]):
        runs = [_run_items([r[2:] for r in run]) for _, run in groupby(group, key=lambda r: r[1])]
        yield from _scanned(bucket, merged(runs))


def _paths(last: bool):
    """Merge the open paths of some buckets; of all that there are, if ``last``, which finishes every node."""

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by([("bucket", "ascending"), ("at", "ascending")])
        first, path = t.column("bucket")[0].as_py(), Path(t.column("bucket")[0].as_py() // FAN)
        for b in t.to_batches():
            for bucket, left, key, depth, size, n, c, kids, leaves, saved, ends in zip(*(values(b.column(x)) for x in ("bucket", "left", "key", "depth", "size", "n", "c", "kids", "leaves", "saved", "ends")), strict=True):
                if depth >= len(path.stack) or path.stack[depth].key != key:
                    path.cut(depth)
                    path.push(key, size, left and bucket == first and not last)
                path.stack[depth].add(n, c, kids, leaves, saved, ends)
        if last:
            path.cut(0)
        else:
            path.ended()
        return pa.Table.from_batches(list(path.finished()), NODE)

    return merge


def _splitters(rows: DataFrame, buckets: int, n: int) -> list[bytes]:
    """Sorted beginnings of conversations that part buckets of much the same size, from ``SAMPLED`` a bucket."""
    if buckets < 2:
        return []
    one_in = max(1, n // (SAMPLED * buckets))
    some = rows.where(F.pmod(F.xxhash64("seq"), F.lit(one_in)) == 0).select(F.substring("seq", 1, TURN * SPLIT_TURNS).alias("s")).collect()  # SAMPLED a bucket, about
    some = sorted(bytes(r.s) for r in some)
    return sorted({some[len(some) * i // buckets] for i in range(1, buckets)}) if some else []


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: each node of the trie of rebuilt conversations.

    A null role or text is empty; turns go by number, null first, those of one number by a digest of role and text;
    repeated rows are turns of their own. Rows without conversation id take no part; an empty table has no node, also
    no root. Very long texts are one digest. A conversation must fit into a task: 20 bytes a turn. Two different turns
    are taken for the same only if 128 bits of their SHA-256 and their texts' lengths agree. Other columns are ignored.
    """
    own = written(own_turns(df, conv_col, turn_col, role_col, text_col), "own-turns")
    rows = distinct_conversations(written(rebuilt(own), "rebuilt"))
    n = rows.count()
    buckets = max(1, min(-(-n // FEW), BUCKETS), -(-n // MANY))
    runs = in_arrow(rows, _runs(_splitters(rows, buckets, n)), SORTED_DDL)
    level = written(in_arrow(runs.repartition("bucket").sortWithinPartitions("bucket", "run", "at"), _buckets, NODE_DDL), "trie")
    nodes = level.where("at IS NULL")
    while buckets:
        last = buckets <= FAN
        level = written(level.where("at IS NOT NULL").groupBy(F.floor(F.col("bucket") / FAN)).applyInArrow(_paths(last), NODE_DDL), "trie")
        nodes = nodes.unionByName(level.where("at IS NULL"))
        buckets = 0 if last else -(-buckets // FAN)
    parents = nodes.where("kids > 0").select(F.col("key").alias("parent"), F.col("c").alias("parent_conv_id"), F.col("kids").alias("brothers"))
    found = hot_join(nodes.where("depth > 0"), parents, "parent", "brothers").unionByName(nodes.where("depth = 0"), allowMissingColumns=True)
    return found.select(
        F.col("c").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.lower(F.hex("ends")).alias("ends_sha256"),
    )
