"""Near duplicates: many universal hash minima, banding, verification, and connected components of the links.

Documents with equal sets of shingles are one class, which its smallest id stands for. Classes that share a band's
hash are candidates. In a bucket only as many pairs are verified as its components need: first every member
against one pivot, then the members of buckets with several components against a few pivots that buckets of much
the same members have in common. What still is in different components is grouped by signatures: blocks of them give
the links that connect whatever is not far from similar enough, and within the connected groups blocks of sets meet
in full, inside tasks. So no pair becomes a row but a link, or one with a pivot. Sets are of 64-bit shingle prints, and
only ids with a partner left bring theirs. Buckets with a large share of all members are joined by broadcast, so that
no task gets all members of one.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import stars
from .common import Memo, col, dropped, hot_join, in_arrow, stretches, written

#: The chance that a pair just similar enough shares no band, at most: about that of a collision of prints.
MISS = 1e-15
#: Bands of a document, at most, if they have more than one minimum.
MOST_BANDS = 96
#: Minima that a signature is made of.
SIGNED = 160
#: Pivots of a bucket with several components, and with how many a member is compared.
PIVOTS = 6
#: Members of a bucket that one task holds, about: with their sets, and with their signatures only.
BLOCK, SIGNED_BLOCK = 500, 4000
#: Held sets that are compared pair by pair, at most; beyond that they make a sorted run.
PAIRS = 64
#: Bits of the map of wanted ids: for each of them, and at most.
BITS, MOST_BITS = 16, 1 << 27
#: Members that one task compares with a pivot, about.
DEALT = 2000
_RNG = np.random.default_rng(20240601)
_WORD = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of prints of k-word shingles; A-Z in lower case, words between white space."""

    def __init__(self, k: int):
        self.k, self.memo = k, Memo(lambda words: map(xxhash.xxh3_64_intdigest, words))

    def prints(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct prints; of fewer words than k the whole sequence is the one shingle, of none there is none."""
        parts = [np.fromiter(self.memo.of(w), np.uint64, len(w)) for part in stretches(text) for w in (part.lower().split(),)]
        h = parts[0] if len(parts) == 1 else np.concatenate(parts or [np.empty(0, np.uint64)])
        if not len(h):
            return h
        k = min(self.k, len(h))
        n = len(h) - k + 1
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out = _scramble(out * _WORD[i] + h[i : i + n])
        return np.unique(out)


class Hashes:
    """Minima of a set under hash functions a x + b mod 2^32, their bands and signatures, for a wanted similarity.

    As many rows a band as go with ``MOST_BANDS`` bands (one at least), and then as many bands as ``MISS`` takes: 87
    bands of 5 for 80 percent.
    """

    def __init__(self, percent: int):
        if not 1 <= percent <= 100:
            raise ValueError("percent must be from 1 to 100")
        self.percent, s = percent, min(percent / 100, 1 - 1e-9)
        need = lambda rows: math.ceil(math.log(MISS) / math.log1p(-(s**rows)))
        self.rows = max((r for r in range(1, 33) if need(r) <= MOST_BANDS), default=1)
        self.bands = need(self.rows)
        n, rng = self.rows * self.bands, np.random.default_rng(20240601)
        self.a = rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, n, dtype=np.uint32)
        self.mix = rng.integers(0, 2**63, self.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.signed = min(SIGNED, n)
        # the greatest number of equal minima that so few pairs just similar enough stay under
        chance, self.least = 0.0, 0
        for k in range(self.signed + 1):
            chance += math.comb(self.signed, k) * s**k * (1 - s) ** (self.signed - k)
            if chance > MISS:
                break
            self.least = k + 1

    def minima(self, prints: np.ndarray) -> np.ndarray:
        """The least value of each hash function over a set that isn't empty."""
        x = (prints >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), 2**32 - 1, np.uint32)
        for i in range(0, len(x), 256):
            low = np.minimum(low, (x[i : i + 256, None] * self.a + self.b).min(axis=0))
        return low

    def keys(self, low: np.ndarray) -> np.ndarray:
        """One bucket key a band."""
        folded = (low.astype(np.uint64).reshape(self.bands, self.rows) * self.mix).sum(axis=1, dtype=np.uint64)
        return _scramble(_scramble(folded) + np.arange(self.bands, dtype=np.uint64)).view(np.int64)

    def signature(self, low: np.ndarray) -> bytes:
        """The highest byte of each of the first scrambled minima."""
        return (_scramble(low[: self.signed].astype(np.uint64)) >> np.uint64(56)).astype(np.uint8).tobytes()

    def near(self, sigs: np.ndarray, sig: np.ndarray) -> np.ndarray:
        """Whether each of the signatures agrees often enough with the other one."""
        return np.count_nonzero(sigs == sig, axis=-1) >= self.least


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted sets that aren't empty."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def similar_sets(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 |A and B| >= percent |A or B|, of sorted sets; an empty one is similar to none."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    both = _common(a, b)
    return 100 * both >= percent * (small + large - both)


def sketches(docs: DataFrame, k: int, hashes: Hashes, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty), its bands and its signature; written, without texts."""
    src = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("binary").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for b in batches:
            n, digest, keys, sigs = [], [], [], []
            for t in b.column(1):
                x = shingler.prints(t.as_py())
                n.append(len(x))
                if len(x):
                    low = hashes.minima(x)
                    digest.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                    keys.append(hashes.keys(low))
                    sigs.append(hashes.signature(low))
                else:
                    digest.append(None)
                    keys.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "digest", "bands", "sig"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return written(in_arrow(src, scan, f"doc_id {kind}, n_shingles long, digest binary, bands array<long>, sig binary"), "sketches")


def _wanted(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and text of the rows whose id hashes as one of ``ids`` does: all rows of these ids, and few others.

    The hashes are broadcast as a bitmap of bounded size, so that texts that nobody wants aren't shuffled.
    """
    size = min(max(BITS * ids.count(), 1), MOST_BITS)
    bit = F.pmod(F.xxhash64("id"), F.lit(size)) + 1
    maps = ids.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("binary").alias("text")).where("id is not null")
    rows = rows.withColumn("bit", bit).select("id", "text", F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").cast("int").alias("at"))
    is_set = F.expr("bit_get(cast(conv(hex(substring(map, cast(at div 8 as int) + 1, 1)), 16, 10) as int), at % 8) = 1")
    return rows.join(F.broadcast(maps), "bucket").where(is_set).select("id", "text")


def _sets(docs: DataFrame, roles: DataFrame, k: int, id_col: str, text_col: str, folder: str) -> DataFrame:
    """The columns of ``roles`` (id first, once each) with the prints of the rows of each id; written to a folder to be ``dropped``."""
    roles = written(roles, f"{folder}/roles")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingler.prints(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], ["id", "prints"])

    sets = in_arrow(_wanted(docs, roles.select("id"), id_col, text_col), build, f"id {dict(roles.dtypes)['id']}, prints binary")
    return written(sets.join(roles, "id").select(*roles.columns, "prints"), f"{folder}/shingle-sets")


def _likely(pairs: DataFrame, hashes: Hashes) -> DataFrame:
    """a, b of the pairs (a, b, sig_a, sig_b) that signatures don't reject; written."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [bool(hashes.near(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8))) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    kind = dict(pairs.dtypes)["a"]
    return written(in_arrow(pairs.select("a", "b", "sig_a", "sig_b"), compare, f"a {kind}, b {kind}").distinct(), "likely-pairs")


def _first_links(docs: DataFrame, members: DataFrame, sigs: DataFrame, k: int, hashes: Hashes, id_col: str, text_col: str) -> DataFrame:
    """Links (a < b) of every candidate with the smallest pivot of its buckets; other pairs are left to later steps.

    Signatures meet first, and only what they don't reject brings its set. A pivot of many members is dealt to
    several tasks, and its set with it.
    """
    mine = written(members.where("id <> pivot").groupBy("id").agg(F.min("pivot").alias("pivot")), "first-pivots")
    pivots = mine.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).join(sigs.select(F.col("id").alias("pivot"), F.col("sig").alias("sig_a")), "pivot")
    met = hot_join(mine.join(sigs, "id"), written(pivots, "pivot-signatures"), "pivot", "n")
    mine = _likely(met.select(F.col("pivot").alias("a"), F.col("id").alias("b"), "sig_a", F.col("sig").alias("sig_b")), hashes).select(F.col("a").alias("pivot"), F.col("b").alias("id"))
    deals = mine.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / DEALT).cast("int").alias("deals"))
    # a candidate belongs to the deal of its pivot that its hash says; a pivot to all deals of its own
    as_member = mine.join(deals, "pivot").select("id", F.array(F.struct("pivot", F.pmod(F.xxhash64("id"), F.col("deals")).cast("int").alias("deal"))).alias("roles"))
    as_pivot = deals.select(F.col("pivot").alias("id"), F.transform(F.sequence(F.lit(0), F.col("deals") - 1), lambda d: F.struct(F.col("pivot").alias("pivot"), d.alias("deal"))).alias("roles"))
    roles = as_member.unionByName(as_pivot).groupBy("id").agg(F.flatten(F.collect_list("roles")).alias("roles"))
    folder = f"first-links-{uuid.uuid4().hex}"
    dealt = _sets(docs, roles, k, id_col, text_col, folder).select(F.explode("roles").alias("r"), "id", "prints").select(F.col("r.pivot").alias("pivot"), F.col("r.deal").alias("deal"), "id", "prints")
    dealt = dealt.repartition("pivot", "deal").sortWithinPartitions("pivot", "deal", F.col("id") != F.col("pivot"), "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own = None, []
        for b in batches:
            a, other = [], []
            for p, d, i, x in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                here = np.frombuffer(x, np.uint64)
                if (p, d) != pivot:
                    pivot, own = (p, d), []
                if i == p:
                    own.append(here)  # rows of one id are one document: any of them may link
                    continue
                if any(similar_sets(x0, here, hashes.percent) for x0 in own):
                    a.append(p)
                    other.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a, b.schema.field(0).type), pa.array(other, b.schema.field(0).type)], ["a", "b"])

    kind = dict(members.dtypes)["id"]
    links = written(in_arrow(dealt, compare, f"a {kind}, b {kind}"), "near-links")
    dropped(docs.sparkSession, folder)
    return links


def _linked(pairs: DataFrame, docs: DataFrame, sigs: DataFrame, k: int, hashes: Hashes, id_col: str, text_col: str) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar; signatures meet first, as in ``_first_links``."""
    one, two = (sigs.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    close = _likely(pairs.join(one, "a").join(two, "b"), hashes)
    ids = close.select(F.col("a").alias("id")).unionByName(close.select(F.col("b").alias("id"))).distinct()
    folder = f"linked-{uuid.uuid4().hex}"
    sets = _sets(docs, ids, k, id_col, text_col, folder)
    one, two = (sets.select(F.col("id").alias(x), F.col("prints").alias(f"x_{x}")) for x in "ab")
    whole = close.join(one, "a").join(two, "b").select("a", "b", "x_a", "x_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [similar_sets(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), hashes.percent) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    kind = dict(pairs.dtypes)["a"]
    links = written(in_arrow(whole, compare, f"a {kind}, b {kind}").distinct(), "near-links")
    dropped(docs.sparkSession, folder)
    return links


def _repeated_links(sketch: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) of the classes of one id's rows: those are one document, whatever their texts."""
    rows = sketch.where("digest is not null and doc_id is not null").select("doc_id", "digest")
    several = rows.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x < y").select("doc_id")
    reps = rows.join(several, "doc_id", "left_semi").join(classes.select("digest", "id"), "digest")
    return reps.select(F.col("id").alias("a"), F.col("doc_id").alias("b")).where("a <> b").distinct()


def _open_rows(members: DataFrame, labels: DataFrame) -> DataFrame:
    """key, id, component of the buckets whose members are in several components; written."""
    placed = members.join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    placed = written(placed, "placed")
    several = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n")).where("x < y").select("key", "n")
    return written(hot_join(placed, written(several, "open-keys"), "key", "n").select("key", "id", "component"), "open-buckets")


def _pivot_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a < b) of each id in open buckets with ``PIVOTS`` pivots of other components, at most.

    The least hash of the id alone makes a pivot, so that buckets which share most of their members share pivots.
    """
    least = [F.min(F.struct(F.xxhash64("id", F.lit(i)).alias("h"), F.col("id").alias("p"), F.col("component").alias("c"))).alias(f"p{i}") for i in range(PIVOTS)]
    of_key = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *least), "pivots")
    own = hot_join(rows, of_key, "key", "n").groupBy("id", "component").agg(*(F.min(f"p{i}").alias(f"p{i}") for i in range(PIVOTS)))
    pivots = F.array_distinct(F.array(*(F.struct(f"p{i}.p", f"p{i}.c") for i in range(PIVOTS))))
    met = own.select("id", F.explode(F.filter(pivots, lambda x: x["c"] != F.col("component"))).alias("x"))
    return met.select(F.least("id", "x.p").alias("a"), F.greatest("id", "x.p").alias("b")).distinct()


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """key, x, y, held, met, id, component: members of buckets dealt to pairs of blocks.

    A task holds a block of a bucket's members outside its largest component, and a block of that component or of
    the others passes by: every pair of different components meets in one task, for a bucket of any size.
    """
    sizes = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    shape = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("big"))
    shape = shape.select("key", "n", F.col("big.component").alias("big"), F.ceil(F.col("big.n") / size).cast("int").alias("bigs"), F.ceil((F.col("n") - F.col("big.n")) / size).cast("int").alias("others"))
    role = lambda x, y, held, met: F.struct(x.alias("x"), y.alias("y"), held.alias("held"), met.alias("met"))
    yes, no, mine = F.lit(True), F.lit(False), F.col("mine")
    blocks = F.sequence(F.lit(0), F.col("others") - 1)
    in_big = F.transform(blocks, lambda j: role(mine, j, no, yes))
    with_big = F.transform(F.sequence(F.lit(0), F.col("bigs") - 1), lambda i: role(i, mine, yes, i == 0))
    after = F.transform(F.filter(blocks, lambda j: j > mine), lambda j: role(-1 - mine, j, yes, no))
    before = F.transform(F.filter(blocks, lambda j: j < mine), lambda j: role(-1 - j, mine, no, yes))
    is_big = F.col("component") == F.col("big")
    dealt = hot_join(rows, written(shape.where("others > 0"), "shapes"), "key", "n").withColumn("mine", F.pmod(F.xxhash64("id"), F.when(is_big, F.col("bigs")).otherwise(F.col("others"))).cast("int"))
    return dealt.select("key", "id", "component", F.explode(F.when(is_big, in_big).otherwise(F.concat(with_big, after, before))).alias("r")).select("key", "r.*", "id", "component")


def _neighbourhoods(rows: DataFrame) -> DataFrame:
    """key, id, component: the members of all buckets that have the same least hash of an id, once each; written.

    Candidates share a bucket, so that they share a neighbourhood, and buckets of much the same members make few of them.
    """
    least = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("p"))).alias("least"))
    homes = written(least.select("key", "n", F.col("least.p").alias("home")), "homes")
    return written(hot_join(rows, homes, "key", "n").select(F.col("home").alias("key"), "id", "component").distinct(), "neighbourhoods")


def _alike(rows: DataFrame, sigs: DataFrame, hashes: Hashes) -> DataFrame:
    """Pairs (a, b) that connect what signatures near enough connect, of members in different components.

    Two blocks put out no more pairs than it takes to connect their members: their number grows with the members.
    """
    dealt = _blocks(rows, SIGNED_BLOCK).join(sigs, "id")
    dealt = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", F.col("held").desc(), "id").select("key", "x", "y", "held", "met", "id", "component", "sig")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal, ids, number, n = None, [], {}, 0
        sigs, comps, group = np.empty((64, hashes.signed), np.uint8), np.empty(64, np.int64), np.empty(64, np.int64)
        for batch in batches:
            a, b = [], []
            for key, x, y, hold, met, i, c, sig in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if (key, x, y) != deal:
                    deal, ids, number, n = (key, x, y), [], {}, 0
                sig, c, found = np.frombuffer(sig, np.uint8), number.setdefault(c, len(number)), ()
                if met and n:
                    found = np.unique(group[:n][hashes.near(sigs[:n], sig) & (comps[:n] != c)])
                    if len(found) > 1:
                        group[:n][np.isin(group[:n], found)] = found[0]
                    a += [i] * len(found)
                    b += [ids[j] for j in found.tolist()]
                if hold:
                    if n == len(sigs):
                        sigs, comps, group = (np.concatenate([t, np.empty_like(t)]) for t in (sigs, comps, group))
                    sigs[n], comps[n], group[n] = sig, c, found[0] if len(found) else n
                    ids.append(i)
                    n += 1
            kind = batch.schema.field(5).type
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])

    kind = dict(rows.dtypes)["id"]
    return written(in_arrow(dealt, compare, f"a {kind}, b {kind}").distinct(), "alike")


class Held:
    """Sets, most of them in sorted runs with their owners: a set meets all of a run at once."""

    def __init__(self):
        self.sizes, self.loose, self.runs = [], [], []

    def add(self, prints: np.ndarray) -> None:
        self.sizes.append(len(prints))
        self.loose.append(prints)
        if len(self.loose) > PAIRS:
            self.pack()

    def pack(self) -> None:
        """Put what is loose into a run."""
        if self.loose:
            last = len(self.sizes)
            prints = np.concatenate(self.loose)
            owner = np.repeat(np.arange(last - len(self.loose), last, dtype=np.int32), [len(x) for x in self.loose])
            order = np.argsort(prints, kind="stable")
            self.runs.append((prints[order], owner[order]))
            self.loose = []

    def similar(self, prints: np.ndarray, percent: int) -> np.ndarray:
        """Places of the sets that are similar to one that isn't empty, as ``similar_sets`` says."""
        n = len(self.sizes)
        both = np.zeros(n, np.int64)
        for run, owner in self.runs:
            first = np.searchsorted(run, prints)
            count = np.searchsorted(run, prints, "right") - first
            at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
            both += np.bincount(owner[at], minlength=n)
        for j, other in enumerate(self.loose, n - len(self.loose)):
            both[j] = _common(prints, other)
        return np.flatnonzero((both > 0) & (100 * both >= percent * (len(prints) + np.array(self.sizes, np.int64) - both)))


def _rest_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of different components in their groups, as many as join what any link joins.

    All pairs of a group are compared, in the blocks of ``_blocks``; two blocks put out no more links than join their
    components.
    """
    dealt = _blocks(rows, BLOCK).join(sets, "id").select("key", "x", "y", "held", "met", "id", "component", "prints")
    dealt = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", F.col("held").desc(), "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal, parent, ids, comps, held = None, {}, [], [], Held()

        def root(c):
            while c in parent:
                c = parent[c]
            return c

        for batch in batches:
            a, b = [], []
            for key, x, y, hold, met, i, c, prints in zip(*(batch.column(n).to_pylist() for n in range(8)), strict=True):
                if (key, x, y) != deal:
                    deal, parent, ids, comps, held = (key, x, y), {}, [], [], Held()
                prints = np.frombuffer(prints, np.uint64)
                if not len(prints):
                    continue
                if met and ids:
                    if not hold:  # nothing is added any more
                        held.pack()
                    for j in held.similar(prints, percent).tolist():
                        p, q = root(c), root(comps[j])
                        if p != q:
                            parent[max(p, q)] = min(p, q)
                            a.append(min(i, ids[j]))
                            b.append(max(i, ids[j]))
                if hold:
                    held.add(prints)
                    ids.append(i)
                    comps.append(c)
            kind = batch.schema.field(5).type
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])

    kind = dict(rows.dtypes)["id"]
    return written(in_arrow(dealt, compare, f"a {kind}, b {kind}").distinct(), "near-links")


def near_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach), kept (it is that id) of each row.

    A null text and one without words have no shingles and link with nothing. Rows without an id link with nothing,
    have no component and are kept. Rows of one id are one document. An empty table gives no rows; other columns
    are ignored. Similarity is exact for every candidate pair that components depend on; a pair that is similar enough
    is no candidate, or rejected by its signature, with a chance of ``MISS`` each at most.
    """
    hashes = Hashes(percent)
    sketch = sketches(docs, k, hashes, id_col, text_col)
    classes = sketch.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = written(classes, "classes")
    sigs = classes.select("id", "sig")
    keys = classes.select("id", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("pivot < last").select("key", "pivot", "n")
    members = written(hot_join(keys, written(buckets, "bucket-pivots"), "key", "n").select("key", "id", "pivot"), "buckets")
    links = _first_links(docs, members, sigs, k, hashes, id_col, text_col).unionByName(_repeated_links(sketch, classes))
    labels = written(stars(links, "a", "b"), "near-components")

    def joined(found: DataFrame) -> DataFrame:
        old = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")
        return written(stars(old.unionByName(found), "a", "b"), "near-components")

    rows = _open_rows(members, labels)
    if not rows.isEmpty():
        labels = joined(_linked(written(_pivot_pairs(rows), "pivot-pairs"), docs, sigs, k, hashes, id_col, text_col))
        rows = _open_rows(rows.select("key", "id"), labels)
        if not rows.isEmpty():
            alike = written(stars(_alike(_neighbourhoods(rows), sigs, hashes), "a", "b"), "alike-groups")
            rows = alike.select(F.col("node").alias("id"), F.col("component").alias("key")).join(labels.withColumnRenamed("node", "id"), "id", "left")
            rows = written(rows.select("key", "id", F.coalesce("component", "id").alias("component")), "alike-rows")
            folder = f"rest-links-{uuid.uuid4().hex}"
            labels = joined(_rest_links(rows, _sets(docs, rows.select("id"), k, id_col, text_col, folder), percent))
            dropped(docs.sparkSession, folder)
    rep = classes.select("digest", F.col("id").alias("rep"))
    return (
        sketch.select("doc_id", "n_shingles", "digest")
        .join(rep, "digest", "left")
        .join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
    )


def without_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_components`` keeps, unchanged: one document of each component."""
    drop = near_components(docs, k, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(drop, col(id_col) == F.col("gone_id"), "left_anti")
