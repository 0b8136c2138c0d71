"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of documents of one partition, as many as a bound of bytes holds, over any number of Arrow batches.
Its words become symbols of the benchmark's vocabulary. Stretches too short to hold a test phrase are left out: a word
outside the vocabulary can be part of no occurrence. What is left is indexed (suffix array, Burrows-Wheeler transform
in a wavelet matrix of packed bits, sampled suffix positions). Test phrases are found by backward search, a block of
them at a time, occurrences are located by walking to the next sampled position, and their spans are merged into what
has to be removed.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, free_names, map_arrow, stretches, written

WINDOW = 13
#: Words, and different words, of the benchmark items that tasks hold (what is shipped has a bound): a benchmark with
#: more goes in groups, each over all rows, with what was found so far written in between.
GROUP_WORDS, GROUP_VOCABULARY = 16_000_000, 500_000
#: Test phrases that are searched at a time.
BLOCK = 100_000
#: Occurrences that are located at a time.
LOCATED = 1 << 19
#: Bytes of text of a shard, but for one longer document.
SHARD_BYTES = 24 << 20
SAMPLE = 8
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))  # a space for all that is in no word


def words(text: bytes | None) -> list[bytes]:
    """A-Z in lower case, then runs of ASCII letters, digits and other than ASCII characters, in UTF-8."""
    return (text or b"").translate(_WORDS).split()


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; a round re-sorts only suffixes whose order is still open."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.concatenate(([True], text[order[1:]] != text[order[:-1]]))
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    width = 1
    while True:
        # rank is the first place of a suffix's group; groups of one are settled
        first = rank[order]
        same = np.concatenate((first[1:] == first[:-1], [False]))
        open_ = np.flatnonzero(same | np.concatenate(([False], same[:-1])))
        if not len(open_):
            return order
        who = order[open_]
        next_ = np.where(who + width < n, rank[np.minimum(who + width, n - 1)], -1)
        by = np.lexsort((next_, first[open_]))
        who, group, next_ = who[by], first[open_][by], next_[by]
        order[open_] = who
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (next_[1:] != next_[:-1])))
        rank[who] = open_[np.flatnonzero(new)[np.cumsum(new) - 1]]
        width *= 2


class Bits:
    """A bit vector in packed words, with the number of ones before each word."""

    def __init__(self, bit: np.ndarray):
        packed = np.packbits(np.append(bit, np.zeros(-len(bit) % 64 + 64, bit.dtype)).astype(bool), bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1])).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many ones lie before each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def at(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class WaveletMatrix:
    """Rank of a symbol before a position, for arrays of symbols and positions at once."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits: list[Bits] = []
        self.zeros: list[int] = []
        rest = symbols
        for level in reversed(range(self.levels)):
            bit = (rest >> level) & 1
            self.bits.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            rest = np.concatenate((rest[bit == 0], rest[bit == 1]))
        begin = np.zeros(sigma, np.int64)  # where the walk of a symbol begins after the last level
        self.starts = self._walk(np.arange(sigma), begin)

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(reversed(range(self.levels))):
            ones = self.bits[k].ones(at)
            at = np.where((symbol >> level) & 1 == 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._walk(symbol, at) - self.starts[symbol]

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        for k in range(self.levels):
            bit, ones = self.bits[k].at(at), self.bits[k].ones(at)
            symbol = symbol * 2 + bit
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return symbol


class FMIndex:
    """Over symbols from 1; 0 is the end. The symbols' order of the text is kept in full, so that locating is exact."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        text = np.concatenate((text, [0])).astype(np.int64)
        order = suffix_array(text)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.ranks = WaveletMatrix(text[order - 1], sigma)
        self.n = len(text)
        marked = order % sample == 0
        self.marked = Bits(marked)
        self.sampled = order[marked].astype(np.int32)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of rows that start with each row of ``phrases`` (all of one length): backward search of all at once."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for k in reversed(range(phrases.shape[1])):
            c = phrases[alive, k]
            lo[alive] = self.before[c] + self.ranks.rank(c, lo[alive])
            hi[alive] = self.before[c] + self.ranks.rank(c, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
            if not len(alive):
                break
        hi = np.maximum(hi, lo)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to a sampled position, and counts them."""
        out, steps, who, at = np.zeros(len(rows), np.int64), 0, np.arange(len(rows)), rows.astype(np.int64)
        while len(who):
            hit = self.marked.at(at) == 1
            out[who[hit]] = self.sampled[self.marked.ones(at[hit])] + steps
            who, at = who[~hit], at[~hit]
            c = self.ranks.access(at)
            at = self.before[c] + self.ranks.rank(c, at)
            steps += 1
        return out


@dataclass
class Phrases:
    """The test phrases of a group of benchmark items: their words as symbols end to end, and where phrases begin."""

    vocabulary: dict[bytes, int]
    symbols: np.ndarray
    names: list[str]  # of the items
    starts: dict[int, np.ndarray]  # by length of the phrase
    owners: dict[int, np.ndarray]  # the item of each phrase
    used: dict[int, np.ndarray]  # which symbols phrases of a length have

    @classmethod
    def of(cls, vocabulary: dict[bytes, int], symbols: np.ndarray, names: list[str], lengths: np.ndarray, window: int) -> Phrases:
        """Of items with so many symbols each, one at least."""
        begins, of = np.cumsum(lengths) - lengths, np.minimum(lengths, window)
        starts, owners, used = {}, {}, {}
        for n in np.unique(of).tolist():
            who = np.flatnonzero(of == n)
            count = lengths[who] - n + 1
            owners[n] = np.repeat(who, count).astype(np.int32)
            starts[n] = (np.repeat(begins[who], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
            used[n] = np.zeros(len(vocabulary) + 1, bool)
            for b, e in zip(begins[who], begins[who] + lengths[who], strict=True):
                used[n][symbols[b:e]] = True
        return cls(vocabulary, symbols, names, starts, owners, used)

    def room(self, symbols: np.ndarray) -> np.ndarray:
        """Which words lie in a stretch of one phrase length's symbols that is long enough for such a phrase."""
        out = np.zeros(len(symbols), bool)
        for n, used in self.used.items():
            edge = np.flatnonzero(np.diff(np.concatenate(([0], used[symbols].astype(np.int8), [0]))))
            begin, end = edge[::2], edge[1::2]
            for k in np.flatnonzero(end - begin >= n):
                out[begin[k] : end[k]] = True
        return out

    def blocks(self, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, symbols (a phrase a row) and items of so many phrases at a time."""
        for n, starts in self.starts.items():
            for at in range(0, len(starts), size):
                yield n, self.symbols[starts[at : at + size, None] + np.arange(n)].astype(np.int64), self.owners[n][at : at + size]


def _search(shard: list[np.ndarray], phrases: Phrases, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard (each document's symbols, 0 outside the vocabulary): which of all its words are hit; pairs of document and item."""
    first = np.concatenate(([0], np.cumsum(np.array([len(s) for s in shard], np.int64))))
    cover, docs, items = np.zeros(first[-1] + 1, np.int64), [], []
    texts, where = [], []
    gap = len(phrases.vocabulary) + 1  # between stretches; no phrase has it
    for d, symbols in enumerate(shard):
        room = phrases.room(symbols)
        if room.any():
            edge = np.flatnonzero(np.diff(np.concatenate(([0], room.astype(np.int8), [0]))))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                texts += [symbols[a:b], [gap]]
                where.append((d, first[d] + a, b - a + 1))
    if where:
        index = FMIndex(np.where((t := np.concatenate(texts)) == 0, gap, t), gap + 1)
        of, begins, lengths = map(np.array, zip(*where, strict=True))
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        for n, rows, owners in phrases.blocks(block):
            rows, same = np.unique(rows, axis=0, return_inverse=True)  # equal phrases are searched once
            owners = owners[np.argsort(same.ravel(), kind="stable")]
            shares = np.bincount(same.ravel(), minlength=len(rows))
            lo, hi = index.search(rows)
            places, pairs = np.concatenate(([0], np.cumsum(hi - lo))), []
            for low in range(0, int(places[-1]), LOCATED):
                place = np.arange(low, min(low + LOCATED, int(places[-1])))
                which = np.searchsorted(places, place, side="right") - 1
                at = index.locate(lo[which] + place - places[which])
                stretch = np.searchsorted(offsets, at, side="right") - 1
                start = begins[stretch] + at - offsets[stretch]
                cover += np.bincount(start, minlength=len(cover)) - np.bincount(start + n, minlength=len(cover))
                pairs.append(np.unique(of[stretch] * len(rows) + which))
            both = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
            phrase, share = both % len(rows), shares[both % len(rows)]
            docs.append(np.repeat(both // len(rows), share))
            items.append(owners[np.repeat((np.cumsum(shares) - shares)[phrase], share) + np.arange(share.sum()) - np.repeat(np.cumsum(share) - share, share)].astype(np.int64))
    pairs = np.concatenate(docs) if docs else np.empty(0, np.int64), np.concatenate(items) if items else np.empty(0, np.int64)
    return np.cumsum(cover)[:-1] > 0, *pairs


def _groups(benchmark: DataFrame, item_col: str, text_col: str, most: int, window: int) -> Iterator[Phrases | None]:
    """The phrases of groups of items of about ``most`` words, whose words become symbols as they arrive; one group at least, None for no words."""
    vocabulary, symbols, names, lengths, any_yet = {}, array("i"), [], [], False
    rows = benchmark.select(col(item_col).cast("string").alias("item"), col(text_col).cast("binary").alias("text"))
    made = lambda: Phrases.of(vocabulary, np.array(symbols, np.int32), names, np.array(lengths, np.int64), window)
    for r in rows.toLocalIterator():
        before = len(symbols)
        for part in stretches(None if r.text is None else bytes(r.text)):
            symbols.extend(vocabulary.setdefault(x, len(vocabulary) + 1) for x in words(part))
        if len(symbols) > before:
            names.append("" if r.item is None else r.item)
            lengths.append(len(symbols) - before)
        if len(symbols) >= most or len(vocabulary) >= GROUP_VOCABULARY:
            yield made()
            vocabulary, symbols, names, lengths, any_yet = {}, array("i"), [], [], True
    if names or not any_yet:
        yield made() if names else None


def found_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_text: str = "text", window: int = WINDOW, group_words: int = GROUP_WORDS, block: int = BLOCK, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with n_words, spans (merged word ranges [start, end) to remove) and items (ids as strings, sorted).

    The names get underscores before them where ``docs`` has such columns. Null texts have no words. A benchmark
    item of fewer words than the window is one phrase; an item without words is none. Rows are judged one by one:
    ids may be null or repeated. Blocks of phrases are searched within one pass over the texts; only a benchmark of
    more than ``group_words`` words takes several passes.
    """
    names = free_names(docs.columns, "n_words", "spans", "items")
    out = docs.select("*", F.lit(0).cast("long").alias(names[0]), F.array().cast("array<struct<start:long,end:long>>").alias(names[1]), F.array().cast("array<string>").alias(names[2]))
    schema = out.schema
    for f in schema.fields:
        f.nullable = True
    for number, group in enumerate(_groups(benchmark, item_col, bench_text, group_words, window)):
        shipped = docs.sparkSession.sparkContext.broadcast(group)
        out = map_arrow(written(out, "benchmark-hits") if number else out, _scan(shipped, docs.columns.index(text_col), len(docs.columns), block, shard_bytes), schema)
    return out


def _scan(shipped, text_at: int, width: int, block: int, shard_bytes: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases | None = shipped.value
        get = {}.get if phrases is None else phrases.vocabulary.get
        held, shard, size = [], [], 0
        for b in batches:
            begin = 0
            for i, text in enumerate(b.column(text_at).cast(pa.binary())):
                raw = text.as_py()
                parts = [np.array([get(x, 0) for x in words(part)], np.int32) for part in stretches(raw)]
                shard.append(np.concatenate(parts) if parts else np.empty(0, np.int32))
                size += len(raw or b"")
                if size >= shard_bytes:
                    held.append(b.slice(begin, i + 1 - begin))
                    yield from closed(held, shard, phrases)
                    held, shard, size, begin = [], [], 0, i + 1
            if begin < b.num_rows:
                held.append(b.slice(begin))
        yield from closed(held, shard, phrases)

    def closed(held: list[pa.RecordBatch], shard: list[np.ndarray], phrases: Phrases | None) -> Iterator[pa.RecordBatch]:
        """The rows of a shard with what is found in it, and what earlier groups of items found."""
        if phrases is not None:
            hit, docs, items = _search(shard, phrases, block)
        else:
            hit, docs, items = np.zeros(sum(map(len, shard)), bool), np.empty(0, np.int64), np.empty(0, np.int64)
        of: dict[int, set[str]] = {}
        for d, i in zip(docs.tolist(), items.tolist(), strict=True):
            of.setdefault(d, set()).add(phrases.names[i])
        d, at = 0, 0
        for rows in held:
            spans, names, counts = [], [], []
            for old, before in zip(rows.column(width + 1), rows.column(width + 2), strict=True):
                own = hit[at : at + len(shard[d])]
                for s in old.as_py() or ():
                    own[s["start"] : s["end"]] = True
                edge = np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0])))).tolist() if own.any() else []
                spans.append([{"start": a, "end": e} for a, e in zip(edge[::2], edge[1::2], strict=True)])
                names.append(sorted(of.get(d, set()).union(before.as_py() or ())))
                counts.append(len(own))
                d, at = d + 1, at + len(own)
            made = [pa.array(counts, pa.int64()), pa.array(spans, rows.schema.field(width + 1).type), pa.array(names, rows.schema.field(width + 2).type)]
            yield pa.RecordBatch.from_arrays([*rows.columns[:width], *made], names=rows.schema.names)

    return scan


def n_hit(spans):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def is_contaminated(n_words, hit):
    """A document is contaminated if at least a twentieth of its words are hit."""
    return (hit > 0) & (20 * hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row; cases as in ``found_spans``."""
    src = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    found = found_spans(src, benchmark, **how).withColumn("n_hit", n_hit(F.col("spans")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
        "spans",
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged."""
    n, spans, _ = free_names(docs.columns, "n_words", "spans", "items")
    found = found_spans(docs, benchmark, text_col=text_col, **how)
    return found.where(~is_contaminated(F.col(n), n_hit(F.col(spans)))).select(*map(col, docs.columns))
