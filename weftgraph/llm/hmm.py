"""Language-model scoring with a hidden Markov model.

Frequent words are symbols of their own, all others are drawn within a class of their shape, with add-one
estimates. Baum-Welch counts are summed over partitions in each round; the scaled forward recursion gives the exact
likelihood of a text, a very long one in parts that are chained exactly. Counts of all training words are gathered; those of rare words meet their texts in a shuffle,
those of frequent words (whose number has a proven bound) are shipped, so that no join key is hot.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS, col, in_arrow, stretches, written

STATES, ROUNDS = 8, 3
#: A word with at least one in so many training tokens is frequent (so there are at most that many frequent words);
#: with one in OWN it is a symbol of its own.
FREQUENT, OWN = 500_000, 20_000
#: Longest stretch of a sequence that is stepped through at once; longer ones are cut and their parts chained exactly.
STRETCH = 1024
#: Tokens whose state probabilities a task holds at once.
GROUP = 150_000
#: Tokens whose symbols a task holds at once (but for one longer text).
HELD_TOKENS = 600_000
#: Words that a task counts before it hands them on.
HELD_WORDS = 150_000
END = b" "  # no word has a space
CLASSES = 8


def words_of(text: bytes | None) -> Iterator[list[bytes]]:
    """Words of the text with A-Z in lower case, a stretch of it at a time."""
    for part in stretches(text):
        yield part.lower().split()


def shape(word: bytes) -> int:
    """The class of a word that has no symbol of its own: by length, and by whether it ends in a letter or digit."""
    return 2 * min(len(word) // 4, 3) + (not word[-1:].isalnum() and word[-1] < 128)


def _held_out(id_name: str):
    return F.coalesce(F.expr(f"pmod(crc32(cast(cast({id_name} as string) as binary)), 7) = 2"), F.lit(False))


def token_counts(texts: DataFrame) -> DataFrame:
    """token, c of a one-column table of texts; written to the shared folder."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "c"])

        for b in batches:
            for t in b.column(0):
                for w in words_of(t.as_py()):
                    seen.update(w)
                    if len(seen) > HELD_WORDS:
                        yield out()
                        seen.clear()
                seen[END] += 1
        yield out()

    partial = in_arrow(texts, count, "token binary, c long")
    return written(partial.groupBy("token").agg(F.sum("c").alias("c")), "token-counts")


@dataclass
class Vocabulary:
    """Frequent words: for each its symbol and count. Symbols: end 0, own words, then the classes."""

    words: list[bytes]
    counts: np.ndarray
    own: int  # the first so many words have symbols 1.. of their own
    total: int
    distinct: int
    class_total: np.ndarray
    class_distinct: np.ndarray
    threshold: int  # words with smaller counts aren't frequent

    @property
    def symbols(self) -> int:
        return 1 + self.own + CLASSES

    @classmethod
    def of(cls, counts: DataFrame) -> Vocabulary:
        r = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
        need = max(1, -(-r.n // FREQUENT))
        rows = counts.where(F.col("c") >= need).orderBy(F.desc("c"), "token").toPandas()  # FREQUENT rows at most
        rows = rows[rows["token"].map(bytes) != END]
        words, c = [bytes(w) for w in rows["token"]], rows["c"].to_numpy(np.int64)
        own = int((c >= max(1, -(-r.n // OWN))).sum())

        def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, CLASSES), np.int64)
            for b in batches:
                for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    sums[:, shape(w)] += (n, 1)
            yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), *map(pa.array, sums)], ["class", "n", "v"])

        least = int(c[own - 1]) if own else None
        rest = counts.where(F.col("token") != F.lit(END))
        rest = rest.where(F.col("c") < least) if least is not None else rest
        n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for x in in_arrow(rest, classes, "class int, n long, v long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
            n[x["class"]], v[x["class"]] = x.n, x.v
        return cls(words, c, own, int(r.n), int(r.v), n, v, need)


def encoded(docs: DataFrame, vocabulary: Vocabulary, ends: int, id_col: str, text_col: str) -> DataFrame:
    """Each row's symbols, what its frequent words give, and its other words with their numbers; written."""
    src = docs.select(F.monotonically_increasing_id().alias("uid"), col(id_col).alias("doc_id"), col(text_col).cast("binary").alias("text"))
    src = src.select("uid", "doc_id", _held_out("doc_id").alias("held_out"), "text")
    schema = f"uid long, doc_id {src.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, known long, log_c double, log_in double, symbols binary, rare array<struct<token:binary,n:int>>"
    rare_type = pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int32())]))
    shipped = docs.sparkSession.sparkContext.broadcast((vocabulary.words, vocabulary.counts))
    own, first_class = vocabulary.own, 1 + vocabulary.own
    log_class = np.log10(vocabulary.class_total + vocabulary.class_distinct + 1.0)
    end_log, end_known = math.log10(ends + 1), int(ends > 0)

    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), rare_type]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = shipped.value
        place = {w: i for i, w in enumerate(words)}
        log_c = np.append(np.log10(counts + 1.0), 0.0)
        # of each frequent word: its symbol, and its probability within its class (own symbols: 1)
        kind = np.array([i + 1 if i < own else first_class + shape(w) for i, w in enumerate(words)] + [0], np.int64)
        inside = np.append(log_c[:-1], 0.0)
        inside[:own] = 0.0
        inside[own:-1] -= log_class[kind[own:-1] - first_class]
        get = place.get
        for b in batches:
            rows, made = [], []
            for text in b.column(3):
                n, known, base, within, parts, others = 1, end_known, end_log, 0.0, [], Counter()
                for found in words_of(text.as_py()):
                    at = np.fromiter([get(w, -1) for w in found], np.int64, len(found))
                    symbols, other = kind[at], np.flatnonzero(at < 0)
                    rare = [found[i] for i in other.tolist()]
                    shapes = np.fromiter(map(shape, rare), np.int64, len(rare))
                    symbols[other] = first_class + shapes
                    n, known = n + len(found), known + len(found) - len(rare)
                    base, within = base + float(log_c[at].sum()), within + float(inside[at].sum() - log_class[shapes].sum())
                    parts.append(symbols.astype(np.uint16).tobytes())
                    others.update(rare)
                counted = [{"token": w, "n": c} for w, c in others.items()]
                rows.append((n, known, base, within, b"".join([*parts, bytes(2)]), counted))
                if len(rows) == ROWS:
                    made.append([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)])
                    rows = []
            made.append([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)])
            made = [pa.concat_arrays([m[i] for m in made]) for i in range(len(kinds))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *made], ["uid", "doc_id", "held_out", "n_tokens", "known", "log_c", "log_in", "symbols", "rare"])

    return written(in_arrow(src, scan, schema), "sequences")


class Group:
    """Stretches of sequences, laid out by time: step t of all stretches that reach it together."""

    def __init__(self, parts: list[np.ndarray]):
        lengths = np.array([len(p) for p in parts])
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        self.row_of = np.argsort(self.order)  # where a stretch lies in the layout
        self.active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        self.offset = np.concatenate(([0], np.cumsum(self.active)))
        row = np.repeat(np.arange(len(lengths)), lengths)
        step = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.symbols = np.empty(len(row), np.int64)
        self.symbols[self.offset[step] + row] = np.concatenate([parts[i] for i in self.order])

    def steps(self):
        return zip(self.active, self.offset[:-1], strict=True)

    def products(self, a: np.ndarray, emit: np.ndarray) -> np.ndarray:
        """The product of all step matrices of each stretch, up to a factor."""
        s = len(a)
        whole = np.tile(np.eye(s), (len(self.order), 1, 1))
        for n, offset in self.steps():
            x = (whole[:n].reshape(-1, s) @ a).reshape(n, s, s) * emit[self.symbols[offset : offset + n]][:, None, :]
            whole[:n] = x / x.max(axis=(1, 2), keepdims=True)
        return whole[self.row_of]

    def forward(self, a: np.ndarray, emit: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled state probabilities after every token, and the scales; before: of each stretch."""
        return self._forward(a, emit[self.symbols], before)

    def _forward(self, a: np.ndarray, shown: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``forward`` with what each state says of every token."""
        alpha, scale, now = np.empty((len(self.symbols), len(a))), np.empty(len(self.symbols)), before[self.order]
        ones = np.ones(len(a))  # products sum short rows faster than numpy's sum
        for n, offset in self.steps():
            x, here = now[:n] @ a, scale[offset : offset + n]
            x *= shown[offset : offset + n]
            np.matmul(x, ones, out=here)
            now = np.divide(x, here[:, None], out=alpha[offset : offset + n])
        return alpha, scale

    def likelihoods(self, scale: np.ndarray) -> np.ndarray:
        """Natural logarithm of the likelihood of each stretch, given what is before it."""
        row = np.concatenate([np.arange(n) for n in self.active])
        return np.bincount(row, np.log(scale), len(self.order))[self.row_of]

    def expected(self, a: np.ndarray, emit: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Baum-Welch counts: of emissions (symbols x states) and transitions, states before each stretch, log-likelihood."""
        shown = emit[self.symbols]
        alpha, scale = self._forward(a, shown, before)
        states, steps = len(a), list(self.steps())
        weighted = np.empty_like(alpha)  # emission times what comes after, divided by the likelihood of the token's row
        past = np.empty_like(alpha)
        first, later, ones, back = before[self.order], after[self.order], np.ones(states), np.ascontiguousarray(a.T)
        for t in range(len(steps) - 1, -1, -1):
            n, offset = steps[t]
            here, b = alpha[offset : offset + n], later[:n]
            w = shown[offset : offset + n] * b
            past[offset : offset + n] = alpha[steps[t - 1][1] : steps[t - 1][1] + n] if t else first[:n]
            np.divide(w, (scale[offset : offset + n] * np.einsum("ij,ij->i", here, b))[:, None], out=weighted[offset : offset + n])
            v = w @ back
            np.divide(v, (v @ ones)[:, None], out=b)
        # gamma of a token: probability of its state given the whole text
        gamma = (past @ a) * weighted
        emissions = np.stack([np.bincount(self.symbols, gamma[:, s], len(emit)) for s in range(states)], axis=1)
        g = first * later
        return emissions, a * (past.T @ weighted), (g / g.sum(axis=1, keepdims=True))[self.row_of], float(np.log(scale).sum())


class Sequences:
    """Sequences of a task, cut into stretches of a bounded length; only a group of those is worked on at a time."""

    def __init__(self, sequences: list[np.ndarray]):
        self.parts = [s[i : i + STRETCH] for s in sequences for i in range(0, len(s), STRETCH)]
        self.owner = np.repeat(np.arange(len(sequences)), [-(-len(s) // STRETCH) for s in sequences])
        self.docs = len(sequences)
        self.cut = np.flatnonzero(np.bincount(self.owner, minlength=self.docs)[self.owner] > 1)  # stretches of longer sequences, in order

    def groups(self, which: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, Group]]:
        """Numbers of stretches and their group; stretches of like length go together."""
        lengths = np.array([len(p) for p in self.parts])
        which = np.arange(len(lengths)) if which is None else which
        which = which[np.argsort(-lengths[which], kind="stable")]
        turn = np.cumsum(lengths[which]) // GROUP
        for part in np.split(which, np.flatnonzero(np.diff(turn)) + 1):
            if len(part):
                yield part, Group([self.parts[i] for i in part])

    def ends(self, a: np.ndarray, emit: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State before each stretch (row vectors) and what comes after it (column vectors), each up to a factor.

        For cut sequences the product of all step matrices of a stretch is made, and the products are chained.
        """
        before, after = np.tile(start, (len(self.parts), 1)), np.ones((len(self.parts), len(start)))
        if len(self.cut):
            place = np.searchsorted(self.cut, np.arange(len(self.parts)))
            whole = np.empty((len(self.cut), len(a), len(a)))
            for which, group in self.groups(self.cut):
                whole[place[which]] = group.products(a, emit)
            for k, i in enumerate(self.cut[1:].tolist(), 1):
                if self.owner[i] == self.owner[i - 1]:
                    v = before[i - 1] @ whole[k - 1]
                    before[i] = v / v.sum()
            for k in range(len(self.cut) - 2, -1, -1):
                i = int(self.cut[k])
                if self.owner[i] == self.owner[i + 1]:
                    v = whole[k + 1] @ after[i + 1]
                    after[i] = v / v.sum()
        return before, after

    def likelihoods(self, a: np.ndarray, emit: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Natural logarithm of the likelihood of each sequence."""
        before, _ = self.ends(a, emit, start)
        out = np.zeros(self.docs)
        for which, group in self.groups():
            out += np.bincount(self.owner[which], group.likelihoods(group.forward(a, emit, before[which])[1]), self.docs)
        return out

    def expected(self, a: np.ndarray, emit: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Baum-Welch counts: of emissions (symbols x states), transitions and first states, and the log-likelihood."""
        before, after = self.ends(a, emit, start)
        opening = np.concatenate(([True], self.owner[1:] != self.owner[:-1]))
        emissions, moves, first, total = np.zeros_like(emit), np.zeros_like(a), np.zeros(len(a)), 0.0
        for which, group in self.groups():
            e, m, f, ll = group.expected(a, emit, before[which], after[which])
            emissions += e
            moves += m
            first += f[opening[which]].sum(axis=0)
            total += ll
        return emissions, moves, first, total


def held_sequences(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[Sequences, list]]:
    """Sequences of a task, as many as it may hold, with their first column's values."""
    held, keys, size = [], [], 0
    for b in batches:
        for key, s in zip(b.column(0) if column else [None] * b.num_rows, b.column(column), strict=True):
            seq = np.frombuffer(s.as_py(), np.uint16)
            held.append(seq)
            keys.append(key.as_py() if column else None)
            size += len(seq)
            if size >= HELD_TOKENS:
                yield Sequences(held), keys
                held, keys, size = [], [], 0
    if held:
        yield Sequences(held), keys


@dataclass
class Model:
    moves: np.ndarray
    emit: np.ndarray  # symbols x states
    start: np.ndarray

    @classmethod
    def begin(cls, frequency: np.ndarray, states: int) -> Model:
        """States that differ by chance (fixed seed) about the symbols' frequencies."""
        rng = np.random.default_rng(7)
        emit = frequency[:, None] * rng.gamma(1.0, 1.0, (len(frequency), states)) + 1e-12
        moves = np.full((states, states), 0.4 / states) + 0.6 * np.eye(states)
        return cls(moves, emit / emit.sum(axis=0), np.full(states, 1 / states))

    @classmethod
    def next(cls, emissions: np.ndarray, moves: np.ndarray, first: np.ndarray, frequency: np.ndarray) -> Model:
        """From expected counts, each with a weak prior: symbols by their frequency, moves and first states alike."""
        emit, moves, first = emissions + frequency[:, None], moves + 1.0, first + 1.0
        return cls(moves / moves.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), first / first.sum())


def train(sequences: DataFrame, symbols: int, frequency: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all sequences; the driver gets one row for each symbol and state, as Spark has summed them."""
    model = Model.begin(frequency, states)
    names = [f"s{i}" for i in range(states)]
    for _ in range(rounds):
        shipped = sequences.sparkSession.sparkContext.broadcast((model.moves, model.emit, model.start))

        def step(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            a, emit, start = shipped.value
            sums = np.zeros((symbols + states + 1, states))
            for some, _ in held_sequences(batches, 0):
                e, m, f, _ll = some.expected(a, emit, start)
                sums[:symbols] += e
                sums[symbols : symbols + states] += m
                sums[-1] += f
            at = np.flatnonzero(sums.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(sums[at, i]) for i in range(states))], ["at", *names])

        rows = in_arrow(sequences, step, "at int, " + ", ".join(f"{n} double" for n in names)).groupBy("at").agg(*(F.sum(n).alias(n) for n in names)).toPandas()
        sums = np.zeros((symbols + states + 1, states))
        sums[rows["at"].to_numpy()] = rows[names].to_numpy()
        model = Model.next(sums[:symbols], sums[symbols:-1], sums[-1], frequency)
        shipped.unpersist()
    return model


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    Null texts are empty and have their end only. Rows whose id is null train and aren't held out. Repeated rows
    score alike, each counts in training. If nothing trains, a word's base probability is 1 and the model knows the
    symbols by their add-one frequency only. Other columns are ignored.
    """
    train_rows = docs.select(col(id_col).alias("id"), col(text_col).cast("binary").alias("text")).where(~_held_out("id")).select("text")
    counts = token_counts(train_rows)
    vocabulary = Vocabulary.of(counts)
    ends = counts.where(F.col("token") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c")).first().c
    seqs = encoded(docs, vocabulary, ends, id_col, text_col)
    frequency = np.concatenate(([ends], vocabulary.counts[: vocabulary.own], vocabulary.class_total)) + 1.0
    frequency /= frequency.sum()
    model = train(seqs.where(~F.col("held_out")).select("symbols"), vocabulary.symbols, frequency, states, rounds)
    shipped = docs.sparkSession.sparkContext.broadcast((model.moves, model.emit, model.start))

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, emit, start = shipped.value
        for some, uids in held_sequences(batches, 1):
            ll = some.likelihoods(a, emit, start)
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(ll / math.log(10))], ["uid", "log_states"])

    of_states = in_arrow(seqs.select("uid", "symbols"), likelihood, "uid long, log_states double")
    rare = seqs.select("uid", F.explode("rare").alias("r")).select("uid", F.col("r.token").alias("token"), F.col("r.n").alias("n"))
    # a word is rare, so that no key is hot; words that training lacks add nothing (c = 0)
    of_rare = rare.join(counts.where(F.col("c") < vocabulary.threshold), "token").groupBy("uid").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_log"), F.sum("n").alias("rare_known"))
    parts = seqs.select("uid", "doc_id", "held_out", "n_tokens", "known", "log_c", "log_in").join(of_states, "uid").join(of_rare, "uid", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    each = math.log10(vocabulary.total + vocabulary.distinct + 1)
    return parts.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("log_c") + rare_log - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        (F.col("log_states") + F.col("log_in") + rare_log).alias("score"),
    )
