"""Toxicity by maximum-scoring segments.

Words and their stems get log-odds of toxic against clean documents under an informative Dirichlet prior: each
term's pseudo-counts follow its share of all fitted documents. Those that are sure beyond what chance finds among so
many terms score. A linear-time scan finds every maximal segment of positive total, and extreme-value statistics say
how surprising a segment is in clean writing of that length. The evidence of a document's segments becomes a
probability by a logistic curve.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, col, free_names, in_arrow, map_arrow, stretches, values, written

#: Labelled rows that the classifier is fitted on, at most (all, where there are fewer): a uniform choice by the
#: hash of the id. Everything else covers all rows.
FIT_ROWS = 60_000
#: Lengths of the stems that count as terms beside whole words.
STEMS = (4, 5, 6, 7)
#: Strength of the Dirichlet prior, in documents of the rarer class.
PRIOR = 4.0
#: Toxic documents that a term needs; fewer can't make it sure.
LEAST = 3
#: What every word loses, so that ordinary writing drifts down; bound of a score.
DRIFT, MOST = 0.5, 8.0
#: Every how manieth document of the sample calibrates and isn't counted for the terms.
FOLDS = 4
#: Documents with this score or more are toxic.
CUT = 0.3
#: Terms that a task counts before it hands them on.
HELD_TERMS = 100_000
#: Bits of the filter through which terms of clean documents pass, a power of two.
FILTER = 1 << 20
#: Sketches of a text, each of three minima.
SKETCHES = 3
_MIX = [int(x) * 2 + 1 for x in np.random.default_rng(5).integers(2**60, 2**63, 3 * SKETCHES)]
_WORD = re.compile(r"[^\W\d_]+")
_KEY = "crc32(cast(cast({} as string) as binary))"


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def terms(word: str) -> list[str]:
    """The word, and each of its stems that is shorter, marked by a star."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def log_odds(toxic: Column, clean: Column, n_toxic: float, n_clean: float) -> tuple[Column, Column]:
    """Log-odds of terms in so many toxic and clean documents, and the signed root of twice their likelihood ratio.

    The prior has ``PRIOR`` documents of the rarer class for each class; a term's part of them is its share of all
    documents. As in a Dirichlet model, the prior is in the numerators and in what is left of the totals (a
    millionth more of those, so that a term of all documents has log-odds of 0).
    """
    n, prior = n_toxic + n_clean, PRIOR * min(n_toxic, n_clean)
    own = (toxic + clean) * (prior / n)
    odds = lambda y, m: F.log((y + own) / ((m + prior) * (1 + 1e-6) - y - own))
    delta = odds(toxic, n_toxic) - odds(clean, n_clean)
    part = lambda y, m: F.when(y > 0, y * F.log(y * n / ((toxic + clean) * m))).otherwise(0.0)
    ratio = part(toxic, n_toxic) + part(clean, n_clean)
    return delta, F.sqrt(2 * F.greatest(ratio, F.lit(0.0))) * F.signum(delta)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time.

    Runs of scores that aren't positive are only passed over by their sums; each positive score joins the list of
    candidates, which are merged as long as an earlier one starts lower and ends lower. A candidate links to the
    nearest earlier one that starts lower, and the search for that goes along links: what a link passes over is never
    looked at again. Where nothing starts lower, all candidates so far are settled and leave the list.
    """
    total = np.concatenate(([0.0], np.cumsum(scores)))
    at = np.flatnonzero(scores > 0)
    out: list[tuple[int, int, float]] = []
    open_: list[tuple[int, int, float, float, int]] = []  # start, end, total before and after, link
    for i, left, right in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist(), strict=True):
        start, link = i, len(open_) - 1
        while link >= 0 and open_[link][2] >= left:
            link = open_[link][4]
        while link >= 0 and open_[link][3] < right:
            start, _, left, _, before = open_[link]
            del open_[link:]
            link = before
        if link < 0:
            out += [(s, e, r - x) for s, e, x, r, _ in open_]
            open_.clear()
        open_.append((start, i + 1, left, right, link))
    return out + [(s, e, r - x) for s, e, x, r, _ in open_]


@dataclass
class Model:
    """Scores of toxic terms, the extreme-value parameters of clean writing, and the logistic curve over the evidence."""

    scores_of: dict[str, float]
    decay: float = 1.0  # lambda of exp(-lambda * score)
    height: float = 0.1  # K of the expected number of such segments, K * length * exp(-lambda * score)
    slope: float = 1.0
    offset: float = -3.0
    fitted: int = 0
    copies: int = 0

    def __post_init__(self):
        self.memo = Memo(lambda words: map(self.score, words))

    def state(self) -> tuple:
        """Plain values, for broadcasting."""
        return self.scores_of, self.decay, self.height, self.slope, self.offset

    def score(self, word: str) -> float:
        """The highest of the word's and its stems' scores; words without toxic terms only drift."""
        get = self.scores_of.get
        return max([get(t, 0.0) for t in terms(word)]) - DRIFT

    def scores(self, text: str | None) -> np.ndarray:
        """The score of each word."""
        parts = [np.fromiter(self.memo.of(w), np.float64, len(w)) for part in stretches(text) for w in (words(part),)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.empty(0)])

    def passages(self, text: str | None) -> list[tuple[int, int, float, float]]:
        """Every maximal segment in words: start, end, score, and its expected number in clean writing of that length."""
        scores = self.scores(text)
        m = max(len(scores), 1)
        return [(s, e, x, self.height * m * math.exp(-self.decay * x)) for s, e, x in segments(scores)]

    def evidence(self, passages: Iterable[tuple[int, int, float, float]]) -> float:
        """-log10 of the chance of the best r segments together in clean writing, at the r that surprises most."""
        sums, best, total = sorted((-math.log(max(x[3], 1e-300)) for x in passages), reverse=True), 0.0, 0.0
        for r, s in enumerate(sums, 1):
            total += s
            if total <= 0:
                break
            # sum statistic: P(T >= t) ~ exp(-t) t^(r-1) / (r! (r-1)!), and 2^-r for choosing r
            log_p = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r) + r * math.log(2)
            best = max(best, -log_p / math.log(10))
        return min(best, 300.0)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * evidence + self.offset))))


def _in_training(id_col: str) -> str:
    return f"pmod({_KEY.format(id_col)}, 4) <> 2"


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """text, toxic, held (kept back for calibrating) and first of the rows to fit on, written to the shared folder.

    They are labelled, in training, and at most ``rows``, chosen by the hash of the id. ``first`` is false for what is
    left out because another row with the same label is nearly its copy (and has a smaller id): else a copied text's
    rare words would pass for toxic ones. The chosen labels have a proven bound, so that they go to the texts; only
    chosen texts are written.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic is not null").where(_in_training("id"))
    known = known.groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    total = known.count()
    if total > rows:
        share = int(2**31 * min(1.0, 1.05 * rows / total))
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(2**31)) < share).orderBy(F.xxhash64("id"), "id").limit(rows)
    held = (F.pmod(F.xxhash64(F.col("id"), F.lit("fold")), F.lit(FOLDS)) == 0).alias("held")
    src = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).join(F.broadcast(known), "id").select("id", "toxic", held, "text")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = [_sketch(t) for t in values(b.column(3))]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([m[i] for m in marks], pa.int64()) for i in range(SKETCHES))], [*b.schema.names, *names])

    names = [f"s{i}" for i in range(SKETCHES)]
    made = written(in_arrow(src, sketch, src.withColumns({n: F.lit(0).cast("long") for n in names}).schema), "labelled")
    one = made.select("id", "toxic", *names)
    for n in names:
        one = one.groupBy("toxic", n).agg(F.min_by(F.struct("id", *(x for x in names if x != n)), "id").alias("r")).select("toxic", n, "r.*")
    # as many ids as chosen labels at most
    return made.join(F.broadcast(one.select("id", F.lit(True).alias("first"))), "id", "left").select("text", "toxic", "held", F.coalesce("first", F.lit(False)).alias("first"))


def _sketch(text: str | None) -> list[int]:
    """Triples of minima over runs of three words; near copies mostly share one, others hardly ever."""
    w = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) for part in stretches(text) for x in words(part)] or [0], np.uint64)
    if len(w) > 2:
        w = w[:-2] * np.uint64(0x9E3779B97F4A7C15) + w[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + w[2:] * np.uint64(0x165667B19E3779F9)
    w ^= w >> np.uint64(29)
    low = [int((w * np.uint64(a)).min()) for a in _MIX]
    return [hash(tuple(low[i::SKETCHES])) for i in range(SKETCHES)]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> Model:
    """Fit on labelled training rows. All terms that are sure make the model; they are terms of ``rows`` documents at most.

    Without labels, or with labels of one kind only, every word is neutral and every score is the offset's. What the
    model's ``fitted`` and ``copies`` say: rows fitted on, and rows left out as near copies of those.
    """
    whole = labelled(docs, labels, id_col, text_col, rows)
    n = {(r.toxic, r.held): r for r in whole.groupBy("toxic", "held").agg(F.sum(F.col("first").cast("long")).alias("n"), F.sum((~F.col("first")).cast("long")).alias("gone")).collect()}
    texts = whole.where("first").select("text", "toxic", "held")
    count = lambda toxic, held: n[toxic, held].n if (toxic, held) in n else 0
    n_toxic, n_clean = float(count(1, False)), float(count(0, False))
    model = Model({}, fitted=sum(r.n for r in n.values()), copies=sum(r.gone for r in n.values()))
    if not n_toxic or not n_clean:
        return model
    fitted = texts.where("not held")
    # a term of few toxic documents can't be sure, so that it needs no count in clean ones
    often = written(_term_counts(fitted.where("toxic = 1")).where(F.col("n") >= LEAST), "toxic-terms")
    clean = _term_counts(fitted.where("toxic = 0"), often).withColumnRenamed("n", "c")
    both = often.join(clean, "term", "left").select("term", F.col("n").cast("double").alias("n"), F.coalesce(F.col("c").cast("double"), F.lit(0.0)).alias("c"))
    delta, z = log_odds(F.col("n"), F.col("c"), n_toxic, n_clean)
    surest = math.sqrt(2 * math.log(max(often.count(), 2)))
    sure = both.select("term", delta.alias("delta"), z.alias("z")).where((F.col("z") >= surest) & (F.col("delta") > DRIFT))
    found = sure.select("term", F.least("delta", F.lit(MOST)).alias("score")).toPandas()
    model.scores_of = dict(zip(found["term"], found["score"].tolist(), strict=True))
    _calibrate(model, texts.where("held") if count(1, True) and count(0, True) else texts)
    return model


def _term_counts(texts: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """term, n: in how many texts each term is; of those only, if given, that are like one of a table (and a few others).

    Tasks get a filter of ``FILTER`` bits for that table, whatever its size.
    """
    bits = None
    if like is not None:
        held = np.zeros(FILTER, bool)
        at = like.select(F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(FILTER)).alias("at")).distinct().toPandas()["at"]  # FILTER rows at most
        held[at.to_numpy(np.int64)] = True
        bits = texts.sparkSession.sparkContext.broadcast(np.packbits(held))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(bits.value).tobytes() if bits is not None else None
        passing = Memo(lambda ws: [tuple(t for t in terms(w) if known is None or known[zlib.crc32(t.encode()) & (FILTER - 1)]) for w in ws])
        seen: Counter[str] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

        for b in batches:
            for text in values(b.column(0)):
                found: set[str] = set()
                for part in stretches(text):
                    found.update(words(part))
                seen.update({t for ts in passing.of(list(found)) for t in ts})
                if len(seen) > HELD_TERMS:
                    yield out()
                    seen.clear()
        yield out()

    return in_arrow(texts.select("text"), count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _calibrate(model: Model, texts: DataFrame) -> None:
    """Lambda from the score distribution of clean words, K from the best clean segments, the curve from all."""
    context = texts.sparkSession.sparkContext.broadcast(model.state())

    def clean_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hist, best = Model(*context.value), np.zeros(4001, np.int64), {}
        for b in batches:
            for text, toxic in zip(values(b.column(0)), b.column(1).to_pylist(), strict=True):
                s = m.scores(text)
                top = max((x for _, _, x in segments(s)), default=0.0)
                key = (1 + int(toxic > 0), round(math.log2(max(len(s), 1))), min(round(top * 10), 3000))
                best[key] = best.get(key, 0) + 1
                if not toxic:
                    hist += np.bincount(np.clip(np.round((s + DRIFT) * 200), 0, 4000).astype(int), minlength=4001)
        rows = [(0, 0, i, int(n)) for i, n in enumerate(hist) if n] + [(*k, n) for k, n in best.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["what", "length", "at", "n"])

    seen = in_arrow(texts.select("text", "toxic"), clean_scores, "what long, length long, at long, n long").groupBy("what", "length", "at").agg(F.sum("n").alias("n")).toPandas()
    words_ = seen[seen["what"] == 0]
    score, weight = words_["at"].to_numpy() / 200 - DRIFT, words_["n"].to_numpy(float)
    weight /= max(weight.sum(), 1.0)
    # toxic words that clean writing lacks still need a chance there: a small floor at the top score
    score, weight = np.append(score, MOST - DRIFT), np.append(weight * (1 - 1e-6), 1e-6)
    lo, hi = 1e-3, 1.0
    while (weight * np.exp(np.minimum(hi * score, 700))).sum() < 1 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (weight * np.exp(np.minimum(mid * score, 700))).sum() < 1 else (lo, mid)
    model.decay = lo
    clean = seen[seen["what"] == 1]
    x, m, n = clean["at"].to_numpy() / 10, 2.0 ** clean["length"].to_numpy(), clean["n"].to_numpy(float)
    # maximum likelihood of K where P(best < x) = exp(-K m exp(-lambda x))
    model.height = float((n.sum() + 1) / ((n * m * np.exp(-model.decay * x)).sum() + 1))
    context.unpersist()
    context = texts.sparkSession.sparkContext.broadcast(model.state())

    def evidences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mo, counts = Model(*context.value), {}
        for b in batches:
            for text, toxic in zip(values(b.column(0)), b.column(1).to_pylist(), strict=True):
                key = (int(toxic > 0), int(mo.evidence(mo.passages(text)) * 10))
                counts[key] = counts.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in counts], pa.int64()) for i in range(2)] + [pa.array(list(counts.values()), pa.int64())], ["toxic", "at", "n"])

    rows = in_arrow(texts.select("text", "toxic"), evidences, "toxic long, at long, n long").groupBy("toxic", "at").agg(F.sum("n").alias("n")).toPandas()
    model.slope, model.offset = _logistic(rows["at"].to_numpy() / 10, rows["toxic"].to_numpy(float), rows["n"].to_numpy(float))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(toxic | evidence) by Newton steps, with a weak pull that keeps separable data finite."""
    x = np.minimum(x, 12.0)  # far evidence must not bend the curve
    a = np.array([1.0, -2.0])
    pull = np.array([0.05, 0.05])
    for _ in range(100):
        p = 1 / (1 + np.exp(-(a[0] * x + a[1])))
        g = np.array([(n * (y - p) * x).sum(), (n * (y - p)).sum()]) - pull * (a - np.array([1.0, -2.0])) * 10
        w = n * p * (1 - p)
        h = np.array([[(w * x * x).sum(), (w * x).sum()], [(w * x).sum(), w.sum()]]) + np.diag(pull * 10)
        step = np.linalg.solve(h, g)
        a = a + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a[0]), 1e-3), float(a[1])


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score, predicted, passages (segments as word ranges with an expected number under 0.05).

    Each row is scored by its text alone; null and empty texts have no evidence. Names that ``docs`` has already
    get an underscore before them. Nothing is shuffled.
    """
    names = free_names(docs.columns, "score", "predicted", "passages")
    kind = "array<struct<start:int,end:int,score:double,expected:double>>"
    schema = docs.select("*", F.lit(0.0).alias(names[0]), F.lit(0).alias(names[1]), F.array().cast(kind).alias(names[2])).schema
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model.state())
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            score, found = [], []
            for text in values(b.column(at)):
                passages = m.passages(text)
                score.append(m.probability(m.evidence(passages)))
                found.append([{"start": s, "end": e, "score": x, "expected": n} for s, e, x, n in passages if n < 0.05])
            made = [pa.array(score, pa.float64()), pa.array([int(s >= CUT) for s in score], pa.int32()), pa.array(found, arrow)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, *names])

    return map_arrow(docs, scan, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages of each row; repeated rows score alike.

    A null id is not held out (its remainder is unknown) and never fitted on. Labels that are null or without a
    document count for nothing; a document labelled twice is toxic if either says so.
    """
    src = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    out = scored(src, fit(src, labels, rows=rows))
    held = F.coalesce(F.expr(f"pmod({_KEY.format('doc_id')}, 4) = 2"), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, unchanged."""
    score = free_names(docs.columns, "score", "predicted", "passages")[1]
    return scored(docs, fit(docs, labels, id_col, text_col, rows), text_col).where(F.col(score) == 0).select(*map(col, docs.columns))
