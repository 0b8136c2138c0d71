"""Toxicity and the hidden Markov model: exact small cases, brute force and held-out rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import hmm, toxicity


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# toxicity


def brute_segments(scores):
    """Maximal segments by definition: the best segment, then the same on what lies left and right of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = scores[i:j].sum()
            if s > 1e-12 and (best is None or s > best[2] + 1e-9):
                best = (i, j, s)
    if best is None:
        return []
    i, j, s = best
    left, right = brute_segments(scores[:i]), brute_segments(scores[j:])
    return [*left, best, *[(a + j, b + j, x) for a, b, x in right]]


def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 5, 12, 25):
        for _ in range(30):
            scores = rng.normal(-0.2, 1, n)
            got, want = toxicity.segments(scores), brute_segments(scores)
            assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
            assert np.allclose([x for *_, x in got], [x for *_, x in want])


def test_segments_in_linear_time():
    """Falling totals, where every candidate starts lower than all before it, and rising ones, which all merge."""
    import time

    for step, want in (([1.0, -2.0], 100_000), ([2.0, -1.0], 1), ([-2.0, 1.0], 100_000)):
        begin = time.process_time()
        assert len(toxicity.segments(np.array(step * 100_000))) == want
        assert time.process_time() - begin < 2


def test_log_odds_weigh_by_the_prior(spark):
    """Against Dirichlet log-odds written out for each term."""
    rows, (n1, n2) = [(20.0, 0.0), (0.0, 20.0), (10.0, 10.0), (3.0, 1.0), (100.0, 300.0)], (100.0, 300.0)
    d, z = toxicity.log_odds(F.col("t"), F.col("c"), n1, n2)
    got = spark.createDataFrame(rows, "t double, c double").select(d.alias("d"), z.alias("z")).collect()
    prior = toxicity.PRIOR * n1
    assert got[-1].d == pytest.approx(0, abs=1e-6) and got[-1].z == pytest.approx(0, abs=1e-6)
    for (t, c), r in zip(rows[:-1], got, strict=False):
        own = prior * (t + c) / (n1 + n2)
        assert r.d == pytest.approx(math.log((t + own) / (n1 + prior - t - own)) - math.log((c + own) / (n2 + prior - c - own)), abs=1e-3)
        like = sum(y * math.log(y / ((t + c) * n / (n1 + n2))) for y, n in ((t, n1), (c, n2)) if y)
        assert r.z == pytest.approx(math.copysign(math.sqrt(2 * like), r.d), abs=1e-6)


def plain_scores(rows, labels):
    """The whole score in plain Python: terms counted text by text, best segments by definition, the model's own curve."""
    train = [(t, labels[i]) for i, t in rows if i in labels and zlib.crc32(str(i).encode()) % 4 != 2]
    n1, n2 = sum(y for _, y in train), sum(1 - y for _, y in train)
    counts = {0: Counter(), 1: Counter()}
    for t, y in train:
        counts[y].update({x for w in toxicity.words(t) for x in toxicity.terms(w)})
    often = [w for w, n in counts[1].items() if n >= toxicity.LEAST]
    scores, prior = {}, toxicity.PRIOR * min(n1, n2)
    for w in often:
        t, c = counts[1][w], counts[0][w]
        own, more = prior * (t + c) / (n1 + n2), 1 + 1e-6
        delta = math.log((t + own) / ((n1 + prior) * more - t - own)) - math.log((c + own) / ((n2 + prior) * more - c - own))
        like = sum(y * math.log(y * (n1 + n2) / ((t + c) * n)) for y, n in ((t, n1), (c, n2)) if y)
        if delta > toxicity.DRIFT and like > 0 and math.sqrt(2 * like) >= math.sqrt(2 * math.log(max(len(often), 2))):
            scores[w] = min(delta, toxicity.MOST)
    return scores


def test_whole_score(spark, monkeypatch):
    """Terms, segments and scores of a small table against plain Python."""
    monkeypatch.setattr(toxicity, "FOLDS", 1 << 40)  # every row counts for the terms, and all calibrate
    rng = np.random.default_rng(12)
    plain, bad = [f"plain{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)], ["vileone", "viletwo", "foulness", "rotten"]
    rows, labels = [], {}
    for i in range(300):
        y = int(i % 5 == 0)
        w = list(rng.choice(plain, rng.integers(5, 40)))
        for _ in range(3 * y):
            w.insert(rng.integers(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels[i] = y
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    want = plain_scores(rows, labels)
    assert model.copies == 0 and model.fitted == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in labels)
    assert want.keys() == model.scores_of.keys() and {"vileone", "rotten"} <= want.keys()
    assert all(model.scores_of[w] == pytest.approx(x) for w, x in want.items())
    for r in toxicity.scored(docs, model).collect():
        s = np.array([max(model.scores_of.get(t, 0.0) for t in toxicity.terms(w)) - toxicity.DRIFT for w in toxicity.words(r.text)])
        found = [(a, b, x, model.height * len(s) * math.exp(-model.decay * x)) for a, b, x in brute_segments(s)]
        assert r.score == pytest.approx(model.probability(model.evidence(found)))
    assert model.slope > 0 and sum(r.predicted == labels[r.doc_id] for r in toxicity.scored(docs, model).collect()) >= 285


def test_near_copies_count_once_and_by_label(spark):
    """A copy with the same label is left out of the fit; one with another label, and other writing, is not."""
    text = [" ".join(f"w{chr(97 + (i * k) % 26)}{chr(97 + i // 5)}" for i in range(90)) for k in (3, 5, 7)]
    free = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2][:6]
    rows = list(zip(free, [text[0], text[0] + " more", text[0], text[1], text[1], text[2]], strict=True))
    labels = list(zip(free, [1, 1, 0, 0, 0, 1], strict=True))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert (model.fitted, model.copies) == (4, 2)


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.toxicity(documents(spark, sf), labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    held = [(r.toxic, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out and r.toxic is not None]
    yes, no = [g.score for t, g in held if t], [g.score for t, g in held if not t]
    auc = np.mean([(np.array(no) < y).mean() + 0.5 * (np.array(no) == y).mean() for y in yes])
    assert auc > 0.9
    assert np.mean([g.predicted for t, g in held if not t]) < 0.1 and np.mean([g.predicted for t, g in held if t]) > 0.75


def test_toxicity_awkward(spark):
    docs = spark.createDataFrame([(1, "vile words", 1), (2, None, 2), (None, "", 3), (1, "vile words", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None), (99, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 4 and all(r.predicted == 0 for r in got)
    assert toxicity.without_toxic(docs, labels).columns == docs.columns
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0
    assert toxicity.toxicity(docs, labels.where("false")).count() == 4


# hidden Markov model


def brute_counts(sequences, a, emit, start):
    """Log-likelihood and expected counts with plain forward and backward matrices."""
    emissions, moves, first, total = np.zeros_like(emit), np.zeros_like(a), np.zeros(len(a)), 0.0
    for s in sequences:
        forward, now = [], start
        for x in s:
            now = (now @ a) * emit[x]
            forward.append(now)
        like = now.sum()
        total += math.log(like)
        after = [np.ones(len(a))]
        for x in s[:0:-1]:
            after.append(a @ (emit[x] * after[-1]))
        after.reverse()
        before = [start, *forward[:-1]]
        for t, x in enumerate(s):
            emissions[x] += forward[t] * after[t] / like
            moves += a * np.outer(before[t], emit[x] * after[t]) / like
        first += start * (a @ (emit[s[0]] * after[0])) / like
    return emissions, moves, first, total


@pytest.mark.parametrize(("stretch", "group"), [(1024, 150_000), (5, 150_000), (5, 12), (3, 1)])
def test_expected_counts(monkeypatch, stretch, group):
    monkeypatch.setattr(hmm, "STRETCH", stretch)
    monkeypatch.setattr(hmm, "GROUP", group)
    rng = np.random.default_rng(8)
    model = hmm.Model.begin(np.full(6, 1 / 6), 3)
    seqs = [rng.integers(0, 6, n) for n in (1, 4, 17, 5, 10, 23)]
    some = hmm.Sequences(seqs)
    got, want = some.expected(model.moves, model.emit, model.start), brute_counts(seqs, model.moves, model.emit, model.start)
    for x, y in zip(got, want, strict=True):
        assert np.allclose(x, y)
    each = some.likelihoods(model.moves, model.emit, model.start)
    assert np.allclose(each, [brute_counts([s], model.moves, model.emit, model.start)[3] for s in seqs])


def naive_tokens(text):
    import re

    return [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())] + [hmm.END]


def test_scores(spark, small):
    rows = [(r.doc_id, r.text) for r in documents(spark, small).select("doc_id", "text").collect()] + [(-1, None), (-2, ""), (None, "new wörd"), (7, "a"), (7, "a"), (-9, "x " * 5000)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in naive_tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        w = naive_tokens(t)
        want.append((i, held(i), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)))
    got = hmm.score_texts(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, uid int")).collect()
    key = lambda r: (str(r[0]), r[2])
    got, want = sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens)), sorted(want, key=key)
    for r, w in zip(got, want, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5]
        assert r.base_score == pytest.approx(w[5], rel=1e-9)
    assert all(r.score < 0 for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) - 1e-9


def test_whole_score_by_hand(spark):
    """The model's score of every text from plain forward matrices, shapes and counts, with all tokens as symbols by hand."""
    rng = np.random.default_rng(3)
    often, rows = [f"w{i}" for i in range(12)], []
    for i in range(60):
        rows.append((i, " ".join([*rng.choice(often, rng.integers(0, 30)), *([f"once{i}"] if i % 3 else []), *(["Once7,"] if i == 7 else [])])))
    rows += [(100, None), (101, "UNKNOWN w1 \u00fc!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in naive_tokens(t))
    n = sum(counts.values())
    own = [w for w in sorted(counts, key=lambda w: (-counts[w], w)) if w != hmm.END and counts[w] >= max(1, -(-n // hmm.OWN))]
    classes = [[w for w in counts if w != hmm.END and w not in own and hmm.shape(w) == k] for k in range(hmm.CLASSES)]
    place = {hmm.END: 0, **{w: k + 1 for k, w in enumerate(own)}}
    symbol = lambda w: place[w] if w in place else 1 + len(own) + hmm.shape(w)
    frequency = np.array([counts[hmm.END], *(counts[w] for w in own), *(sum(counts[w] for w in c) for c in classes)]) + 1.0
    model = hmm.Model.begin(frequency / frequency.sum(), hmm.STATES)
    train = [[symbol(w) for w in naive_tokens(t)] for i, t in rows if not held(i)]
    for _ in range(hmm.ROUNDS):
        e, m, f, _ = brute_counts(train, model.moves, model.emit, model.start)
        model = hmm.Model.next(e, m, f, frequency / frequency.sum())
    got = {r.doc_id: r.score for r in hmm.score_texts(docs).collect()}
    for i, t in rows:
        w = naive_tokens(t)
        states = brute_counts([[symbol(x) for x in w]], model.moves, model.emit, model.start)[3] / math.log(10)
        inside = sum(math.log10((counts[x] + 1) / (sum(counts[y] for y in classes[hmm.shape(x)]) + len(classes[hmm.shape(x)]) + 1)) for x in w if x not in place)
        assert got[i] == pytest.approx(states + inside, rel=1e-6), i


def test_gain_over_the_base(spark):
    """On held-out texts the states are worth at least a twentieth of a decimal digit a token."""
    got = hmm.score_texts(documents(spark, "/root/testdata/sf0.1")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (got.s - got.b) / got.n > 0.05


def test_probabilities_of_words_sum_to_one(spark):
    """Every sequence of symbols ends; over one step, all known words and one new word of each class have at most all chance."""
    model = hmm.Model.begin(np.array([0.2, 0.3, 0.5]), 2)
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.moves.sum(axis=1), 1)
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert hmm.score_texts(nothing).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = hmm.score_texts(spark.createDataFrame([(held, "nothing trains")], "doc_id long, text string")).first()
    assert only.train_tokens == 0 and only.base_score == 0 and math.isfinite(only.score)


def test_training_raises_the_likelihood(spark, small):
    rows = [tuple(len(w) % 5 for w in (r.text or "").split()[:200]) + (5,) for r in documents(spark, small).limit(40).collect()]
    df = spark.createDataFrame([(bytearray(np.array(r, np.uint16).tobytes()),) for r in rows], "symbols binary")
    group, frequency = hmm.Sequences([np.array(r) for r in rows]), np.full(6, 1 / 6)
    lls = []
    for rounds in (0, 1, 4):
        m = hmm.train(df, 6, frequency, 3, rounds)
        lls.append(group.expected(m.moves, m.emit, m.start)[3])
    assert lls[0] < lls[1] < lls[2]


def test_expected_counts_look_emissions_up_once():
    """One lookup for all tokens of a group, forward and backward, and the counts of plain steps."""

    class Counted(np.ndarray):
        looked = 0

        def __getitem__(self, at):
            Counted.looked += 1
            return np.asarray(super().__getitem__(at))

    rng = np.random.default_rng(3)
    model = hmm.Model.begin(np.full(9, 1 / 9), 3)
    seqs = [rng.integers(0, 9, n).astype(np.uint16) for n in (1, 4, 7, 7)]
    moves, likelihood = np.zeros((3, 3)), 0.0
    for s in seqs:
        alpha = [model.start]
        for x in s:
            alpha.append((alpha[-1] @ model.moves) * model.emit[x])
        beta, total = np.ones(3), alpha[-1].sum()
        likelihood += np.log(total)
        for t in range(len(s) - 1, -1, -1):
            moves += np.outer(alpha[t], model.emit[s[t]] * beta) * model.moves / total
            beta = model.moves @ (model.emit[s[t]] * beta)
    got = hmm.Sequences(seqs).expected(model.moves, model.emit.view(Counted), model.start)
    assert Counted.looked == 1
    assert np.allclose(got[1], moves) and np.isclose(got[3], likelihood)
