"""The stages in order: each on what its predecessor kept."""

import hashlib
import math

import numpy as np
from test_dedup import brute, normal
from test_models import brute_segments, plain_scores
from test_scans import naive_hits

import corpus_pipeline
from weftgraph.llm import decontaminate, exact, near, toxicity
from weftgraph.llm.common import table
from weftgraph.llm.queries import piece_model


def test_stages(spark, small):
    docs = table(spark, small, "documents")
    labels, benchmark = table(spark, small, "labels"), table(spark, small, "benchmark")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "pieces"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    decisions = [
        lambda d: ids(toxicity.toxicity(d, labels).where("predicted = 0")),
        lambda d: ids(exact.exact_groups(d).where("kept")),
        lambda d: ids(near.near_components(d).where("kept")),
        lambda d: ids(decontaminate.contamination(d, benchmark).where("not contaminated")),
        ids,
    ]
    original = docs.toPandas().set_index("doc_id")
    for (name, stage), kept in zip(corpus_pipeline.STAGES, decisions, strict=True):
        out = stage(spark, docs, small)
        assert ids(out) == kept(docs), name
        if name != "pieces":
            assert out.columns == docs.columns
            for r in out.collect():
                assert r.text == original.loc[r.doc_id, "text"]
            docs = spark.createDataFrame(out.collect(), docs.schema)
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns)


def test_stages_on_awkward_rows(spark, small):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int, `a.b` string"
    rows = [(None, None, None, None, None, None, None), (1, "", "en", "s", 0, 1, "x"), (2, "one", "en", "s", 3, 1, "x"), (2, "one", "en", "s", 3, 1, "x"), (3, "word " * 9000, None, None, 1, 1, "x")]
    for chosen in (rows, []):
        docs = spark.createDataFrame(chosen, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, small)
            if name != "pieces":
                assert out.columns == docs.columns, name
                docs = spark.createDataFrame(out.collect(), schema)
            else:
                assert out.count() == docs.count() == (3 if chosen else 0)


def plain_run(rows, labels, items, model):
    """Ids, piece ids and decoded texts that ``run`` has to return, by plain Python; of the fitted model, only its terms' calibration is used."""
    import sentencepiece

    terms = plain_scores(rows, labels)
    kept = []
    for i, t in rows:
        s = np.array([max(terms.get(x, 0.0) for x in toxicity.terms(w)) - toxicity.DRIFT for w in toxicity.words(t)])
        found = [(a, b, x, model.height * len(s) * math.exp(-model.decay * x)) for a, b, x in brute_segments(s)]
        if model.probability(model.evidence(found)) < toxicity.CUT:
            kept.append((i, t))
    first = {}
    for i, t in sorted(kept):
        first.setdefault(normal(t), (i, t))
    kept = sorted(first.values())
    root = brute(kept, 5, 80)
    kept = [(i, t) for i, t in kept if root[i][1] == i]
    hit = {i: h > 0 and 20 * h >= n for i, n, h, _ in naive_hits(kept, items)}
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    return [(i, ids, library.decode(ids)) for i, t in kept if not hit[i] for ids in [library.encode(t or "", add_eos=True)]]


def test_run(spark, tmp_path, monkeypatch):
    """The whole pipeline against plain Python, with toxic texts, copies, near copies and benchmark passages planted."""
    monkeypatch.setattr(toxicity, "FOLDS", 1 << 40)  # as in the test of the whole score: every row counts
    rng = np.random.default_rng(31)
    plain, bad = [f"plain{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)], ["vileone", "viletwo", "foulness", "rotten"]
    rows, labels = [], {}
    for i in range(300):
        w = list(rng.choice(plain, rng.integers(20, 60)))
        for _ in range(4 * (i % 5 == 0)):
            w.insert(rng.integers(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels[i] = int(i % 5 == 0)
    clean = [t for i, t in rows if i % 5]
    rows += [(1000 + i, t.replace(" ", "  ")) for i, t in enumerate(clean[:40])]  # copies but for white space
    rows += [(2000 + i, t + " plainaa Plainab") for i, t in enumerate(clean[40:80])]  # near copies
    items = [(i, " ".join(rng.choice(plain, 13 + i))) for i in range(5)] + [(9, "onlyhere twice"), (10, None)]
    rows += [(3000 + i, f"{clean[100 + i]} before {t} after") for i, (_, t) in enumerate(items[:5])] + [(3010, "Onlyhere, twice!"), (3011, None), (3012, ""), (3013, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", marks), ("benchmark", spark.createDataFrame(items, "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    want = plain_run(rows, labels, items, toxicity.fit(table(spark, str(tmp_path), "documents"), table(spark, str(tmp_path), "labels")))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, list(r.ids), r.n_tokens) for r in got) == sorted((i, ids, len(ids)) for i, ids, _ in want)
    assert {r.doc_id: r.decoded_sha256 for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, _, t in want}
    left = {r.doc_id for r in got}
    assert not left & {*range(1000, 1040), *range(3000, 3005), 3010, 3012} and {3011, 3013} <= left  # null and empty are one text, a space another
    assert len(left & {i for i in labels if not labels[i]}) > 200 and len(left & {i for i in labels if labels[i]}) < 15
