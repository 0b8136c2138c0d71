"""Decontamination, URL filters, secrets, WARC, pieces and sharding against brute force and round trips."""

import base64
import hashlib
import random
import re
import string
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate, pieces, secrets, sharding, urls, warc
from weftgraph.llm.queries import ORACLES, QUERIES, piece_model


def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


# decontamination


def naive_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def naive_hits(docs, items, window=13):
    windows = defaultdict(set)
    for item, text in items:
        w = naive_words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[k : k + window])].add(item)
    lengths = {len(p) for p in windows}
    out = []
    for i, text in docs:
        w, hit, found = naive_words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[p]
        out.append((i, len(w), len(hit), sorted(map(str, found))))
    return out


@pytest.mark.parametrize("how", [{}, {"block": 40, "shard_bytes": 5000}, {"group_words": 3000}])
def test_contamination(spark, small, how):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()] + [(900, None), (901, "--"), (902, "zwölf Große"), (903, "x"), (None, "x")]
    docs = documents(spark, small) + [(-1, None), (-2, ""), (-3, "A zwölf gro\u00dfe X"), (-4, "x " * 40), (-5, " ".join(t for _, t in items if t)), (-4, "x"), (None, "x")]
    got = decontaminate.contamination(
        spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, spans int"), spark.createDataFrame(items, "item_id long, text string"), **how
    ).collect()
    want = naive_hits(docs, [("" if i is None else i, t) for i, t in items])
    rows = [(i, n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0 and 20 * h >= n) for i, n, h, f in want]
    assert sorted(map(str, ((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got))) == sorted(map(str, rows))
    assert sum(r[2] > 0 for r in rows) > 5


def test_contamination_by_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = QUERIES["op6_decontamination"](spark, sf)
    got = [tuple(r) for r in df.collect()]
    assert sorted(got) == sorted(con.sql("select " + ", ".join(df.columns) + " from (" + ORACLES["op6_decontamination"] + ")").fetchall())
    assert sum(r[2] > 0 for r in got) > 10


def test_many_blocks_are_one_pass(spark, small):
    """A benchmark of a hundred blocks is searched in one Python stage over the texts."""
    found = decontaminate.found_spans(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet"), block=200)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_no_benchmark(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in decontaminate.contamination(docs, none).collect()] == [(2, 0, False)]
    assert decontaminate.without_contaminated(docs, none).collect() == docs.collect()
    assert decontaminate.contamination(docs.where("false"), none).count() == 0
    some = spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert decontaminate.contamination(docs.where("false"), some).count() == 0
    assert decontaminate.contamination(docs.repartition(3), some).first().n_hit == 1  # with empty partitions


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(3)
    text = rng.integers(1, 5, 700)
    index = decontaminate.FMIndex(text, 6)
    bit = rng.integers(0, 2, 321)
    bits = decontaminate.Bits(bit)
    assert bits.ones(np.arange(322)).tolist() == np.concatenate(([0], np.cumsum(bit))).tolist() and (bits.at(np.arange(321)) == bit).all()
    assert [list(text[i:]) for i in decontaminate.suffix_array(text)] == sorted(list(text[i:]) for i in range(len(text)))
    phrases = np.array([text[i : i + 4] for i in range(0, 600, 7)] + [[5, 5, 5, 5]])
    for p, lo, hi in zip(phrases, *index.search(phrases), strict=True):
        assert sorted(index.locate(np.arange(lo, hi))) == [i for i in range(len(text) - 3) if (text[i : i + 4] == p).all()]


# URLs


def naive_judge(url):
    _, mark, rest = (url or "").partition("://")
    host = re.split(r"[/?#]", rest)[0] if mark else ""
    path = re.split(r"[?#]", rest[len(host) :])[0] if mark else ""
    host = "".join(c.lower() if c in string.ascii_uppercase else c for c in host)
    best = None
    for verdict, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_urls(spark, small):
    rows = [(r.page_id, r.url) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    rows += list(enumerate([None, "", "x", "http://", "http://A.Example.NET/en/x?y#z", "http://example.net/EN/", "http://net/", "http://xnet/", "HTTP://casino.org/fr/a", "http://b.org/casino", "http://example.com/de/a?b=/c",
        "http://example.com?de/", "http://example.com#/de/", "http://q.net", "http://ü.org/fr/ß", "ftp://a.b/x.exe", "a://b/" + "z" * 20_000], 10_000))
    rows += [(None, "http://spam-x.com/"), (10_001, "http://ads.y.com/a")]
    full = [re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g), re.DOTALL) for g in urls.GLOBS]
    got = urls.judge_urls(spark.createDataFrame([(i, u, 1) for i, u in rows], "page_id long, url string, host int")).collect()
    want = []
    for i, u in rows:
        host, path, best = naive_judge(u)
        canonical = urls.parts(u)[2].encode().decode("latin-1")
        glob = any(g.fullmatch(canonical) for g in full)
        want.append((i, host, path, best and best[1], best[0] if best else "block" if glob else "allow", glob))
    assert sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict, r.glob) for r in got))) == sorted(map(str, want))
    assert sum(w[5] for w in want) >= 4
    pages = spark.createDataFrame([(1, "http://a.net/", 1), (2, "http://a.com/", 2), (3, None, 3)], "page_id long, url string, url_key int")
    assert sorted(r.page_id for r in urls.allowed_pages(pages).collect()) == [2, 3]
    assert urls.judge_urls(pages.where("false")).count() == 0


def test_automaton_over_several_words():
    patterns = ["a*" + "b" * 70 + "?c", "*x", "", "q?*", "**"]
    for chosen in (patterns[:1], patterns[:4], patterns[2:3], patterns):
        a = urls.Globs.of(chosen)
        strings = ["", "a" + "b" * 70 + "zc", "a" + "b" * 69 + "zc", "abx", "q", "qz", "qzzz", "b"]
        want = [any(re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else c for c in p), s) for p in chosen) for s in strings]
        assert a.matches([s.encode() for s in strings]).tolist() == want
    assert urls.Globs.of(["a"]).matches([]).tolist() == []


def test_thousands_of_patterns(spark, tmp_path):
    """Patterns from a file, in many automata, against regular expressions."""
    rng = random.Random(8)
    patterns = ["*" + "".join(rng.choice("abc?*") for _ in range(rng.randint(4, 14))) + rng.choice(["", "*"]) for _ in range(3000)]
    (tmp_path / "globs.txt").write_text("# comment\n\n" + "\n".join(patterns) + "\n")
    read = list(urls.read_globs(spark, str(tmp_path / "globs.txt")))
    assert sorted(read) == sorted(set(patterns)) and len(urls.Globs.several(read)) > 10
    full = re.compile("|".join("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p) for p in sorted(set(patterns)) if p.count("*") < 4), re.DOTALL)
    few = [p for p in read if p.count("*") < 4]
    strings = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 14))) for _ in range(300)]
    got = urls.any_matches(urls.Globs.several(few), [s.encode() for s in strings]).tolist()
    assert got == [bool(full.fullmatch(s)) for s in strings] and 0 < sum(got) < 300


def test_patterns_in_groups(spark):
    """However many groups there are, the result is that of one."""
    rng = random.Random(3)
    patterns = ["*://" + "".join(rng.choice("ab?") for _ in range(rng.randint(2, 8))) + "/" for _ in range(60)] + ["*x/"]
    pages = spark.createDataFrame([(i, "http://" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) + rng.choice(["/", "", "x/", ".org/fr/"])) for i in range(200)] + [(None, None)], "page_id long, url string")
    rows = lambda **how: sorted(map(str, urls.judge_urls(pages, globs=(p for p in patterns), **how).collect()))
    assert rows() == rows(group_bytes=40) == rows(group_bytes=1) and 0 < sum("glob=True" in r for r in rows()) < 200
    assert sorted(map(str, urls.judge_urls(pages, globs=()).collect())) != rows()


def test_canonical_urls():
    for given, want in {
        "HTTP://Ex.COM": "http://ex.com/", "http://x:80/%7Ea/../b": "http://x/b", "https://x.:443/a/./b/..?": "https://x/a/", "http://x:8080/%2f%41%zz?q=%7e%2F#f": "http://x:8080/%2FA%zz?q=~%2F",
        "http://x/../../a//b/.": "http://x/a//b/", "http://x/..": "http://x/", "http://x/...": "http://x/...", "a://b:80/": "a://b:80/", "http://x:/": "http://x/", "x": "", "http://": "http:///",
    }.items():
        assert urls.parts(given)[2] == want, given
    assert urls.parts("http://X:80/%7Ea/../b")[:2] == ("x:80", "/%7Ea/../b")


# secrets


def naive_base(text):
    out = [(m.start(), "assign", m.end()) for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    out += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ["assign", "access", "hex"]
    return sorted(out, key=lambda x: (x[0], order.index(x[1])))


def test_secrets(spark, small):
    rng = random.Random(5)
    token = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    planted = [(20_000 + i, f"Grüße 😀 the value {token(40)} was left here") for i in range(60)]
    plain = [(30_000 + i, "internationalisationsverantwortlichkeiten donaudampfschifffahrtsgesellschaftskapitaen") for i in range(20)]
    docs = documents(spark, small) + planted + plain + [(-1, None), (-2, ""), (-3, "API_key = 'abc' token:abcdef ſecret=abcdefg toKen=abcdefg"), (-4, "AKIA" + "A" * 16 + " AKIA" + "B" * 15), (-5, "f" * 24 + "A" + "0" * 23), (None, "passwd: hunter22"), (-5, "f" * 24 + "A" + "0" * 23)]
    got = secrets.scan_secrets(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, spans int")).collect()
    want = []
    for i, t in docs:
        base = naive_base(t or "")
        want.append((i, *(sum(k == kind for _, k, _ in base) for kind in ("assign", "access", "hex")), hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in base).encode()).hexdigest()))
    assert sorted(map(str, ((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got))) == sorted(map(str, want))
    by = {r.doc_id: r for r in got}
    assert sum(by[i].n_random == 1 for i, _ in planted) >= 55
    assert all(by[i].n_random == 0 for i, _ in plain)
    texts = dict(docs)
    for r in got:
        parts = [s.split(":") for s in r.spans.split(",") if s]
        assert len(parts) == r.n_assign + r.n_access + r.n_hex + r.n_random
        assert all(0 <= int(s) < int(e) <= len(texts[r.doc_id] or "") for _, s, e in parts)
    assert secrets.scan_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_random_spans_of_each_encoding(spark):
    """Tokens of several encodings among prose of the corpus' symbols: most are found, and of what is found hardly any is prose."""
    rng = random.Random(11)
    alphabets = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", string.digits + string.ascii_lowercase]
    vowels = "eaiounrtlsdhcm"
    prose = lambda n: "".join(rng.choice(vowels) for _ in range(n))
    rows, planted = [], {}
    for i in range(1500):
        a = alphabets[i % 4]
        rows.append((i, f"some words {prose(12)} and {prose(30)} then {''.join(rng.choice(a) for _ in range(44))} end" if i % 3 == 0 else f"{prose(26)} and {prose(9)} {prose(34)}"))
        if i % 3 == 0:
            planted[i] = (rows[-1][1].index(" then ") + 6, rows[-1][1].rindex(" end"))
    got = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = [(r.doc_id, int(x[1]), int(x[2])) for r in got for x in (s.split(":") for s in r.spans.split(",") if s) if x[0] == "random"]
    false = [f for f in found if planted.get(f[0]) != f[1:]]
    assert len(found) - len(false) > 0.9 * len(planted) and len(false) <= 2 * secrets.FALSE_SHARE * len(found)
    texts = dict(rows)
    for doc, s, e in found:  # by brute force: each is a candidate that overlaps no base span
        assert re.fullmatch(r"[A-Za-z0-9+/_-]{20,}", texts[doc][s:e]) and all(e <= a or z <= s for a, _, z in naive_base(texts[doc]))


def test_many_candidates_are_one_pass():
    base = [(10 * i, 2, 10 * i + 30) for i in range(3000)]
    spans = [(10 * i + k, 10 * i + k + 2) for i in range(2990, 3010) for k in (0, 5)]
    assert list(secrets._apart(base, iter(spans))) == [x for x in spans if all(x[1] <= a or z <= x[0] for a, _, z in base)]
    assert list(secrets._apart([], iter(spans))) == spans


# WARC


@pytest.mark.parametrize("segment", [97, 32_768])
def test_warc(spark, small, segment):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    rows += [(i + 10_000, "http://a/", t) for i, t in enumerate([None, "", "same", "same", "ü" * 500, "WARC/1.1\r\nx\r\n\r\n\r\n\r\nWARC/1.1\r\n", "\r\n\r\n", "big" * 30_000, "same"])] + [(20_000, None, "url\nless"), (20_001, "b\r\nc", None)]
    first = {}
    for i, _, t in sorted(rows, key=lambda r: r[0]):
        first.setdefault(t or "", i)
    want = []
    for i, _, t in rows:
        raw, f = (t or "").encode(), first[t or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if f == i else "revisit", None if f == i else f, raw if f == i else None))
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    got = warc.archive_round_trip(pages, segment=segment, chunk=50).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload)) for r in got if r.payload) == sorted(w for w in want if w[5])
    assert sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(str(w[:5]) for w in want)
    assert warc.archive_round_trip(pages.where("false")).count() == 0


def test_warc_small_payloads_and_null_ids(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd"), (None, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = warc.archive_round_trip(pages, min_bytes=3).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got if r.record_type == "revisit") == [("4", "revisit", 3)] * 2
    assert len(got) == 6


def test_warc_any_string_id(spark):
    """Ids are strings with the signs that headers and record ids use."""
    ids = ["a:b", "x>y", "", "=", "%3A", "ü\r\n:", "<urn:x-page:1>", " s "]
    pages = spark.createDataFrame([(i, "http://u/", f"page {k // 2}" * 50) for k, i in enumerate(ids)] + [(None, "u", "page 0" * 50)], "page_id string, url string, html string")
    got = warc.archive_round_trip(pages, segment=100).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(map(str, [*ids, None]))
    for k in range(0, len(ids), 2):
        a, b = sorted(ids[k : k + 2])
        assert {(r.page_id, r.record_type, r.refers_to) for r in got if r.page_id in (a, b)} == {(a, "response", None), (b, "revisit", a)}


def test_warc_common_payload(spark):
    """A third of the pages is empty, with text that looks like records in another."""
    pages = spark.range(3000).selectExpr("id as page_id", "'u' as url", "case id % 3 when 0 then '' when 1 then repeat('WARC/1.1\r\n', 300 + id) else string(id) end as html")
    got = warc.archive_round_trip(pages)
    assert got.where("payload_bytes = 0 and record_type = 'revisit' and refers_to = 0").count() == 999
    assert got.where("record_type = 'response'").count() == 2001


def test_warc_long_payload(spark):
    """Reassembly takes time in proportion: 64 MB in 4,000 segments."""
    rows = spark.range(1, 4001).selectExpr("'a' as id", "'response' as type", "'1' as page", "string(null) as refers", "string(null) as digest", "'a' as origin", "int(id) as number", "if(id = 4000, 64000000L, null) as total", "binary(repeat(char(97 + id % 26), 16000)) as block")
    begin = time.perf_counter()
    block = warc.reassembled(rows).select(F.md5("block").alias("h"), F.octet_length("block").alias("n")).first()
    assert block.n == 64_000_000 and block.h == hashlib.md5(b"".join(bytes([97 + i % 26]) * 16000 for i in range(1, 4001))).hexdigest()
    assert time.perf_counter() - begin < 20


def test_warc_missing_segment(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 1000)], "page_id long, url string, html string")
    path = str(tmp_path / "a")
    warc.write_archives(warc.with_revisits(pages), path, segment=100)
    records = warc.read_records(spark, path)
    assert records.count() > 10
    assert [bytes(r.payload) for r in warc.payloads(warc.reassembled(records.orderBy(F.rand(1)))).collect()] == [b"x" * 1000]
    with pytest.raises(Exception, match="segments are missing"):
        warc.reassembled(records.where("number is null or number <> 3")).collect()
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nab\r\n0\r\n\r\n")


# pieces


def test_agendas_side_by_side():
    """Stretches merged beside others are as those with a heap of their own."""
    p, rng = pieces.Pieces(open(piece_model(), "rb").read()), random.Random(6)
    signs = [*"etaoinshrdlucmfw", "é", "ß", "-", "3", "\u4e2d", "\u0301", "\U0001f600", "\u2581"]
    some = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(2000)] + ["\u2581the", "a", "\u2581" * 40]
    assert p.merged(some) == [p._ids(p._heaped(s)) for s in some]
    assert p.merged([]) == []


def test_pieces_checks_every_row(spark, monkeypatch):
    whole = pieces.Pieces
    monkeypatch.setattr(pieces, "Pieces", type("Odd", (whole,), {"encode": lambda self, texts, end=True: whole.encode(self, [t.replace("rare", "common") for t in texts], end)}))
    texts = [(i, "a rare text" if i == 150 else f"text {i}") for i in range(200)]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    assert pieces.encode_decode(df.where("doc_id <> 150"), piece_model()).count() == 199
    with pytest.raises(Exception, match="encodes or decodes this text otherwise: 'a rare text'"):
        pieces.encode_decode(df, piece_model()).collect()


def test_pieces_checks_stretches_as_they_are_made():
    """A wrong stretch raises when it is made, and again when it is asked for again; a mark alone has no text of its own."""
    p = pieces.Pieces(open(piece_model(), "rb").read())
    texts = ["some words", " ", "a  ", "words again", "\u4e2d words"]
    assert p.encode(texts) == p.library.encode(texts, add_eos=True)
    p.forget()
    p.merged = lambda stretches: [(0,) if s == "\u2581words" else p._ids(p._heaped(s)) for s in stretches]
    for _ in range(2):
        with pytest.raises(ValueError, match="encodes this otherwise: '\u2581words'"):
            p.encode(["some words"])


def test_pieces_keep_library_calls_short():
    """The library encodes a stretch once, and no whole text whose ids give the text again."""
    p, sent = pieces.Pieces(open(piece_model(), "rb").read()), []

    class Counted:
        def __init__(self, library):
            self.decode, self.whole = library.decode, library.encode

        def encode(self, texts, **options):
            sent.extend([texts] if isinstance(texts, str) else texts)
            return self.whole(texts, **options)

    p.library = Counted(p.library)
    texts = [f"some words again {i % 3}" for i in range(100)]
    encoded = p.encode(texts)
    p.check(texts, encoded, [p.decode(ids) for ids in encoded])
    assert sorted(sent) == ["0", "1", "2", "again", "some", "words"]


def test_pieces(spark, small):
    rng = random.Random(2)
    noise = ["".join(chr(rng.choice([32, 9, 10, 0x2581, 0xE9, 0x4E2D, 0x1F600, 0x0, 0xFFFD, 0x300, *range(97, 105)])) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    docs = documents(spark, small) + list(enumerate([None, "", " ", "  a", "\u2581a", "a\u2581 b ", "x" * 5000, *noise], 10_000)) + [(None, "a"), (1, "a")]
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, ids int")
    got = pieces.encode_decode(df, piece_model(), outputs=("ids", "decoded", "n_tokens"))
    assert got.columns == ["doc_id", "text", "ids", "_ids", "decoded", "n_tokens"]
    for r in got.collect():
        want = library.encode(r.text or "", add_eos=True)
        assert r["_ids"] == want and r.n_tokens == len(want)
        assert r.decoded == library.decode(want)
    out = pieces.encode_decode(df, piece_model(), keep=["doc_id"]).where("doc_id = 10001").first()
    assert out.ids_sha256 == hashlib.sha256(str(library.eos_id()).encode()).hexdigest() and out.decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert pieces.encode_decode(df.where("false"), piece_model()).count() == 0


def test_contamination_by_many_equal_short_items(monkeypatch):
    """A thousand equal one-word items, and that word a million times: searched once, located in slices."""
    vocabulary, names = {b"the": 1, b"cat": 2}, [str(i) for i in range(1001)]
    phrases = decontaminate.Phrases.of(vocabulary, np.array([1] * 1000 + [1, 2], np.int32), names, np.array([1] * 1000 + [2]), 13)
    shard = [np.tile(np.array([1, 1, 2, 0], np.int32), 250_000), np.zeros(3, np.int32), np.array([0, 2, 1], np.int32)]
    tracemalloc.start()
    hit, docs, items = decontaminate._search(shard, phrases, 100_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6
    assert hit[:1_000_000].tolist() == [True, True, True, False] * 250_000 and hit[1_000_000:].tolist() == [False] * 4 + [False, True]
    assert sorted(zip(docs.tolist(), items.tolist(), strict=True)) == [(0, i) for i in range(1001)] + [(2, i) for i in range(1000)]


# sharding


def shares(rows):
    """Rows by shard: places without gaps from 0, and bytes."""
    places, load = defaultdict(list), defaultdict(int)
    for r in rows:
        places[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    return load


def test_sharding(spark, small, tmp_path):
    docs = documents(spark, small) + [(-1, None), (-2, ""), (None, "a"), (None, "a"), (7, "ü"), (7, "ü")] + [(100_000 + i, "hot text") for i in range(3000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, size int")
    folder = f"file://{tmp_path}/map"
    rows, smap = sharding.shard_documents(df, shards=8, folder=folder)
    got = rows.collect()
    crc = lambda t: zlib.crc32((t or "").encode())
    assert sorted(map(str, ((r.doc_id, r["size"], r.text_crc32) for r in got))) == sorted(str((i, len((t or "").encode()) + 8, crc(t))) for i, t in docs)
    load = shares(got)
    assert set(load) == set(range(8)) and max(load.values()) - min(load.values()) <= max(smap.bytes)
    # the map is stored, and holds for what comes later: no record moves but into the new shard
    assert smap.version == 1 and sharding.SlotMap.stored(spark, folder) == smap and sharding.SlotMap.stored(spark, folder + "-none") is None
    later, more = sharding.shard_documents(df, shards=9, folder=folder)
    before, after = ({(r.doc_id, r.text_crc32): r.shard for r in d if r.doc_id is not None} for d in (got, later.collect()))
    assert more.version == 2 and all(after[k] in (s, 8) for k, s in before.items())
    assert min(shares(later.collect()).values()) > 0.5 * sum(more.loads()) / 9
    assert sharding.SlotMap.stored(spark, folder).shards == 9 and sharding.SlotMap.stored(spark, folder, 1) == smap
    with pytest.raises(ValueError, match="9 shards"):
        sharding.shard_documents(df, shards=8, folder=folder)
    # a slot that grows is made up for by moving few slots; a map that is even stays as it is
    heavy = spark.createDataFrame([(5, "x" * 200_000, 1)], "doc_id long, text string, size int")
    _, third = sharding.shard_documents(df.unionByName(heavy), shards=9, folder=folder)
    assert third.version == 3 and third.shards == 9 and 0 < sum(a != b for a, b in zip(more.shard_of, third.shard_of, strict=True)) < 3000
    assert sharding.shard_documents(df.unionByName(heavy), shards=9, folder=folder)[1].version == 3
    empty, _ = sharding.shard_documents(df.where("false"))
    assert empty.count() == 0


def test_sharding_without_ids(spark):
    """Rows without ids, and rows of one id, don't fill one shard."""
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 7L, id)) as doc_id", "concat('some text ', id % 500) as text")
    load = shares(sharding.shard_documents(df, shards=6)[0].collect())
    assert max(load.values()) < 1.1 * min(load.values())


def test_sharding_of_repeated_rows(spark):
    """A fifth of the rows is one row, ids and all."""
    df = spark.range(20_000).selectExpr("if(id % 5 = 0, 7L, id) as doc_id", "if(id % 5 = 0, 'the very same text', concat('some text ', id % 500)) as text")
    rows = sharding.shard_documents(df, shards=24)[0].collect()
    load = shares(rows)
    assert len(rows) == 20_000 and len(load) == 24 and max(load.values()) < 1.1 * min(load.values())


def plain_shards(docs, shards):
    """The whole result by a loop: 16 repeats of a row go together, heaviest slots first to the lightest shard."""
    counted, slots = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs), defaultdict(list)
    for (i, size, crc), n in counted.items():
        for salt in range(-(-n // 16)):
            name = ":".join(str(x) for x in (i, crc, size, f"+{salt}" if salt else None) if x is not None)
            slots[int(hashlib.md5(name.encode()).hexdigest()[:8], 16) % 4096] += [(i, crc, size)] * min(16, n - 16 * salt)
    weight = {s: sum(r[2] for r in slots[s]) for s in range(4096)}
    load, of = [0] * shards, {}
    for s in sorted(range(4096), key=lambda s: (-weight[s], s)):
        of[s] = min(range(shards), key=lambda x: (load[x], x))
        load[of[s]] += weight[s]
    out, at = [], [0] * shards
    for s in range(4096):
        for i, crc, size in sorted(slots[s], key=lambda r: (r[0] is not None, r[0] or 0, *r[1:])):
            out.append((i, size, crc, of[s], at[of[s]]))
            at[of[s]] += 1
    return sorted(out, key=str)


def test_sharding_whole_result(spark, small):
    docs = documents(spark, small) + [(None, "a")] * 40 + [(3, None)] * 2 + [(9, "b")] * 100
    got = sharding.shard_documents(spark.createDataFrame(docs, "doc_id long, text string"), shards=5)[0].collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got), key=str) == plain_shards(docs, 5)


def test_slot_map_survives_a_writer_that_dies(spark, tmp_path):
    folder, df = f"file://{tmp_path}/map", spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id long, text string")
    _, first = sharding.shard_documents(df, shards=4, folder=folder)
    for half in ("version=2/_temporary/0", ".half"):  # of a writer by another protocol, and by this one
        (tmp_path / "map" / half).mkdir(parents=True)
    assert sharding.SlotMap.stored(spark, folder) == first
    _, second = sharding.shard_documents(df, shards=5, folder=folder)
    assert second.version == 2 and sharding.SlotMap.stored(spark, folder).version == 2
    with pytest.raises(FileExistsError):
        second.store(spark, folder)
    with pytest.raises(Exception, match="infer schema"):
        (tmp_path / "map2/version=1").mkdir(parents=True)
        (tmp_path / "map2/version=1/_SUCCESS").touch()
        sharding.SlotMap.stored(spark, f"file://{tmp_path}/map2")  # a table that can't be read isn't taken for none


def test_queries_have_the_contract_columns(spark, small):
    for name, columns in {
        "op9_url_filter": ["page_id", "host", "path", "rule", "verdict"],
        "op10_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op6_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        "op4_pieces": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    }.items():
        assert set(columns) <= set(QUERIES[name](spark, small).columns), name


def test_memo_is_bounded():
    """Also where whoever reads takes exactly as many values as there are keys."""
    from weftgraph.llm.common import Memo, stretches

    asked = []
    memo = Memo(lambda keys: [asked.append(k) or len(k) for k in keys], most=50_000)
    for i in range(300):
        keys = ["often", *(f"w{i}-{j}" for j in range(50))]
        assert np.fromiter(memo.of(keys), np.int64, len(keys)).tolist() == list(map(len, keys))
        assert len(memo.young) + len(memo.old) < 2 * (50_000 // 230 + 60)
    assert asked.count("often") == 1
    assert list(stretches("aa bb\ncc dd", 3)) == ["aa", "bb\ncc", "dd"] or " ".join(stretches("aa bb\ncc dd", 3)).split() == ["aa", "bb", "cc", "dd"]
    assert list(stretches(b"x" * 50, 3)) == [b"x" * 50] and list(stretches(None)) == list(stretches("")) == []
