"""Secret scans: three fixed patterns, and a randomness test battery for everything else.

A candidate is a long run of the symbols that keys are written in. Its encoding (the smallest alphabet with all its
symbols) is inferred, and three tests are made: chi-squared uniformity over that alphabet, runs about the
alphabet's middle, and serial correlation of neighbours. A candidate must look random in all three. Then, how
surely it isn't ordinary writing is judged against the symbol frequencies of the corpus itself, and a step-up
procedure within classes of encoding and length keeps the share of false discoveries under a bound.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, in_arrow, values, written

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}", re.ASCII)
HEX = re.compile(r"[0-9a-f]{24,}", re.ASCII)
#: Shortest value of an assignment; shortest candidate of the battery.
VALUE, SHORTEST = 6, 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % SHORTEST, re.ASCII)
_SYMBOLS = re.compile(r"[A-Za-z0-9+/_-]+", re.ASCII)
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets from the smallest, in the order of their symbols' values.
ALPHABETS = (
    ("decimal", _DIGITS), ("hex", _DIGITS + "abcdef"), ("HEX", _DIGITS + "ABCDEF"), ("lower", _LOWER), ("upper", _UPPER), ("base32", _UPPER + "234567"),
    ("base36", _DIGITS + _LOWER), ("BASE36", _DIGITS + _UPPER), ("letters", _UPPER + _LOWER), ("base62", _UPPER + _LOWER + _DIGITS),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/"), ("base64url", _UPPER + _LOWER + _DIGITS + "-_"), ("any", _UPPER + _LOWER + _DIGITS + "+/-_"),
)
_VALUES = np.full((len(ALPHABETS), 128), -1, np.int64)
for _i, (_, _symbols) in enumerate(ALPHABETS):
    for _v, _c in enumerate(_symbols):
        _VALUES[_i, ord(_c)] = _v
#: Lengths at which a new class begins.
LENGTHS = (SHORTEST, 28, 40, 64, 128)
#: A candidate that is random fails the battery this often; the share of false discoveries among those reported.
ALPHA, FALSE_SHARE = 0.001, 0.01
#: Bins of -log10 of the p-value, ten a decade: what the step-up procedure sees, whatever the corpus.
BINS = 400


def _tail(z: float) -> float:
    """P(N(0, 1) > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str) -> tuple[int, float, float]:
    """The inferred encoding, the chi-squared statistic over its alphabet, and the p-value of 'these are random symbols'.

    The p-value is three times the least of the three tests' (Bonferroni), 1 at most.
    """
    codes = np.frombuffer(token.encode(), np.uint8)
    encoding = next(i for i in range(len(ALPHABETS)) if (_VALUES[i][codes] >= 0).all())
    v, n, k = _VALUES[encoding][codes], len(codes), len(ALPHABETS[encoding][1])
    x2 = float((np.bincount(v, minlength=k) ** 2).sum()) * k / n - n
    # Wilson-Hilferty's cube root, with the exact variance of the statistic for small samples
    mean, var = k - 1.0, 2.0 * (k - 1) * (n - 1) / n
    df, scale = 2 * mean * mean / var, var / (2 * mean)
    z = ((max(x2, 0.0) / scale / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    p_uniform = _tail(z)
    high = v >= k / 2
    a, b = int(high.sum()), int(n - high.sum())
    if a and b:
        runs, mu = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * a * b / n
        sd = math.sqrt(max((mu - 1) * (mu - 2) / (n - 1), 1e-9))
        p_runs = 2 * _tail(max(abs(runs - mu) - 0.5, 0) / sd)
    else:
        p_runs = 2.0 ** (1 - n)
    d = v - v.mean()
    total = float((d * d).sum())
    p_serial = 2 * _tail(abs(float((d[1:] * d[:-1]).sum()) / total + 1 / n) * math.sqrt(n)) if total else 0.0
    return encoding, x2, min(1.0, 3 * min(p_uniform, p_runs, p_serial))


def ordinary_p(encoding: int, n: int, x2: float, frequencies: np.ndarray) -> float:
    """P(ordinary writing in this alphabet has so small a chi-squared statistic), from the corpus' symbol frequencies."""
    codes = [ord(c) for c in ALPHABETS[encoding][1]]
    q, k = frequencies[codes] + 1.0, len(codes)
    q = q / q.sum()
    s2, s3 = float((q**2).sum()), float((q**3).sum())
    mean = k - 1 + (n - 1) * (k * s2 - 1)
    var = 2.0 * (k - 1) + 4.0 * n * max(k * k * (s3 - s2 * s2), 0.0)
    return max(_tail((mean - x2) / math.sqrt(var)), 1e-40)


def _length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS) - 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the fixed patterns, in code points, by start and kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= VALUE]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def symbol_frequencies(found: DataFrame) -> np.ndarray:
    """How often each ASCII byte is in the texts of all rows, from ``candidates``. The driver gets 128 sums."""
    out = np.zeros(128, np.int64)
    for r in found.where("symbols is not null").select(F.posexplode("symbols").alias("code", "n")).groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r.code] = r.n
    return out


def _apart(base: list[tuple[int, int, int]], spans: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Those spans that overlap none of ``base``; both in the order of their starts, so that one pass does."""
    at, far = 0, 0  # far: where the base spans that begin before this one end at the latest
    for s, e in spans:
        while at < len(base) and base[at][0] < e:
            far = max(far, base[at][2])
            at += 1
        if far <= s:
            yield s, e


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (spans of the fixed patterns, and how random the battery finds what they hold), found (candidates that overlap none, with their statistics), symbols.

    A last row of each task has symbols: how often each ASCII byte is in its texts. Others have a null there.
    """
    src = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, base array<struct<start:int,kind:int,end:int,p_random:double>>, found array<struct<start:int,end:int,encoding:int,x2:double,p_random:double>>, symbols array<long>"
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("p_random", pa.float64())]))
    found_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.int32()), ("x2", pa.float64()), ("p_random", pa.float64())]))
    names = ["doc_id", "base", "found", "symbols"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kind = np.zeros(256, np.int64), None
        for b in batches:
            bases, founds, kind = [], [], b.column(0).type
            for text in values(b.column(1)):
                text = text or ""
                total += np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
                base = base_spans(text)
                found = []
                for s, e in _apart(base, (m.span() for m in CANDIDATE.finditer(text))):
                    encoding, x2, p = battery(text[s:e])
                    found.append({"start": s, "end": e, "encoding": encoding, "x2": x2, "p_random": p})
                bases.append([{"start": s, "kind": k, "end": e, "p_random": _how_random(text[s:e])} for s, k, e in base])
                founds.append(found)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bases, base_type), pa.array(founds, found_type), pa.nulls(b.num_rows, pa.list_(pa.int64()))], names)
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([[]], base_type), pa.array([[]], found_type), pa.array([total[:128].tolist()], pa.list_(pa.int64()))], names)

    return in_arrow(src, scan, schema)


def _how_random(span: str) -> float | None:
    """The battery's p-value of the last run of key symbols in a span, null where there is none."""
    runs = _SYMBOLS.findall(span)
    return battery(runs[-1])[2] if runs else None


def _bin(p: float) -> int:
    return min(int(-10 * math.log10(p)), BINS - 1)


def thresholds(found: DataFrame, frequencies: np.ndarray) -> dict[tuple[int, int], int]:
    """Step-up over all candidates of the corpus: for each class (encoding, length) the first bin that is reported.

    Benjamini and Hochberg's procedure with every p-value rounded up to its bin's edge, so that it errs on the
    strict side. The driver gets one row for each class and bin, at most 13 x 5 x 400.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int, int], int] = {}
        for b in batches:
            for row in values(b.column(0)):
                for c in row or ():
                    n = c["end"] - c["start"]
                    at = _bin(ordinary_p(c["encoding"], n, c["x2"], frequencies)) if c["p_random"] >= ALPHA else 0
                    key = (c["encoding"], _length_class(n), at)
                    counts[key] = counts.get(key, 0) + 1
        rows = list(counts.items())
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k, _ in rows], pa.int32()) for i in range(3)), pa.array([n for _, n in rows], pa.int64())], ["encoding", "length", "bin", "n"])

    rows = in_arrow(found.select("found"), scan, "encoding int, length int, bin int, n long").groupBy("encoding", "length", "bin").agg(F.sum("n").alias("n")).collect()
    out = {}
    for key in {(r.encoding, r.length) for r in rows}:
        hist = np.zeros(BINS, np.int64)
        for r in rows:
            if (r.encoding, r.length) == key:
                hist[r.bin] = r.n
        at_least, total = np.cumsum(hist[::-1])[::-1], hist.sum()
        edge = 10.0 ** (-np.arange(BINS) / 10)  # every p-value of a bin is this at most
        passed = np.flatnonzero((at_least > 0) & (edge <= FALSE_SHARE * at_least / total))
        if len(passed) and passed[0] > 0:
            out[key] = int(passed[0])
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random, base_p_random of each row.

    The last has the battery's p-value for each base span, in their order. Spans are kind:start:end in code points, by start and then kind, joined by commas. A null text is empty. Whole
    texts are scanned and every row counts for the false-discovery control; repeated rows are found alike, an empty
    table gives no rows, other columns are ignored. Only counts are shuffled.
    """
    found = written(candidates(docs, id_col, text_col), "secret-candidates")
    frequencies = symbol_frequencies(found)
    first = thresholds(found, frequencies)
    schema = f"doc_id {found.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long, base_p_random array<double>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(spans):
            return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)

        for b in batches:
            counts, digests, texts, ps = [], [], [], []
            for base, more in zip(values(b.column(1)), values(b.column(2)), strict=True):
                spans = [(s["start"], s["kind"], s["end"]) for s in base]
                extra = []
                for c in more:
                    n = c["end"] - c["start"]
                    least = first.get((c["encoding"], _length_class(n)))
                    if least is not None and c["p_random"] >= ALPHA and _bin(ordinary_p(c["encoding"], n, c["x2"], frequencies)) >= least:
                        extra.append((c["start"], 3, c["end"]))
                counts.append([*(sum(k == i for _, k, _ in spans) for i in range(3)), len(extra)])
                digests.append(hashlib.sha256(joined(spans).encode()).hexdigest())
                texts.append(joined(sorted(spans + extra)))
                ps.append([s["p_random"] for s in base])
            at = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *at[:3], pa.array(digests, pa.string()), pa.array(texts, pa.string()), at[3], pa.array(ps, pa.list_(pa.float64()))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random", "base_p_random"])

    return in_arrow(found.where("symbols is null").select("doc_id", "base", "found"), scan, schema)
