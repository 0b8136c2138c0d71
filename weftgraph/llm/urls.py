"""URL filters: host and path rules first, and a bit-parallel wildcard automaton for every URL that no rule decides.

All glob patterns are packed side by side into the bits of several 64-bit words (Shift-And). One step over one
character moves every pattern at once; a batch of URLs moves together, so that a step costs a few array operations.
Many patterns are several automata of a bounded width each, which the URLs pass one after the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, in_arrow, values, written

#: (verdict, host and path): the production rules.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Canonical URLs that one of these matches as a whole are blocked where no rule decides. ``*``: any run, ``?``: any byte.
GLOBS = (
    "*://spam-*", "*://*.spam-*", "*://cheap-*", "*://*.cheap-*", "*casino*", "*viagra*", "*pills*", "*://*-farm.*",
    "*/wp-login.php*", "*/cgi-bin/*", "*?sessionid=*", "*.exe", "*.zip", "*://*xxx*", "*/tracker/*", "*://ads.*", "*://*.ads.*",
)
#: State bits of one automaton, but for one longer pattern; URLs that move together.
BITS, TOGETHER = 2048, 2048
#: Bytes of the patterns that tasks hold at a time, about; automata take 32 times as many. More patterns go in groups,
#: each over all URLs that none has matched yet, with what was found so far written in between.
GROUP_BYTES = 4 << 20
#: Ports that a scheme has anyway.
PORTS = {"http": ":80", "https": ":443", "ftp": ":21", "ws": ":80", "wss": ":443"}
_ESCAPE = re.compile("%[0-9A-Fa-f]{2}")
_PLAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _unescaped(text: str) -> str:
    """Escapes of characters that need none as those characters, others with upper-case digits."""
    return _ESCAPE.sub(lambda m: c if (c := chr(int(m[0][1:], 16))) in _PLAIN else m[0].upper(), text)


def _without_dots(path: str) -> str:
    """The path without ``.`` and ``..`` segments; those that lead above the root go."""
    if "/." not in path:
        return path
    out: list[str] = []
    segments = path.split("/")[1:]
    for s in segments:
        if s == "..":
            del out[-1:]
        elif s != ".":
            out.append(s)
    return "/" + "/".join(out) + ("/" if segments[-1] in (".", "..") and out else "")


def parts(url: str | None) -> tuple[str, str, str]:
    """Host with A-Z in lower case, path, and the canonical URL.

    That has scheme and host in lower case, no port that the scheme has anyway, no final dot of the host, no needless
    escapes, no dot segments, no fragment and no empty query. A null URL, and one without ``://``, has an empty host,
    path and canonical URL.
    """
    scheme, mark, rest = (url or "").partition("://")
    if not mark:
        return "", "", ""
    rest, _, _ = rest.partition("#")
    before, ask, query = rest.partition("?")
    host, slash, path = before.partition("/")
    host, path, scheme = host.translate(_LOWER), slash + path, scheme.translate(_LOWER)
    plain = host.removesuffix(PORTS.get(scheme, "-")).removesuffix(":").removesuffix(".")
    return host, path, f"{scheme}://{plain}{_without_dots(_unescaped(path)) or '/'}" + (ask + _unescaped(query) if query else "")


@dataclass(frozen=True)
class PathRules:
    """Rules by host; a rule holds for its host and all subdomains where the path starts with the rule's path."""

    by_host: dict[str, tuple[tuple[str, str, str], ...]]

    @classmethod
    def of(cls, rules: Iterable[tuple[str, str]]) -> PathRules:
        by_host: dict[str, tuple[tuple[str, str, str], ...]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            by_host[host] = (*by_host.get(host, ()), (slash + path, rule, verdict))
        return cls(by_host)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest fitting rule and its verdict (of equally long ones, the one with the longer host)."""
        best, tail = None, host
        while tail:
            for start, rule, verdict in self.by_host.get(tail, ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
            _, _, tail = tail.partition(".")
        return best


@dataclass(frozen=True)
class Globs:
    """The automaton: state bit i of a pattern says that its first i symbols are matched."""

    step: np.ndarray  # 256 x words: bits that a byte may move into
    stay: np.ndarray  # words: bits before a star, which any byte keeps
    start: np.ndarray
    accept: np.ndarray

    @classmethod
    def of(cls, patterns: Iterable[str]) -> Globs:
        symbols: list[tuple[int | None, bool, bool, bool]] = []  # byte (None: any), start, accept, stays
        for pattern in patterns:
            first = len(symbols)
            symbols.append((-1, True, False, False))
            for c in pattern.encode():
                if c == 42:
                    b, s, a, _ = symbols[-1]
                    symbols[-1] = (b, s, a, True)
                else:
                    symbols.append((None if c == 63 else c, False, False, False))
            b, s, _, k = symbols[-1]
            symbols[-1] = (b, len(symbols) - 1 == first, True, k)
        words = max(1, -(-len(symbols) // 64))
        step, one = np.zeros((256, words), np.uint64), np.zeros((3, words), np.uint64)
        for i, (byte, *flags) in enumerate(symbols):
            word, bit = i // 64, np.uint64(1 << (i % 64))
            if byte is None:
                step[:, word] |= bit
            elif byte >= 0:
                step[byte, word] |= bit
            for row, flag in enumerate(flags):
                if flag:
                    one[row, word] |= bit
        return cls(step, one[2], one[0], one[1])

    @classmethod
    def several(cls, patterns: Iterable[str]) -> list[Globs]:
        """Automata of ``BITS`` bits at most that share the patterns out."""
        out, held, bits = [], [], 0
        for p in patterns:
            need = len(p.encode()) + 1
            if held and bits + need > BITS:
                out.append(cls.of(held))
                held, bits = [], 0
            held.append(p)
            bits += need
        return out + [cls.of(held)] if held else out

    def matches(self, urls: list[bytes]) -> np.ndarray:
        """For each URL, whether any pattern matches the whole of it."""
        lengths = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-lengths, kind="stable")
        state = np.tile(self.start, (len(urls), 1))
        if len(urls) and lengths.max():
            # URLs lie end to end; a long one costs its own length only
            flat, at = np.frombuffer(b"".join(urls[i] for i in order), np.uint8), np.cumsum(lengths[order]) - lengths[order]
            active = np.searchsorted(-lengths[order], -np.arange(lengths.max()), side="left")
            for k, n in enumerate(active):
                d = state[:n]
                moved = d << np.uint64(1)
                moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
                state[:n] = (moved & self.step[flat[at[:n] + k]]) | (d & self.stay)
        out = np.zeros(len(urls), bool)
        out[order] = (state & self.accept).any(axis=1)
        return out


def any_matches(automata: list[Globs], urls: list[bytes]) -> np.ndarray:
    """For each URL, whether a pattern of any automaton matches the whole of it; those with a match pass no more."""
    out = np.zeros(len(urls), bool)
    for at in range(0, len(urls), TOGETHER):
        left = np.arange(at, min(at + TOGETHER, len(urls)))
        for a in automata:
            out[left] = a.matches([urls[i] for i in left])
            left = left[~out[left]]
    return out


def read_globs(spark: SparkSession, path: str) -> Iterator[str]:
    """The patterns of text files, one a line, sorted, some partitions at a time; blank lines and those that begin with # are none."""
    lines = spark.read.text(path).select(F.trim("value").alias("p")).where("p <> '' and not startswith(p, '#')").distinct()
    return (r.p for r in lines.orderBy("p").toLocalIterator())


def _groups(globs: Iterable[str], most: int) -> Iterator[list[str]]:
    """Patterns of about ``most`` bytes each; one group at least."""
    held, size, any_yet = [], 0, False
    for g in globs:
        held.append(g)
        size += len(g.encode()) + 1
        if size >= most:
            yield held
            held, size, any_yet = [], 0, True
    if held or not any_yet:
        yield held


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, globs: Iterable[str] = GLOBS, id_col: str = "page_id", url_col: str = "url", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict, glob (whether a glob matches) of each row.

    The longest fitting rule decides; else a matching glob blocks, and what none matches is allowed. Null and
    malformed URLs have an empty host and path and are allowed. Every row is judged by itself: repeated rows, null
    ids, empty tables and other columns need no care; nothing is shuffled. ``globs`` may be what ``read_globs`` gives,
    of any size: patterns of more than ``group_bytes`` take several passes over the URLs.
    """
    table, spark = PathRules.of(rules), pages.sparkSession
    rows = pages.select(col(id_col).alias("page_id"), col(url_col).alias("url"), F.lit(False).alias("glob"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def matched(automata):
        """Rows with what these patterns match as well."""

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hit = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
                left = np.flatnonzero(~hit)
                urls = b.column(1).take(pa.array(left))
                hit[left] = any_matches(automata.value, [parts(u)[2].encode("utf-8", "surrogatepass") for u in values(urls)])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hit)], ["page_id", "url", "glob"])

        return scan

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [parts(u) for u in values(b.column(1))]
            found, hit = [table.find(h, p) for h, p, _ in split], b.column(2).to_pylist()
            cols = [
                b.column(0),
                pa.array([h for h, _, _ in split], pa.string()),
                pa.array([p for _, p, _ in split], pa.string()),
                pa.array([r and r[0] for r in found], pa.string()),
                pa.array([r[1] if r else ("block" if g else "allow") for r, g in zip(found, hit, strict=True)], pa.string()),
                b.column(2),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "host", "path", "rule", "verdict", "glob"])

    def both(scan):
        return lambda batches: judged(scan(batches))

    last = None
    for number, group in enumerate(_groups(globs, group_bytes)):
        if last is not None:  # not the last group, as there is another
            rows = written(in_arrow(rows, last, f"page_id {kind}, url string, glob boolean"), f"url-globs-{number}")
        last = matched(spark.sparkContext.broadcast(Globs.several(group)))
    return in_arrow(rows, both(last), f"page_id {kind}, host string, path string, rule string, verdict string, glob boolean")


def allowed_pages(pages: DataFrame, url_col: str = "url", **how) -> DataFrame:
    """The rows of ``pages`` whose URL is allowed, with all their columns; null URLs are, repeated rows stay as many."""
    from .common import free_names

    (key,) = free_names(pages.columns, "url_key")
    urls = pages.select(col(url_col).alias("url")).distinct().withColumn("page_id", F.col("url"))
    blocked = judge_urls(urls, **how).where("verdict = 'block'").select(F.col("page_id").alias(key))
    return pages.join(blocked, col(url_col) == F.col(key), "left_anti")
