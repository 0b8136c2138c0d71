"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the piece that they make (ties: leftmost
first) and merges the best until no pair makes a piece. Texts are cut where no piece can reach across; the agendas of
new stretches of one length are worked off side by side, a merge of each in a step, and what a stretch encodes to is
remembered within a bound. The library encodes every stretch that isn't remembered, too, and decodes every row, whose
ids must give its text again; rows that don't (some cannot, by the library's rules) are encoded by it as a whole.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Memo, col, free_names, map_arrow

SPACE = "▁"
#: The place of a pair that makes no piece.
NEVER = 2**31 - 1
#: Most characters of the stretches that are merged side by side; longer ones have an agenda of their own, a heap.
WIDTHS = (6, 9, 12, 16, 24, 48)
#: Bytes of each of the two generations of stretches that a task remembers.
MEMO = 28 << 20
#: Rows and characters whose decodings are checked against the library in one call, but for one longer text.
CHECKED, CHECKED_CHARS = 512, 1 << 20


class Pieces:
    """A merge-type vocabulary with byte fallback, read from a model's bytes.

    Supports the identity normaliser with a dummy prefix and kept white space; others raise ValueError.
    """

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto.FromString(model)
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if train.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or train.treat_whitespace_as_suffix or not train.byte_fallback:
            raise ValueError("only merge-type models with byte fallback and an identity normaliser are supported")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids: dict[str, int] = {}
        self.cost: dict[str, float] = {}
        self.byte_ids = [0] * 256
        self.surface: list[str | bytes] = []
        for i, p in enumerate(proto.pieces):
            if p.type == p.NORMAL:
                self.ids[p.piece], self.cost[p.piece] = i, -p.score
                self.surface.append(p.piece.replace(SPACE, " "))
            elif p.type == p.BYTE:
                value = int(p.piece[3:-1], 16)
                self.byte_ids[value] = i
                self.surface.append(bytes([value]))
            elif p.type == p.CONTROL:
                self.surface.append("")
            elif p.type == p.UNKNOWN:
                self.surface.append(train.unk_surface)
            else:
                raise ValueError(f"pieces of type {p.type} are not supported")
        self.end = self.library.eos_id()
        #: without pieces that hold a space mark after another symbol, nothing merges across the begin of a word
        across = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.cut = re.compile(".+" if across else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", re.DOTALL)
        self.as_text = [str(i) for i in range(len(self.surface))]
        self.byte_set = frozenset(self.byte_ids)
        self._tabulate()
        self.forget()

    def _tabulate(self) -> None:
        """Symbols (pieces, and characters of pieces) as numbers; for each pair of them that makes a piece, that piece's place by cost."""
        symbols = sorted({*self.cost, *(c for p in self.cost for c in p)})
        number = {s: i for i, s in enumerate(symbols)}
        made = sorted((p for p in self.cost if len(p) > 1), key=self.cost.__getitem__)
        place = {c: i for i, c in enumerate(dict.fromkeys(map(self.cost.__getitem__, made)))}
        chars = [s for s in symbols if len(s) == 1]
        self.codes, self.code_symbols = np.array([ord(c) for c in chars], np.int64), np.array([number[c] for c in chars], np.int64)
        self.none = len(symbols)  # any other character
        self.odd = re.compile(f"([^{re.escape(''.join(chars))}])", re.DOTALL) if chars else re.compile("(.)", re.DOTALL)
        pairs = [(number[p[:k]] * (self.none + 1) + number[p[k:]], place[cost]) for p, cost in self.cost.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
        self.pair_keys, self.pair_places = np.append(table[0], 2**62), np.append(table[1], NEVER).astype(np.int32)
        # the piece of each place; where several pieces have one cost, the place doesn't tell
        of = {place[self.cost[p]]: number[p] for p in made}
        self.place_symbols = np.array([of[i] for i in range(len(place))], np.int32)
        self.tied = np.bincount([place[self.cost[p]] for p in made], minlength=1) > 1
        self.symbol_ids = [*(self._ids([s]) for s in symbols), ()]

    def forget(self) -> None:
        self.memo = Memo(self._checked, MEMO)

    def _checked(self, stretches: list[str]) -> list[tuple[int, ...]]:
        """The ids of each stretch; ValueError if the library encodes one otherwise.

        The mark that a stretch begins with is the library's dummy prefix; a mark alone would be an empty text there.
        """
        made = self.merged(stretches)
        wanted = self.library.encode([s[1:].replace(SPACE, " ") for s in stretches], num_threads=1)
        if list(map(tuple, wanted)) != made:
            for s, ids, want in zip(stretches, made, wanted, strict=True):
                if s != SPACE and ids != tuple(want):
                    raise ValueError("the library encodes this otherwise: " + repr(s[:200]))
        return made

    def merged(self, stretches: list[str]) -> list[tuple[int, ...]]:
        """The ids of each stretch, by the agenda."""
        out: list[tuple[int, ...]] = [()] * len(stretches)
        lengths = np.fromiter(map(len, stretches), np.int64, len(stretches))
        widths = np.searchsorted(WIDTHS, lengths)
        for k, width in enumerate(WIDTHS):
            who = np.flatnonzero(widths == k)
            if len(who):
                self._side_by_side(stretches, who, lengths[who], width, out)
        for i in np.flatnonzero(widths == len(WIDTHS)).tolist():
            out[i] = self._ids(self._heaped(stretches[i]))
        return out

    def _places(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The places of the pieces that pairs make; ``NEVER`` for those that make none."""
        key = left.astype(np.int64) * (self.none + 1) + right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_places[at], np.int32(NEVER))

    def _side_by_side(self, stretches: list[str], rows: np.ndarray, lengths: np.ndarray, width: int, out: list[tuple[int, ...]]) -> None:
        """Merge stretches of such a width at most, a row each; of a row's least entries the leftmost goes. A row without any is done."""
        codes = np.frombuffer("".join([stretches[i] for i in rows.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.searchsorted(self.codes, codes)
        at[at == len(self.codes)] = 0
        known = self.codes[at] == codes if len(self.codes) else np.zeros(len(codes), bool)
        row = np.repeat(np.arange(len(rows)), lengths)
        symbols = np.full((len(rows), width), self.none, np.int32)
        symbols[row, np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.where(known, self.code_symbols[at] if len(self.codes) else 0, self.none)
        whole = np.bincount(row[~known], minlength=len(rows)) == 0
        if not whole.all():
            self._around_odd(stretches, rows[~whole].tolist(), out)
            rows, symbols = rows[whole], symbols[whole]
        agenda = self._places(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            if width > 1:
                best = agenda.argmin(axis=1)
                least = agenda[np.arange(len(rows)), best]
            else:
                best, least = np.zeros(len(rows), np.int64), np.full(len(rows), NEVER)
            going = least < NEVER
            hard = going.copy()
            hard[going] = self.tied[least[going]]
            going &= ~hard
            if not going.all():
                for i, s in zip(rows[~going].tolist(), symbols[~going].tolist(), strict=True):
                    out[i] = tuple([x for y in s for x in self.symbol_ids[y]])
                for i in rows[hard].tolist():
                    out[i] = self._ids(self._heaped(stretches[i]))
                rows, symbols, agenda, best, least = rows[going], symbols[going], agenda[going], best[going], least[going]
                if not len(rows):
                    break
            each, width = np.arange(len(rows)), width - 1
            keep = np.ones(symbols.shape, bool)
            keep[each, best + 1] = False
            symbols[each, best] = self.place_symbols[least]
            symbols = symbols[keep].reshape(len(rows), width)
            gone = np.ones(agenda.shape, bool)
            gone[each, best] = False
            agenda = agenda[gone].reshape(len(rows), width - 1)
            after, before = best < width - 1, best > 0
            agenda[each[after], best[after]] = self._places(symbols[each[after], best[after]], symbols[each[after], best[after] + 1])
            agenda[each[before], best[before] - 1] = self._places(symbols[each[before], best[before] - 1], symbols[each[before], best[before]])

    def _around_odd(self, stretches: list[str], rows: list[int], out: list[tuple[int, ...]]) -> None:
        """Stretches with characters of no piece: those never merge, so that what lies between them merges by itself."""
        parts = [self.odd.split(stretches[i]) for i in rows]
        between = dict.fromkeys(x for p in parts for x in p[::2] if x)
        found = dict(zip(between, self.merged(list(between)), strict=True))
        for i, p in zip(rows, parts, strict=True):
            out[i] = tuple(chain.from_iterable(found.get(x, ()) if k % 2 == 0 else self._ids([x]) for k, x in enumerate(p)))

    def _heaped(self, stretch: str) -> list[str]:
        """The symbols that no pair of merges any further; entries of pairs that are gone stay in the heap and are passed over."""
        n, cost = len(stretch), self.cost
        symbols: list[str] = list(stretch)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(cost[p], i, p) for i in range(n - 1) if (p := stretch[i : i + 2]) in cost]
        heapify(agenda)
        while agenda:
            _, i, piece = heappop(agenda)
            j = after[i]
            if j >= n or not symbols[i] or len(symbols[i]) + len(symbols[j]) != len(piece):
                continue  # one of the pair has been merged meanwhile
            symbols[i], symbols[j] = piece, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (p := piece + symbols[k]) in cost:
                    heappush(agenda, (cost[p], i, p))
            h = before[i]
            if h >= 0 and (p := symbols[h] + piece) in cost:
                heappush(agenda, (cost[p], h, p))
        return [s for s in symbols if s]

    def _ids(self, symbols: list[str]) -> tuple[int, ...]:
        out: list[int] = []
        for s in symbols:
            known = self.ids.get(s)
            if known is not None:
                out.append(known)
            else:
                out += [self.byte_ids[b] for b in s.encode()]
        return tuple(out)

    def encode(self, texts: list[str], end: bool = True) -> list[list[int]]:
        """The ids of each text."""
        cuts = [self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else [] for text in texts]
        found = self.memo.of(list(chain.from_iterable(cuts)))
        last = [self.end] if end else []
        return [[*chain.from_iterable(islice(found, len(cut))), *last] for cut in cuts]

    def decode(self, ids: list[int]) -> str:
        """As the library's decode: bytes of a run are read as UTF-8, each invalid one becomes U+FFFD; the dummy prefix goes."""
        surface = self.surface
        if self.byte_set.isdisjoint(ids):
            text = "".join(map(surface.__getitem__, ids))
        else:
            parts: list[str] = []
            run = bytearray()
            for i in ids:
                s = surface[i]
                if isinstance(s, bytes):
                    run += s
                else:
                    if run:
                        parts.append(_utf8(run))
                        run = bytearray()
                    parts.append(s)
            if run:
                parts.append(_utf8(run))
            text = "".join(parts)
        # the first piece with a surface loses its leading space, if it is no byte and no other sign stands before it
        for i in ids:
            s = surface[i]
            if s:
                return text[1:] if isinstance(s, str) and s[0] == " " and i in self.starts else text
        return text

    def check(self, texts: list[str], encoded: list[list[int]], decodings: list[str], end: bool = True) -> None:
        """ValueError if the library encodes or decodes any of the texts otherwise; ids of stretches have been compared before.

        Ids that decode to the text, stretch by stretch the library's, are the library's.
        """
        if decodings != self.library.decode(encoded, num_threads=1):
            odd = range(len(texts))
        else:
            odd = [i for i, (text, decoded) in enumerate(zip(texts, decodings, strict=True)) if text != decoded]
        for i in odd:
            if encoded[i] != self.library.encode(texts[i], add_eos=end) or decodings[i] != self.library.decode(encoded[i]):
                raise ValueError("the library encodes or decodes this text otherwise: " + repr(texts[i][:200]))

    @property
    def starts(self) -> frozenset[int]:
        found = self.__dict__.get("_starts")
        if found is None:
            found = self._starts = frozenset(i for p, i in self.ids.items() if p.startswith(SPACE))
        return found


@lru_cache(maxsize=1)
def _read(kind: type[Pieces], model: bytes) -> Pieces:
    """The vocabulary of a model; a worker's next task of the same model takes it as it is, with nothing remembered."""
    return kind(model)


def _utf8(run: bytearray) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for width in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + width].decode())
                    at += width
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def _grouped(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column, nulls as empty ones, a few at a time."""
    held, size = [], 0
    for text in column:
        held.append(text.as_py() or "")
        size += len(held[-1])
        if len(held) == CHECKED or size >= CHECKED_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


#: What ``encode_decode`` can return.
OUTPUTS = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded": T.StringType(), "decoded_sha256": T.StringType()}


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids_sha256", "decoded_sha256"), keep: list[str] | None = None, end: bool = True) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with what its texts encode to and what that decodes to.

    A null text is empty and encodes to the end id alone. Whole texts are encoded, each row by itself: repeated
    rows, null ids and empty tables need no care, nothing is shuffled. Names that ``docs`` has already get an
    underscore before them. The model is read on the driver and shipped. A stretch, or what a row decodes to, that differs
    from the library raises.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = docs.columns if keep is None else keep
    names = free_names(kept, *outputs)
    (text_name,) = free_names([*kept, *names], "text_in")
    src = docs.select(*map(col, kept), col(text_col).alias(text_name))
    schema = src.drop(text_name).schema
    for name, what in zip(names, outputs, strict=True):
        schema = schema.add(name, OUTPUTS[what])
    kinds = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded": pa.string(), "decoded_sha256": pa.string()}

    of = {
        "ids": lambda pieces, ids, decoded: ids,
        "n_tokens": lambda pieces, ids, decoded: len(ids),
        "ids_sha256": lambda pieces, ids, decoded: hashlib.sha256(" ".join([pieces.as_text[i] for i in ids]).encode()).hexdigest(),
        "decoded": lambda pieces, ids, decoded: decoded,
        "decoded_sha256": lambda pieces, ids, decoded: hashlib.sha256(decoded.encode()).hexdigest(),
    }

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _read(Pieces, model.value)
        pieces.forget()
        gc.disable()  # nothing here makes cycles, and a collection walks all that is remembered
        try:
            for b in batches:
                made: dict[str, list[pa.Array]] = {o: [] for o in outputs}
                for texts in _grouped(b.column(b.num_columns - 1)):
                    once = list(dict.fromkeys(texts))
                    encoded = pieces.encode(once, end)
                    decodings = [pieces.decode(ids) for ids in encoded]
                    pieces.check(once, encoded, decodings, end)
                    place = {text: i for i, text in enumerate(once)}
                    at = pa.array([place[text] for text in texts], pa.int32())
                    for o in outputs:
                        made[o].append(pa.array([of[o](pieces, ids, decoded) for ids, decoded in zip(encoded, decodings, strict=True)], kinds[o]).take(at))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.concat_arrays(made[o]) if made[o] else pa.array([], kinds[o]) for o in outputs)], [*b.schema.names[:-1], *names])
        finally:  # the worker is used again, whatever ends this task
            pieces.forget()
            gc.enable()

    return map_arrow(src, scan, schema)
