"""MD5 of many short messages at once: the beginnings of ``draw_key``, in numpy."""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: Digests that are worked on at the same time: their words stay in the processor's cache.
WIDE = 1 << 15
#: Bytes of a message, at most, that MD5 takes in one block; longer ones go to the library one by one.
SHORT = 55
_K = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURN = [n for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for n in four * 4]
_WORD = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


class Tails:
    """Ends of messages: ``data`` has their bytes in a row, ``ends`` where each ends."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        self.sizes = (ends - starts).astype(np.int64)
        self.longest = int(self.sizes.max(initial=0))
        self.data, self.starts = data, starts
        self._laid: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.sizes)

    @classmethod
    def of(cls, texts) -> Tails:
        """Of an Arrow array of strings."""
        import pyarrow as pa

        texts = texts.cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        return cls(data[ends[0] : ends[-1]], ends[1:] - ends[0])

    @classmethod
    def numbers(cls, first: int, last: int) -> Tails:
        """The decimal numbers from ``first`` to ``last``, without sign."""
        n = np.arange(first, last + 1, dtype=np.int64)
        width = len(str(last))
        digits = np.empty((len(n), width), np.uint8)
        rest = n
        for i in range(width - 1, -1, -1):
            rest, digits[:, i] = np.divmod(rest, 10)
        digits += 48
        sizes = sum((n >= 10**i).astype(np.int64) for i in range(1, width)) + 1 if width > 1 else np.ones(len(n), np.int64)
        return cls(digits[np.arange(width) >= (width - sizes)[:, None]], np.cumsum(sizes))

    def laid(self, at: int) -> np.ndarray:
        """MD5's 16 words of each tail that begins at byte ``at`` of its block, with marks and lengths: (16, n)."""
        if at not in self._laid:
            block = np.zeros((len(self), 64), np.uint8)
            place = np.arange(self.longest) < self.sizes[:, None]
            block[:, at : at + self.longest][place] = self.data
            block[np.arange(len(self)), at + self.sizes] = 0x80
            words = np.ascontiguousarray(block.view("<u4").T).astype(np.uint32, copy=False)
            words[14] = 8 * (at + self.sizes)
            self._laid = {at: words}
        return self._laid[at]


def heads(prefixes: list[bytes], tails: Tails, both: bool = False) -> np.ndarray:
    """The first 32 bits (with ``both``, 64) of MD5 of every prefix, which are equally long, followed by every tail.

    An array (prefixes, tails) of uint32 or uint64, in the order of the digests' hexadecimal digits.
    """
    size = len(prefixes[0])
    if size + tails.longest > SHORT:
        take, texts = 8 if both else 4, [tails.data[s : s + n].tobytes() for s, n in zip(tails.starts, tails.sizes, strict=True)]
        flat = b"".join(hashlib.md5(p + t).digest()[:take] for p in prefixes for t in texts)
        return np.frombuffer(flat, ">u8" if both else ">u4").astype(np.uint64 if both else np.uint32).reshape(len(prefixes), len(texts))
    shape = (len(prefixes), len(tails))
    own = tails.laid(size)
    ahead = np.frombuffer(b"".join(p.ljust(64, b"\0") for p in prefixes), "<u4").reshape(-1, 16).T.astype(np.uint32)[:, :, None]
    # what a word is added up from: the prefixes' part, the tails', or nothing
    parts = [([ahead[w]] if 4 * w < size else []) + ([own[w : w + 1]] if own[w].any() else []) for w in range(16)]
    a, b, c, d = (np.full(shape, x) for x in _START)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64 if both else 61):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        k, held = np.uint32(_K[i]), parts[_WORD[i]]
        f += held[0] + k if held else k
        for more in held[1:]:
            f += more
        np.left_shift(f, np.uint32(_TURN[i]), out=t)
        f >>= np.uint32(32 - _TURN[i])
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
        if i == 60:
            first = b + _START[0]
    if not both:
        return first.byteswap()
    return (first.byteswap().astype(np.uint64) << np.uint64(32)) | (b + _START[1]).byteswap()
