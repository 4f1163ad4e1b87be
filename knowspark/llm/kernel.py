"""Vectorised text primitives in numpy for code inside Spark tasks.

Texts of a slice lie in one byte array; words and their hashes come from whole-
array operations, so the cost is a few nanoseconds a byte and no Python object
is made for a word.  Slices are bounded by ``SLICE_BYTES``; a text longer than
that is a slice of its own.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
#: odd bases of the polynomial hashes
BASE, SECOND_BASE = 0x9E3779B97F4A7C55, 0xD1B54A32D192ED03
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: A-Z lower-cased, all other bytes as they are
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: space and \t \n \v \f \r
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset: column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]: off[-1]], off - off[0]


def slices(buf: np.ndarray, off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of whole texts of about ``most`` bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, buf[off[i]: off[j]], off[i: j + 1] - off[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finish of 64-bit hashes (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=3)
def _powers(bits: int, base: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they lie.

    Sums of ``byte * base**position`` over a prefix array; the span's start is
    taken out by a shift to the common exponent, so one pass serves all spans.
    """

    def __init__(self, buf: np.ndarray, base: int = BASE):
        n = self.n = len(buf)
        self.base = base
        self.power = _powers(max(12, int(n + 1).bit_length()), base)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.begun(starts)(ends)

    def begun(self, starts: np.ndarray):
        """The hashes of spans with these starts as a function of their ends."""
        before, scale = self.total[starts], self.power[self.n - starts] * _shift(self.n, self.base)

        def ended(ends: np.ndarray) -> np.ndarray:
            h = self.total[ends]
            h -= before
            h *= scale
            h += (ends - starts).astype(np.uint64) * _M2
            return mix(h)
        return ended


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Hasher(buf)(starts, ends)


@lru_cache(maxsize=4096)
def _shift(n: int, base: int) -> np.uint64:
    """base ** (2**40 - n): brings the hashes of slices of different length to one exponent."""
    return np.uint64(pow(base, (1 << 40) - n, 1 << 64))


def ascii_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space), and the words' offsets by text (n + 1)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~SPACE[buf]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:n]
    last[:-1] &= ~solid[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


#: classes of code points
SPACE_CP, LETTER, NUMBER, OTHER = 0, 1, 2, 3


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point as the tokenizers library sees it.

    ``unicodedata`` gives the classes; code points that are unassigned there
    but letters or numbers to a newer Unicode version are put to the library.
    """
    import regex
    from tokenizers import pre_tokenizers

    top = sys.maxunicode + 1
    out = np.full(top, OTHER, np.uint8)
    free = np.zeros(top, bool)
    kinds = {"L": LETTER, "N": NUMBER}
    for c in range(top):
        k = unicodedata.category(chr(c))
        free[c] = k == "Cn"
        if k[0] in kinds:
            out[c] = kinds[k[0]]
    for lo, hi in ((9, 13), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
                   (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[lo:hi + 1] = SPACE_CP
    every = "".join(chr(c) if free[c] else " " for c in range(top))
    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    for beside, kind, pattern in (("a", LETTER, r"\p{L}"), ("1", NUMBER, r"\p{N}")):
        new = [m.start() for m in regex.finditer(pattern, every)]
        said = split.pre_tokenize_str("".join(f"\n{beside}{chr(c)}{beside}" for c in new))
        spans = {at for _, at in said}
        for i, c in enumerate(new):
            if (4 * i + 1, 4 * i + 4) in spans:
                out[c] = kind
    return out


def word_starts(cp: np.ndarray, cut: np.ndarray, spaced: bool) -> np.ndarray:
    """Flags of the code points at which a pre-token begins.

    ``cut`` (n + 1 flags) marks where a text begins.  ``spaced``: white space is
    kept and one space joins the word after it; numbers are runs.  Otherwise
    white space is dropped and each number stands alone.  Both split the
    endings 's 't 're 've 'm 'll 'd off.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, bool)
    kind = classes()[cp]
    space = kind == SPACE_CP
    new = cut[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    if spaced:
        ends = np.zeros(n, bool)  # last of a run of spaces before a word of the same text
        ends[:-1] = space[:-1] & ~space[1:] & ~cut[1:n]
        new |= ends
        joined = ends & (cp == 32)
        new[1:] &= ~joined[:-1]
    else:
        new |= kind == NUMBER
        new &= ~space
    at = np.flatnonzero(new & (cp == 39))
    if len(at):
        more = np.concatenate([cp, np.zeros(2, cp.dtype)])
        stop = np.concatenate([cut, np.ones(2, bool)])
        a, b = more[at + 1], more[at + 2]
        one = np.isin(a, np.array([115, 116, 109, 100], cp.dtype)) & ~stop[at + 1]
        two = (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)) & ~stop[at + 1] & ~stop[at + 2]
        for which, size in ((one, 2), (two, 3)):
            i = at[which]
            new[i + 1] = False
            j = i + size
            j = j[j < n]
            new[j] |= True if spaced else ~space[j]
    return new


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 and the byte position at which each begins."""
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    if len(lead) == len(buf):
        return buf.astype(np.uint32), lead
    b = buf[lead].astype(np.uint32)
    cp = b.copy()
    wide = np.flatnonzero(b >= 0xC0)
    at = lead[wide]
    b = b[wide]
    tail = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.uint32) & 0x3F
    two = ((b & 0x1F) << 6) | tail[at + 1]
    three = ((b & 0x0F) << 12) | (tail[at + 1] << 6) | tail[at + 2]
    four = ((b & 0x07) << 18) | (tail[at + 1] << 12) | (tail[at + 2] << 6) | tail[at + 3]
    cp[wide] = np.where(b < 0xE0, two, np.where(b < 0xF0, three, four))
    return cp, lead
