"""Vectorised words, shingles and hashes over the buffers of an Arrow string array.

A batch of texts is one array of UTF-8 bytes and one of offsets. Words are found by comparing bytes with
the separators, which are ASCII, so that no code point is ever cut. A word's hash is a polynomial in its
bytes modulo 2**64, taken as a difference of prefix sums, then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_M = (1 << 64) - 1


def _spaces() -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return t


def _not_alnum() -> np.ndarray:
    t = np.ones(256, dtype=bool)
    t[0x80:] = False
    for a, b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
        t[a:b] = False
    return t


#: Separator tables: ASCII white space, and any ASCII byte but letters and digits.
SPACES, NOT_ALNUM = _spaces(), _not_alnum()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = np.full(size, base & _M, dtype=np.uint64)
            have[0] = 1
            have = np.multiply.accumulate(have)
        _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, one more than rows) of a string or binary array; null rows are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    o = np.frombuffer(off, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if off is not None and len(texts) else np.zeros(1, np.int64)
    b = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo, hi = int(o[0]), int(o[-1])
    return b[lo:hi], o - lo


class Words:
    """The words of a batch: starts, ends (bytes), hashes, and each row's first word in `first` (rows + 1)."""

    def __init__(self, texts: pa.Array, separators: np.ndarray = SPACES, lower: bool = True, parts: int = 1 << 16):
        data, off = buffers(texts)
        self.rows, self.bytes, self.offsets = len(off) - 1, data, off
        n = len(data)
        word = np.empty(n + 2, dtype=bool)
        word[0] = word[-1] = False
        np.logical_not(separators[data], out=word[1:-1])
        cut = np.zeros(n + 1, dtype=bool)  # a row's start also starts a word
        cut[off] = True
        rising = word[1:] & (~word[:-1] | cut)
        falling = word[:-1] & (~word[1:] | cut)
        self.start = np.flatnonzero(rising[:n])
        self.end = np.flatnonzero(falling)
        self.first = np.searchsorted(self.start, off)
        self.hash = self._hashes(LOWER[data] if lower else data, parts)

    def _hashes(self, data: np.ndarray, parts: int) -> np.ndarray:
        out = np.empty(len(self.start), dtype=np.uint64)
        inverse = pow(_BASE, -1, 1 << 64)
        lo = 0
        while lo < len(self.start):  # in parts, so that the tables stay small
            base = int(self.start[lo])
            hi = max(lo + 1, int(np.searchsorted(self.end, base + parts, side="right")))
            a, b = self.start[lo:hi] - base, self.end[lo:hi] - base
            n = int(b[-1])
            with np.errstate(over="ignore"):
                terms = (data[base : base + n].astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n)
                total = np.empty(n + 1, dtype=np.uint64)
                total[0] = 0
                np.cumsum(terms, out=total[1:])
                out[lo:hi] = (total[b] - total[a]) * _power("down", inverse, n)[a] + (b - a).astype(np.uint64)
            lo = hi
        return mix(out)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))

    def grams(self, offsets: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and rows of the word tuples at these offsets from each word, within the row."""
        span = max(offsets)
        n = len(self.hash) - span
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        row = self.row
        with np.errstate(over="ignore"):
            h = np.full(n, salt & _M, dtype=np.uint64)
            for o in offsets:
                h = h * np.uint64(_BASE) + self.hash[o : o + n]
                h ^= h >> np.uint64(29)
        keep = row[:n] == row[span : span + n]
        return mix(h[keep]), row[:n][keep]

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes of each row, in (row, hash) order, and the rows' starts (rows + 1).

        A row with fewer words has its whole sequence as one shingle; one without words has none.
        """
        h, row = self.grams(tuple(range(width)), width)
        count = np.diff(self.first)
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            extra = np.zeros(len(short), dtype=np.uint64)
            for i, r in enumerate(short):
                x = int(count[r])
                for w in self.hash[self.first[r] : self.first[r + 1]]:
                    x = ((x * _BASE) ^ int(w) ^ (x >> 31)) & _M
                extra[i] = x
            h, row = np.concatenate([h, mix(extra)]), np.concatenate([row, short])
        order = np.argsort(h, kind="stable")
        order = order[np.argsort(row[order], kind="stable")]
        h, row = h[order], row[order]
        if len(h):
            new = np.empty(len(h), dtype=bool)
            new[0] = True
            np.not_equal(h[1:], h[:-1], out=new[1:])
            new[1:] |= row[1:] != row[:-1]
            h, row = h[new], row[new]
        return h, np.searchsorted(row, np.arange(self.rows + 1))
