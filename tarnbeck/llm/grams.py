"""Words, windows and rolling hashes of many texts at once, in NumPy over their UTF-8 bytes.

Hashes are polynomials over random 64-bit values of the bytes, taken from prefix sums and then mixed. They only
pick candidates or stand for items inside one set; where bytes have to be equal, a 128-bit digest decides.
"""

from __future__ import annotations

import numpy as np

_M = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

_rng = np.random.default_rng(20240607)
VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: The same with A-Z as a-z.
FOLDED = VALUES.copy()
FOLDED[65:91] = VALUES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

#: Bytes whose words are hashed at a time: what that takes beside the hashes is some 50 times as much.
PIECE_BYTES = 500_000

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, b in ((0, _BASE), (1, _INVERSE)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix(buf: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    """Sums so that span_hash gives the hash of any span."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(values[buf] * powers(len(buf))[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a run of texts: byte start and end of each, and per text its words' range."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs = buf, offs
        n = len(buf)
        self.inside = ~SPACE[buf]
        before = np.zeros(n + 1, bool)
        before[1:] = self.inside
        cut = np.zeros(n + 1, bool)
        cut[offs] = True
        self.start = np.flatnonzero(self.inside & (~before[:-1] | cut[:-1]))
        del before
        after = np.zeros(n + 1, bool)
        after[:-1] = self.inside
        self.end = np.flatnonzero(self.inside & (~after[1:] | cut[1:])) + 1
        self.range = np.searchsorted(self.start, offs)
        self.count = np.diff(self.range)

    def hashes(self, fold: bool = True) -> np.ndarray:
        """A word's hash tells nothing of its place, so words are hashed by pieces of PIECE_BYTES, or one word."""
        out, i = np.empty(len(self.start), np.uint64), 0
        while i < len(out):
            low = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, low + PIECE_BYTES, "right")))
            out[i:j] = span_hash(prefix(self.buf[low : self.end[j - 1]], FOLDED if fold else VALUES), self.start[i:j] - low, self.end[i:j] - low)
            i = j
        return out


def shingles(words: Words, k: int, fold: bool = True, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows and per text their range; with `short`, a text of 1 to k-1 words is one window."""
    h = words.hashes(fold)
    n = len(h)
    first, last = words.range[:-1], words.range[1:]
    per = np.maximum(words.count - k + 1, 0)
    if short:
        per = np.where((words.count > 0) & (words.count < k), 1, per)
    bounds = np.concatenate([[0], np.cumsum(per)])
    total = int(bounds[-1])
    doc = np.repeat(np.arange(len(per)), per)
    at = first[doc] + (np.arange(total) - bounds[doc])
    out = np.zeros(total, np.uint64)
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    for j in range(k):
        out += np.where(at + j < last[doc], padded[np.minimum(at + j, n)] * _STEP[j], np.uint64(0))
    out += np.minimum(words.count, k)[doc].astype(np.uint64) * _STEP[k]
    return mix(out), bounds


def per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of flags over each text's bytes."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]
