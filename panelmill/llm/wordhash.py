"""64-bit word hashes of many texts at once, in numpy over their UTF-8 bytes.

A word is a run ``[^\\x20\\x09-\\x0D]+``. Its hash is a polynomial over its bytes modulo 2^64, mixed,
so equal words have equal hashes in every task; different words collide with probability about
2^-64. ``Words.second`` gives a second hash of other polynomials, for 128 bits in all.
"""

from __future__ import annotations

import functools

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All ASCII but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_POWERS = 4096


def _powers(base: int) -> np.ndarray:
    out, p = np.empty(_POWERS, np.uint64), 1
    for i in range(_POWERS):
        out[i] = p
        p = p * base % 2**64
    return out


_POW = _powers(_BASE)
_POW_FAR = _powers(0xD6E8FEB86659FD93)
_SECOND = 0xC2B2AE3D27D4EB4F
_SECOND_FAR = 0x165667B19E3779F9


_second_powers = functools.lru_cache(maxsize=2)(_powers)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """hashes: of all words of all texts in order; counts: words by text; offsets: count + 1 bounds.
    data, starts and ends locate the words' bytes."""

    def __init__(self, texts: list[str], lower: bool = False, separators: np.ndarray = _SPACE):
        encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = b"\n".join(encoded) + b"\n"
        raw = np.frombuffer(self.data, np.uint8)
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1
        self.bounds = np.concatenate(([0], np.cumsum(sizes)))
        self.raw = raw
        self.space = space = separators[raw]
        body = ~space
        edge = np.diff(body.view(np.int8), prepend=np.int8(0))
        self.starts = starts = np.flatnonzero(edge == 1)
        self.ends = ends = np.flatnonzero(edge == -1)
        self.lower = lower
        self.hashes = self._polynomials(_POW, _POW_FAR)
        self.offsets = np.searchsorted(starts, self.bounds)
        self.counts = np.diff(self.offsets)

    def _polynomials(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        starts, raw = self.starts, self.raw
        if not len(starts):
            return np.empty(0, np.uint64)
        values = (_LOWER[raw] if self.lower else raw).astype(np.uint64) + np.uint64(1)
        inside = np.arange(len(raw))
        first = np.repeat(starts, np.diff(np.append(starts, len(raw))))
        inside[starts[0] :] -= first
        if (self.ends - starts).max() >= _POWERS:
            values *= far[(inside >> 12) & (_POWERS - 1)]
        values *= near[inside & (_POWERS - 1)]
        values[self.space] = 0
        return mix(np.add.reduceat(values, starts))

    def second(self) -> np.ndarray:
        """Second hashes of all words, of other bases than ``hashes``."""
        return self._polynomials(_second_powers(_SECOND), _second_powers(_SECOND_FAR))

    def word_bytes(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` consecutive word hashes (order counts)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # doubling: H_{2k}(i) = mix-free combination H_k(i) * M_k + H_k(i + k)
    out, have, rest, done = None, hashes, width, 0
    power, mult = 1, 0xA0761D6478BD642F
    step = hashes
    while rest:
        if rest & 1:
            if out is None:
                out, done = step[: len(hashes) - power + 1], power
            else:
                m = np.uint64(pow(mult, power, 2**64))
                size = len(hashes) - done - power + 1
                out = out[:size] * m + step[done : done + size]
                done += power
        rest >>= 1
        if rest:
            size = len(hashes) - 2 * power + 1
            step = step[:size] * np.uint64(pow(mult, power, 2**64)) + step[power : power + size]
            power *= 2
    return mix(out[:n])
