"""Words of UTF-8 bytes, found and hashed in numpy: no Python object for each word.

A word is a run of characters that are no white space (as str.split has it). Its two hashes are polynomials of its
bytes modulo 2**64, with random values for bytes, then mixed. A polynomial of a stretch is a difference of running
sums, so all words of a text cost a few array operations, and so does any run of words.
"""

from __future__ import annotations

import numpy as np

#: Bytes hashed at a time; a word that lies across a border is put together again.
SEGMENT = (1 << 18) - 1

_SPACES = [c.encode() for c in map(chr, range(0x3001)) if c.isspace()]
_ONE = np.zeros(256, bool)
_ONE[[x[0] for x in _SPACES if len(x) == 1]] = True
_LEAD = np.zeros(256, bool)
_LEAD[[x[0] for x in _SPACES if len(x) > 1]] = True
_WIDE = {n: np.array([int.from_bytes(x) for x in _SPACES if len(x) == n], np.int64) for n in (2, 3)}

_VALUES = np.random.default_rng(20).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Base of polynomials over words.
_OVER = 0xD6E8FEB86659FD93


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64; the first ``most`` are held once they were asked for."""

    def __init__(self, base: int, most: int = 1 << 18):
        self.base, self.most = (base, pow(base, -1, 1 << 64)), most
        self.held = self._made(1)

    def _made(self, n: int) -> list[np.ndarray]:
        return [np.cumprod(np.append(np.uint64(1), np.full(n - 1, b, np.uint64)), dtype=np.uint64) for b in self.base]

    def upto(self, n: int) -> list[np.ndarray]:
        if n > self.most:
            return self._made(n)
        if len(self.held[0]) < n:
            self.held = self._made(min(self.most, 1 << (n - 1).bit_length()))
        return [x[:n] for x in self.held]


_BYTE_POWERS = tuple(Powers(b) for b in _BASES)


def white(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    out = _ONE[data]
    at = np.flatnonzero(_LEAD[data])
    if len(at):
        pad = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.int64)
        two = pad[at] << 8 | pad[at + 1]
        for n, code in ((2, two), (3, two << 8 | pad[at + 2])):
            hit = at[np.isin(code, _WIDE[n])]
            for k in range(n):
                out[hit + k] = True
    return out


def words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, hash, second hash) of the words of texts that lie end to end in data; edges: where each begins, and the end."""
    starts, sums, lengths, open_ = [], ([], []), [], False
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + SEGMENT)
        while lo < hi < len(data) and data[hi] & 0xC0 == 0x80:
            hi -= 1
        hi = hi if hi > lo else min(len(data), lo + SEGMENT)  # no valid UTF-8: cut anywhere
        part = data[lo:hi]
        inside = ~white(part)
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        border = edges[np.searchsorted(edges, lo) : np.searchsorted(edges, hi)] - lo
        begin[border] = inside[border]
        s = np.flatnonzero(begin)
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | begin[1:]
        e = np.flatnonzero(stop) + 1
        sums_here = []
        for values, powers in zip(_VALUES, _BYTE_POWERS, strict=True):
            up, down = powers.upto(len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(values[part] * up[:-1], out=total[1:])
            sums_here.append((total[e] - total[s]) * down[s])
        n = e - s
        if open_ and len(s) and s[0] == 0 and not (len(border) and border[0] == 0):
            # The word goes on from the segment before.
            for own, here, powers in zip(sums, sums_here, _BYTE_POWERS, strict=True):
                own[-1][-1:] += here[:1] * np.uint64(pow(powers.base[0], int(lengths[-1][-1]), 1 << 64))
            lengths[-1][-1] += n[0]
            s, n, sums_here = s[1:], n[1:], [x[1:] for x in sums_here]
        if len(s):
            starts.append(s + lo)
            lengths.append(n)
            for own, here in zip(sums, sums_here, strict=True):
                own.append(here)
        open_ = bool(inside[-1])
        lo = hi
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    n = np.concatenate(lengths).astype(np.uint64)
    return np.concatenate(starts), *(mixed(np.concatenate(x) + n * np.uint64(_OVER)) for x in sums)


_WORD_POWERS = Powers(_OVER)


class Runs:
    """Hashes of any runs of some words."""

    def __init__(self, hashes: np.ndarray):
        up, self.down = _WORD_POWERS.upto(len(hashes) + 1)
        self.total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[:-1], out=self.total[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray, mark: int = 0) -> np.ndarray:
        """Hash of words lo to hi (without), their number and a mark."""
        many = (hi - lo).astype(np.uint64)
        return mixed((self.total[hi] - self.total[lo]) * self.down[lo] + (many * np.uint64(4) + np.uint64(mark)) * np.uint64(0x9E3779B97F4A7C15))
