"""Sets of word shingles as sorted arrays of 64-bit hashes, worked out with numpy."""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
_P = 0x9E3779B97F4A7C15  # an odd multiplier
_CHUNK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit (splitmix64's finisher)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Distinct shingles of ``width`` words of a text; a shorter text is one shingle, a text without words none.

    A-Z is lower-cased and words end at ASCII white space. A word's hash is a polynomial over its bytes, taken from running
    sums of the whole text; a shingle's hash mixes its words' hashes in order.
    """

    def __init__(self, width: int):
        self.width = width
        self._byte = mixed(np.arange(1, 257, dtype=_U))
        self._space = np.zeros(256, bool)
        self._space[[9, 10, 11, 12, 13, 32]] = True
        self._powers = self._inverses = np.ones(1, _U)

    def _grow(self, n: int) -> None:
        if n > len(self._powers):
            n = 1 << (n - 1).bit_length()
            self._powers, self._inverses = (
                np.concatenate([np.ones(1, _U), np.cumprod(np.full(n - 1, p, _U))]) for p in (_P, pow(_P, -1, 2**64))
            )

    def _words(self, data: bytes) -> np.ndarray:
        b = np.frombuffer(data, np.uint8)
        space = np.concatenate([[True], self._space[b], [True]])
        edges = np.flatnonzero(space[1:] != space[:-1])
        starts, ends = edges[::2], edges[1::2]
        self._grow(len(b) + 1)
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(self._byte[b] * self._powers[: len(b)])])
        return mixed((sums[ends] - sums[starts]) * self._inverses[starts] + (ends - starts).astype(_U))

    def words(self, text: str | None) -> np.ndarray:
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        if len(data) <= _CHUNK:
            return self._words(data)
        parts, at = [], 0
        while at < len(data):  # long texts in pieces that end at white space
            end = at + _CHUNK
            while end < len(data) and not self._space[data[end]]:
                end += 1
            parts.append(self._words(data[at:end]))
            at = end
        return np.concatenate(parts)

    def __call__(self, text: str | None) -> np.ndarray:
        words = self.words(text)
        n = min(self.width, len(words))
        if not n:
            return np.zeros(0, _U)
        h = np.full(len(words) - n + 1, n, _U)
        for k in range(n):
            h = mixed(h + words[k : len(words) - n + 1 + k])
        return np.unique(h)


def fingerprint(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def bitmap(shingles: np.ndarray, bits: int) -> np.ndarray:
    """Hashed bitmap of a set: one bit a shingle, ``bits`` (a power of two, 64 at least) in 64-bit words."""
    held = np.zeros(bits, bool)
    held[(shingles & _U(bits - 1)).astype(np.int64)] = True
    return np.packbits(held, bitorder="little").view("<u8")


def folded(signature: np.ndarray, bits: int) -> np.ndarray:
    """The bitmap of the same set at a smaller power of two."""
    return np.bitwise_or.reduce(signature.reshape(-1, bits // 64), axis=0)


def signature_bits(size: int) -> int:
    """Half a bit for each shingle, as a power of two: wide enough to tell unlike sets apart, and bounded by the set."""
    return max(64, 1 << max(0, (max(1, size) - 1).bit_length() - 1))
