"""Hashes of a text's words, worked out on whole arrays.

Words are runs of bytes other than space and 0x09-0x0D. A word's hash is a polynomial in its bytes modulo 2^64 taken from one
prefix array, then mixed; spans of words are hashed from a second prefix array in the same way.
"""

from __future__ import annotations

import hashlib

import numpy as np

_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_U = np.uint64


class _Powers:
    def __init__(self, base: int):
        self.base, self.values = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            self.values = np.concatenate([self.values, self.values * _U(pow(self.base, len(self.values), 1 << 64))])
        return self.values[:n]


_UP = {b: _Powers(b) for b in (_BYTE_BASE, _WORD_BASE)}
_DOWN = {b: _Powers(pow(b, -1, 1 << 64)) for b in (_BYTE_BASE, _WORD_BASE)}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _UP[base].upto(len(values)), out=out[1:])
    return out


class Words:
    """The words of one text: `line` is them joined by one space."""

    def __init__(self, raw: bytes):
        words = raw.split()
        self.n, self.line = len(words), b" ".join(words)
        self._hashes: np.ndarray | None = None

    def _places(self) -> None:
        codes = np.frombuffer(self.line, np.uint8)
        gaps = np.flatnonzero(codes == 32)
        self.begin = np.concatenate([[0], gaps + 1])
        self.end = np.concatenate([gaps, [len(codes)]])
        p = _prefix(codes.astype(np.uint64) + _U(1), _BYTE_BASE)
        self._hashes = mix((p[self.end] - p[self.begin]) * _DOWN[_BYTE_BASE].upto(len(codes))[self.begin])

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            if not self.n:
                self.begin = self.end = np.zeros(0, np.int64)
                self._hashes = np.zeros(0, np.uint64)
            else:
                self._places()
        return self._hashes

    def grams(self, k: int) -> np.ndarray:
        """The hash of every k consecutive words."""
        if self.n < k:
            return np.zeros(0, np.uint64)
        g = _prefix(self.hashes, _WORD_BASE)
        return mix((g[k:] - g[:-k]) * _DOWN[_WORD_BASE].upto(len(g) - k))

    def shingles(self, k: int) -> np.ndarray:
        """The distinct grams in ascending order; fewer than k words are one shingle, no words none."""
        if self.n >= k:
            return np.unique(self.grams(k))
        return np.unique(self.grams(self.n)) if self.n else np.zeros(0, np.uint64)

    def digest(self, first: int, last: int) -> tuple[int, int]:
        """128 bits of the words first to last (inclusive), as two signed integers."""
        _ = self.hashes
        return digest(self.line[self.begin[first] : self.end[last]])


def digest(data: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
