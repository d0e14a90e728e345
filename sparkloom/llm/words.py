"""Words of many texts at once, in numpy: where they are, whose they are, and 64-bit hashes of them.

A word is a run of ASCII letters and digits and of characters beyond ASCII, in lower case; the usual punctuation beyond
ASCII separates words too.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np

#: Latin-1 signs, general punctuation and CJK punctuation; combining marks and letters are not among them.
_PUNCTUATION = re.compile("[\u0080-©«-´¶-¹»-¿×÷ -⁯　-〿！-／：-＠]+")
_IN_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class Words(NamedTuple):
    data: np.ndarray  # the texts' bytes, normalised, with a space after each
    begin: np.ndarray  # of each word in data
    end: np.ndarray
    text: np.ndarray  # which text each word is from
    hash: np.ndarray
    sums: np.ndarray  # of the hash's terms up to each byte

    def bytes(self, k: int) -> bytes:
        return self.data[self.begin[k] : self.end[k]].tobytes()


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(n + n // 4, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors)
    return _powers[0], _powers[1]


def normalise(text: str | None) -> bytes:
    if not text:
        return b""
    low = text.lower()
    return (low if low.isascii() else _PUNCTUATION.sub(" ", low)).encode()


def split(texts: list[str | None]) -> Words:
    return cut([normalise(t) for t in texts], _IN_WORD)


def cut(parts: list[bytes], in_word: np.ndarray) -> Words:
    """The words of some texts, where ``in_word`` says which bytes belong to one; a space doesn't."""
    data = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = in_word[data]
    turn = np.diff(inside)
    begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    first = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])]) if parts else np.zeros(0, np.int64)
    power, inverse = _grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    hashed = mix((sums[end] - sums[begin]) * inverse[begin])
    return Words(data, begin, end, np.searchsorted(first, begin, side="right") - 1, hashed, sums)


def beginnings(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words are longer than ``size`` bytes, and hashes of their first ``size`` bytes (other ones than words have)."""
    at = np.flatnonzero(words.end - words.begin > size)
    begin = words.begin[at]
    return at, ~mix((words.sums[begin + size] - words.sums[begin]) * _grow(len(words.data) + 1)[1][begin])


def grams(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where n words of one text begin, and the hashes of those n-grams."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    last = len(hashes) - n + 1
    total = np.zeros(last, np.uint64)
    for k in range(n):
        total = total * np.uint64(_BASE) + hashes[k : last + k]
    at = np.flatnonzero(text[:last] == text[n - 1 :])
    return at, mix(total[at])


class HashSet:
    """Fixed 64-bit hashes to look others up in: a bitmap turns most away before the exact search."""

    def __init__(self, hashes: np.ndarray, bits: int = 20) -> None:
        self.sorted = np.unique(hashes)
        self.shift = np.uint64(64 - bits)
        self.map = np.zeros(1 << bits, bool)
        self.map[self.sorted >> self.shift] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``hashes`` of those that are in the set, their places in ``sorted``)."""
        at = np.flatnonzero(self.map[hashes >> self.shift])
        if not len(at):
            return at, at
        k = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
        same = self.sorted[k] == hashes[at]
        return at[same], k[same]
