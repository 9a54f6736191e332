"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

A word is a longest run of word bytes; all bytes of a character beyond ASCII are
word bytes, so that runs of bytes are runs of characters.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_random = np.random.Generator(np.random.Philox(20260501))
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Multipliers of gram hashes: one row for each of two independent hashes.
_GRAM = _random.integers(1, 1 << 63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {}


def _bytes_in(*ranges: tuple[int, int]) -> np.ndarray:
    found = np.zeros(256, bool)
    for low, high in ranges:
        found[low:high + 1] = True
    return found


#: Everything but space, tab, line feed, vertical tab, form feed and carriage return.
BY_SPACE = ~_bytes_in((0x20, 0x20), (0x09, 0x0D))
#: Digits, letters and all beyond ASCII; capital letters count as small ones.
ALNUM = _bytes_in((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SAME = np.arange(256, dtype=np.uint8)


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(n + (n >> 1) + 1024, base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """``data[start[i]:end[i]]`` is word ``i``; text ``t`` has the words ``first[t]`` to ``first[t + 1] - 1``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def last(self) -> np.ndarray:
        """For each word, the number after the last word of its text."""
        return np.repeat(self.first[1:], self.counts)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def word(self, i: int) -> str:
        return self.data[self.start[i]:self.end[i]].tobytes().decode("utf-8", "replace")

    def hashes(self) -> np.ndarray:
        """64 bits of each word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        values = _BYTE[self.data] * _power(_BASE, len(self.data))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
        return mix((total[self.end] - total[self.start]) * _power(_BASE_INVERSE, len(self.data))[self.start])


def words(texts: pa.Array, kind: np.ndarray, fold: np.ndarray = SAME) -> Words:
    """Words of a column; null has none. ``fold`` maps bytes first (LOWER: A-Z to a-z)."""
    data, offsets = text_bytes(texts)
    data = fold[data] if fold is not SAME else data
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = kind[data]
    opens, closes = inside[:-1].copy(), inside[:-1].copy()
    opens[1:] &= ~inside[:-2]
    closes &= ~inside[1:]
    at = offsets[:-1][offsets[:-1] < len(data)]       # a text starts a word anew, and ends the one before it
    opens[at] = inside[at]
    before = at[at > 0] - 1
    closes[before] = inside[before]
    start = np.flatnonzero(opens)
    return Words(data, start, np.flatnonzero(closes) + 1, np.searchsorted(start, offsets))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins; null is empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0]:offsets[-1]] if held is not None and held.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def grams(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """64 bits of every ``k`` consecutive hashes; entry ``i`` covers ``i`` to ``i + k - 1``, across texts too."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out += h[j:j + n] * _GRAM[which, j]
    return mix(out)
