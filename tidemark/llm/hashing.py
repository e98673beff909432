"""Words and their hashes from the bytes of many texts at once, in NumPy."""

from __future__ import annotations

import numpy as np

GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)

#: Byte classes: a byte's folded value, or 0 where it separates words.
ALNUM = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 0 for c in range(256)], np.uint8)
NONSPACE = np.array([0 if c == 32 or 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c or 255 for c in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: every bit of the result hangs on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_byte_value = mix(np.arange(1, 257, dtype=np.uint64) * GOLD)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        size = max(n, 1 << 21)
        steps = np.full(size, _BASE, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
        steps[1:] = inverse
        _inverse = np.cumprod(steps, dtype=np.uint64)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in data[offsets[i]:offsets[i + 1]]: start, end, text and hash of each word, a run of bytes that table does not map to 0."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    folded = table[data]
    inside = folded != 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    start[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    _grow(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte_value[folded] * _powers[:n], out=sums[1:])
    hashes = mix((sums[e] - sums[s]) * _inverse[s] + (e - s).astype(np.uint64))
    return s, e, np.searchsorted(offsets, s, side="right") - 1, hashes


def shingles(text: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """text and hash of each run of size consecutive words; a text of fewer words, but not none, is one run."""
    n = len(hashes)
    if not n:
        return text, hashes
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    count = np.diff(np.r_[first, n])
    left = np.repeat(first + count, count) - np.arange(n)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        part = np.zeros(n, np.uint64)
        part[: max(0, n - k)] = hashes[k:]
        part[left <= k] = 0
        total = total * _BASE + part
    keep = (left >= size) | (np.repeat(count, count) < size) & (np.arange(n) == np.repeat(first, count))
    return text[keep], mix(total[keep])


def multisets(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) in that order, and how often each occurs."""
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])]) if len(text) else np.zeros(0, np.int64)
    return text[first], hashes[first], np.diff(np.r_[first, len(text)])
