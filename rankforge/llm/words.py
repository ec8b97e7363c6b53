"""Words and 64-bit word hashes, computed on a text's bytes without making a string of each word.

A word's hash is a polynomial over table values of its bytes, taken from prefix sums
of the whole text: (sum up to the word's end - sum up to its start) / BASE ** start,
all modulo 2 ** 64, where an odd base has an inverse; then mixed with the length.
"""

from __future__ import annotations

import re

import numpy as np

#: What the contracts call a word: anything but a space and the bytes 9 to 13.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True

#: Odd base of the polynomials over words, and that over bytes (fixed values).
BASE = np.uint64(0x9E3779B97F4A7C15)
BYTE_BASE = 0xD1342543DE82EF95
_TABLE = np.random.default_rng(20_240).integers(0, 1 << 64, 256, np.uint64)
_TABLE_LOWER = _TABLE.copy()
_TABLE_LOWER[65:91] = _TABLE[97:123]
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BYTE_BASE ** i and its inverse for i < n; kept, and as long as the longest text so far."""
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, 1 << 16)
        up, down = np.full(n, BYTE_BASE, np.uint64), np.full(n, pow(BYTE_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers, _inverse = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers, _inverse


def split_words(text: str | None, lower: bool = False) -> list[str]:
    """The words of a text, in order; A-Z lower-cased on demand. Null gives none."""
    if not text:
        return []
    if lower:
        text = text.translate(_LOWER) if not text.isascii() else text.lower()
    # split(" ") after mapping the blanks is several times as fast as a regular expression.
    for c in "\t\n\x0b\x0c\r":
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a polynomial's low bits (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(data: bytes | memoryview | None, lower: bool = False) -> np.ndarray:
    """Hashes of the words of a UTF-8 text, in order; A-Z lower-cased on demand."""
    b = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    word = ~_BLANK[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]])))
    start, end = edge[::2], edge[1::2]
    up, down = _tables(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((_TABLE_LOWER if lower else _TABLE)[b] * up[: len(b)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words; empty if there are fewer."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:m].copy()
    for i in range(1, n):
        out *= BASE
        out += hashes[i : i + m]
    return mix(out)


def shingle_set(data: bytes | memoryview | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a UTF-8 text's n-word shingles (A-Z lower-cased).

    Fewer than n words: the whole sequence counts as one shingle. No words: empty.
    """
    h = word_hashes(data, lower=True)
    if not len(h):
        return h
    if len(h) < n:
        return gram_hashes(h, len(h)) + np.uint64(len(h))
    g = np.sort(gram_hashes(h, n))
    return g[np.concatenate([[True], g[1:] != g[:-1]])]
