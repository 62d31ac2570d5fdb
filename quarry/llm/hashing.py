"""Vectorised hashing of bytes, words and shingles for tasks that work on Arrow batches."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, size: int) -> np.ndarray:
    """base ** 0 .. size - 1 modulo 2 ** 64, kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < size:
        have = np.full(max(size, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Prefixes:
    """Prefix sums of a polynomial over bytes: the hash of any span takes two look-ups."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        undo = powers(_INVERSE, len(self.sums))
        return mix((self.sums[end] - self.sums[start]) * undo[start])


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_codes(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(owner, code): the shingles of each text, repeated ones as often as they occur, sorted by owner and code.

    Words are runs of non-blank bytes with A-Z lower-cased. A text of 1 to width - 1 words is one shingle; one without
    a word has none.
    """
    data = [t.encode("utf-8", "replace").translate(_LOWER) for t in texts]
    joined = np.frombuffer(b" " + b" ".join(data) + b" ", np.uint8)
    blank = _BLANK[joined]
    change = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, end = change[0::2], change[1::2]
    words = Prefixes(joined).spans(start, end)
    lengths = np.array(list(map(len, data)), np.int64)
    first_byte = np.concatenate([[1], 1 + np.cumsum(lengths + 1)[:-1]]) if len(data) else np.zeros(0, np.int64)
    owner = np.searchsorted(first_byte, start, "right") - 1
    count = np.bincount(owner, minlength=len(texts))
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    code = np.zeros(len(words), np.uint64)
    last = (first + count)[owner]  # the word after the text's last
    at = np.arange(len(words))
    for i in range(width):
        code = code * np.uint64(BASE) + np.where(at + i < last, padded[i : i + len(words)], np.uint64(i + 1))
    full = (at + width <= last) | ((at == first[owner]) & (count[owner] < width))
    code, owner = mix(code[full]), owner[full]
    order = np.lexsort((code, owner))
    return owner[order], code[order]


def _fresh(owner: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Which shingles differ from the one before."""
    fresh = np.ones(len(code), bool)
    fresh[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    return fresh


def weights_of(owner: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, code, weight): the distinct shingles of shingle_codes() with their counts."""
    first = np.flatnonzero(_fresh(owner, code))
    return owner[first], code[first], np.diff(np.append(first, len(code))).astype(float)


def shingles(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The cells of the texts' shingles."""
    return cells_of(*shingle_codes(texts, width))


def cells_of(owner: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, cell): the nth copy of a shingle is a cell of its own, so that the Jaccard similarity of cell sets is the
    weighted Jaccard similarity of shingle counts. Sorted by owner and cell."""
    fresh = _fresh(owner, code)
    nth = np.arange(len(code)) - np.maximum.accumulate(np.where(fresh, np.arange(len(code)), 0))
    again = nth > 0
    if again.any():
        code[again] = mix(code[again] + nth[again].astype(np.uint64) * np.uint64(BASE))
        order = np.lexsort((code, owner))
        code, owner = code[order], owner[order]
    return owner, code
