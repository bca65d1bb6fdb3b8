"""64-bit hashes of the words and of the distinct n-word shingles of whole texts, in numpy over Arrow's bytes.

A word's hash is a polynomial in an odd base over random values of its bytes (A-Z as a-z), modulo 2**64, taken from prefix sums;
a shingle's is a sum of its words' hashes times odd multipliers; both are then mixed. Distinct shingles share a hash with
a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import STEP_BYTES, text_bytes

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_UP = np.ones(1, np.uint64)
_DOWN = np.ones(1, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least."""
    global _UP, _DOWN
    if len(_UP) < n:
        size = 1 << (n - 1).bit_length()
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            made.append(np.multiply.accumulate(factors))
        _UP, _DOWN = made
    return _UP, _DOWN


def _hash_words(u8: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words; first marks bytes that begin a text."""
    if not len(u8):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~_BLANK[u8]
    edge = first.copy()
    edge[0] = True
    edge[1:] |= ~word[:-1]
    begin = np.flatnonzero(word & edge)
    last = np.ones(len(u8), bool)
    last[:-1] = ~word[1:] | first[1:]
    end = np.flatnonzero(word & last) + 1
    up, down = _powers(len(u8) + 1)
    sums = np.zeros(len(u8) + 1, np.uint64)
    np.cumsum(_VALUE[u8] * down[: len(u8)], out=sums[1:])
    return mixed((sums[end] - sums[begin]) * up[begin]), begin


def words_of_texts(column: pa.Array, step: int = STEP_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice of texts, and offsets into them for each text (one more than texts)."""
    u8, off = text_bytes(column)
    marks = np.zeros(len(u8) + 1, bool)
    marks[off[:-1]] = True
    hashes, begins, at = [], [], 0
    while at < len(u8):
        to = min(len(u8), at + step)
        while to < len(u8) and not (_BLANK[u8[to]] or marks[to]):  # never within a word
            to += 1
        h, b = _hash_words(u8[at:to], marks[at:to])
        hashes.append(h)
        begins.append(b + at)
        at = to
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    b = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    return h, np.searchsorted(b, off)


def class_hashes(words: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text's sequence of words; texts of equal words are equal in it."""
    up, down = _powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mixed(words ^ np.uint64(0x5851F42D4C957F2D)) * down[: len(words)], out=sums[1:])
    n = np.diff(off).astype(np.uint64)
    return mixed((sums[off[1:]] - sums[off[:-1]]) * up[off[:-1]] + n * np.uint64(0xC2B2AE3D27D4EB4F))


def shingle_sets(words: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles, sorted by both. Fewer words than width: the whole sequence is one shingle."""
    odd = [np.uint64((_BASE * (2 * k + 3)) & _MASK | 1) for k in range(width)]
    n = np.diff(off)
    h = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        h += words[k : k + len(h)] * odd[k]
    count = np.maximum(n - width + 1, 0)
    text = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(off[:-1], count)
    got = mixed(h[at] if len(at) else np.zeros(0, np.uint64))
    few = np.flatnonzero((n > 0) & (n < width))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for k in range(width - 1):
            some = n[few] > k
            short[some] += words[off[few[some]] + k] * odd[k]
        short = mixed(short + n[few].astype(np.uint64) * np.uint64(0x27D4EB2F165667C5))
        text, got = np.concatenate([text, few]), np.concatenate([got, short])
    order = np.lexsort((got, text))
    text, got = text[order], got[order]
    fresh = np.ones(len(got), bool)
    fresh[1:] = (got[1:] != got[:-1]) | (text[1:] != text[:-1])
    return text[fresh], got[fresh]
