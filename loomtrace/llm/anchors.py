"""Content-chosen anchors of unit sequences (words or bytes), for finding repeated windows.

Two equal windows of `length` units hold the same `k`-grams, so they hold the same smallest k-gram hash. An anchor is a
k-gram whose hash is the smallest of at least one window over it (all of them, when several tie). Every pair of equal
windows therefore meets at equal anchors, at equal offsets, and only the anchors need to travel.
"""

from __future__ import annotations

import functools

import numpy as np
import xxhash

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
STEP = 1 << 16  # units handled at once: memory stays bounded for any length


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n, from tables of a few sizes."""
    up, down = _powers(1 << max(17, int(n - 1).bit_length()))
    return up[:n], down[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of values[t] * BASE^t over i <= t < j."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=sums[1:]) if len(values) else None
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the units start <= t < end; equal content gives an equal hash wherever it stands."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64) * BASE)


def word_values(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word of UTF-8 bytes; blanks are space and 0x09 to 0x0D."""
    known: dict[bytes, int] = {}
    words = data.tobytes().split()
    for word in set(words):
        known[word] = xxhash.xxh64_intdigest(word, 35)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def slide(op, x: np.ndarray, width: int) -> np.ndarray:
    """op (minimum or maximum) over every `width` neighbours."""
    y, size = x, 1
    while 2 * size <= width:
        y, size = op(y[:-size], y[size:]), 2 * size
    rest = width - size
    return op(y[: len(y) - rest], y[rest:]) if rest else y


def anchors(values: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, k-gram hash, context hash) of every anchor of a sequence.

    The context is the anchor with `length - k` units on each side, clipped at the ends of the sequence: the union of all
    windows over the anchor. Sequences shorter than a window have no anchor.
    """
    n, side = len(values), length - k
    found = []
    for low in range(0, max(0, n - length + 1), STEP):
        high = min(low + STEP, n - length + 1)  # windows that start in low..high
        left, right = max(0, low - 2 * length), min(n, high + 3 * length)
        sums = prefix_sums(values[left:right])
        up = np.arange(right - left - k + 1)
        grams = span_hash(sums, up, up + k)
        own = grams[low - left : high - left + side]
        least = slide(np.minimum, own, side + 1)
        padded = np.concatenate((np.zeros(side, np.uint64), least, np.zeros(side, np.uint64)))
        at = np.flatnonzero(slide(np.maximum, padded, side + 1) == own) + low
        begin, end = np.maximum(at - side, 0), np.minimum(at + k + side, n)
        context = span_hash(sums, begin - left, end - left) + (at - begin).astype(np.uint64) * INVERSE
        found.append((at, grams[at - left], mix(context ^ BASE)))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    at, gram, context = (np.concatenate(x) for x in zip(*found))
    at, first = np.unique(at, return_index=True)  # an anchor may belong to windows of two pieces
    return at, gram[first], context[first]
