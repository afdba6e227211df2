"""Remove byte strings that occur more than once, by deep-shallow suffix sorting of anchored contexts."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomtrace.llm import anchors as A
from loomtrace.llm import repeats

LENGTH, K = 200, 40  # bytes of a repeated string and of an anchor
WORD = 8  # bytes that the quicksort takes as one character
SHALLOW = 2  # characters the quicksort looks at


def multikey(words: np.ndarray, segment: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order rows within segments by their first `depth` characters: multikey quicksort, all segments at once.

    words: a row of characters per string; segment: start of each row's segment, rows of a segment side by side. In a
    round every open segment is split by its middle row's character into less, equal and greater; the equal part goes on
    with the next character. Returns (order, segments); rows left in one segment agree on all characters seen.
    """
    n = len(words)
    order, segment, level = np.arange(n), segment.copy(), np.zeros(n, np.int64)
    while True:
        size = np.bincount(segment, minlength=n)[segment] if n else segment
        open_ = np.flatnonzero((size > 1) & (level < depth))
        if not len(open_):
            return order, segment
        start, rows = segment[open_], order[open_]
        middle = order[start + size[open_] // 2]
        char, pivot = words[rows, level[open_]], words[middle, level[open_]]
        side = 1 + (char > pivot).astype(np.int8) - (char < pivot)
        place = np.lexsort((side, start))
        order[open_], start, side = rows[place], start[place], side[place]
        level[open_] = level[open_][place] + (side == 1)
        new = np.concatenate(([True], (start[1:] != start[:-1]) | (side[1:] != side[:-1])))
        segment[open_] = open_[np.flatnonzero(new)][np.cumsum(new) - 1]


def blind_order(strings: list[bytes]) -> list[int]:
    """Order strings of one length by a blind trie: nodes hold a depth and the bytes that follow there, nothing else."""
    width, same, numbers, root = len(strings[0]), {}, {}, None
    for i, s in enumerate(strings):
        if s in same:
            same[s].append(i)
            continue
        same[s], numbers[s] = [i], int.from_bytes(s, "big")
        if root is None:
            root = s
            continue
        node = root
        while type(node) is list:  # go down blindly to some leaf
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        common = width - ((numbers[s] ^ numbers[node]).bit_length() + 7) // 8
        leaf, above, node = node, None, root
        while type(node) is list and node[0] < common:
            above, node = node, node[1][s[node[0]]]
        if type(node) is list and node[0] == common:
            node[1][s[common]] = s
            continue
        fork = [common, {s[common]: s, leaf[common]: node}]
        if above is None:
            root = fork
        else:
            above[1][s[above[0]]] = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if type(node) is list:
            stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
        else:
            out.extend(same[node])
    return out


def deep_shallow(strings: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows sorted within segments, and the bytes each shares with the row before it; -1 at a segment's start.

    Multikey quicksort to a shallow depth; blind tries order the groups that still agree.
    """
    n, width = strings.shape
    padded = np.zeros((n, -(-width // WORD) * WORD), np.uint8)
    padded[:, :width] = strings
    order, left = multikey(padded.view(">u8").astype(np.uint64), segment, SHALLOW)
    starts = np.flatnonzero(left == np.arange(n))
    for begin, size in zip(starts.tolist(), np.diff(np.append(starts, n)).tolist()):
        if size > 1:
            rows = order[begin : begin + size]
            order[begin : begin + size] = rows[blind_order([s.tobytes() for s in strings[rows]])]
    common = np.full(n, -1, np.int64)
    if n > 1:
        differ = strings[order[1:]] != strings[order[:-1]]
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        common[1:] = np.where(segment[order[1:]] == segment[order[:-1]], shared, -1)
    return order, common


def _payload(data: np.ndarray, positions: np.ndarray, length: int, k: int) -> list[bytes]:
    """The context's bytes, led by the number of bytes before the anchor."""
    side, raw = length - k, data.tobytes()
    return [min(p, side).to_bytes(2, "little") + raw[max(0, p - side) : p + k + side] for p in positions.tolist()]


def _windows(payload: bytes, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    at = int.from_bytes(payload[:2], "little")
    values = A.BYTE_VALUES[np.frombuffer(payload, np.uint8, offset=2)]
    ((top, hashes),) = repeats.owned_windows(values, np.array([at]), length, k)
    return top - np.arange(len(hashes)), hashes


def _resolve(grams: np.ndarray, weights: np.ndarray, payloads: list[bytes], length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A window with o bytes before its anchor is repeated when some other context shares those o bytes and the rest behind.

    Contexts of an anchor are sorted twice, by what follows it and by what precedes it, backwards. Rows that share d bytes
    are neighbours without a common length under d between them, so each depth numbers its classes by a running count.
    """
    side, n = length - k, len(payloads)
    before, after = np.zeros((n, side), np.uint8), np.zeros((n, side), np.uint8)
    lead, tail = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, p in enumerate(payloads):
        at, text = int.from_bytes(p[:2], "little"), np.frombuffer(p, np.uint8, offset=2)
        lead[i], tail[i] = at, len(text) - at - k
        before[i, :at] = text[:at][::-1]
        after[i, : tail[i]] = text[at + k :]
    new = np.concatenate(([True], grams[1:] != grams[:-1]))
    segment = np.flatnonzero(new)[np.cumsum(new) - 1]
    left_order, left = deep_shallow(before, segment)
    right_order, right = deep_shallow(after, segment)
    repeated = np.zeros((n, side + 1), bool)
    left_class, right_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(side + 1):
        left_class[left_order] = np.cumsum(left < o)
        right_class[right_order] = np.cumsum(right < side - o)
        fits = np.flatnonzero((lead >= o) & (tail >= side - o))
        if len(fits) < 2:
            continue
        key = left_class[fits] * (n + 1) + right_class[fits]
        by = np.argsort(key, kind="stable")
        edge = np.concatenate(([True], key[by][1:] != key[by][:-1]))
        group = np.cumsum(edge) - 1
        repeated[fits[by], o] = (np.bincount(group, weights[fits[by]]) > 1)[group]
    flat = np.diff(np.pad(repeated, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(flat == 1)
    _, last = np.nonzero(flat == -1)
    return row, first, last - 1


def method(length: int = LENGTH, k: int = K) -> repeats.Method:
    return repeats.Method(
        lambda data: A.BYTE_VALUES[data], length, k, lambda data, _values, at: _payload(data, at, length, k),
        lambda grams, weights, payloads: _resolve(grams, weights, payloads, length, k), lambda payload: _windows(payload, length, k),
    )


def _kept(text: bytes, spans: pa.ListScalar) -> tuple[bytes, int, int]:
    gone = repeats.spans_mask(len(text), spans)
    if not gone.any():
        return text, 0, 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, k: int = K, most: int = repeats.MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the kept bytes, of every row of docs.

    A byte of the UTF-8 text goes when a string of `length` bytes over it also starts anywhere else, in the same document
    too; overlaps count, matches never cross documents, and strings are judged on the input. Null texts are empty, texts
    shorter than `length` lose nothing; repeated rows repeat each other; other columns are ignored.
    """

    def summary(text, spans):
        kept, gone, runs = _kept(text, spans)
        return len(text), gone, runs, kept

    return repeats.with_spans(docs, method(length, k), summary, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary", most)


def byte_digests(docs: DataFrame, length: int = LENGTH, k: int = K, most: int = repeats.MOST) -> DataFrame:
    """remove_repeated_bytes with the digest of the kept bytes in their place."""

    def summary(text, spans):
        kept, gone, runs = _kept(text, spans)
        return len(text), gone, runs, sha256(kept).hexdigest()

    return repeats.with_spans(docs, method(length, k), summary, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", most)
