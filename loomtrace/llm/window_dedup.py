"""Remove word windows that occur more than once, found through content-chosen anchors."""

from __future__ import annotations

import itertools
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomtrace.llm import anchors as A
from loomtrace.llm import repeats

LENGTH, K = 35, 12  # words of a window and of an anchor


def _payload(_data: np.ndarray, values: np.ndarray, positions: np.ndarray, length: int, k: int) -> list[bytes]:
    return [int(o).to_bytes(8, "little") + h.tobytes() for o, h in repeats.owned_windows(values, positions, length, k)]


def _windows(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    hashes = np.frombuffer(payload, np.uint64, offset=8)
    return int.from_bytes(payload[:8], "little") - np.arange(len(hashes)), hashes


def _resolve(grams: np.ndarray, weights: np.ndarray, payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows are equal when anchor, offset and hash are."""
    counts = np.array([len(p) // 8 - 1 for p in payloads], np.int64)
    row = np.repeat(np.arange(len(payloads)), counts)
    hashes = np.concatenate([np.frombuffer(p, np.uint64, offset=8) for p in payloads]) if len(payloads) else np.empty(0, np.uint64)
    tops = np.array([int.from_bytes(p[:8], "little") for p in payloads], np.int64)
    offsets = np.repeat(tops, counts) - (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts))
    key = A.mix(hashes + offsets.astype(np.uint64) * A.BASE)
    order = np.lexsort((key, grams[row]))
    gram, sorted_key = grams[row][order], key[order]
    new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (sorted_key[1:] != sorted_key[:-1]))) if len(order) else np.empty(0, bool)
    group = np.cumsum(new) - 1
    often = np.empty(len(order), bool)
    often[order] = (np.bincount(group, weights[row][order]) > 1)[group] if len(order) else False
    row, offsets = row[often], offsets[often]
    if not len(row):  # the contexts share less than a window
        return row, offsets, offsets
    # offsets of a row fall by one from window to window
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (offsets[1:] != offsets[:-1] - 1)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return row[first], offsets[last], offsets[first]


def method(length: int = LENGTH, k: int = K) -> repeats.Method:
    return repeats.Method(
        A.word_values, length, k, lambda data, values, at: _payload(data, values, at, length, k), _resolve, _windows
    )


def _kept(text: bytes, spans: pa.ListScalar) -> tuple[list[bytes], int]:
    words = text.split()
    gone = repeats.spans_mask(len(words), spans)
    return (list(itertools.compress(words, (~gone).tolist())) if gone.any() else words), len(words)


def remove_repeated_windows(docs: DataFrame, length: int = LENGTH, k: int = K, most: int = repeats.MOST) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one blank, of every row of docs.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, unchanged. A word goes when a window of `length` words over it
    also starts anywhere else, in the same document too. Windows are judged on the input. Null texts have no words, texts
    shorter than a window lose none; repeated rows repeat each other; other columns are ignored.
    """

    def summary(text, spans):
        kept, n = _kept(text, spans)
        return n, n - len(kept), b" ".join(kept).decode()

    return repeats.with_spans(docs, method(length, k), summary, "doc_id bigint, n_words bigint, n_removed bigint, kept string", most)


def window_digests(docs: DataFrame, length: int = LENGTH, k: int = K, most: int = repeats.MOST) -> DataFrame:
    """remove_repeated_windows with the digest of the kept text in its place."""

    def summary(text, spans):
        kept, n = _kept(text, spans)
        return n, n - len(kept), sha256(b" ".join(kept)).hexdigest()

    return repeats.with_spans(docs, method(length, k), summary, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string", most)
