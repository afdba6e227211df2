"""Window and suffix deduplication against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from edge_cases import EDGES
from loomtrace.llm import anchors, suffix_dedup, window_dedup


def covered(sequences, length):
    """For each sequence which units repeated windows cover."""
    seen = Counter(tuple(s[i : i + length]) for s in sequences for i in range(len(s) - length + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            if seen[tuple(s[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def by_words(rows, length):
    words = [(t or "").encode().split() for _, t, *_ in rows]
    for (i, *_), w, gone in zip(rows, words, covered(words, length)):
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        yield i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()


def by_bytes(rows, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    for (i, *_), b, gone in zip(rows, texts, covered(texts, length)):
        runs = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        yield i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()


def crowd(seed):
    """Documents that share passages, whole, cut, edited and repeated inside one document."""
    draw = random.Random(seed)
    passages = [[draw.choice("abcdefghij") * draw.randint(1, 3) for _ in range(draw.randint(5, 60))] for _ in range(12)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(draw.randint(0, 4)):
            p = list(draw.choice(passages))
            p = p[draw.randint(0, 4) : len(p) - draw.randint(0, 4)]
            if p and draw.random() < 0.3:
                p[draw.randrange(len(p))] = "edit"
            words += p + [str(draw.random())] * draw.randint(0, 2)
        rows.append((i % 100, " ".join(words), "s"))
    return rows + [(200, "the " * 300, "s"), (201, "the " * 100, "s"), (201, "the " * 100, "s")]


def order(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("length,k,most", [(6, 3, 2000), (9, 4, 2), (35, 12, 2000)])
def test_windows(rows_of, length, k, most):
    rows = crowd(length)
    got = window_dedup.window_digests(rows_of(rows), length, k, most).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert order(got) == order(by_words(rows, length))


@pytest.mark.parametrize("length,k,most", [(20, 6, 2000), (40, 11, 2), (200, 40, 2000)])
def test_bytes(rows_of, length, k, most):
    rows = crowd(length)
    got = suffix_dedup.byte_digests(rows_of(rows), length, k, most).collect()
    assert order(got) == order(by_bytes(rows, length))


def test_edges(edges, nothing):
    assert order(window_dedup.window_digests(edges).collect()) == order(by_words(EDGES, 35))
    assert order(suffix_dedup.byte_digests(edges).collect()) == order(by_bytes(EDGES, 200))
    assert window_dedup.window_digests(nothing).collect() == suffix_dedup.byte_digests(nothing).collect() == []


def test_texts_are_returned(rows_of):
    docs = rows_of([(1, "a b c d e", "s"), (2, "x b c d y", "s")])
    got = {r.doc_id: r.kept for r in window_dedup.remove_repeated_windows(docs, 3, 2).collect()}
    assert got == {1: "a e", 2: "x y"}
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeated_bytes(docs, 7, 3).collect()}
    assert got == {1: b"ae", 2: b"xy"}


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    values = anchors.mix(np.random.default_rng(1).integers(0, 4, 5000).astype(np.uint64))
    whole = anchors.anchors(values, 35, 12)
    monkeypatch.setattr(anchors, "STEP", 64)
    for a, b in zip(whole, anchors.anchors(values, 35, 12)):
        assert (a == b).all()


def test_deep_shallow_orders_like_a_plain_sort():
    draw = np.random.default_rng(2)
    strings = draw.integers(97, 99, (400, 40)).astype(np.uint8)
    strings[200:300] = strings[100:200]
    strings[300:, :30] = strings[0, :30]
    segment = np.repeat([0, 150], [150, 250])
    got, common = suffix_dedup.deep_shallow(strings, segment)
    rows = [s.tobytes() for s in strings]
    assert [rows[i] for i in got] == sorted(rows[:150]) + sorted(rows[150:])
    assert common[0] == common[150] == -1
    for i in (1, 5, 149, 151, 399):
        a, b = rows[got[i - 1]], rows[got[i]]
        assert common[i] == next((j for j in range(40) if a[j] != b[j]), 40)


def test_passages_shorter_than_a_window_stay(rows_of):
    """Texts that share 12 to 34 words meet at anchors, but no window is repeated."""
    rows = []
    for n in range(12, 37):
        for t in range(4):
            shared = [f"s{n}x{t}x{i}" for i in range(n)]
            for side in "ab":
                rows.append((len(rows), " ".join([f"{side}{n}p{t}q{i}" for i in range(40)] + shared + [f"{side}{n}r{t}s{i}" for i in range(40)]), "s"))
    got = window_dedup.window_digests(rows_of(rows)).collect()
    assert order(got) == order(by_words(rows, 35))


def test_long_words_that_differ_everywhere(rows_of):
    """A Thue-Morse word and its complement are different words for every polynomial modulus of two."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    first, second = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    around = [f"w{i}" for i in range(34)]
    rows = [(i, " ".join(around[:17] + [w] + around[17:]), "s") for i, w in enumerate([first, second])] * 2
    got = window_dedup.window_digests(rows_of(rows[:2])).collect()
    assert [r.n_removed for r in got] == [0, 0]
    assert order(window_dedup.window_digests(rows_of(rows)).collect()) == order(by_words(rows, 35))
