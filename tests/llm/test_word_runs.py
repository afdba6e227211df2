"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from edge_cases import EDGES
from loomtrace.llm import word_runs


def brute_runs(words, least=6, times=4):
    out, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(least, times * q):
                if not any(words[s : s + length - d] == words[s + d : s + length] for d in range(1, q)):
                    out.append((s, length, q))
            i = max(i, s) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    n = len(words)
    if doc_id is None or not n or zlib.crc32(str(doc_id).encode()) % 10:
        return words
    g = zlib.crc32(str(doc_id).encode()) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = planted(doc_id, (text or "").encode().split())
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.tuples(st.integers(0, 59), st.integers(1, 9), st.integers(4, 60)), max_size=3))
def test_runs(words, repeats):
    for start, period, length in repeats:
        for i in range(start + period, min(len(words), start + length)):
            words[i] = words[i - period]
    assert word_runs.runs_of(np.array(words, np.int64)) == brute_runs(words)


@pytest.mark.parametrize("period,times", [(1, 300), (7, 40), (70, 5), (90, 4), (100, 3)])
def test_long_periods_inside_text(period, times):
    draw = random.Random(period)
    block = [draw.randrange(30) for _ in range(period)]
    words = [draw.randrange(30) for _ in range(200)] + block * times + [draw.randrange(30) for _ in range(200)]
    assert word_runs.runs_of(np.array(words)) == brute_runs(words)


def test_other_limits():
    words = [0, 1] * 3 + [2, 2, 2]
    assert word_runs.runs_of(np.array(words), least=3, times=3) == brute_runs(words, 3, 3) == [(0, 6, 2), (6, 3, 1)]


def test_rare_words_split():
    ids = word_runs.word_ids(b"a b a b a b a b rare a b a b c c c c".split())
    assert word_runs.segments(ids) == [(0, 8)]  # after the split `a` and `b` are rare in the second part, and `c` is too short
    assert word_runs.segments(np.empty(0, np.int64)) == []


def test_digests_of_odd_documents(edges, nothing, rows_of):
    draw = random.Random(2)
    rows = EDGES + [(i, " ".join(draw.choice("abcde") for _ in range(draw.randrange(120))), "s") for i in range(100, 220)]
    got = word_runs.run_digests(word_runs.with_repeated_tails(rows_of(rows))).collect()
    assert sorted(map(tuple, got), key=str) == sorted((expected(i, t) for i, t, _ in rows), key=str)
    assert any(r.n_runs for r in got)
    assert word_runs.run_digests(word_runs.with_repeated_tails(nothing)).collect() == []
    assert word_runs.run_digests(edges).count() == len(EDGES)


def test_spans_and_text(rows_of):
    got = word_runs.collapse_runs(rows_of([(1, "x " + "a b " * 5 + "é y", "s"), (2, None, "s")])).collect()
    assert {r.doc_id: (r.collapsed, [tuple(x) for x in r.runs]) for r in got} == {1: ("x a b é y", [(1, 10, 2)]), 2: ("", [])}
