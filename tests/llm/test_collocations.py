"""Phrase mining against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

from loomtrace.llm import collocations


def brute(rows, support, longest, best, share):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        frequent = {p: n for p, n in f.items() if n >= support and len(p) > 1}
        found = []
        for p, a in frequent.items():
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * n >= share * a for q, n in frequent.items())
            if not inside:
                found.append((" ".join(p), a, left, right, score))
        found.sort(key=lambda r: (-r[4], -r[1], r[0].encode()))
        out += [(lang, i, p, a, left, right, total[lang], s) for i, (p, a, left, right, s) in enumerate(found[:best], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def docs_of(spark):
    return lambda rows: spark.createDataFrame([(*r, 5, "p") for r in rows], "doc_id bigint, text string, lang string, n int, phrase string")


def sample(n):
    draw = random.Random(n)
    words = ["The", "the", "of", "été", "a b", "x", "日本", "ÉX", "zz", "k."]
    text = lambda: "".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ", ", "\n", "\r\n", "!?"]) for _ in range(draw.randrange(40)))
    return [(draw.choice([1, 2, 3, None]), text(), draw.choice(["en", "fr", None, "und"])) for _ in range(n)]


@pytest.mark.parametrize("longest,best,share,group", [(3, 2000, 50, 100), (4, 20, 70, 10**6), (2, 5, 50, 1000)])
def test_against_brute_force(docs_of, longest, best, share, group):
    rows = sample(300) + [(9, "one two three. " * 2500, "en")] * 2 + [(7, None, "en"), (8, "", None), (8, ".,;", "xx")]
    got = collocations.collocations(docs_of(rows).repartition(3), 5, longest, best, share, group)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, longest, best, share)


def test_nothing_and_nothing_frequent(docs_of):
    assert collocations.collocations(docs_of([])).collect() == []
    assert collocations.collocations(docs_of([(1, None, None), (2, " .\n", "en")])).collect() == []
    assert collocations.collocations(docs_of([(1, "once only", "en")])).collect() == []


def test_support_is_met_over_shards(docs_of):
    """Ten documents with one occurrence each: no shard holds the whole support."""
    rows = [(i, f"rare pair {i}", "en") for i in range(10)] + [(i, f"other pair {i}", "en") for i in range(100, 109)]
    got = collocations.collocations(docs_of(rows)).collect()
    assert [(r.phrase, r.a, r.l, r.r) for r in got] == [("rare pair", 10, 10, 19)]


def test_large_counts_are_exact(spark):
    a, left, right = 3 * 10**11 + 7, 5 * 10**11 + 1, 4 * 10**11 + 3
    frequent = spark.createDataFrame([("en", 1, "x", left), ("en", 1, "y", right), ("en", 2, "x y", a)], "lang string, words int, phrase string, f bigint")
    assert [tuple(r) for r in collocations._scored(frequent, 3).collect()] == [("en", 2, "x y", a, left, right, 10**6 * a * a // (left * right))]


def test_many_words_keep_phrases_apart():
    class Many:
        words, langs = range(1 << 40), ["en"]

    import numpy as np

    many = Many()
    many.ids, many.lang = np.array([5, 1 << 39, 5, 1 << 39, 6]), np.zeros(5, np.int64)
    key = collocations._key(many, np.array([0, 1, 2]), 3 - 1)
    assert key[0] == key[2] != key[1]
