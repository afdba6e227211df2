"""Exact and near deduplication, components, mixing and URL rules."""

import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from edge_cases import EDGES
from loomtrace.llm import chunk_dedup, components, mixture, shingle_dedup, simhash, url_rules


def test_chunks_give_the_text_back(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice("sen abcd\n,.é") for _ in range(n)) for n in (0, 1, 1023, 1024, 5000, 40_000)] + ["x" * 20_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    chunks = df.select("text", F.regexp_extract_all("text", F.lit(chunk_dedup.chunk_pattern()), F.lit(0)).alias("c")).collect()
    assert all("".join(r.c) == r.text and all(len(c) <= chunk_dedup.MOST for c in r.c) for r in chunks)
    assert max(len(r.c) for r in chunks) > 10


def test_exact_groups(edges, nothing, rows_of):
    got = chunk_dedup.exact_dedup(edges).collect()
    by_text = defaultdict(list)
    for i, text, _ in EDGES:
        by_text[text or ""].append(i)
    text_of = {hashlib.sha256(t.encode()).hexdigest(): t for t in by_text}
    assert len(got) == len(EDGES)
    for r in got:
        best = max((x for x in by_text[text_of[r.text_sha256]] if x is not None), default=None)
        assert (r.group_size, r.keep_id) == (len(by_text[text_of[r.text_sha256]]), best)
    assert sum(r.kept for r in got) == len(by_text)
    assert chunk_dedup.exact_dedup(nothing).collect() == []
    kept = chunk_dedup.drop_copies(edges)
    assert kept.columns == edges.columns and sorted(r.text or "" for r in kept.collect()) == sorted(by_text)


def test_chunks_that_differ_in_the_middle(rows_of):
    text = "some words and others " * 2000
    rows = [(1, text, "a"), (2, text[:20_000] + "x" + text[20_000:], "a"), (3, text, "b")]
    got = {r.doc_id: (r.keep_id, r.kept) for r in chunk_dedup.exact_dedup(rows_of(rows)).collect()}
    assert got == {1: (3, False), 2: (2, True), 3: (3, True)}


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    values = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(v >> i & 1 for v in values) > len(values))


def brute_components(nodes, near):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_fingerprints(edges, nothing):
    got = sorted(((r.doc_id, r.fingerprint) for r in simhash.near_duplicates(edges).collect()), key=str)
    assert got == sorted(((i, f"{brute_fingerprint(t):016x}") for i, t, _ in EDGES), key=str)
    assert simhash.near_duplicates(nothing).collect() == []
    kept = simhash.drop_near_duplicates(edges)
    assert kept.columns == edges.columns
    groups = brute_components({brute_fingerprint(t) for _, t, _ in EDGES}, lambda a, b: (a ^ b).bit_count() <= 2)
    assert kept.count() == len(set(groups.values()))


@pytest.mark.parametrize("seed", [1, 2])
def test_links_are_all_pairs_within_two_bits(spark, seed):
    draw = random.Random(seed)
    prints = {0, 1, 3, 1 << 63, (1 << 64) - 1}
    for _ in range(60):
        x = draw.getrandbits(64)
        prints.add(x)
        for _ in range(draw.randint(0, 4)):
            x ^= sum(1 << b for b in draw.sample(range(64), draw.randint(1, 3)))
            prints.add(x)
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    df = spark.createDataFrame([(s,) for s in signed], "print bigint")
    got = {r.node: r.component for r in components.components(simhash.links(df)).collect()}
    want = brute_components(sorted(signed), lambda a, b: (signed[a] ^ signed[b]).bit_count() <= 2)
    assert {s: got.get(s, s) for s in signed} == want


def brute_jaccard(a, b):
    return not a and not b or len(a & b) * 5 >= len(a | b) * 4


def test_sketches_never_rule_out_a_similar_pair(spark):
    rng = np.random.default_rng(5)
    share = Fraction(shingle_dedup.SIMILARITY)
    rows = []
    for n in [0, 1, 4, 9, 60, 900, 4200, 5000]:  # 4,200 less a few has fewer bits
        for gone in sorted({0, 1, n // 9, n // 5, n // 2, n}):
            one = np.unique(rng.integers(-(2**63), 2**63, n))
            two = np.unique(np.append(one[gone:], rng.integers(-(2**63), 2**63, gone // 10)))
            shared = len(np.intersect1d(one, two))
            apart = shared * 10 < 6 * (len(one) + len(two) - shared) and n > 50
            similar = shared * 10 >= 8 * (len(one) + len(two) - shared)
            rows.append(([int(x) for x in shingle_dedup.parities(one)], [int(x) for x in shingle_dedup.parities(two)], len(one), len(two), similar, apart))
    told = spark.createDataFrame(rows, "a_odd array<bigint>, b_odd array<bigint>, n int, m int, similar boolean, apart boolean")
    got = told.select("similar", "apart", shingle_dedup._may_do(share).alias("may")).collect()
    assert all(r.may for r in got if r.similar)
    assert not any(r.may for r in got if r.apart) and any(r.similar for r in got)


def brute_shingles(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


@pytest.mark.parametrize("pivots", [0, 2])
def test_near_copies_are_all_pairs_by_jaccard(rows_of, edges, nothing, pivots):
    import corpus_pipeline

    draw = random.Random(11)
    words = ["".join(draw.choice("abcdefgh") for _ in range(4)) for _ in range(500)]
    passage, texts = draw.choices(words, k=60), ["one two", "One  two", "one two three four", "", " "]
    for _ in range(40):
        text = draw.choices(words, k=draw.randint(5, 150)) + passage * draw.randint(0, 1)
        for _ in range(draw.randint(1, 6)):
            texts.append(" ".join(text))
            text = list(text)
            for _ in range(draw.randint(1, 3)):
                text[draw.randrange(len(text))] = draw.choice(words)
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    sets = {i: brute_shingles(t) for i, t, _ in rows}
    want = set(brute_components(sorted(sets), lambda a, b: brute_jaccard(sets[a], sets[b])).values())
    kept = {r.doc_id for r in shingle_dedup.drop_near_copies(rows_of(rows), pivots=pivots).collect()}
    assert kept == want and len(want) < len(rows) - 20
    if pivots:
        assert {r.doc_id for r in corpus_pipeline.near_dedup(None, rows_of(rows[::-1]), None).collect()} == want
        kept = shingle_dedup.drop_near_copies(edges)
        assert kept.columns == edges.columns and kept.count() == len({brute_shingles(t) for _, t, _ in EDGES})
        assert shingle_dedup.drop_near_copies(nothing).collect() == []


def test_near_copies_are_candidates_by_their_fingerprints(spark):
    draw = random.Random(3)
    prints = [0, 0, 3, -1]
    for _ in range(30):
        x = draw.getrandbits(64) - (1 << 63)
        for _ in range(draw.randint(1, 4)):
            prints += [x] * draw.randint(1, 3)
            x ^= 1 << draw.randrange(63)
    nodes = {i - 50: (p, 10 + i % 7) for i, p in enumerate(prints)}
    df = spark.createDataFrame([(i, n, p) for i, (p, n) in nodes.items()], "node bigint, n int, print bigint")
    pairs = shingle_dedup.print_pairs(df).collect()
    near = lambda a, b: ((nodes[a][0] ^ nodes[b][0]) & (1 << 64) - 1).bit_count() <= 2
    got = {r.node: r.component for r in components.components(spark.createDataFrame([(r.a, r.b) for r in pairs], "a bigint, b bigint")).collect()}
    assert all(r.a < r.b and (r.n, r.m) == (nodes[r.a][1], nodes[r.b][1]) for r in pairs)
    assert {i: got.get(i, i) for i in nodes} == brute_components(sorted(nodes), near)


def test_near_copies_link_by_fingerprint_before_prefixes(rows_of, monkeypatch):
    words = [f"w{i}" for i in range(3000)]
    text, other = " ".join(words), " ".join([*words[:-1], "x"])
    assert (simhash.fingerprint(text.encode(), 5) ^ simhash.fingerprint(other.encode(), 5)).bit_count() <= 2
    seen = []
    monkeypatch.setattr(shingle_dedup, "_components", lambda rows, named, *rest: seen.extend(named.collect()) or named)
    kept = shingle_dedup.drop_near_copies(rows_of([(1, text, "a"), (2, other, "a"), (3, "another text", "a")])).collect()
    assert {r.doc_id for r in kept} == {1, 3} and len(seen) == 2


def test_prefix_puts_often_shared_values_late():
    share, nothing, often = Fraction("0.8"), np.empty(0, np.int64), np.zeros(2, np.int64)
    often[0], often[1] = 1 << 3, 1 << (70 - 64)
    got = shingle_dedup.prefix(np.arange(100), share, nothing, nothing, often).tolist()
    assert got == [0, 1, 2, *range(4, 22)] and shingle_dedup.prefix(np.arange(60, 80), share, nothing, nothing, often).tolist() == [60, 61, 62, 63, 64]
    assert shingle_dedup.prefix(np.array([3, 70, 90]), share, np.array([90]), np.array([0]), often, 9).tolist() == [3, 70, 90]


@pytest.mark.parametrize("often", [None, np.zeros(2, np.int64), np.array([-1, 5]), np.array([1, 1 << 40])])
def test_prefixes_of_similar_sets_meet(often):
    draw, share, nothing = random.Random(9), Fraction("0.8"), np.empty(0, np.int64)
    for _ in range(200):
        one = {draw.getrandbits(64) - (1 << 63) for _ in range(draw.randint(5, 60))}
        other = set(draw.sample(sorted(one), draw.randint(len(one) * 4 // 5, len(one)))) | {draw.getrandbits(64) - (1 << 63) for _ in range(draw.randint(0, 3))}
        if brute_jaccard(one, other):
            first = [set(shingle_dedup.prefix(np.array(sorted(x)), share, nothing, nothing, often).tolist()) for x in (one, other)]
            assert first[0] & first[1]


def test_long_chain_of_components(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components.components(edges).collect()
    assert len(got) == 301 and {r.component for r in got} == {0}
    assert components.components(edges.limit(0)).collect() == []


def test_mixture(edges, nothing, rows_of):
    draw = random.Random(5)
    rows = [(i, "w " * draw.randint(0, 50), "abc"[min(2, i % 5)]) for i in range(300)] + EDGES
    got = mixture.mix_sizes(rows_of(rows), span_rows=7).collect()
    assert len(got) == len(rows)
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
    assert all(taken[s] == int(target[s]) and target[s] <= 2 * size[s] for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    again = mixture.mix_sizes(rows_of(rows[::-1]).repartition(3), span_rows=50).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert mixture.mix_sizes(nothing).collect() == []
    mixed = mixture.mix_documents(rows_of(rows))
    assert mixed.columns == rows_of(rows).columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.source] += len((r.text or "").encode().split())
    assert all(abs(words[s] - taken[s]) <= 3 for s in taken)


def test_url_rules(spark, nothing):
    rules = spark.createDataFrame(
        [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/f", "block"), ("Net", "/f", "allow"), (None, "/", "block")],
        "host string, path string, action string",
    )
    urls = {
        "http://example.com/en/x": ("example.com", "/en/x", "example.com/en/", "block"),
        "http://WWW.Example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://notexample.com/en/?q=://": ("notexample.com", "/en/", "com/", "allow"),
        "x://a.net/foo/bar#frag": ("a.net", "/foo/bar", "net/f", "block"),
        "x://net?/f": ("net", "", None, "allow"),
        "x://com": ("com", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "x://a..b.com./f": ("a..b.com.", "/f", None, "allow"),
        "x://" + "a." * 2000 + "com/" + "p/" * 2000: ("a." * 2000 + "com", "/" + "p/" * 2000, "com/", "allow"),
    }
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate([*urls, *urls])], "page_id bigint, url string, host string, action int")
    got = {r.page_id: tuple(r)[1:] for r in url_rules.judge(pages, rules).collect()}
    assert got == dict(enumerate([*urls.values(), *urls.values()]))
    assert {r.verdict for r in url_rules.judge(pages, rules.limit(0), "block").collect()} == {"block"}
    assert url_rules.judge(pages.limit(0), rules).collect() == []
