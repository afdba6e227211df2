"""Search against brute force; classifiers on labels they have not seen; the pipeline's stages."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomtrace.llm import cover_topk, quality, queries, toxicity

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("clustered", [True, False])
def test_dual_search(clustered):
    draw = np.random.default_rng(4)
    points = draw.integers(-60, 60, (1500, 6))
    if clustered:
        points = points[:20][draw.integers(0, 20, 1500)] * 20 + draw.integers(-3, 4, (1500, 6))
    points[1000:1100] = points[0]
    queries_, ids = points[::9] + draw.integers(-1, 2, (167, 6)), draw.permutation(1500)
    top, named = cover_topk.dual_search(queries_, np.full(167, cover_topk.LEAST), points, ids, 7)
    score, want = cover_topk.best(queries_ @ points.T, np.broadcast_to(ids, (167, 1500)), 7)
    assert (top == score).all() and (named == want).all()
    top, named = cover_topk.dual_search(queries_, score[:, -1], points, ids, 7)
    assert (top == score).all() and (named == want).all()


def test_search_edges(spark):
    draw = random.Random(6)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(4)], 1) for i in range(60)]
    rows += [(60, None, 1), (61, [1.0, None, 0.0, 0.0], 1), (62, [float("nan")] * 4, 1), (63, [float("inf")] * 4, 1), (64, [], 1), (0, rows[0][1], 2), (80, [1.0, 2.0], 1), (None, rows[5][1], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int")
    got = sorted(tuple(r) for r in cover_topk.top_k(df, k=5, every=20).collect())
    clean = [(i, np.floor(1024 * np.array(np.float32(v), float)).astype(int)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all()]
    want = set()
    for n, (i, q) in enumerate(clean):
        if i is not None and i % 20 == 0:
            others = sorted((-int(q @ c), 1e99 if j is None else j, j) for m, (j, c) in enumerate(clean) if m != n and len(c) == len(q))[:5]
            want |= {(i, r + 1, j, -s) for r, (s, _, j) in enumerate(others)}
    assert got == sorted(want)
    assert cover_topk.top_k(df.limit(0)).collect() == []


def held_out(spark, name, label):
    scored = queries.QUERIES[name](spark, SF_DIR)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert scored.count() == docs.count() and scored.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = scored.filter("held_out").join(labels, "doc_id").collect()
    score, y = np.array([r.score for r in rows]), np.array([r.y for r in rows])
    rank = np.argsort(np.argsort(score)) + 1
    ones = int(y.sum())
    return (rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


def test_quality_of_unseen_labels(spark):
    assert held_out(spark, "op9_quality", "quality") > 0.95


def test_toxicity_of_unseen_labels(spark):
    assert held_out(spark, "op3_toxicity", "toxic") > 0.75


def insults(rows_of, spark, bad=("scoundrel", "nincompoop"), n=600):
    draw = random.Random(7)
    words = ["".join(draw.choice("aeioulmnrst") for _ in range(draw.randint(2, 8))) for _ in range(400)]
    said, marks = [], []
    for i in range(n):
        text = [draw.choice(words) for _ in range(40)]
        if toxic := i % 5 == 0:
            text[draw.randrange(40)] = draw.choice(bad)
        said.append((i, " ".join(text) + ".", "s"))
        marks.append((i, 1, int(toxic)))
    return rows_of(said), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int"), words


def test_insults_with_gaps_and_inserted_characters(rows_of, spark):
    docs, labels, words = insults(rows_of, spark)
    model = toxicity.fit(docs, labels)
    clean = " ".join(words[:50])
    bad = model.scores(iter([f"{clean} {x} {clean}" for x in ("scoundrel", "SCOUNDREL", "scoundr1el", "nincom1poop", "s c o u n d r e l", "n.i.n.c.o.m.p.o.o.p", "ninc-om*poop", "nincompooop")]))
    good = model.scores(iter([clean, "", ". . .", "a b c", clean * 100]))
    assert min(bad) >= 0.3 > max(good)
    gapped = ("s - c - o - u - n - d - r - e - l", "s * c * o * u * n * d * r * e * l", "\n".join("scoundrel"), "\n\n".join("scoundrel"), "s.c.o. u.n.d. r.e.l", "s   c    o     u n d r e l")
    assert min(model.scores(iter([f"{clean} {x} {clean}" for x in gapped]))) >= 0.3


SHORT = ["idiot", "moron", "clown", "trash", "loser", "scum", "stupid", "rascal", "fool", "jerk"]


def test_short_insults_with_strange_characters(rows_of, spark):
    docs, labels, words = insults(rows_of, spark, SHORT, 3000)
    model = toxicity.fit(docs, labels)
    clean = " ".join(words[:50])
    forms = {x for w in SHORT for i in range(1, len(w)) for x in (w[:i] + "0" + w[i:], w[:i] + "00" + w[i:], w[:i] + "x" + w[i:], w[:i] + "4" + w[i + 1 :])}
    forms |= {"idi00t", "1diot", "cl0wn", "l0ser", "sc0um", "tra00sh", "s.c.0.u.m", "l o 0 s e r"}
    scores = dict(zip(sorted(forms), model.scores(iter([f"{clean} {x} {clean}" for x in sorted(forms)]))))
    assert not [x for x, score in scores.items() if score < 0.3]
    assert max(model.scores(iter([" ".join(words[i : i + 50]) for i in range(0, 400, 50)] + ["", "crown crash lover scam motion rapid reveal foil park"]))) < 0.3


def test_words_spelled_out():
    spell = toxicity.spelled
    for text in ("s - c - u - m", "s * c * u * m", "s\nc\nu\nm", "s.c. u.m", "so s     c u m", "s_c_u_m!", "s -\nc u m"):
        assert spell(text) == ["scum"]
    assert spell("") == spell("a b") == spell("ab cd ef") == spell("a - - b - - c") == []
    assert spell("a b c and d e f - g") == ["abc", "defg"]
    old = re.compile(r"(?<![^\W_])[^\W_](?:[\W_]{1,3}[^\W_](?![^\W_])){2,}")  # the rule before tokens were looked up once
    draw = random.Random(9)
    for _ in range(3000):
        text = "".join(draw.choice("abé1 -._") for _ in range(30))
        if "  " not in text:
            assert spell(text) == ["".join(re.findall(r"[^\W_]", x)) for x in old.findall(text)]


def test_classifiers_on_edges(edges, nothing, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, 1), (4, None, None), (5, 1, 1), (999, 0, 0)], "doc_id bigint, quality int, toxic int")
    for operator in (quality, toxicity):
        assert {r.score for r in operator.score_documents(edges, none).collect()} == {0.5}
        rows = operator.score_documents(edges, odd).collect()
        assert len(rows) == edges.count() and all(0 <= r.score <= 1 for r in rows)
        assert operator.score_documents(nothing, odd).collect() == []
    assert toxicity.drop_toxic(edges, none).columns == edges.columns


def test_trees_learn_an_exclusive_or():
    draw = np.random.default_rng(8)
    x = draw.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) != (x[:, 1] > 0)).astype(float)
    model = quality.train(x[:1500], y[:1500], 0.5)
    assert ((model.scores(x[1500:]) > 0.5) == (y[1500:] == 1)).mean() > 0.95
    one = quality.train(x[:10], np.ones(10), 0.9)
    assert np.allclose(one.scores(x[:3]), 0.9) and len(model.scores(x[:0])) == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, SF_DIR))
        count = docs.count()
        if name == "exact dedup":
            assert count == docs.select("text").distinct().count()
        if name == "mixture":
            assert count > before
        elif name != "encode":
            assert 0.8 * before < count <= before
        if name != "encode":
            assert docs.columns == columns
        before = count
    assert corpus_pipeline.run(spark, SF_DIR).count() == before
