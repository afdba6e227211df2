"""Children and roll-up of tasks against all pairs and all paths."""

import random

import pytest
from pyspark.sql import functions as F

from loomtrace.functions import covered as C
from loomtrace.operators import tasks as T
from loomtrace.operators.session_metrics import TOKENS

NAMES = list(TOKENS)


def frame(spark, rows):
    """Tasks from (session, started_seq, end_seq, thread, parent thread, own tokens, ms)."""
    df = spark.createDataFrame(rows, "session_id string, started_seq bigint, end_seq bigint, thread_id string, parent_thread_id string, own bigint, ms bigint")
    own = [C.known(F.col("own") * (i + 1)).alias(f"own_{n}") for i, n in enumerate(NAMES)]
    key = F.concat_ws("|", "session_id", "started_seq").alias("task_key")
    return df.select("session_id", "started_seq", "end_seq", "thread_id", "parent_thread_id", key, *own, C.known(F.col("ms")).alias("total_ms"))


def brute_edges(rows):
    return [
        (p, c) for p in rows for c in rows
        if p[0] == c[0] and p[3] is not None and p[3] == c[4] and p[1] <= c[1] <= p[2] and p[1] != c[1]
    ]


def brute_rollup(rows):
    below = {}
    for p, c in brute_edges(rows):
        below.setdefault(p[:2], []).append(c)

    def paths(task):
        yield 0, task
        for child in below.get(task[:2], []):
            for depth, node in paths(child):
                yield depth + 1, node

    def add(values):
        known = [v for v in values if v is not None]
        return sum(known) if known else None

    out = {}
    for t in rows:
        found = list(paths(t))
        ms = [c[6] for c in below.get(t[:2], [])]
        state = "unknown" if add(ms) is None else "known" if None not in ms else "partial"
        out[t[:2]] = (add([n[5] for _, n in found]), add([n[5] for d, n in found if d]), add(ms), state)
    return out


def rolled(spark, rows, span):
    got = C.flatten_covered(T.task_rollup(frame(spark, rows), span).select("session_id", "started_seq", *NAMES, "spawn_agent", "spawn_agent_ms")).collect()
    for r in got:
        for i, n in enumerate(NAMES):
            assert r[n] == (None if r[NAMES[0]] is None else r[NAMES[0]] * (i + 1))
    factor = NAMES.index("total") + 1
    return {(r.session_id, r.started_seq): (r[NAMES[0]], r.spawn_agent and r.spawn_agent // factor, r.spawn_agent_ms, r.spawn_agent_ms_coverage) for r in got}


@pytest.mark.parametrize("span", [5, 1_000_000])
def test_overlapping_tasks_and_several_paths(spark, span):
    draw = random.Random(span)
    rows = []
    for s in "ab":
        for seq in sorted(draw.sample(range(60), 22)):
            thread = draw.choice(["t0", "t1", "t2", "t3", None])
            above = {"t1": ["t0"], "t2": ["t0", "t1"], "t3": ["t2", "t3"]}.get(thread, [None])
            rows.append((s, seq, seq + draw.choice([-1, 0, 5, 30, 70]), thread, draw.choice(above), draw.choice([None, 1, 10, 100]), draw.choice([None, 3, 4])))
    df = frame(spark, rows)
    got = {(r.session_id, r.parent_seq, r.child_seq, r.parent_key, r.child_key) for r in T.task_children(df, span).collect()}
    edges = brute_edges(rows)
    assert len(edges) > 15 and got == {(p[0], p[1], c[1], f"{p[0]}|{p[1]}", f"{c[0]}|{c[1]}") for p, c in edges}
    assert rolled(spark, rows, span) == brute_rollup(rows)


def test_wide_parent_spreads_over_spans(spark):
    n = 30_000
    rows = [("s", 0, n + 5, "root", None, 1, 2)] + [("s", i, i, f"t{i % 7}", "root", i, 1) for i in range(1, n + 1)]
    got = rolled(spark, rows, 1_000)
    assert got["s", 0] == (1 + n * (n + 1) // 2, n * (n + 1) // 2, n, "known")
    assert T.task_children(frame(spark, rows), 1_000).count() == n


def test_no_tasks(spark):
    empty = frame(spark, [("s", 0, 1, "t", None, 1, 1)]).limit(0)
    assert T.task_children(empty).collect() == [] and T.task_rollup(empty).collect() == []
