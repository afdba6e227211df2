"""Pointer doubling against walks over the parents."""

import random

import pytest
from pyspark.sql import functions as F

from loomtrace.operators import threads
from loomtrace.operators import trees as R
from loomtrace.operators.normalize import legacy_states
from loomtrace.operators.timeline import thread_recent_lines


def brute(rows):
    """(session, thread) -> depth, way, children, first below, size, preorder of rows (session, thread, parent, first, position)."""
    kids, out = {}, {}
    for s, t, p, first, position in sorted(rows, key=lambda r: r[4]):
        kids.setdefault((s, p), []).append((t, first))

    def walk(s, t, first, way, count):
        way, start = [*way, t], next(count)
        low, size = [first], 1
        for kid, kid_first in kids.get((s, t), []):
            below, n = walk(s, kid, kid_first, way, count)
            low, size = low + below, size + n
        known = [x for x in low if x is not None]
        out[s, t] = (len(way) - 1, way, len(kids.get((s, t), [])), min(known, default=None), size, start)
        return low, size

    for s in {r[0] for r in rows}:
        count = iter(range(10**9))
        for t, first in kids.get((s, None), []):
            walk(s, t, first, [], count)
    return out


def index(spark, rows):
    return spark.createDataFrame(rows, "session_id string, thread_id string, parent_thread_id string, first_seq bigint, position bigint")


def numbered(rows):
    seen, out = {}, []
    for s, t, p, first in rows:
        seen[s, p] = seen.get((s, p), -1) + 1
        out.append((s, t, p, first, seen[s, p]))
    return out


def forest(seed):
    draw, rows = random.Random(seed), []
    for s in "ab":
        for i in range(60):
            rows.append((s, f"t{i}", None if i < 3 else f"t{draw.randrange(max(0, i - 8), i)}", draw.choice([None, draw.randrange(1000)])))
        rows += [(s, "c1", "c2", 1), (s, "c2", "c1", 2), (s, "c3", "c1", 3)]  # a cycle and what hangs on it
    return numbered(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_of_forests_with_cycles(spark, seed):
    rows = forest(seed)
    got = threads.thread_paths(threads.thread_closure(index(spark, rows))).collect()
    assert {(r.session_id, r.thread_id): (r.depth, r.way, r.children, r.first_below, r.size, r.preorder) for r in got} == brute(rows)


def test_chain_takes_log_rounds(spark, monkeypatch):
    n, cuts = 3000, []
    nodes = spark.range(n).select(F.lit("s").alias("k"), F.col("id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("up"))
    real = R.cut_lineage
    monkeypatch.setattr(R, "cut_lineage", lambda df: cuts.append(1) or real(df))
    got = R.depths(nodes, ["k"], "id", "up")
    assert got.where("depth = id").count() == n and len(cuts) <= 14


def test_star_and_nothing(spark):
    rows = numbered([("s", "root", None, 5)] + [("s", f"t{i}", "root", 4 if i == 7 else 9) for i in range(500)])
    got = {r.thread_id: r for r in threads.thread_closure(index(spark, rows)).collect()}
    assert (got["root"].children, got["root"].size, got["root"].first_below) == (500, 501, 4) and got["t499"].preorder == 500
    assert threads.thread_closure(index(spark, rows).limit(0)).collect() == []


def test_reported_states_come_after_the_receivers_of_their_event(spark, events_of):
    reported = [("b", "failed", "gave up"), ("c", None, "hello")]
    rows = events_of([
        {"seq": 0, "ts": "2026-04-08T10:00:00Z", "event_type": "thread.started", "thread_id": "root"},
        {"seq": 1, "event_type": "collab.wait", "thread_id": "root", "status": "completed", "receiver_thread_ids": ["b", "c"], "agents_states": reported},
        {"seq": 2, "event_type": "collab.wait", "thread_id": "root", "agents_states": [("b", "running", "unheard")]},
    ])
    found = {r["thread_id"]: (r["status"], r["parent_thread_id"]) for r in threads.thread_state(rows, F.lit("root")).collect()}
    assert found == {"root": ("running", None), "b": ("failed", "root"), "c": ("completed", "root")}
    lines = {(r["thread"], r["line"]) for r in thread_recent_lines(rows).collect()}
    assert lines == {("b", "gave up"), ("c", "hello")}


def test_end_messages_of_session_logs_report_states(spark):
    said = {
        "collab_waiting_end": '{"statuses":{"b":{"status":"ok","message":"m"},"a":"text","c":{"completed":"x"}},"agent_statuses":[{"thread_id":"z"}]}',
        "collab_agent_spawn_end": '{"new_thread_id":"n","status":{"pending_init":null}}',
        "collab_close_end": '{"receiver_thread_id":"r","status":"shutdown"}',
        "collab_agent_interaction_end": '{"receiver_thread_id":"r","status":{"status":"done","message":"bye"}}',
        "exec_command_end": '{"receiver_thread_id":"r"}',
    }
    rows = spark.createDataFrame(list(said.items()), "kind string, value string").withColumn("p", F.parse_json("value"))
    found = {r["kind"]: r["s"] and [tuple(x) for x in r["s"]] for r in rows.select("kind", legacy_states(F.col("p"), F.col("kind")).alias("s")).collect()}
    assert found == {
        "collab_waiting_end": [("b", "ok", "m"), ("c", None, None)], "collab_agent_spawn_end": [("n", None, None)],
        "collab_close_end": [("r", "shutdown", None)], "collab_agent_interaction_end": [("r", "done", "bye")], "exec_command_end": None,
    }
