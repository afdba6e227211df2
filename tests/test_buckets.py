"""States kept by bucket, array files put together from lines, and tasks of bounded rows."""

import json

import pandas as pd
from pyspark.sql import functions as F

from loomtrace.operators import ordered
from loomtrace.sources import logs as L
from loomtrace.streaming import tail as T


class Held:
    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_keys_of_one_bucket_share_one_call():
    columns = ["session_id", "call_id", "chunk", "place", "called"]
    step = T._by_key(T._name_call, 2, columns, ["session_id", "call_id", "chunk", "place", "call_name"], ["chunk", "place"])
    first = [("a", "c", 1, 1, None), ("a", "c", 1, 0, "grep"), ("b", "c", 1, 0, "ls"), (None, "c", 1, 0, None)]
    state = Held()
    told = [x for frame in step((), iter([pd.DataFrame(first, columns=columns)]), state) for x in frame.itertuples(index=False, name=None)]
    assert sorted(told, key=str) == sorted([("a", "c", 1, 0, None), ("a", "c", 1, 1, "grep"), ("b", "c", 1, 0, None), (None, "c", 1, 0, None)], key=str)
    assert len(json.loads(state.get[0])) == 3
    again = pd.DataFrame([("b", "c", 2, 0, None), ("a", "c", 1, 0, None)], columns=columns)
    told = [x for frame in step((), iter([again]), state) for x in frame.itertuples(index=False, name=None)]
    assert sorted(told) == [("a", "c", 1, 0, None), ("b", "c", 2, 0, "ls")]  # a's chunk fell back, so its name is forgotten


def test_operations_of_one_bucket():
    fields = ["k", "mutable", *T.OPERATION_FIELDS[-9:]]
    columns = ["k", "seq", "event_type", "event_phase", "status", "is_terminal", "mutable", "preference"]
    step, state, big = T._by_key(T._fold_operation, 1, columns, fields, ["seq"]), Held(), (1 << 60) + 1
    rows = [("x", big + 1, "b", "completed", "ok", True, False, 0), ("x", big, "a", "started", None, False, False, 0), ("y", 5, "a", None, None, False, True, 0)]
    (out,) = step((), iter([pd.DataFrame(rows[:2], columns=columns), pd.DataFrame(rows[2:], columns=columns)]), state)
    got = {r.k: r for r in out.itertuples()}
    assert (got["x"].revision, got["x"].started_seq, got["x"].terminal_seq, got["x"].last_status) == (2, big, big + 1, "ok")
    assert got["y"].terminal_seq is None and got["y"].mutable
    late = pd.DataFrame([("x", big + 2, "c", None, None, False, False, 0)], columns=columns)
    assert list(step((), iter([late]), state)) == []


def test_driver_learns_no_array_paths(spark, tmp_path):
    texts = {"good": '[{"seq":1},\r\n{"seq":2},]\n', "bad": ' \n[{"seq":3},\r\n\r{"seq"\n', "lines": '{"seq":4}\r{"seq":5}\r\n'}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_bytes(text.encode())
    rows = L.scan_event_array(spark, str(tmp_path))
    assert not [f for f in rows.inputFiles() if str(tmp_path) in f]
    found = rows.select("seq", "parse_status", F.try_variant_get("payload", "$.raw_line", "string").alias("raw")).collect()
    assert sorted((r.seq, r.raw) for r in found if r.parse_status == "parsed") == [(1, None), (2, None), (4, None), (5, None)]
    assert [r.raw for r in found if r.parse_status == "unparsed"] == [texts["bad"]]


def test_tasks_of_bounded_rows(spark):
    table = spark.range(1000).select((F.col("id") % 3).alias("k"), "id", F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    assert ordered.enough_parts(table) is None and ordered.enough_parts(table, 50) == 20
    make = lambda parts: ordered.carry(table, ["k"], "id", {"last": F.col("v")}, span=10, parts=parts)
    assert sorted(make(None).collect()) == sorted(make(20).collect())
    assert "hashpartitioning(k" in (plan := make(20)._jdf.queryExecution().executedPlan().toString()) and ", 20)" in plan
