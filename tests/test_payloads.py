"""Typed views of payloads, by hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from loomtrace.functions import json as J
from loomtrace.operators import payloads as P

CASES = [
    ("tool.call", {"tool_name": "sh", "input": {"a": [1]}, "receiver_thread_ids": ["x", "y"], "other": 1}, "tool_call", None,
     {"tool_name": "sh", "input": '{"a":[1]}', "receiver_thread_ids": ["x", "y"], "status": None}),
    ("tool.call", {"status": None}, "tool_call", None, {"tool_name": "unknown", "status": None}),
    ("tool.call", {"tool_name": None}, "value", "tool_name", None),
    ("tool.call", {"tool_name": 7}, "value", "tool_name", None),
    ("tool.call", {"receiver_thread_ids": ["x", 1]}, "value", "receiver_thread_ids", None),
    ("tool.call", {"receiver_thread_ids": [], "agents_states": {"t": 1}}, "tool_call", None, {"receiver_thread_ids": [], "agents_states": '{"t":1}'}),
    ("shell.result", {"exit_code": -1, "output": "text"}, "tool_result", None, {"exit_code": -1, "output": '"text"', "tool_name": "unknown"}),
    ("shell.result", {"exit_code": "1"}, "value", "exit_code", None),
    ("shell.result", {"exit_code": 1 << 31}, "value", "exit_code", None),
    ("info.tokens", {"input_tokens": 5, "total_tokens": None, "rate_limits": [1]}, "info_tokens", None, {"input_tokens": 5, "total_tokens": None, "rate_limits": "[1]"}),
    ("info.tokens", {"input_tokens": -1}, "value", "input_tokens", None),
    ("info.tokens", {"input_tokens": 1.5}, "value", "input_tokens", None),
    ("message.user", {}, "agent_message", None, {"text": "", "role": None}),
    ("message.user", {"text": "x", "text_links": {"url": "u", "status_code": 70000, "host": 4}}, "value", "text_links", None),
    ("agent.failed", {"text_links": {"url": "u", "status_code": 404, "host": 4}}, "agent_turn", None, {"text_links": {"url": "u", "status_code": 404, "host": None}}),
    ("error", {"text_links": {"status_code": 65537, "reconnect_limit": -1}}, "error", None, {"text_links": {"status_code": 1, "reconnect_limit": None}}),
    ("error", {"text_links": "u"}, "value", "text_links", None),
    ("file.change", {"changes": [{"kind": "add", "path": "p"}, 5, {"path": 3}]}, "file_change", None, {"changes": [{"kind": "add", "path": "p"}, {"kind": "", "path": ""}]}),
    ("file.change", {"changes": "none"}, "file_change", None, {"changes": []}),
    ("todo.update", {"items": [{"text": "t", "completed": True}, {"completed": 1}], "completed_count": 1}, "todo_update", None,
     {"items": [{"text": "t", "completed": True}, {"text": "", "completed": False}], "completed_count": 1, "total_count": 0}),
    ("todo.update", {"tool_name": "update_plan"}, "tool_result", None, {"tool_name": "update_plan"}),
    ("todo.update", {"input": None}, "tool_result", None, {"tool_name": "unknown"}),
    ("error", {"message": "m", "is_fallback": True, "reconnect_limit": 3}, "error", None, {"message": "m", "is_fallback": True, "reconnect_limit": 3}),
    ("error", {"is_fallback": "yes"}, "value", "is_fallback", None),
    ("task.started", {"meta_type": "task_started", "turn_id": "t"}, "agent_meta", None, {"meta_type": "task_started"}),
    ("task.started", {}, "agent_meta", None, {"meta_type": "meta"}),
    ("stderr.line", {"text": "e"}, "stderr", None, {"text": "e"}),
    ("user.input.request", {"text": "e"}, "value", None, None),
    ("tool.call", [1], "value", None, None),
]


@pytest.fixture(scope="module")
def shredded(spark):
    rows = [(i, t, json.dumps(p)) for i, (t, p, *_) in enumerate(CASES)] + [(len(CASES), "tool.call", None)]
    df = spark.createDataFrame(rows, "i int, event_type string, p string").withColumn("payload", F.parse_json("p"))
    got = P.typed_payloads(df)
    text = [F.to_json(f"as_{view}", {"ignoreNullFields": "false"}).alias(view) for view in P.VIEWS]
    return {r["i"]: r for r in got.select("i", "payload_view", "payload_error", *text).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_views(shredded, i):
    _, _, view, error, fields = CASES[i]
    row = shredded[i]
    assert (row["payload_view"], row["payload_error"]) == (view, error)
    filled = [v for v in P.VIEWS if row[v] is not None]
    assert filled == ([] if view == "value" else [view])
    if fields:
        got = json.loads(row[view])
        for name, value in fields.items():
            have = got[name]
            if isinstance(value, str) and not isinstance(have, str):
                have, value = have, json.loads(value)
            if isinstance(value, dict):
                have = {k: have[k] for k in value}
            assert have == value or json.dumps(have) == value


def test_no_payload_has_no_view(shredded):
    row = shredded[len(CASES)]
    assert row["payload_view"] == "value" and row["payload_error"] is None


def test_every_type_has_one_view():
    types = [t for names in P.VIEW_OF.values() for t in names.split()]
    assert len(types) == len(set(types)) and set(P.VIEW_OF) <= set(P.VIEWS)


def test_objects_are_told_without_the_types_of_their_fields(spark):
    texts = ["{}", '{"a":{"b":[1,"x"]}}', "[]", '[{"a":1}]', '"{}"', "1", "1.5", "true", "null", None]
    trees = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.parse_json("t").alias("tree"))
    told = trees.select("i", J.is_object(F.col("tree")).alias("o"))
    assert {r.i: r.o for r in told.collect()} == {i: i < 2 for i in range(len(texts))}
    assert "SchemaOfVariant" not in told._jdf.queryExecution().executedPlan().toString()
