"""Text of single events, from canonical payloads and from session logs."""

import json

import pytest
from pyspark.sql import functions as F

from loomtrace.operators import timeline
from loomtrace.operators.event_text import event_summary, told

LONG = "word " * 60
CASES = [
    ("task.completed", {"last_agent_message": "all  done"}, "done: all done"),
    ("task.completed", {"turn_id": "t"}, "done"),
    ("task.started", {"collaboration_mode_kind": " plan ", "turn_id": "t1", "model_context_window": 200000}, "started: mode=plan turn=t1 window=200000"),
    ("message.agent", {"text": LONG}, (LONG[:97] + "...")),
    ("agent.session", {"agent_role": "worker", "agent_nickname": "", "cwd": "/w"}, "ready: role=worker cwd=/w"),
    ("agent.session.foreign", {"foreign_thread_id": "f"}, "foreign session meta: thread=f"),
    ("agent.meta", {"meta_type": "turn_context", "cwd": "/w"}, "turn context: cwd=/w"),
    ("agent.meta", {}, "meta meta"),
    ("runtime.context", {"cwd": "/w", "model": "m", "collaboration_mode": {"mode": "plan"}}, "context: cwd=/w model=m mode=plan"),
    ("context.compacted", {"replacement_history": [1, 2], "message": " kept "}, "context compacted: items=2 message=kept"),
    ("info.tokens", {"input_tokens": 1234567, "total_tokens": "many"}, "tokens: input: 1 234 567, total: many"),
    ("shell.call", {"tool_name": "exec_command", "input": {"cmd": " ls  -l\ncat x "}}, "command [exec_command]: ls -l\ncat x"),
    ("shell.call", {"tool_name": "exec_command", "actor_type": "subagent", "input": {"cmd": "ls"}}, "tool exec_command: ls"),
    ("shell.result", {"tool_name": "exec_command", "exit_code": 1, "output": {"stderr": " ", "stdout": {"message": "no\nfile"}}}, "command fail [exec_command]: exit=1 -> no file"),
    ("tool.result", {"tool_name": "build", "status": "failed", "error": "bad"}, "tool result [build]: bad"),
    ("tool.result", {"tool_name": "build", "status": "completed", "error": "bad"}, "tool result [build]"),
    ("tool.result", {"tool_name": "build", "actor_type": "subagent", "output": [1]}, "result build: [1]"),
    ("collab.spawn_agent", {"tool_name": "spawn_agent", "phase": "completed", "prompt": " go ", "receiver_thread_ids": ["a", "b"], "agents_states": {"b": {"status": "ok"}, "c": 1}},
     "subagent launch [spawn_agent]: phase=completed prompt=go agents=a,b states=b:ok"),
    ("web.search", {"tool_name": "web_search", "input": {}}, "search [web_search]: query=<pending>"),
    ("web.open", {"tool_name": "web_search", "phase": "completed", "output": {"query": "u", "action": {"type": "open_page", "url": "u"}}}, "open page result [web_search]: url=u"),
    ("mcp.call", {"phase": "started", "arguments": {"b": 1, "a": None}, "server": "s", "tool": "t"}, 'mcp call: phase=started arguments={"a":null,"b":1} server=s tool=t'),
    ("mcp.result", {"result": None, "error": "e"}, "mcp result: error=e"),
    ("stdin.write", {"input": {"session_id": None, "chars": " y "}, "output": "a\nb"}, "stdin write: session_id=null chars=y output=a b"),
    ("todo.update", {"items": [{"text": "a", "completed": True}, {"text": "b"}], "completed_count": 1, "total_count": 2, "phase": "updated"}, "todo updated: 1/2 next=b"),
    ("todo.update", {"tool_name": "update_plan", "input": {"plan": [1], "explanation": " x "}}, "todo update: explanation=x steps=1"),
    ("user.input.request", {"input": {"questions": [{"header": 5, "question": "q"}]}, "output": {"answers": {"a": {"answers": [1, 2]}, "b": " ", "c": [3]}}}, "user input request: questions=1 answers=3"),
    ("patch.apply", {"status": "completed", "input": "*** Update File: b.rs\n*** Add File: a.rs"}, "patch apply: status=completed file=b.rs (+1)"),
    ("patch.apply", {"changes": {}, "output": "unread"}, "patch apply: files=0"),
    ("file.change", {"changes": [{"path": "p"}, {"kind": "add"}]}, "files: change p (+1)"),
    ("file.change", {}, "files changed"),
    ("stderr.line", {"text": "t"}, "stderr: t"),
    ("error", {"message": "m", "text_links": {"status_code": 503, "host": "h", "is_fallback": False, "fallback_to": "x"}}, "error: m [status=503 host=h]"),
    ("agent.failed", {"error": {"message": "e"}}, "agent failed: e"),
    ("agent.aborted", {"reason": "r"}, "agent aborted: reason=r"),
    ("thread.started", {}, "thread.started"),
]


@pytest.fixture(scope="module")
def lines(spark):
    from loomtrace.sources.logs import canonical_rows, flat_events

    values = [(json.dumps({"seq": i, "run_id": "r", "event_type": kind, "payload": payload}),) for i, (kind, payload, _) in enumerate(CASES)]
    return flat_events(canonical_rows(spark.createDataFrame(values, "value string")))


def test_text_of_each_type(lines):
    found = {r["seq"]: r["summary"] for r in event_summary(lines).select("seq", "summary").collect()}
    assert [(found[i], text) for i, (_, _, text) in enumerate(CASES) if found[i] != text] == []


def test_full_text_is_not_cut(lines):
    found = {r["seq"]: r["summary"] for r in event_summary(lines, full=True).select("seq", "summary").collect()}
    assert found[3] == LONG.strip() and found[0] == "done: all  done"


def test_told_descends_to_any_depth(spark):
    deep = '{"stderr":"","output":{"error":null,"message":' * 8 + '"core"' + "}}" * 8
    rows = spark.createDataFrame([(deep,), ('{"x":1}',), ('" a "',), ("null",), ("7",), ("[ ]",)], "value string")
    assert [r[0] for r in rows.select(told(F.parse_json("value"))).collect()] == ["core", '{"x":1}', "a", None, "7", "[]"]


def test_timeline_words_its_last_entries_only(spark, monkeypatch):
    rows = [(run, seq, "t", "error") for run in ("a", None) for seq in range(30)] + [("b", None, "t", "error"), ("b", 3, "t", "error")]
    events = spark.createDataFrame(rows, "run_id string, seq bigint, ts string, event_type string")
    worded = []
    monkeypatch.setattr(timeline, "event_summary", lambda df: worded.append(df.count()) or df.withColumn("summary", F.concat(F.lit("s"), "seq")))
    got = {(r.run_id, r.position): (r.seq, r.label) for r in timeline.run_timeline(events).collect()}
    assert worded == [26] and got[("a", 1)] == got[(None, 1)] == (29, "s29") and got[("a", 12)] == (18, "s18")
    assert got[("b", 1)] == (3, "s3") and got[("b", 2)] == (None, None) and len(got) == 26
