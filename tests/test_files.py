"""Readers and the tail on real files."""

import json

import pytest

from loomtrace.operators.normalize import normalize_session, normalize_stdout, parse_lines
from loomtrace.session import cut_lineage
from loomtrace.sources import logs as L
from loomtrace.sources import metrics_store as S
from loomtrace.streaming import tail as T


def write(path, lines, end="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(end.join(x if isinstance(x, str) else json.dumps(x) for x in lines) + end)


def record(kind, payload, second=0):
    return {"timestamp": f"2026-04-07T10:00:{second:02d}Z", "type": kind, "payload": payload}


def test_lines_are_numbered_across_splits(spark, tmp_path):
    for name in "ab":
        write(tmp_path / f"{name}.jsonl", [x for i in range(1, 900) for x in (f"{name} line {i} {'x' * 40}", "")], "\r\n" if name == "b" else "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = L.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 2 * 899
    assert all(r.value.split()[2] == str(r.seq) and not r.value.endswith("\r") for r in rows)


def test_listing_takes_no_task_a_folder(spark, tmp_path):
    names = [f"{i:03d}" for i in range(100)]
    for name in names:
        write(tmp_path / f"session_id={name}" / "part.jsonl", [name, name])
    before = {key: spark.conf.get(key, None) for key in ("spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.openCostInBytes")}
    context = spark.sparkContext
    context.setJobGroup("listing", "listing")
    try:
        rows = L.read_lines(spark, str(tmp_path)).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    told = context.statusTracker()
    stages = [told.getStageInfo(s) for job in told.getJobIdsForGroup("listing") for s in told.getJobInfo(job).stageIds]
    assert max(s.numTasks for s in stages if s) <= 8 * context.defaultParallelism < 100
    assert sorted((r.value, r.seq) for r in rows) == [(name, seq) for name in names for seq in (1, 2)]
    assert before == {key: spark.conf.get(key, None) for key in before}


def test_session_file_to_events(spark, tmp_path):
    path = tmp_path / "sessions" / "2026" / "rollout-2026-04-07T10-00-00-abc-1.jsonl"
    content = [{"type": "output_text", "text": "done\n"}]
    write(path, [
        record("session_meta", {"id": "abc-1", "cwd": "/w", "source": {"subagent": {"thread_spawn": {"parent_thread_id": " p1 "}}}}),
        record("response_item", {"type": "function_call", "name": "spawn_agent", "call_id": "c1", "arguments": '{"message":"go"}'}),
        record("response_item", {"type": "function_call_output", "call_id": "c1", "output": '{"agent_id":"kid","nickname":"N"}'}),
        record("response_item", {"type": "message", "role": "assistant", "content": content}),
        record("event_msg", {"type": "agent_message", "message": "done"}),
        record("compacted", {"message": "m"}),
        record("event_msg", {"type": "context_compacted"}),
        record("session_meta", {"id": "other"}),
        "{broken",
        '{"type":"event_msg","payload":{"type":"user_message"}} trailing',
    ])
    found = L.discover_session_files(spark, str(tmp_path)).first()
    assert (found.session_id, found.diagnostic) == ("abc-1", None)
    bronze = cut_lineage(parse_lines(L.session_lines(spark, str(tmp_path))))
    events = {r.seq: r for r in normalize_session(bronze).collect()}
    kinds = {seq: r.event_type for seq, r in events.items()}
    assert kinds == {
        1: "agent.session", 2: "collab.spawn_agent", 3: "collab.spawn_agent", 4: "message.assistant", 6: "context.compacted",
        7: "context.compacted.duplicate", 8: "agent.session.foreign", 9: "raw.unparsed", 10: "raw.unparsed",
    }
    assert {r.parent_thread_id for r in events.values()} == {"p1"}
    assert (events[2].prompt, events[3].new_thread_id, events[3].receiver_thread_ids) == ("go", "kid", ["kid"])
    assert (events[9].parse_status, events[9].reason_unparsed) == ("unparsed", "invalid_json")


def test_placeholder_parent_is_no_parent(spark, tmp_path):
    meta = {"id": "s", "source": {"subagent": {"thread_spawn": {"parent_thread_id": "standalone-root"}}}}
    write(tmp_path / "rollout-2026-04-07T10-00-00-s.jsonl", [record("session_meta", meta)])
    bronze = cut_lineage(parse_lines(L.session_lines(spark, str(tmp_path))))
    assert normalize_session(bronze).first().parent_thread_id is None


def test_run_folder_replay(spark, tmp_path):
    run = tmp_path / "task-a" / "runs" / "2026--r1"
    write(tmp_path / "task-a" / "task.json", [{"task_id": "T1"}])
    write(run / "stdout.jsonl", [
        {"type": "thread.started", "thread_id": "main"},
        {"type": "item.completed", "item": {"type": "collab_tool_call", "id": "i0", "tool": "spawn_agent", "receiver_thread_ids": ["kid"]}},
        {"type": "item.completed", "item": {"type": "command_execution", "id": "i1", "command": "ls", "status": "completed", "exit_code": 0}},
    ])
    write(run / "subagents" / "nobody.jsonl", [record("session_meta", {"id": "nobody"})])
    write(run / "stderr.log", ["warn one", "warn two"])
    write(run / "subagents" / "kid.jsonl", [record("session_meta", {"id": "kid"}), record("event_msg", {"type": "task_started", "turn_id": "t"})])
    rows = [(r.run_id, r.task_id, r.seq, r.event_type, r.thread_id) for r in L.replay_run_dir(spark, str(tmp_path)).collect()]
    assert sorted(rows, key=str) == sorted([
        ("r1", "T1", 1, "thread.started", "main"), ("r1", "T1", 2, "collab.spawn_agent", "main"), ("r1", "T1", 3, "agent.session", "kid"),
        ("r1", "T1", 4, "task.started", "kid"), ("r1", "T1", 5, "shell.result", "main"), ("r1", "T1", 6, "stderr.line", None),
        ("r1", "T1", 7, "stderr.line", None),
    ], key=str)


@pytest.mark.parametrize("text", ['[{"seq":1,"payload":{"a":1}},\n {"seq":2},\n]', '{"seq":1,"payload":{"a":1}}\n\nnot json\n[3]\n{"seq":2}\n'])
def test_event_arrays_and_lines(spark, tmp_path, text):
    (tmp_path / "e.json").write_text(text)
    rows = L.scan_event_array(spark, str(tmp_path / "e.json")).collect()
    assert sorted((r.seq, r.event_type, r.payload.toJson()) for r in rows) == [(1, "raw.unparsed", '{"a":1}'), (2, "raw.unparsed", "{}")]


def test_canonical_log_to_flat_events(spark, tmp_path):
    line = lambda kind, **payload: {"seq": 1, "run_id": "r", "event_type": kind, "payload": payload}
    write(tmp_path / "e.jsonl", [
        line("task.started", title=" ", prompt="do it", summary="s"), line("file.change", path="x/review.md"), line("file.change", artifact_path=None, path="y"),
        line("shell.call", title="t", total_tokens="7", input_tokens=7, receiver_thread_ids=["a", 1]),
    ])
    rows = L.flat_events(L.scan_event_log(spark, str(tmp_path))).collect()
    assert [(r.session_id, r.title, r.artifact_path, r.total_tokens, r.input_tokens, r.receiver_thread_ids) for r in rows] == [
        ("r", "do it", None, None, None, None), ("r", None, "x/review.md", None, None, None), ("r", None, None, None, None, None), ("r", "t", None, None, 7, ["a"]),
    ]


def test_array_file_without_last_comma(spark, tmp_path):
    (tmp_path / "a b+c.json").write_text('\n [\n{"seq":1},\n{"seq":2}\n]\n')
    (tmp_path / "lines.json").write_text('{"seq":3}\n[4]\n')
    (tmp_path / "broken.json").write_text('[{"seq":5},')
    rows = L.scan_event_array(spark, str(tmp_path)).collect()
    assert sorted((r.seq, r.parse_status) for r in rows) == [(0, "unparsed"), (1, "parsed"), (2, "parsed"), (3, "parsed")]


def test_files_without_lines_are_found(spark, tmp_path):
    write(tmp_path / "blank x.jsonl", ["", ""])
    write(tmp_path / "rollout-2026-04-07T10-00-00-s.jsonl", ["", json.dumps(record("session_meta", {"id": "s"}))])
    rows = {r.session_ref.split("/")[-1]: (r.session_id, r.diagnostic) for r in L.discover_session_files(spark, str(tmp_path)).collect()}
    missing = (None, "session id not found")
    assert rows == {"blank x.jsonl": missing, "rollout-2026-04-07T10-00-00-s.jsonl": ("s", None)}


def test_receivers_are_read_from_json_only(spark):
    inner = json.dumps({"receiver_thread_ids": ["deep", 7]})
    payload = {"text": 'prose "receiver_thread_ids": ["ghost"]', "x": [{"y": {"receiver_thread_ids": ["a]b", " ok ", ""]}}], "z": json.dumps({"q": inner})}
    rows = spark.createDataFrame([(json.dumps(payload),), ("{broken",), (None,), ("{}",)], "payload_text string")
    assert sorted(r.receivers for r in L.collect_receiver_ids(rows).collect()) == [[], [], [], ["a]b", "deep", "ok"]]


def test_items_are_unwrapped_at_any_depth(spark):
    item = {"type": "command_execution", "id": "i", "command": "ls"}
    for kind in ("item.completed", "item.updated", "item.started", "item.completed"):
        item = {"type": kind, "item": item}
    lines = spark.createDataFrame([("r", "t", 1, json.dumps(item), "2026-04-07T10:00:00Z")], "run_id string, task_id string, seq bigint, value string, read_at string")
    row = normalize_stdout(lines).first()
    assert (row.operation_id, row.event_type) == ("i", "shell.result")


def test_nothing_is_too_late_for_dedup(spark, tmp_path):
    schema = "session_id string, event_time timestamp, ts string, raw_type string, value string"
    for i, hour in enumerate((10, 11, 8, 8)):
        row = (("s", f"2026-04-07 {hour:02d}:00:00", "t", "k", f"line {hour}"),)
        spark.createDataFrame(row, "session_id string, event_time string, ts string, raw_type string, value string").selectExpr(
            "session_id", "CAST(event_time AS timestamp) AS event_time", "ts", "raw_type", "value"
        ).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        told = drain(spark, T.stream_dedup(stream), tmp_path / "out")
    assert sorted(r.value for r in told) == ["line 10", "line 11", "line 8"]


def test_a_replaced_file_is_not_told_again(spark, tmp_path):
    name = "rollout-2026-04-07T10-00-00-s.jsonl"
    lines = [f"line {i}" for i in range(300)] + ["  "]
    write(tmp_path / "in" / f"{name}.1", lines)
    read = lambda: drain(spark, T.tail_session(T.tail_lines(spark, str(tmp_path / "in"))), tmp_path / "out")
    assert len(read()) == 301
    write(tmp_path / "in" / "again" / f"{name}.1", [*lines, "new"])
    assert [(r.seq, r.value) for r in read() if r.is_reset] == [(302, "new")]
    (tmp_path / "in" / f"{name}.2").write_text("half a li")
    with pytest.raises(Exception, match="inside a line"):
        read()


def test_upsert_keeps_one_current_row(spark, tmp_path):
    path = str(tmp_path / "store")
    S.upsert(spark, path, spark.createDataFrame([("a", 1), ("b", 1)], "session_id string, n int"), buckets=4)
    S.upsert(spark, path, spark.createDataFrame([("b", 2), ("c", 2)], "session_id string, n int"), buckets=4)
    assert {(r.session_id, r.n) for r in S.load(spark, path).collect()} == {("a", 1), ("b", 2), ("c", 2)}
    assert [(r.session_id, r.n) for r in S.load_by_id(spark, path, ["b", "zzz"], buckets=4).collect()] == [("b", 2)]


def drain(spark, stream, out):
    query = stream.writeStream.option("checkpointLocation", f"{out}-cursor").trigger(availableNow=True)
    query.foreachBatch(lambda df, _: df.write.mode("append").parquet(str(out))).start().awaitTermination()
    return spark.read.parquet(str(out)).collect()


def test_tail_carries_state_and_survives_replacement(spark, tmp_path):
    folder = tmp_path / "landing"
    tail = lambda: {
        (r.seq, r.value, r.parent_thread_id, r.is_reset) for r in drain(spark, T.tail_session(T.tail_lines(spark, str(folder))), tmp_path / "out")
    }
    names = lambda: {
        (r.chunk, r.place, r.call_name) for r in drain(spark, T.stream_call_names(T.tail_lines(spark, str(folder))), tmp_path / "names")
    }
    name = "rollout-2026-04-07T10-00-00-s.jsonl"
    meta = json.dumps(record("session_meta", {"id": "s", "source": {"subagent": {"thread_spawn": {"parent_thread_id": "p"}}}}))
    call = json.dumps(record("response_item", {"type": "function_call", "name": "exec_command", "call_id": "c"}))
    reply = json.dumps(record("response_item", {"type": "function_call_output", "call_id": "c"}))
    write(folder / f"{name}.1", [meta, call])
    first = tail()
    assert first == {(1, meta, "p", False), (2, call, "p", False)}
    assert names() == {(1, 1, None)}
    write(folder / f"{name}.2", [reply])
    second = tail()
    assert second - first == {(3, reply, "p", False)}
    assert names() == {(1, 1, None), (2, 0, "exec_command")}
    # The file is replaced: its old lines are known, the new one is told.
    write(folder / "again" / f"{name}.1", [meta, call, "new line"])
    assert tail() - second == {(3, "new line", "p", True)}
