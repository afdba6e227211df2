"""Coverage algebra and worked examples of sessions, tasks and operations."""

import random

import pytest
from pyspark.sql import functions as F

from loomtrace.functions import covered as C
from loomtrace.operators import operations as O
from loomtrace.operators import session_metrics as M
from loomtrace.operators import tasks as T


def at(second):
    return f"2026-04-23T10:00:{second:02d}Z"


@pytest.fixture(scope="module")
def catalog(spark):
    names = ["session_id", "project_key", "session_scope", "tokens_used", "agent_role", "model", "reasoning_effort", "cli_version", "approval_mode", "sandbox_policy_kind"]
    schema = ", ".join(f"{n} {'bigint' if n == 'tokens_used' else 'string'}" for n in names)
    return spark.createDataFrame([("session-1", "project:x", "main", 900, *[None] * 6)], schema)


def metric(value, coverage):
    return F.struct(F.lit(value).cast("bigint").alias("value"), F.lit(coverage).alias("coverage"), F.lit("s").alias("source"))


@pytest.mark.parametrize(
    ("inputs", "want"),
    [
        ([(1, "known"), (2, "known")], (3, "known", "derived")),
        ([(1, "known"), (2, "partial")], (3, "partial", "derived")),
        ([(1, "known"), (None, "unknown")], (1, "partial", "derived")),
        ([(None, "unknown")], (None, "unknown", "unavailable")),
        ([], (None, "unknown", "unavailable")),
    ],
)
def test_covered_sum(spark, inputs, want):
    df = spark.createDataFrame(inputs, "v bigint, c string").select(F.struct(F.col("v").alias("value"), F.col("c").alias("coverage"), F.lit("s").alias("source")).alias("m"))
    assert tuple(df.agg(C.covered_sum("m").alias("m")).first().m) == want


def test_subtract_rules(spark):
    one = spark.range(1)
    full, less, none = metric(5, "known"), metric(7, "partial"), metric(None, "unknown")
    row = one.select(
        C.covered_subtract(full, less).alias("floor"), C.covered_subtract(full, none).alias("backend"), C.covered_subtract_view(full, none).alias("view")
    ).first()
    assert tuple(row.floor)[:2] == (0, "partial")
    assert tuple(row.backend)[:2] == (None, "unknown")
    assert tuple(row.view) == (5, "known", "s")


def one_session():
    return [
        dict(seq=1, ts=at(0), event_type="message.user", text="run tests", thread_id="root", turn_id="turn-1"),
        dict(seq=2, ts=at(2), event_type="shell.call", operation_id="sh", thread_id="root", tool_name="exec_command", command="cargo test"),
        dict(seq=3, ts=at(7), event_type="shell.result", operation_id="sh", thread_id="root", status="failed"),
        dict(seq=4, ts=at(8), event_type="tool.call", operation_id="to", thread_id="root", tool_name="search_query"),
        dict(seq=5, ts=at(9), event_type="tool.result", operation_id="to", thread_id="root", status="completed", tool_name="search_query"),
        dict(seq=6, ts=at(10), event_type="info.tokens", input_tokens=100, cached_input_tokens=20, output_tokens=30, reasoning_output_tokens=7, total_tokens=150),
        dict(seq=7, ts=at(11), event_type="error"),
        dict(seq=8, ts=at(12), event_type="agent.failed", error_text="tool_error"),
    ]


def test_session_document(events_of, catalog):
    events = events_of(one_session())
    operations = O.project_operations(events)
    row = M.session_metrics(events, operations, catalog).first()
    want = dict(
        event_count=8, message_count=1, operation_count=2, tool_calls=2, shell_calls=1, failed_operations=1, error_count=1, failure_count=1,
        tokens_total=150, tokens_input=100, tokens_cached_input=20, tokens_reasoning_output=7, start_context_size=100, total_ms=12_000, shell_ms=5_000,
    )
    assert {n: row[n].value for n in want} == want
    assert (row.outcome, row.error_type) == ("failed", "tool_error")
    # Tokens without a thread are never complete.
    assert row.tokens_total.coverage == "partial"
    breakdown = {r.category: (r.operations, r.failures) for r in O.tool_breakdown(operations).collect()}
    assert breakdown == {"test": (1, 1), "search": (1, 0)}


def test_session_without_operations_is_unknown(events_of, catalog):
    events = events_of([dict(seq=1, ts=at(0), event_type="message.user", text="hi")])
    row = M.session_metrics(events, O.project_operations(events), catalog).first()
    assert tuple(row.tool_calls) == (None, "unknown", "unavailable")
    assert tuple(row.tokens_total) == (900, "partial", C.FROM_CATALOG)


def parent_and_child():
    return [
        dict(seq=1, ts=at(0), event_type="task.started", thread_id="root", turn_id="a", collaboration_mode_kind="interactive"),
        dict(seq=2, ts=at(1), event_type="shell.call", operation_id="sh", thread_id="root", tool_name="exec_command"),
        dict(seq=3, ts=at(2), event_type="shell.result", operation_id="sh", thread_id="root", status="completed"),
        dict(seq=4, ts=at(3), event_type="collab.spawn_agent", operation_id="sp", thread_id="root", phase="started", requested_agent_type="reviewer"),
        dict(seq=5, ts=at(4), event_type="collab.spawn_agent", operation_id="sp", thread_id="root", phase="completed", status="completed", receiver_role="reviewer"),
        dict(seq=6, ts=at(5), event_type="task.started", thread_id="sub", parent_thread_id="root", turn_id="b", collaboration_mode_kind="review_loop"),
        dict(seq=7, ts=at(6), event_type="agent.session", thread_id="sub", parent_thread_id="root", agent_role="reviewer"),
        dict(seq=8, ts=at(7), event_type="info.tokens", thread_id="sub", input_tokens=7, output_tokens=5, total_tokens=12),
        dict(seq=9, ts=at(8), event_type="task.completed", thread_id="sub", parent_thread_id="root", turn_id="b"),
        dict(seq=10, ts=at(9), event_type="info.tokens", thread_id="root", input_tokens=10, output_tokens=8, reasoning_output_tokens=2, total_tokens=18),
        dict(seq=11, ts=at(10), event_type="task.completed", thread_id="root", turn_id="a"),
    ]


def test_task_rollup_over_threads(events_of, catalog):
    events = events_of(parent_and_child())
    operations = O.project_operations(events)
    facts = {r.turn_id: r for r in T.task_facts(events, operations, catalog).collect()}
    parent, child = facts["a"], facts["b"]
    want = dict(shell_calls=1, spawn_agent_calls=1, total_ms=10_000, spawn_agent_ms=3_000, task=18, spawn_agent=12, total=30, input=17, output=13)
    assert {n: parent[n].value for n in want} == want
    assert (parent.requested_agent_type, parent.receiver_role) == ("reviewer", "reviewer")
    assert (child.total.value, child.total_ms.value, child.agent_role, child.task_class) == (12, 3_000, "reviewer", "review")
    ledger = M.token_ledger(M.thread_fold(events), catalog).first()
    assert (ledger.total.value, ledger.task.value, ledger.spawn_agent.value) == (30, 18, 12)


def test_row_order_does_not_matter(events_of, catalog):
    rows = parent_and_child() + [{**r, "session_id": "session-2", "run_id": "session-2"} for r in one_session()]
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    results = []
    for data in (rows, shuffled):
        events = events_of(data)
        results.append(sorted(map(str, M.session_metrics(events, O.project_operations(events), catalog).collect())))
    assert results[0] == results[1]


def test_ended_immutable_operations_refuse_events(events_of):
    phases = [("file.change", "completed"), ("patch.apply", "completed")]
    rows = []
    for kind, _ in phases:
        rows += [dict(event_type=kind, operation_id=kind, phase=p, ts=at(0)) for p in ("started", "completed", "updated")]
    rows = [{**r, "seq": i} for i, r in enumerate(rows, 1)]
    got = {r.kind: (r.revision, r.last_phase, r.terminal_seq) for r in O.project_operations(events_of(rows)).collect()}
    assert got == {"file.change": (2, "completed", 2), "patch.apply": (3, "updated", 5)}


def test_terminal_preference(events_of):
    rows = [
        dict(seq=1, ts=at(0), event_type="shell.call", operation_id="x"),
        dict(seq=2, ts=at(1), event_type="shell.result", operation_id="x", duplicate_of="response_item.function_call_output"),
        dict(seq=3, ts=at(2), event_type="shell.result", operation_id="x"),
    ]
    row = O.project_operations(events_of(rows)).first()
    assert (row.terminal_seq, row.last_seq, row.duration_ms) == (2, 3, 1000)


def test_annotation_reads_events_once(spark, events_of, tmp_path):
    from loomtrace.operators import operations as O

    rows = [{"seq": i, "event_type": "shell.call", "operation_id": f"o{i % 3}", "phase": "started"} for i in range(1, 9)]
    events_of(rows).write.parquet(str(tmp_path / "scanned"))
    events = spark.read.parquet(str(tmp_path / "scanned"))
    annotated = O.annotate_events(events, O.project_operations(events))
    assert annotated.count() == 8
    plan = annotated._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in line and "revision" not in line for line in plan.splitlines()) == 1
