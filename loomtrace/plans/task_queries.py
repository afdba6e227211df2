"""Registered queries and comparison SQL for task facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.functions import covered as C
from loomtrace.operators import session_metrics as M
from loomtrace.operators import tasks as T
from loomtrace.plans import fixtures
from loomtrace.plans.metrics_queries import MS_SQL, OPS_COUNT_NAMES, events, metric_sessions, operations
from loomtrace.plans.oracle import cte
from loomtrace.session import cut_lineage

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def covered_as(value: str, name: str, coverage: str) -> str:
    usable = f"({value}) IS NOT NULL AND {coverage} <> 'unknown'"
    return f"CAST(CASE WHEN {usable} THEN {value} END AS BIGINT) AS {name}, CASE WHEN {usable} THEN {coverage} ELSE 'unknown' END AS {name}_coverage"


cte("threaded", "SELECT *, coalesce(thread_id, sender_thread_id) AS thread FROM log_events")
cte("starts", """
SELECT session_id, task_id, turn_id, thread AS thread_id, parent_thread_id, seq AS started_seq, ts AS started_at FROM threaded WHERE event_type = 'task.started'""")
cte("ends", """
SELECT session_id, turn_id, thread AS thread_id, seq, ts, event_type, error_text FROM threaded WHERE event_type IN ('task.completed', 'agent.aborted', 'agent.failed')""")
cte("bounds", """
SELECT s.*, (SELECT min(e.seq) FROM ends e WHERE e.session_id = s.session_id AND e.turn_id = s.turn_id AND e.seq > s.started_seq
    AND (s.thread_id IS NULL OR e.thread_id = s.thread_id)) AS ended_seq,
  (SELECT min(n.started_seq) FROM starts n WHERE n.session_id = s.session_id AND n.started_seq > s.started_seq
    AND n.thread_id IS NOT DISTINCT FROM s.thread_id AND n.turn_id IS DISTINCT FROM s.turn_id) AS next_seq,
  (SELECT max(l.seq) FROM log_events l WHERE l.session_id = s.session_id) AS last_seq
FROM starts s""")
cte("task_iv", """
SELECT concat('task:', b.session_id, '|', b.task_id, '|', b.turn_id, '|', coalesce(b.thread_id, 'unknown')) AS task_key, b.session_id, b.task_id, b.turn_id,
  b.thread_id, b.parent_thread_id, b.started_seq, b.started_at, b.ended_seq, e.ts AS ended_at, e.event_type AS terminal_type, e.error_text AS terminal_text,
  coalesce(b.ended_seq, b.next_seq - 1, b.last_seq) AS end_seq,
  CASE WHEN b.ended_seq IS NOT NULL THEN 'known' WHEN coalesce(b.next_seq - 1, b.last_seq) > b.started_seq THEN 'partial' ELSE 'unknown' END AS interval_coverage
FROM bounds b LEFT JOIN ends e ON e.session_id = b.session_id AND e.seq = b.ended_seq""")


def intervals(spark, sf):
    return T.task_intervals(events(spark, sf))


@query("task_intervals", "SELECT session_id, started_seq, turn_id, thread_id, parent_thread_id, ended_seq, ended_at, end_seq FROM task_iv")
def task_intervals(spark, sf):
    return intervals(spark, sf).select("session_id", "started_seq", "turn_id", "thread_id", "parent_thread_id", "ended_seq", "ended_at", "end_seq")


@query("task_coverage", "SELECT session_id, started_seq, interval_coverage FROM task_iv")
def task_coverage(spark, sf):
    return intervals(spark, sf).select("session_id", "started_seq", "interval_coverage")


@query("task_key", "SELECT session_id, started_seq, task_key FROM task_iv")
def task_key(spark, sf):
    return intervals(spark, sf).select("session_id", "started_seq", "task_key")


cte("task_outcomes", """
SELECT session_id, started_seq, CASE terminal_type WHEN 'task.completed' THEN 'completed' WHEN 'agent.failed' THEN 'failed'
    WHEN 'agent.aborted' THEN CASE WHEN terminal_text = 'interrupted' THEN 'interrupted' ELSE 'aborted' END ELSE 'unknown' END AS outcome,
  CASE WHEN terminal_type IS NULL THEN 'unknown' ELSE 'known' END AS outcome_coverage,
  CASE WHEN terminal_type IN ('agent.aborted', 'agent.failed') THEN terminal_text END AS error_type FROM task_iv""")


@query("task_outcome", "SELECT * FROM task_outcomes")
def task_outcome(spark, sf):
    return T.task_outcome(intervals(spark, sf)).select("session_id", "started_seq", "outcome", "outcome_coverage", "error_type")


cte("task_sig", f"""
SELECT t.session_id, t.started_seq, {', '.join(f'arg_min(e.{s}, e.seq) FILTER (WHERE e.{s} IS NOT NULL) AS {s}' for s in T.SIGNALS if s != 'agent_role')},
  coalesce(arg_min(e.agent_role, e.seq) FILTER (WHERE e.agent_role IS NOT NULL), CASE WHEN any_value(t.parent_thread_id) IS NULL THEN any_value(s.agent_role) END) AS agent_role
FROM task_iv t JOIN threaded e ON e.session_id = t.session_id AND e.seq BETWEEN t.started_seq AND t.end_seq AND (t.thread_id IS NULL OR e.thread = t.thread_id)
JOIN fx_sessions s ON s.session_id = t.session_id GROUP BY t.session_id, t.started_seq""")


def signals(spark, sf):
    return T.task_signals(intervals(spark, sf), events(spark, sf), fixtures.sessions(spark, sf))


@query("task_signals", f"SELECT session_id, started_seq, {', '.join(T.SIGNALS)} FROM task_sig")
def task_signals(spark, sf):
    return signals(spark, sf).select("session_id", "started_seq", *T.SIGNALS)


def _class_sql(column: str) -> str:
    cases = " ".join(f"WHEN lower({column}) IN ({', '.join(repr(w) for w in words)}) THEN '{name}'" for name, words in T.CLASS_WORDS.items())
    return f"CASE {cases} END"


cte("task_classes", f"""
SELECT session_id, started_seq, CASE WHEN n = 1 THEN coalesce(c1, c2, c3, c4) ELSE 'unknown' END AS task_class,
  CASE WHEN n > 1 THEN 'ambiguous_signals' WHEN c1 IS NOT NULL THEN 'collaboration_mode' WHEN c2 IS NOT NULL THEN 'agent_role'
    WHEN c3 IS NOT NULL THEN 'requested_agent_type' WHEN c4 IS NOT NULL THEN 'receiver_role' ELSE 'unclassified' END AS task_class_source,
  CASE n WHEN 0 THEN 'unknown' WHEN 1 THEN 'confident' ELSE 'partial' END AS task_class_confidence
FROM (SELECT *, len(list_distinct(list_filter([c1, c2, c3, c4], lambda x: x IS NOT NULL))) AS n FROM (
  SELECT session_id, started_seq, {_class_sql('collaboration_mode_kind')} AS c1, {_class_sql('agent_role')} AS c2,
  {_class_sql('requested_agent_type')} AS c3, {_class_sql('receiver_role')} AS c4 FROM task_sig) AS a) AS b""")
CLASS_COLUMNS = ["session_id", "started_seq", "task_class", "task_class_source", "task_class_confidence"]


@query("task_class", "SELECT * FROM task_classes")
def task_class(spark, sf):
    return T.task_class(signals(spark, sf)).select(*CLASS_COLUMNS)


TOK = M.SNAPSHOT
cte("task_points", f"""
SELECT t.session_id, t.started_seq, t.interval_coverage, {', '.join(f'e.{c} AS e_{c}, b.{c} AS b_{c}' for c in TOK)}, b.seq AS before_seq
FROM task_iv t
LEFT JOIN token_rows e ON e.session_id = t.session_id AND e.seq = (SELECT max(p.seq) FROM token_rows p WHERE p.session_id = t.session_id AND p.thread = t.thread_id
  AND p.seq <= t.end_seq AND coalesce(p.input_tokens, p.cached_input_tokens, p.output_tokens, p.reasoning_output_tokens, p.total_tokens) IS NOT NULL)
LEFT JOIN token_rows b ON b.session_id = t.session_id AND b.seq = (SELECT max(p.seq) FROM token_rows p WHERE p.session_id = t.session_id AND p.thread = t.thread_id
  AND p.seq < t.started_seq AND coalesce(p.input_tokens, p.cached_input_tokens, p.output_tokens, p.reasoning_output_tokens, p.total_tokens) IS NOT NULL)""")


def _delta_sql(name: str) -> str:
    c = M.TOKENS[name]
    base = f"CASE WHEN before_seq IS NULL THEN 0 ELSE b_{c} END"
    return covered_as(f"CASE WHEN e_{c} >= {base} THEN e_{c} - {base} END", f"own_{name}", "interval_coverage")


cte("task_deltas", f"SELECT session_id, started_seq, {', '.join(_delta_sql(n) for n in M.TOKENS)} FROM task_points")


def deltas(spark, sf):
    return T.task_token_delta(intervals(spark, sf), events(spark, sf))


@query("task_token_delta", "SELECT * FROM task_deltas")
def task_token_delta(spark, sf):
    return C.flatten_covered(deltas(spark, sf).select("session_id", "started_seq", *[f"own_{n}" for n in M.TOKENS]))


SPENT = {"tool_ms": "kind NOT IN ('shell', 'mcp')", "shell_ms": "kind = 'shell'", "mcp_ms": "kind = 'mcp'"}
COUNT_TESTS = {
    "operation_count": "true", "successful_operations": "last_status = 'completed'",
    "failed_operations": "last_status IN ('failed', 'error', 'cancelled')", "tool_calls": "kind <> 'file.change'", "shell_calls": "kind = 'shell'",
    "mcp_calls": "kind = 'mcp'", "collaboration_calls": "kind LIKE 'collab.%'", "spawn_agent_calls": "kind = 'collab.spawn_agent'",
}
cte("task_ops_raw", f"""
SELECT t.session_id, t.started_seq, any_value(t.thread_id) AS thread_id, any_value(t.interval_coverage) AS interval_coverage,
  {', '.join(f'count(o.session_id) FILTER (WHERE {test}) AS {n}' for n, test in COUNT_TESTS.items())},
  {', '.join(f'coalesce(sum(o.duration_ms) FILTER (WHERE {test}), 0) AS {n}' for n, test in SPENT.items())}
FROM task_iv t LEFT JOIN ops o ON o.session_id = t.session_id AND o.scope_thread_id = t.thread_id AND o.started_seq BETWEEN t.started_seq AND t.end_seq
GROUP BY t.session_id, t.started_seq""")
cte("task_ops", f"""
SELECT session_id, started_seq, {', '.join(covered_as(f'CASE WHEN thread_id IS NOT NULL THEN {n} END', n, 'interval_coverage') for n in COUNT_TESTS)},
  {', '.join(covered_as(n, n, 'interval_coverage') for n in SPENT)} FROM task_ops_raw""")


@query("task_operations", "SELECT * FROM task_ops")
def task_operations(spark, sf):
    found = T.task_operations(intervals(spark, sf), operations(spark, sf))
    return C.flatten_covered(found.select("session_id", "started_seq", *OPS_COUNT_NAMES, *SPENT))


@query("task_duration", f"""
SELECT session_id, started_seq, {MS_SQL.format(a='started_at', b='ended_at')} AS total_ms,
  CASE WHEN {MS_SQL.format(a='started_at', b='ended_at')} IS NULL THEN 'unknown' ELSE 'known' END AS total_ms_coverage FROM task_iv""")
def task_duration(spark, sf):
    return C.flatten_covered(T.task_duration(intervals(spark, sf)).select("session_id", "started_seq", "total_ms"))


cte("task_edges", """
SELECT p.session_id, p.started_seq AS parent_seq, c.started_seq AS child_seq, p.task_key AS parent_key, c.task_key AS child_key
FROM task_iv p JOIN task_iv c ON c.session_id = p.session_id AND c.parent_thread_id = p.thread_id AND c.started_seq <> p.started_seq
  AND c.started_seq BETWEEN p.started_seq AND p.end_seq""")


@query("task_children", "SELECT * FROM task_edges")
def task_children(spark, sf):
    return T.task_children(cut_lineage(intervals(spark, sf)))


cte("task_paths", """
SELECT session_id, started_seq AS top, started_seq AS node, 0 AS depth FROM task_iv
UNION ALL SELECT p.session_id, p.top, e.child_seq, p.depth + 1 FROM task_paths p JOIN task_edges e ON e.session_id = p.session_id AND e.parent_seq = p.node""")
cte("task_sums", f"""
SELECT p.session_id, p.top AS started_seq, {', '.join(f'CAST(sum(d.own_{n}) AS BIGINT) AS {n}' for n in M.TOKENS)},
  CAST(sum(d.own_total) FILTER (WHERE p.depth > 0) AS BIGINT) AS spawn_agent
FROM task_paths p JOIN task_deltas d ON d.session_id = p.session_id AND d.started_seq = p.node GROUP BY p.session_id, p.top""")
cte("task_child_ms", f"""
SELECT e.session_id, e.parent_seq AS started_seq, CAST(sum(ms) AS BIGINT) AS spawn_agent_ms, CASE WHEN sum(ms) IS NULL THEN 'unknown' WHEN count(ms) = count(*) THEN 'known' ELSE 'partial' END AS spawn_agent_ms_coverage
FROM task_edges e JOIN (SELECT session_id, started_seq, {MS_SQL.format(a='started_at', b='ended_at')} AS ms FROM task_iv) AS t
  ON t.session_id = e.session_id AND t.started_seq = e.child_seq GROUP BY e.session_id, e.parent_seq""")
ROLLUP_SQL = f"""
SELECT s.session_id, s.started_seq, {', '.join(f"s.{n}, CASE WHEN s.{n} IS NULL THEN 'unknown' ELSE 'partial' END AS {n}_coverage" for n in [*M.TOKENS, 'spawn_agent'])},
  d.own_total AS task, d.own_total_coverage AS task_coverage, m.spawn_agent_ms, coalesce(m.spawn_agent_ms_coverage, 'unknown') AS spawn_agent_ms_coverage
FROM task_sums s JOIN task_deltas d ON d.session_id = s.session_id AND d.started_seq = s.started_seq
LEFT JOIN task_child_ms m ON m.session_id = s.session_id AND m.started_seq = s.started_seq"""


def facts(spark, sf):
    return T.task_facts(events(spark, sf), operations(spark, sf), metric_sessions(spark, sf))


@query("task_rollup", ROLLUP_SQL)
def task_rollup(spark, sf):
    rolled = T.task_rollup(T.task_duration(deltas(spark, sf)))
    return C.flatten_covered(rolled.select("session_id", "started_seq", *M.TOKENS, "spawn_agent", "task", "spawn_agent_ms"))


@query("task_order", """
SELECT session_id, started_seq, task_key, row_number() OVER (PARTITION BY session_id ORDER BY started_at, started_seq, task_key) AS position FROM task_iv""")
def task_order(spark, sf):
    from loomtrace.operators.ordered import row_index

    order = [F.col("started_at"), F.col("started_seq"), F.col("task_key")]
    numbered = row_index(intervals(spark, sf), ["session_id"], F.substring("started_at", 1, 10), order, "position")
    return T.task_order(numbered.withColumn("position", F.col("position") + 1).select("session_id", "started_at", "started_seq", "task_key", "position")).drop("started_at")


@query("primary_task", """
SELECT session_id, task_key, started_seq, task_class, task_class_confidence FROM (
  SELECT t.session_id, t.task_key, t.started_seq, c.task_class, c.task_class_confidence,
    row_number() OVER (PARTITION BY t.session_id ORDER BY t.parent_thread_id IS NOT NULL, t.started_seq, t.task_key) AS rn
  FROM task_iv t JOIN task_classes c ON c.session_id = t.session_id AND c.started_seq = t.started_seq) AS r WHERE rn = 1""")
def primary_task(spark, sf):
    return M.primary_task(T.task_class(signals(spark, sf)))
