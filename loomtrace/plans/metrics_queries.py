"""Registered queries and comparison SQL for operations and session metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.functions import covered as C
from loomtrace.functions import exprs as X
from loomtrace.operators import operations as O
from loomtrace.operators import session_metrics as M
from loomtrace.plans import fixtures
from loomtrace.plans.oracle import covered_sum, cte, known, partial

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def events(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.log_events(spark, sf)


def operations(spark: SparkSession, sf: str) -> DataFrame:
    return O.project_operations(events(spark, sf))


def metric_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog rows as the metrics read them."""
    from loomtrace.operators import catalog as K

    return K.with_identity(fixtures.sessions(spark, sf)).withColumns(
        {"sandbox_policy_kind": K.sandbox_kind(F.col("sandbox_policy")), "thread_name": K.thread_name()}
    )


# ---- operations -------------------------------------------------------------------------------

SPLIT_SQL = "('tool.result', 'shell.result', 'mcp.result')"
WORDS_SQL = "('completed', 'failed', 'cancelled', 'error')"

cte("classified", f"""
SELECT *, CASE WHEN event_type IN ('tool.call', 'tool.result') THEN 'tool' WHEN event_type IN ('shell.call', 'shell.result') THEN 'shell'
    WHEN event_type IN ('mcp.call', 'mcp.result') THEN 'mcp'
    WHEN event_type IN ('stdin.write', 'web.search', 'web.open', 'user.input.request', 'patch.apply', 'file.change', 'todo.update')
      OR event_type LIKE 'collab.%' THEN event_type END AS kind,
  coalesce(lower(phase), CASE WHEN raw_type LIKE 'item.%' THEN substr(raw_type, 6) END) AS event_phase,
  coalesce(coalesce(lower(phase), CASE WHEN raw_type LIKE 'item.%' THEN substr(raw_type, 6) END) IN {WORDS_SQL}, false)
    OR coalesce(lower(status) IN {WORDS_SQL}, false) OR event_type IN {SPLIT_SQL} AS is_terminal,
  CASE WHEN duplicate_of IS NULL THEN 0 WHEN duplicate_of LIKE 'response_item.%' THEN 2 ELSE 1 END AS pref,
  coalesce(thread_id, sender_thread_id, parent_thread_id) AS scope_thread_id
FROM log_events""")
cte("accepted", """
SELECT * FROM (SELECT *, min(CASE WHEN is_terminal THEN seq END) OVER (PARTITION BY session_id, kind, run_id, scope_thread_id, operation_id) AS first_end
  FROM classified WHERE kind IS NOT NULL AND operation_id IS NOT NULL) AS l
WHERE kind NOT IN ('stdin.write', 'user.input.request', 'file.change') OR first_end IS NULL OR seq <= first_end""")
cte("ops", """
SELECT g.*, CASE WHEN g.ended_at >= g.started_at THEN CAST(floor((epoch_us(g.ended_at) - epoch_us(g.started_at)) / 1000) AS BIGINT) END AS duration_ms FROM (
SELECT session_id, kind, run_id, scope_thread_id, operation_id, count(*) AS revision, min(seq) AS started_seq, max(seq) AS last_seq,
  arg_max(event_type, seq) AS last_event_type, arg_max_null(event_phase, seq) AS last_phase, arg_max_null(status, seq) AS last_status,
  bool_or(is_terminal) AS terminal, arg_max(seq, pref * 1000000000000 + seq) FILTER (WHERE is_terminal) AS terminal_seq,
  arg_min_null(lower(tool_name), seq) AS tool_name, arg_min_null(lower(command), seq) AS command,
  arg_min(CAST(ts AS TIMESTAMP), seq) AS started_at,
  arg_max(CAST(ts AS TIMESTAMP), pref * 1000000000000 + seq) FILTER (WHERE is_terminal) AS ended_at,
  kind NOT IN ('stdin.write', 'user.input.request', 'file.change') AS mutable
FROM accepted GROUP BY session_id, kind, run_id, scope_thread_id, operation_id) AS g""")


@query("classify_event", """
SELECT session_id, seq, event_type, CASE WHEN event_type IN ('patch.apply.duplicate', 'context.compacted.duplicate') THEN 'duplicate_marker'
    WHEN kind IS NOT NULL THEN 'lifecycle' ELSE 'atomic' END AS event_class, kind,
  CASE WHEN kind IS NULL THEN NULL WHEN event_type IN ('tool.call', 'shell.call', 'mcp.call') THEN 'start'
    WHEN event_type IN ('tool.result', 'shell.result', 'mcp.result') THEN 'terminal' WHEN event_phase = 'started' THEN 'start'
    WHEN event_phase = 'updated' THEN 'update' WHEN is_terminal THEN 'terminal' ELSE 'update' END AS role,
  CASE WHEN kind IS NOT NULL THEN kind NOT IN ('stdin.write', 'user.input.request', 'file.change') END AS mutable
FROM classified""")
def classify_event(spark, sf):
    return O.classify_events(events(spark, sf)).select(
        "session_id", "seq", "event_type", "event_class", "kind", F.col("role_in_operation").alias("role"), "mutable"
    )


@query("event_phase_terminal", "SELECT session_id, seq, event_phase, is_terminal FROM classified")
def event_phase_terminal(spark, sf):
    return O.classify_events(events(spark, sf)).select("session_id", "seq", "event_phase", "is_terminal")


OPS_COLUMNS = [*O.KEY, "revision", "started_seq", "terminal_seq", "last_seq", "last_event_type", "last_phase", "last_status", "terminal", "mutable"]


@query("project_operations", f"SELECT {', '.join(OPS_COLUMNS)} FROM ops")
def project_operations(spark, sf):
    return operations(spark, sf).select(*OPS_COLUMNS)


@query("operation_updates", """
SELECT session_id, kind, run_id, scope_thread_id, operation_id, seq,
  row_number() OVER (PARTITION BY session_id, kind, run_id, scope_thread_id, operation_id ORDER BY seq) AS revision FROM accepted""")
def operation_updates(spark, sf):
    return O.operation_updates(events(spark, sf))


@query("duplicate_markers", """
SELECT session_id, seq, event_type, run_id, scope_thread_id, operation_id, duplicate_of FROM classified
WHERE event_type IN ('patch.apply.duplicate', 'context.compacted.duplicate')""")
def duplicate_markers(spark, sf):
    return O.duplicate_markers(events(spark, sf))


@query("terminal_preference", """
SELECT session_id, kind, scope_thread_id, operation_id, terminal_seq,
  (SELECT c.pref FROM accepted c WHERE c.session_id = ops.session_id AND c.seq = ops.terminal_seq) AS terminal_preference
FROM ops WHERE terminal""")
def terminal_preference(spark, sf):
    ended = operations(spark, sf).where("terminal")
    return ended.select("session_id", "kind", "scope_thread_id", "operation_id", "terminal_seq", "terminal_preference")


KIND_CASE = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(O.KIND_ORDER, 1)) + " END"


@query("order_operations", f"""
SELECT session_id, kind, scope_thread_id, operation_id, row_number() OVER (PARTITION BY session_id
  ORDER BY started_seq, {KIND_CASE}, operation_id) AS position FROM ops""")
def order_operations(spark, sf):
    from loomtrace.operators.ordered import row_index

    ops = operations(spark, sf)
    order = [F.col("started_seq"), O.kind_ordinal(F.col("kind")), F.col("operation_id")]
    numbered = row_index(ops, ["session_id"], F.floor(F.col("started_seq") / 100_000), order, "position")
    return O.order_operations(numbered).select(
        "session_id", "kind", "scope_thread_id", "operation_id", (F.col("position") + 1).alias("position")
    )


cte("annotated", """
SELECT c.session_id, c.seq, c.kind, c.event_type, o.revision, o.started_seq, o.terminal_seq, o.last_status AS operation_status,
  CASE WHEN o.started_seq IS NOT NULL THEN concat(c.run_id, ':', CAST(o.started_seq AS VARCHAR)) END AS root_event_id,
  coalesce(c.seq = o.started_seq, false) AS is_root, c.run_id
FROM classified c LEFT JOIN ops o ON c.session_id = o.session_id AND c.kind = o.kind AND c.run_id = o.run_id
  AND c.scope_thread_id IS NOT DISTINCT FROM o.scope_thread_id AND c.operation_id = o.operation_id""")


def annotated(spark, sf):
    rows = events(spark, sf)
    return O.annotate_events(rows, O.project_operations(rows))


@query("annotate_events", "SELECT session_id, seq, kind, revision, terminal_seq, operation_status, root_event_id, is_root FROM annotated")
def annotate_events(spark, sf):
    return annotated(spark, sf).select(
        "session_id", "seq", "kind", "revision", "terminal_seq", "operation_status", "root_event_id", "is_root"
    )


@query("operation_parent", """
SELECT session_id, seq, concat(run_id, ':', CAST(seq AS VARCHAR)) AS event_id, root_event_id AS parent_event_id
FROM annotated WHERE root_event_id IS NOT NULL AND NOT is_root""")
def operation_parent(spark, sf):
    return O.operation_parent(annotated(spark, sf))


@query("operation_durations", """
SELECT session_id, kind, run_id, scope_thread_id, operation_id, duration_ms FROM ops WHERE duration_ms IS NOT NULL""")
def operation_durations(spark, sf):
    return O.operation_durations(operations(spark, sf))


cte("op_categories", """
SELECT *, CASE WHEN kind = 'mcp' THEN 'mcp' WHEN kind IN ('web.search', 'web.open') THEN 'web_search'
  WHEN kind IN ('file.change', 'patch.apply') THEN 'edit' WHEN kind LIKE 'collab.%' THEN 'collaboration'
  WHEN w LIKE '%search%' OR w LIKE '%rg %' OR w LIKE 'rg%' THEN 'search' WHEN w LIKE '%web%' THEN 'web_search'
  WHEN w LIKE '%apply\\_patch%' ESCAPE '\\' OR w LIKE '%sed -i%' OR w LIKE '%edit%' THEN 'edit' WHEN w LIKE '%test%' THEN 'test'
  WHEN w LIKE '%build%' OR w LIKE '%cargo check%' THEN 'build' WHEN w LIKE '%git %' OR w LIKE 'git%' THEN 'git'
  WHEN w LIKE '%ls %' OR w LIKE '%find %' OR w LIKE '%cat %' THEN 'filesystem' ELSE 'other' END AS category
FROM (SELECT *, concat(coalesce(tool_name, ''), ' ', coalesce(command, '')) AS w FROM ops) AS x""")


@query("tool_category", "SELECT session_id, kind, scope_thread_id, operation_id, category FROM op_categories")
def tool_category(spark, sf):
    category = O.tool_category(F.col("kind"), F.col("tool_name"), F.col("command"))
    return operations(spark, sf).select("session_id", "kind", "scope_thread_id", "operation_id", category.alias("category"))


@query("tool_breakdown", """
SELECT session_id, category, count(*) AS operations, count(*) FILTER (WHERE last_status IN ('failed', 'error', 'cancelled')) AS failures,
  CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS duration_ms FROM op_categories GROUP BY session_id, category""")
def tool_breakdown(spark, sf):
    return O.tool_breakdown(operations(spark, sf))


OPS_COUNTS = """count(*) AS operation_count, count(*) FILTER (WHERE last_status = 'completed') AS successful_operations,
  count(*) FILTER (WHERE last_status IN ('failed', 'error', 'cancelled')) AS failed_operations,
  count(*) FILTER (WHERE kind <> 'file.change') AS tool_calls, count(*) FILTER (WHERE kind = 'shell') AS shell_calls,
  count(*) FILTER (WHERE kind = 'mcp') AS mcp_calls, count(*) FILTER (WHERE kind LIKE 'collab.%') AS collaboration_calls,
  count(*) FILTER (WHERE kind = 'collab.spawn_agent') AS spawn_agent_calls"""
OPS_COUNT_NAMES = ["operation_count", "successful_operations", "failed_operations", "tool_calls", "shell_calls", "mcp_calls", "collaboration_calls", "spawn_agent_calls"]

cte("op_counts", f"""
SELECT s.session_id, {', '.join(known('n.' + n, n) for n in OPS_COUNT_NAMES)}
FROM fx_sessions s LEFT JOIN (SELECT session_id, {OPS_COUNTS} FROM ops GROUP BY session_id) AS n ON s.session_id = n.session_id""")


@query("operation_metrics", "SELECT * FROM op_counts")
def operation_metrics(spark, sf):
    return C.flatten_covered(M.operation_metrics(fixtures.sessions(spark, sf), operations(spark, sf)))


@query("loaded_operation_stats", """
SELECT d.session_id, d.messages, t.tool_calls, t.successful_operations, t.failed_operations, t.spawn_agent_calls, t.unique_tools,
  round(t.success_rate, 6) AS success_rate, round(t.error_rate, 6) AS error_rate, d.direct_errors + coalesce(t.failed_operations, 0) AS errors
FROM (SELECT session_id, count(*) FILTER (WHERE event_type LIKE 'message.%') AS messages, count(*) FILTER (WHERE event_type = 'error') AS direct_errors
  FROM log_events GROUP BY session_id) AS d
LEFT JOIN (SELECT session_id, nullif(count(*) FILTER (WHERE kind <> 'file.change'), 0) AS tool_calls,
  CASE WHEN count(*) FILTER (WHERE kind <> 'file.change') > 0 THEN count(*) FILTER (WHERE kind <> 'file.change' AND last_status = 'completed') END AS successful_operations,
  count(*) FILTER (WHERE last_status IN ('error', 'failed')) AS failed_operations,
  count(*) FILTER (WHERE kind = 'collab.spawn_agent') AS spawn_agent_calls,
  CASE WHEN count(*) FILTER (WHERE kind <> 'file.change') > 0 THEN count(DISTINCT CASE WHEN kind <> 'file.change' THEN tool END) END AS unique_tools,
  count(*) FILTER (WHERE kind <> 'file.change' AND last_status = 'completed') * 1.0 / nullif(count(*) FILTER (WHERE kind <> 'file.change'), 0) AS success_rate,
  count(*) FILTER (WHERE last_status IN ('error', 'failed')) * 1.0 / count(*) AS error_rate
  FROM (SELECT o.*, (SELECT arg_min(c.tool_name, c.seq) FROM classified c WHERE c.session_id = o.session_id AND c.kind = o.kind AND c.run_id = o.run_id
      AND c.scope_thread_id IS NOT DISTINCT FROM o.scope_thread_id AND c.operation_id = o.operation_id AND c.tool_name IS NOT NULL) AS tool FROM ops o) AS z
  GROUP BY session_id) AS t ON d.session_id = t.session_id""")
def loaded_operation_stats(spark, sf):
    rows = events(spark, sf)
    stats = O.loaded_operation_stats(rows, O.project_operations(rows))
    return stats.withColumns({c: F.round(c, 6) for c in ("success_rate", "error_rate")})


# ---- session metrics --------------------------------------------------------------------------

cte("fold", """
SELECT session_id, count(*) AS event_count,
  count(*) FILTER (WHERE event_type IN ('message.user', 'message.agent', 'message.commentary', 'agent.reasoning')) AS message_count,
  count(*) FILTER (WHERE event_type = 'message.assistant') AS assistant_message_count, count(*) FILTER (WHERE event_type = 'error') AS error_count,
  count(*) FILTER (WHERE event_type = 'agent.aborted') AS abort_count, count(*) FILTER (WHERE event_type = 'agent.failed') AS failure_count,
  count(*) FILTER (WHERE event_type = 'context.compacted') AS compaction_count,
  nullif(count(*) FILTER (WHERE event_type = 'task.started'), 0) AS task_count, count(*) FILTER (WHERE event_type = 'mcp.call') AS mcp_call_count,
  arg_max(error_text, seq) FILTER (WHERE event_type = 'agent.aborted') AS abort_text,
  arg_max(error_text, seq) FILTER (WHERE event_type = 'agent.failed') AS failure_text,
  bool_or(event_type IN ('agent.completed', 'task.completed')) AS completed, arg_min(ts, seq) AS started_at, arg_max(ts, seq) AS ended_at,
  arg_min(runtime_mcp_servers, seq) FILTER (WHERE runtime_mcp_servers IS NOT NULL) AS mcp_server_count,
  arg_min(runtime_skills, seq) FILTER (WHERE runtime_skills IS NOT NULL) AS runtime_skills_count,
  arg_min(runtime_start_context_size, seq) FILTER (WHERE runtime_start_context_size IS NOT NULL) AS runtime_start_context_size,
  arg_min(coalesce(CASE WHEN input_tokens > 0 THEN input_tokens END, CASE WHEN total_tokens > 0 THEN total_tokens END), seq)
    FILTER (WHERE input_tokens > 0 OR total_tokens > 0) AS context_tokens,
  arg_min(context_size, seq) FILTER (WHERE context_size IS NOT NULL) AS context_legacy,
  arg_min_null(text, seq) FILTER (WHERE event_type LIKE 'message.%') AS first_text,
  nullif(count(*) FILTER (WHERE lower(coalesce(agent_role, receiver_role)) = 'reviewer'), 0) AS review_cycles,
  nullif(count(*) FILTER (WHERE artifact_path LIKE '%review%' OR artifact_path LIKE '%finding%'), 0) AS review_findings,
  arg_min(trim(text), seq) FILTER (WHERE event_type = 'message.user' AND trim(text) <> '') AS user_message,
  arg_min(title, seq) FILTER (WHERE event_type = 'task.started' AND title IS NOT NULL) AS task_title
FROM log_events GROUP BY session_id""")
cte("outcomes", """
SELECT session_id, CASE WHEN abort_text = 'interrupted' THEN 'interrupted' WHEN abort_count > 0 THEN 'aborted' WHEN failure_count > 0 THEN 'failed'
    WHEN completed THEN 'completed' ELSE 'unknown' END AS outcome,
  CASE WHEN abort_count > 0 OR failure_count > 0 OR completed THEN 'known' ELSE 'unknown' END AS outcome_coverage,
  CASE WHEN abort_count > 0 THEN abort_text ELSE failure_text END AS error_type FROM fold""")

COUNT_NAMES = ["event_count", "message_count", "assistant_message_count", "error_count", "abort_count", "failure_count", "compaction_count", "task_count", "mcp_call_count"]


@query("session_counts", f"SELECT session_id, {', '.join(known(n, n) for n in COUNT_NAMES)} FROM fold")
def session_counts(spark, sf):
    return C.flatten_covered(M.session_counts(events(spark, sf)))


@query("session_outcome", "SELECT * FROM outcomes")
def session_outcome(spark, sf):
    return M.session_outcome(events(spark, sf))


MS_SQL = "CASE WHEN CAST({b} AS TIMESTAMP) >= CAST({a} AS TIMESTAMP) THEN CAST(floor((epoch_us(CAST({b} AS TIMESTAMP)) - epoch_us(CAST({a} AS TIMESTAMP))) / 1000) AS BIGINT) END"
cte("durations", f"SELECT session_id, started_at, ended_at, {MS_SQL.format(a='started_at', b='ended_at')} AS duration_ms FROM fold")


@query("session_duration", f"SELECT session_id, started_at, ended_at, {known('duration_ms', 'duration_ms')} FROM durations")
def session_duration(spark, sf):
    return C.flatten_covered(M.session_duration(events(spark, sf)))


cte("breakdown", """
SELECT d.session_id, d.duration_ms AS total_ms, CAST(o.tool_ms AS BIGINT) AS tool_ms, CAST(o.shell_ms AS BIGINT) AS shell_ms,
  CAST(o.mcp_ms AS BIGINT) AS mcp_ms, CAST(o.spawn_agent_ms AS BIGINT) AS spawn_agent_ms,
  CAST(greatest(d.duration_ms - coalesce(o.all_ms, 0), 0) AS BIGINT) AS idle_ms
FROM durations d LEFT JOIN (SELECT session_id, sum(duration_ms) AS all_ms,
  sum(CASE WHEN kind NOT IN ('shell', 'mcp', 'collab.spawn_agent') THEN duration_ms ELSE 0 END) AS tool_ms,
  sum(CASE WHEN kind = 'shell' THEN duration_ms ELSE 0 END) AS shell_ms, sum(CASE WHEN kind = 'mcp' THEN duration_ms ELSE 0 END) AS mcp_ms,
  sum(CASE WHEN kind = 'collab.spawn_agent' THEN duration_ms ELSE 0 END) AS spawn_agent_ms
  FROM ops WHERE duration_ms IS NOT NULL GROUP BY session_id) AS o ON d.session_id = o.session_id""")


@query("duration_breakdown", f"""
SELECT session_id, {known('total_ms', 'total_ms')}, CAST(NULL AS BIGINT) AS generation_ms, 'unknown' AS generation_ms_coverage,
{', '.join(partial(n, n) for n in ['tool_ms', 'shell_ms', 'mcp_ms', 'spawn_agent_ms', 'idle_ms'])} FROM breakdown""")
def duration_breakdown(spark, sf):
    rows = events(spark, sf)
    return C.flatten_covered(M.duration_breakdown(M.session_duration(rows), O.project_operations(rows)))


TOK = M.SNAPSHOT
cte("token_rows", f"""
SELECT session_id, coalesce(thread_id, sender_thread_id) AS thread, seq, {', '.join(TOK)} FROM log_events WHERE event_type = 'info.tokens'
""")
cte("thread_tokens", f"""
SELECT session_id, thread, seq, {', '.join(TOK)} FROM (SELECT *, row_number() OVER (PARTITION BY session_id, thread ORDER BY seq DESC) AS rn
FROM token_rows WHERE thread IS NOT NULL AND coalesce({', '.join(TOK)}) IS NOT NULL) AS t WHERE rn = 1""")
cte("loose_tokens", f"""
SELECT session_id, {', '.join(TOK)} FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS rn
FROM token_rows WHERE thread IS NULL) AS t WHERE rn = 1 AND coalesce({', '.join(TOK)}) IS NOT NULL""")
cte("thread_parents", """
SELECT session_id, thread, arg_min(parent, seq) AS parent, count(DISTINCT parent) > 1 AS ambiguous
FROM (SELECT session_id, seq, coalesce(thread_id, sender_thread_id) AS thread, parent_thread_id AS parent FROM log_events) AS p
WHERE thread IS NOT NULL AND parent IS NOT NULL GROUP BY session_id, thread""")


@query("token_latest_by_thread", "SELECT * FROM thread_tokens")
def token_latest_by_thread(spark, sf):
    return M.token_latest_by_thread(M.thread_fold(events(spark, sf)))


@query("token_unscoped", "SELECT * FROM loose_tokens")
def token_unscoped(spark, sf):
    return M.token_unscoped(M.thread_fold(events(spark, sf)))


@query("thread_parent_state", "SELECT * FROM thread_parents")
def thread_parent_state(spark, sf):
    return M.thread_parent_state(M.thread_fold(events(spark, sf)))


def _ledger_sql(name: str) -> str:
    column = M.TOKENS[name]
    catalog = "s.tokens_used" if name == "total" else "CAST(NULL AS BIGINT)"
    value = f"CASE WHEN g.threads IS NOT NULL THEN g.sum_{column} WHEN u.session_id IS NOT NULL THEN u.{column} ELSE {catalog} END"
    return (
        f"CAST({value} AS BIGINT) AS {name}, CASE WHEN {value} IS NULL THEN 'unknown' WHEN g.threads IS NOT NULL AND g.n_{column} = g.threads "
        f"AND u.session_id IS NULL THEN 'known' ELSE 'partial' END AS {name}_coverage"
    )


cte("ledger_base", f"""
SELECT s.session_id, {', '.join(_ledger_sql(n) for n in M.TOKENS)},
  CASE WHEN g.threads IS NOT NULL THEN CASE WHEN g.children = 0 THEN 0 ELSE CAST(g.child_sum AS BIGINT) END END AS spawn_agent,
  CASE WHEN g.threads IS NULL OR (g.children > 0 AND g.child_sum IS NULL) THEN 'unknown'
    WHEN u.session_id IS NULL AND NOT coalesce(a.ambiguous, false) AND g.parentless <= 1 AND g.child_n = g.children THEN 'known' ELSE 'partial' END AS spawn_agent_coverage
FROM fx_sessions s LEFT JOIN loose_tokens u ON s.session_id = u.session_id
LEFT JOIN (SELECT session_id, bool_or(ambiguous) AS ambiguous FROM thread_parents GROUP BY session_id) AS a ON s.session_id = a.session_id
LEFT JOIN (SELECT t.session_id, count(*) AS threads, count(*) FILTER (WHERE p.parent IS NULL) AS parentless,
  count(*) FILTER (WHERE p.parent IS NOT NULL) AS children, {', '.join(f'sum({c}) AS sum_{c}, count({c}) AS n_{c}' for c in TOK)},
  sum(total_tokens) FILTER (WHERE p.parent IS NOT NULL) AS child_sum, count(total_tokens) FILTER (WHERE p.parent IS NOT NULL) AS child_n
  FROM thread_tokens t LEFT JOIN thread_parents p ON t.session_id = p.session_id AND t.thread = p.thread GROUP BY t.session_id) AS g
  ON s.session_id = g.session_id""")
cte("ledger", """
SELECT *, CASE WHEN total IS NOT NULL AND spawn_agent IS NOT NULL THEN greatest(total - spawn_agent, 0) END AS task,
  CASE WHEN total IS NULL OR spawn_agent IS NULL THEN 'unknown' WHEN total_coverage = 'known' AND spawn_agent_coverage = 'known' THEN 'known' ELSE 'partial' END AS task_coverage,
  CAST(NULL AS BIGINT) AS tool_call, 'unknown' AS tool_call_coverage FROM ledger_base""")


@query("token_ledger", "SELECT * FROM ledger")
def token_ledger(spark, sf):
    return C.flatten_covered(M.token_ledger(M.thread_fold(events(spark, sf)), fixtures.sessions(spark, sf)))


@query("coverage_sum", f"""
SELECT s.git_branch, {covered_sum('total')}, {covered_sum('spawn_agent')} FROM ledger l JOIN fx_sessions s ON s.session_id = l.session_id GROUP BY s.git_branch""")
def coverage_sum(spark, sf):
    catalog = fixtures.sessions(spark, sf)
    ledger = M.token_ledger(M.thread_fold(events(spark, sf)), catalog).join(catalog.select("session_id", "git_branch"), "session_id")
    sums = ledger.groupBy("git_branch").agg(C.covered_sum("total").alias("total"), C.covered_sum("spawn_agent").alias("spawn_agent"))
    return C.flatten_covered(sums)


@query("coverage_subtract", """
SELECT session_id, CASE WHEN total IS NOT NULL AND cached_input IS NOT NULL THEN greatest(total - cached_input, 0) END AS uncached,
  CASE WHEN total IS NULL OR cached_input IS NULL THEN 'unknown' WHEN total_coverage = 'known' AND cached_input_coverage = 'known' THEN 'known' ELSE 'partial' END AS uncached_coverage
FROM ledger""")
def coverage_subtract(spark, sf):
    ledger = M.token_ledger(M.thread_fold(events(spark, sf)), fixtures.sessions(spark, sf))
    return C.flatten_covered(ledger.select("session_id", C.covered_subtract(F.col("total"), F.col("cached_input")).alias("uncached")))


cte("view_uncached", """
SELECT session_id, CASE WHEN total IS NOT NULL AND cached_input IS NOT NULL THEN greatest(total - cached_input, 0) ELSE total END AS uncached,
  CASE WHEN total IS NULL OR cached_input IS NULL THEN total_coverage WHEN total_coverage = 'known' AND cached_input_coverage = 'known' THEN 'known' ELSE 'partial' END AS uncached_coverage
FROM ledger""")


@query("coverage_subtract_view", "SELECT * FROM view_uncached")
def coverage_subtract_view(spark, sf):
    ledger = M.token_ledger(M.thread_fold(events(spark, sf)), fixtures.sessions(spark, sf))
    return C.flatten_covered(ledger.select("session_id", C.covered_subtract_view(F.col("total"), F.col("cached_input")).alias("uncached")))


@query("turn_and_thread_counts", f"""
SELECT session_id, {known('t', 'turn_count')}, {partial('h', 'agent_work_item_count')}
FROM (SELECT session_id, nullif(count(DISTINCT turn_id), 0) AS t, nullif(count(DISTINCT thread_id), 0) AS h FROM log_events GROUP BY session_id) AS c""")
def turn_and_thread_counts(spark, sf):
    rows = events(spark, sf)
    return C.flatten_covered(M.turn_and_thread_counts(rows, M.thread_fold(rows)))


@query("runtime_context_values", f"""
SELECT session_id, {', '.join(known(n, n) for n in ['mcp_server_count', 'runtime_skills_count', 'runtime_start_context_size'])} FROM fold""")
def runtime_context_values(spark, sf):
    return C.flatten_covered(M.runtime_context_values(events(spark, sf)))


cte("start_context", "SELECT session_id, coalesce(runtime_start_context_size, context_tokens, context_legacy) AS start_context_size FROM fold")


@query("start_context_size", f"SELECT session_id, {known('start_context_size', 'start_context_size')} FROM start_context")
def start_context_size(spark, sf):
    return C.flatten_covered(M.start_context_size(events(spark, sf)))


# Line by line: after the heading, list items and blank lines until anything else.
cte("skill_lines", """
SELECT session_id, pos, trim(line) AS line FROM (SELECT session_id, unnest(string_split(first_text, chr(10))) AS line,
  unnest(range(len(string_split(first_text, chr(10))))) AS pos FROM fold WHERE first_text IS NOT NULL) AS l""")
cte("skill_block", """
SELECT l.session_id, regexp_extract(l.line, '^- +`*([^:`\\s]+)', 1) AS skill FROM skill_lines l
JOIN (SELECT session_id, min(pos) AS head FROM skill_lines WHERE line = '### Available skills' GROUP BY session_id) AS h ON l.session_id = h.session_id
LEFT JOIN (SELECT s.session_id, min(s.pos) AS stop FROM skill_lines s
  JOIN (SELECT session_id, min(pos) AS head FROM skill_lines WHERE line = '### Available skills' GROUP BY session_id) AS g ON s.session_id = g.session_id
  WHERE s.pos > g.head AND s.line <> '' AND regexp_extract(s.line, '^- +`*([^:`\\s]+)', 1) = '' GROUP BY s.session_id) AS e ON l.session_id = e.session_id
WHERE l.pos > h.head AND (e.stop IS NULL OR l.pos < e.stop)""")
cte("enabled_skills", """
SELECT f.session_id, coalesce(b.n, f.runtime_skills_count) AS skills_count FROM fold f
LEFT JOIN (SELECT session_id, count(DISTINCT skill) AS n FROM skill_block WHERE skill <> '' GROUP BY session_id) AS b ON f.session_id = b.session_id""")


@query("enabled_skills_count", f"SELECT session_id, {known('skills_count', 'skills_count')} FROM enabled_skills")
def enabled_skills_count(spark, sf):
    return C.flatten_covered(M.enabled_skills_count(events(spark, sf)))


cte("skill_ids", """
SELECT DISTINCT session_id, skill FROM (
  SELECT session_id, trim(regexp_extract(text, '<name>(.*?)</name>', 1)) AS skill FROM log_events
  WHERE event_type IN ('message.user', 'message.agent', 'message.commentary', 'agent.reasoning') AND text LIKE '%<skill>%'
  UNION ALL SELECT session_id, trim(unnest(string_split(skill_list, ','))) FROM log_events WHERE event_type = 'shell.call') AS x
WHERE skill <> ''""")


@query("used_skills", f"""
SELECT s.session_id, {known('n.c', 'used_skills')} FROM fx_sessions s
LEFT JOIN (SELECT session_id, count(*) AS c FROM skill_ids GROUP BY session_id) AS n ON s.session_id = n.session_id""")
def used_skills(spark, sf):
    return C.flatten_covered(M.used_skills(fixtures.sessions(spark, sf), M.used_skill_ids(events(spark, sf))))


@query("used_skill_ids", "SELECT * FROM skill_ids")
def used_skill_ids(spark, sf):
    return M.used_skill_ids(events(spark, sf))


@query("review_cycles", f"SELECT session_id, {partial('review_cycles', 'review_cycles')} FROM fold")
def review_cycles(spark, sf):
    return C.flatten_covered(M.review_cycles(M.session_fold(events(spark, sf))))


@query("review_findings", f"SELECT session_id, {partial('review_findings', 'review_findings')} FROM fold")
def review_findings(spark, sf):
    return C.flatten_covered(M.review_findings(events(spark, sf)))


cte("efficiency", """
SELECT o.session_id, CASE WHEN o.outcome = 'completed' THEN CAST(l.total AS DOUBLE) END AS tokens_per_successful_session,
  CASE WHEN l.total > 0 THEN f.review_findings * 1000.0 / CAST(l.total AS DOUBLE) END AS review_findings_per_1k_tokens
FROM outcomes o JOIN ledger l ON o.session_id = l.session_id JOIN fold f ON f.session_id = o.session_id""")


@query("derived_efficiency", f"""
SELECT session_id, {known('tokens_per_successful_session', 'tokens_per_successful_session')}, CAST(NULL AS DOUBLE) AS tokens_per_accepted_task,
  'unknown' AS tokens_per_accepted_task_coverage, {partial('round(review_findings_per_1k_tokens, 6)', 'review_findings_per_1k_tokens')} FROM efficiency""")
def derived_efficiency(spark, sf):
    rows = events(spark, sf)
    out = M.derived_efficiency(M.session_fold(rows), M.token_ledger(M.thread_fold(rows), fixtures.sessions(spark, sf)))
    return C.flatten_covered(out).withColumn("review_findings_per_1k_tokens", F.round("review_findings_per_1k_tokens", 6))


cte("sandbox", """
SELECT session_id, coalesce(nullif(trim(CASE WHEN sandbox_policy LIKE '{%' THEN json_extract_string(sandbox_policy, '$.type') END), ''), sandbox_policy) AS sandbox_policy_kind
FROM fx_sessions""")


@query("factor_metadata", f"""
SELECT s.session_id, s.model, s.reasoning_effort, s.cli_version, s.approval_mode, s.agent_role, b.sandbox_policy_kind, {known('e.skills_count', 'skills_count')},
  {known('f.mcp_server_count', 'mcp_server_count')}, {known('f.mcp_call_count', 'mcp_call_count')}, {known('c.start_context_size', 'start_context_size')}
FROM fx_sessions s JOIN sandbox b ON b.session_id = s.session_id JOIN fold f ON f.session_id = s.session_id JOIN enabled_skills e ON e.session_id = s.session_id
JOIN start_context c ON c.session_id = s.session_id""")
def factor_metadata(spark, sf):
    return C.flatten_covered(M.factor_metadata(M.session_fold(events(spark, sf)), metric_sessions(spark, sf)))


@query("session_request_and_title", """
SELECT s.session_id, coalesce(s.first_user_message, f.user_message) AS start_user_request,
  CASE WHEN s.first_user_message IS NOT NULL THEN 'indexed_first_user_message' WHEN f.user_message IS NOT NULL THEN 'message_user' ELSE 'unavailable' END AS start_user_request_source,
  coalesce(nullif(trim(s.title), ''), f.task_title, n.thread_name) AS task_summary,
  CASE WHEN trim(s.title) <> '' THEN 'indexed_title' WHEN f.task_title IS NOT NULL THEN 'task_started' WHEN n.thread_name IS NOT NULL THEN 'indexed_title' ELSE 'unavailable' END AS task_summary_source
FROM fx_sessions s JOIN fold f ON f.session_id = s.session_id
JOIN (SELECT session_id, coalesce(nullif(trim(title), ''), first_user_message, agent_nickname) AS thread_name FROM fx_sessions) AS n ON n.session_id = s.session_id""")
def session_request_and_title(spark, sf):
    return M.session_request_and_title(M.session_fold(events(spark, sf)), metric_sessions(spark, sf))
