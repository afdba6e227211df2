"""Registered queries and comparison SQL for normalisation and the raw-log rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.functions import exprs as X
from loomtrace.functions import json as J
from loomtrace.functions import tools as T
from loomtrace.operators import normalize as N
from loomtrace.plans import fixtures
from loomtrace.plans.oracle import cte

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def js(path: str, tree: str = "p") -> str:
    """String at a path, null for other types."""
    return f"(CASE WHEN json_type({tree}, '{path}') = 'VARCHAR' THEN json_extract_string({tree}, '{path}') END)"


def ji(path: str, tree: str = "p") -> str:
    return f"(CASE WHEN json_type({tree}, '{path}') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract_string({tree}, '{path}') AS BIGINT) END)"


WS = "' ' || chr(9) || chr(10) || chr(13)"
cte("lines", """
SELECT session_id, seq, read_at, value, coalesce(json_valid(value) AND json_type(CASE WHEN json_valid(value) THEN value END) = 'OBJECT', false) AS valid,
  CASE WHEN json_valid(value) THEN value END AS rec FROM fx_lines""")
cte("parsed", f"""
SELECT *, coalesce({js('$.type')}, 'unknown') AS t, coalesce({js('$.call_id')}, '') AS call_id, {js('$.name')} AS name, {js('$.id')} AS p_id FROM (
  SELECT *, coalesce({js('$.timestamp', 'rec')}, read_at) AS ts, CASE WHEN valid THEN coalesce({js('$.type', 'rec')}, 'unknown') ELSE 'invalid_json' END AS raw_type,
    CASE WHEN valid AND json_type(rec, '$.payload') = 'OBJECT' THEN json_extract(rec, '$.payload') END AS p FROM lines) AS a""")
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
cte("named", f"""
SELECT *, CASE WHEN call_id <> '' THEN last_value(CASE WHEN raw_type = 'response_item' AND t IN ('function_call', 'custom_tool_call') THEN coalesce(name, 'unknown') END IGNORE NULLS)
    OVER (PARTITION BY session_id, call_id ORDER BY seq {BEFORE}) END AS call_name,
  coalesce(call_id <> '' AND bool_or(raw_type = 'event_msg' AND t = 'patch_apply_end') OVER (PARTITION BY session_id, call_id ORDER BY seq {BEFORE}), false) AS patch_ended,
  last_value(CASE WHEN valid AND (raw_type <> 'event_msg' OR p IS NOT NULL) THEN raw_type END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq {BEFORE}) AS previous_type,
  last_value(CASE WHEN raw_type = 'session_meta' AND p IS NOT NULL AND coalesce(p_id, session_id) = session_id THEN {js('$.source.subagent.thread_spawn.parent_thread_id')} END IGNORE NULLS)
    OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS parent_thread_id
FROM parsed""")
cte("tooled", """
SELECT *, CASE WHEN raw_type = 'response_item' AND t IN ('function_call', 'custom_tool_call') THEN coalesce(name, 'unknown')
  WHEN raw_type = 'response_item' AND t IN ('function_call_output', 'custom_tool_call_output') THEN coalesce(call_name, 'unknown')
  WHEN (raw_type = 'response_item' AND t = 'web_search_call') OR (raw_type = 'event_msg' AND t = 'web_search_end') THEN 'web_search_call'
  WHEN raw_type = 'event_msg' AND t = 'patch_apply_end' THEN 'apply_patch'
  WHEN raw_type = 'event_msg' AND t IN ('exec_command_end', 'collab_agent_spawn_end', 'collab_waiting_end', 'collab_close_end', 'collab_agent_interaction_end') THEN
    coalesce(call_name, CASE t WHEN 'exec_command_end' THEN 'exec_command' WHEN 'collab_agent_spawn_end' THEN 'spawn_agent' WHEN 'collab_waiting_end' THEN 'wait_agent'
      WHEN 'collab_close_end' THEN 'close_agent' ELSE 'send_input' END)
  WHEN raw_type = 'event_msg' AND t = 'item_completed' THEN 'update_plan' END AS tool FROM named""")


def tool_type(name: str, is_result: bool) -> str:
    kind = "result" if is_result else "call"
    return (
        f"CASE WHEN {name} = 'update_plan' THEN 'todo.update' WHEN {name} = 'request_user_input' THEN 'user.input.request' WHEN {name} = 'write_stdin' THEN 'stdin.write' "
        f"WHEN {name} = 'spawn_agent' THEN 'collab.spawn_agent' WHEN {name} = 'send_input' THEN 'collab.send_input' WHEN {name} IN ('wait', 'wait_agent') THEN 'collab.wait' "
        f"WHEN {name} = 'close_agent' THEN 'collab.close_agent' WHEN {name} = 'resume_agent' THEN 'collab.resume_agent' "
        f"WHEN {name} IN ('command_execution', 'exec_command') THEN 'shell.{kind}' ELSE 'tool.{kind}' END"
    )


RES = "tool IN ('list_mcp_resources', 'list_mcp_resource_templates', 'read_mcp_resource')"
OPEN = f"coalesce(trim(coalesce({js('$.action')}, {js('$.action.type')})) = 'open_page', false)"
ROLE = f"coalesce(nullif(lower(trim({js('$.role')})), ''), 'assistant')"
COLLAB = "t IN ('collab_agent_spawn_end', 'collab_waiting_end', 'collab_close_end', 'collab_agent_interaction_end')"
cte("typed_lines", f"""
SELECT *, CASE WHEN NOT valid THEN 'raw.unparsed' WHEN raw_type = 'compacted' THEN 'context.compacted' WHEN raw_type = 'turn_context' THEN 'runtime.context'
  WHEN p IS NULL THEN 'raw.unparsed' WHEN raw_type = 'session_meta' THEN CASE WHEN coalesce(p_id, session_id) = session_id THEN 'agent.session' ELSE 'agent.session.foreign' END
  WHEN raw_type = 'response_item' THEN CASE t WHEN 'function_call' THEN CASE WHEN {RES} THEN 'mcp.call' ELSE {tool_type('tool', False)} END
    WHEN 'function_call_output' THEN CASE WHEN {RES} THEN 'mcp.result' ELSE {tool_type('tool', True)} END
    WHEN 'custom_tool_call' THEN CASE WHEN tool = 'apply_patch' THEN 'patch.apply' ELSE 'tool.call' END
    WHEN 'custom_tool_call_output' THEN CASE WHEN tool <> 'apply_patch' THEN 'tool.result' WHEN patch_ended THEN 'patch.apply.duplicate' ELSE 'patch.apply' END
    WHEN 'web_search_call' THEN CASE WHEN {OPEN} THEN 'web.open' ELSE 'web.search' END WHEN 'message' THEN concat('message.', {ROLE}) WHEN 'reasoning' THEN 'agent.reasoning' ELSE 'raw.unparsed' END
  WHEN raw_type = 'event_msg' THEN CASE WHEN t = 'agent_message' THEN concat('message.', {ROLE}) WHEN t = 'token_count' THEN 'info.tokens' WHEN t = 'task_started' THEN 'task.started'
    WHEN t = 'task_complete' THEN 'task.completed' WHEN t = 'user_message' THEN 'message.user' WHEN t = 'turn_aborted' THEN 'agent.aborted' WHEN t = 'patch_apply_end' THEN 'patch.apply'
    WHEN t = 'context_compacted' THEN CASE WHEN previous_type = 'compacted' THEN 'context.compacted.duplicate' ELSE 'context.compacted' END
    WHEN t = 'web_search_end' THEN CASE WHEN {OPEN} THEN 'web.open' ELSE 'web.search' END WHEN t = 'exec_command_end' OR {COLLAB} THEN {tool_type('tool', True)}
    WHEN t = 'item_completed' AND {js('$.item.type')} = 'Plan' THEN 'todo.update' ELSE 'raw.unparsed' END ELSE 'raw.unparsed' END AS event_type FROM tooled""")
PARTS = "array_to_string(list_filter(json_extract_string({x}, '$[*].text'), lambda s: s <> ''), chr(10))"
SINGLE = "event_type IN ('todo.update', 'user.input.request', 'stdin.write') OR event_type LIKE 'collab.%'"
cte("messages", f"""
SELECT *, CASE WHEN raw_type = 'response_item' AND t = 'message' THEN coalesce(trim({PARTS.format(x="json_extract(p, '$.content')")}, {WS}), '')
    WHEN raw_type = 'response_item' AND t = 'reasoning' THEN coalesce(trim({PARTS.format(x="json_extract(p, '$.summary')")}, {WS}), '')
    WHEN raw_type = 'event_msg' AND t IN ('agent_message', 'user_message') THEN coalesce({js('$.message')}, '') END AS text,
  coalesce((raw_type = 'response_item' AND t = 'message') OR (raw_type = 'event_msg' AND t IN ('agent_message', 'user_message')), false) AND p IS NOT NULL AS is_message,
  CASE WHEN raw_type = 'event_msg' AND t = 'user_message' THEN 'user' WHEN t IN ('message', 'agent_message') THEN {ROLE} END AS role,
  CASE WHEN NOT valid THEN 'unparsed' WHEN event_type = 'raw.unparsed' THEN 'best_effort' ELSE 'parsed' END AS parse_status FROM typed_lines""")
cte("considered", """
SELECT *, lag(is_message) OVER w AS m0, lag(role) OVER w AS r0, lag(text) OVER w AS t0, lag(raw_type) OVER w AS o0 FROM messages
WHERE valid AND event_type NOT IN ('agent.session.foreign', 'patch.apply.duplicate', 'context.compacted.duplicate')
  AND (p IS NOT NULL OR raw_type NOT IN ('session_meta', 'response_item', 'event_msg'))
WINDOW w AS (PARTITION BY session_id ORDER BY seq)""")
cte("islands", f"""
SELECT *, sum(CASE WHEN is_message AND m0 AND role = r0 AND trim(text, {WS}) = trim(t0, {WS}) AND trim(text, {WS}) <> '' THEN 0 ELSE 1 END)
  OVER (PARTITION BY session_id ORDER BY seq) AS island FROM considered""")
cte("echoes", """
SELECT session_id, seq FROM (SELECT *, first_value(raw_type) OVER (PARTITION BY session_id, island ORDER BY seq) AS opener FROM islands WHERE is_message) AS i WHERE raw_type <> opener""")
cte("normal", f"""
SELECT m.session_id, m.seq, m.ts, m.event_type, m.raw_type, m.parse_status, m.parent_thread_id, CASE WHEN m.event_type <> 'raw.unparsed' THEN m.tool END AS tool_name, m.text, m.role, m.t, m.p, m.call_name, m.value,
  CASE WHEN m.raw_type = 'response_item' AND t = 'web_search_call' THEN p_id WHEN t = 'item_completed' THEN {js('$.item.id')} WHEN tool IS NOT NULL AND call_id <> '' THEN call_id END AS operation_id,
  CASE WHEN p IS NULL THEN NULL WHEN raw_type = 'response_item' AND t = 'function_call' THEN CASE WHEN {SINGLE} OR event_type = 'mcp.call' THEN 'started' END
    WHEN raw_type = 'response_item' AND t = 'custom_tool_call' THEN CASE WHEN event_type = 'patch.apply' THEN 'started' END
    WHEN t IN ('function_call_output', 'custom_tool_call_output', 'patch_apply_end', 'exec_command_end', 'web_search_end') OR {COLLAB} THEN 'completed'
    WHEN t = 'web_search_call' THEN coalesce(nullif(trim({js('$.phase')}), ''), CASE {js('$.status')} WHEN 'in_progress' THEN 'started' WHEN 'started' THEN 'started' WHEN 'running' THEN 'started' WHEN 'updated' THEN 'updated' ELSE 'completed' END)
    WHEN event_type = 'todo.update' THEN 'completed' END AS phase,
  CASE WHEN p IS NULL THEN NULL WHEN t = 'function_call_output' THEN CASE WHEN NOT ({SINGLE}) THEN 'completed' END WHEN t IN ('custom_tool_call', 'web_search_call') THEN {js('$.status')}
    WHEN t = 'custom_tool_call_output' THEN CASE WHEN event_type LIKE 'patch.apply%' THEN CASE WHEN lower({js('$.output')}) LIKE '%failed%' OR lower({js('$.output')}) LIKE '%error%' THEN 'failed' ELSE 'completed' END END
    WHEN t = 'patch_apply_end' THEN 'completed' WHEN t = 'exec_command_end' THEN coalesce({js('$.status')}, 'completed')
    WHEN t = 'collab_agent_spawn_end' THEN 'pending_init' WHEN {COLLAB} THEN 'completed' WHEN t = 'item_completed' THEN 'completed' END AS status,
  CASE WHEN event_type = 'patch.apply.duplicate' THEN 'event_msg.patch_apply_end' WHEN event_type = 'context.compacted.duplicate' THEN 'compacted'
    WHEN t = 'exec_command_end' OR {COLLAB} THEN 'response_item.function_call_output' WHEN t = 'item_completed' THEN 'response_item.message' END AS duplicate_of
FROM messages m WHERE NOT EXISTS (SELECT 1 FROM echoes e WHERE e.session_id = m.session_id AND e.seq = m.seq)""")
NORMAL = ["session_id", "seq", "ts", "event_type", "raw_type", "parse_status", "parent_thread_id", "tool_name", "operation_id", "phase", "status", "duplicate_of", "text"]


def silver(spark, sf):
    return fixtures.silver(spark, sf)


@query("normalize_session_records", f"SELECT {', '.join(NORMAL)} FROM normal")
def normalize_session_records(spark, sf):
    return silver(spark, sf).select(*NORMAL)


@query("resolve_call_name", "SELECT session_id, seq, call_id, call_name FROM named WHERE call_id <> ''")
def resolve_call_name(spark, sf):
    return N.resolve_call_names(fixtures.bronze(spark, sf)).where("call_id <> ''").select("session_id", "seq", "call_id", "call_name")


@query("mark_patch_duplicate", "SELECT session_id, seq, operation_id, duplicate_of FROM normal WHERE event_type = 'patch.apply.duplicate'")
def mark_patch_duplicate(spark, sf):
    return silver(spark, sf).where(F.col("event_type") == "patch.apply.duplicate").select("session_id", "seq", "operation_id", "duplicate_of")


@query("mark_compaction_duplicate", "SELECT session_id, seq, event_type, duplicate_of FROM normal WHERE event_type LIKE 'context.compacted%'")
def mark_compaction_duplicate(spark, sf):
    return silver(spark, sf).where(F.col("event_type").startswith("context.compacted")).select("session_id", "seq", "event_type", "duplicate_of")


@query("drop_message_echo", "SELECT session_id, seq, event_type, text FROM normal WHERE event_type LIKE 'message.%'")
def drop_message_echo(spark, sf):
    return silver(spark, sf).where(F.col("event_type").startswith("message.")).select("session_id", "seq", "event_type", "text")


@query("carry_parent_thread", "SELECT session_id, seq, parent_thread_id FROM named")
def carry_parent_thread(spark, sf):
    return N.carry_context(fixtures.bronze(spark, sf)).select("session_id", "seq", "parent_thread_id")


@query("flag_foreign_session", "SELECT session_id, seq, json_extract_string(p, '$.id') AS foreign_thread_id FROM normal WHERE event_type = 'agent.session.foreign'")
def flag_foreign_session(spark, sf):
    return silver(spark, sf).where(F.col("event_type") == "agent.session.foreign").select("session_id", "seq", "foreign_thread_id")


@query("message_text", "SELECT session_id, seq, text FROM normal WHERE text IS NOT NULL")
def message_text(spark, sf):
    return silver(spark, sf).where(F.col("text").isNotNull()).select("session_id", "seq", "text")


@query("message_role_direction", """
SELECT session_id, seq, event_type, role, CASE t WHEN 'message' THEN 'input_text' WHEN 'agent_message' THEN 'output_text' ELSE 'input_text' END AS direction
FROM normal WHERE event_type LIKE 'message.%'""")
def message_role_direction(spark, sf):
    return silver(spark, sf).where(F.col("event_type").startswith("message.")).select("session_id", "seq", "event_type", "role", "direction")


@query("flatten_token_counts", f"""
SELECT session_id, seq, {', '.join(f"{ji('$.info.total_token_usage.' + c)} AS {c}" for c in N.TOKEN_FIELDS)} FROM normal WHERE event_type = 'info.tokens'""")
def flatten_token_counts(spark, sf):
    return silver(spark, sf).where(F.col("event_type") == "info.tokens").select("session_id", "seq", *N.TOKEN_FIELDS)


@query("parse_embedded_json", f"""
SELECT session_id, seq, json_valid({js('$.output')}) AS is_json, CASE WHEN json_valid({js('$.output')}) THEN json_extract_string({js('$.output')}, '$.agent_id') END AS agent_id,
  CASE WHEN NOT json_valid({js('$.output')}) THEN {js('$.output')} END AS plain FROM normal WHERE t = 'function_call_output'""")
def parse_embedded_json(spark, sf):
    rows = silver(spark, sf).where((F.col("raw_type") == "response_item") & F.try_variant_get("payload", "$.type", "string").isin("function_call_output"))
    raw = J.text(F.col("payload"), "$.output")
    tree = J.parse(raw)
    return rows.select("session_id", "seq", tree.isNotNull().alias("is_json"), J.text(tree, "$.agent_id").alias("agent_id"), F.when(tree.isNull(), raw).alias("plain"))


@query("response_phase", "SELECT session_id, seq, event_type, phase, status FROM normal WHERE event_type LIKE 'web.%'")
def response_phase(spark, sf):
    return silver(spark, sf).where(F.col("event_type").startswith("web.")).select("session_id", "seq", "event_type", "phase", "status")


@query("custom_tool_status", "SELECT session_id, seq, status FROM normal WHERE t = 'custom_tool_call_output' AND event_type LIKE 'patch.apply%'")
def custom_tool_status(spark, sf):
    rows = silver(spark, sf).where(F.try_variant_get("payload", "$.type", "string") == "custom_tool_call_output")
    return rows.where(F.col("event_type").startswith("patch.apply")).select("session_id", "seq", "status")


RAW_OUT = js("$.output")
cte("shell_outputs", f"""
SELECT session_id, seq, CASE WHEN t = 'exec_command_end' THEN CAST({ji('$.exit_code')} AS INTEGER) WHEN json_valid({RAW_OUT}) THEN CAST(json_extract_string({RAW_OUT}, '$.exit_code') AS INTEGER)
  ELSE TRY_CAST(nullif(regexp_extract({RAW_OUT}, 'Process exited with code ([+-]?[0-9]+)', 1), '') AS INTEGER) END AS exit_code,
  CASE WHEN t = 'function_call_output' AND NOT json_valid({RAW_OUT}) THEN TRY_CAST(replace(nullif(regexp_extract({RAW_OUT}, 'Original token count: ([0-9,]+)', 1), ''), ',', '') AS BIGINT) END AS original_token_count
FROM normal WHERE event_type = 'shell.result'""")


@query("shell_result_fields", "SELECT * FROM shell_outputs")
def shell_result_fields(spark, sf):
    return silver(spark, sf).where(F.col("event_type") == "shell.result").select("session_id", "seq", "exit_code", "original_token_count")


@query("legacy_status", f"SELECT session_id, seq, status FROM normal WHERE raw_type = 'event_msg' AND {COLLAB}")
def legacy_status(spark, sf):
    return silver(spark, sf).where(F.col("detection_confidence").isNotNull()).select("session_id", "seq", "status")


@query("legacy_receivers_states", f"""
SELECT session_id, seq, CASE t WHEN 'collab_agent_spawn_end' THEN {js('$.new_thread_id')} ELSE concat(json_extract_string(p, '$.agent_statuses[0].thread_id'),
    CASE WHEN json_extract_string(p, '$.agent_statuses[0].thread_id') <> json_extract_string(p, '$.agent_statuses[1].thread_id') THEN concat(',', json_extract_string(p, '$.agent_statuses[1].thread_id')) ELSE '' END,
    ',', json_keys(p, '$.statuses')[1]) END AS receivers, CASE WHEN tool_name IN ('spawn_agent', 'send_input', 'wait', 'wait_agent', 'close_agent', 'resume_agent') THEN 'high' ELSE 'medium' END AS detection_confidence
FROM normal WHERE raw_type = 'event_msg' AND {COLLAB}""")
def legacy_receivers_states(spark, sf):
    rows = silver(spark, sf).where(F.col("detection_confidence").isNotNull())
    return rows.select("session_id", "seq", F.array_join("receiver_thread_ids", ",").alias("receivers"), "detection_confidence")


@query("spawn_enrichment", f"""
SELECT session_id, seq, CASE WHEN t = 'function_call' THEN json_extract_string({js('$.arguments')}, '$.message') END AS prompt,
  CASE WHEN t = 'function_call' THEN json_extract_string({js('$.arguments')}, '$.agent_type') END AS requested_agent_type,
  CASE WHEN t = 'function_call' THEN json_extract_string({js('$.arguments')}, '$.model') END AS model,
  CASE WHEN t = 'function_call_output' AND json_valid({RAW_OUT}) THEN json_extract_string({RAW_OUT}, '$.agent_id') END AS new_thread_id,
  CASE WHEN t = 'function_call_output' AND json_valid({RAW_OUT}) THEN json_extract_string({RAW_OUT}, '$.nickname') END AS new_agent_nickname
FROM normal WHERE event_type = 'collab.spawn_agent' AND raw_type = 'response_item'""")
def spawn_enrichment(spark, sf):
    rows = silver(spark, sf).where((F.col("event_type") == "collab.spawn_agent") & (F.col("raw_type") == "response_item"))
    return rows.select("session_id", "seq", "prompt", "requested_agent_type", "model", "new_thread_id", "new_agent_nickname")


@query("quarantine_unparsed", """
SELECT session_id, seq, parse_status, CASE WHEN parse_status = 'unparsed' THEN 'invalid_json' WHEN raw_type IN ('session_meta', 'response_item', 'event_msg') AND p IS NULL THEN concat('missing ', raw_type, ' payload object')
  WHEN raw_type = 'response_item' THEN concat('unsupported response_item.type=', t) WHEN raw_type = 'event_msg' THEN concat('unsupported event_msg.type=', t)
  ELSE concat('unsupported subagent record type=', raw_type) END AS reason_unparsed, value AS raw_line FROM normal WHERE event_type = 'raw.unparsed'""")
def quarantine_unparsed(spark, sf):
    return N.quarantine(silver(spark, sf))


@query("run_counters", """
SELECT session_id AS run_id, 'event' AS counter, event_type AS name, count(*) AS n FROM normal GROUP BY session_id, event_type
UNION ALL SELECT session_id, 'tool', tool_name, count(*) FROM normal WHERE tool_name IS NOT NULL GROUP BY session_id, tool_name
UNION ALL SELECT session_id, 'subagent', tool_name, count(*) FROM normal WHERE tool_name IN ('spawn_agent', 'send_input', 'wait', 'wait_agent', 'close_agent', 'resume_agent') GROUP BY session_id, tool_name""")
def run_counters(spark, sf):
    return N.run_counters(silver(spark, sf))


@query("extract_skill_paths", """
SELECT session_id, seq, concat(CASE WHEN event_type = 'shell.call' THEN 's' ELSE 'e' END, regexp_extract(CAST(p AS VARCHAR), '/[se]([0-9])/SKILL', 1)) AS skills FROM normal
WHERE event_type IN ('shell.call', 'shell.result') AND CAST(p AS VARCHAR) LIKE '%SKILL.md%' UNION ALL
SELECT session_id, seq, concat('e', regexp_extract(CAST(p AS VARCHAR), '/[se]([0-9])/SKILL', 1)) FROM normal WHERE t = 'exec_command_end' AND event_type NOT IN ('shell.call', 'shell.result')""")
def extract_skill_paths(spark, sf):
    rows = silver(spark, sf).where(F.col("skill_identifiers").isNotNull())
    return rows.select("session_id", "seq", F.array_join("skill_identifiers", ",").alias("skills"))


@query("shell_command", """
SELECT session_id, seq, CASE WHEN t = 'exec_command_end' THEN json_extract_string(p, '$.command[2]') ELSE json_extract_string(json_extract_string(p, '$.arguments'), '$.cmd') END AS command
FROM normal WHERE t = 'exec_command_end' OR (t = 'function_call' AND tool_name = 'exec_command')""")
def shell_command(spark, sf):
    return silver(spark, sf).where(F.col("input_command").isNotNull()).select("session_id", "seq", F.col("input_command").alias("command"))


@query("startup_metadata", """
SELECT session_id, json_extract_string(p, '$.id') AS first_id, json_extract_string(p, '$.cwd') AS cwd, CAST(seq AS BIGINT) AS seq, lead_line FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rn, seq = (SELECT min(f.seq) FROM parsed f WHERE f.session_id = q.session_id) AND json_extract_string(p, '$.id') = session_id AS lead_line
  FROM parsed q WHERE raw_type = 'session_meta' AND p IS NOT NULL) AS m WHERE rn = 1""")
def startup_metadata(spark, sf):
    from loomtrace.sources.logs import startup_metadata as first_meta

    return first_meta(fixtures.bronze(spark, sf))


cte("tools_seen", "SELECT DISTINCT tool FROM tooled WHERE tool IS NOT NULL")


@query("tool_event_type", f"SELECT session_id, seq, name, {tool_type('name', False)} AS call_type, {tool_type('name', True)} AS result_type FROM parsed WHERE name IS NOT NULL")
def tool_event_type(spark, sf):
    rows = fixtures.bronze(spark, sf).where(F.col("name").isNotNull())
    return rows.select("session_id", "seq", "name", T.tool_event_type(F.col("name"), False).alias("call_type"), T.tool_event_type(F.col("name"), True).alias("result_type"))


@query("tool_predicates", f"""
SELECT session_id, seq, coalesce(name IN ('spawn_agent', 'send_input', 'wait', 'wait_agent', 'close_agent', 'resume_agent'), false) AS is_subagent,
  CASE WHEN name IN ('list_mcp_resources', 'list_mcp_resource_templates', 'read_mcp_resource') THEN 'agent' END AS server, {OPEN} AS opens_page FROM parsed""")
def tool_predicates(spark, sf):
    name, p = F.col("name"), F.col("p")
    return fixtures.bronze(spark, sf).select(
        "session_id", "seq", F.coalesce(T.is_subagent_tool(name), F.lit(False)).alias("is_subagent"), T.resource_server(name, "agent").alias("server"),
        T.is_open_page(J.text(p, "$.action"), J.text(p, "$.action.type")).alias("opens_page"),
    )


# ---- stdout ------------------------------------------------------------------------------------

cte("out_items", f"""
SELECT *, CASE WHEN json_extract_string(i1, '$.type') IN ('item.started', 'item.updated', 'item.completed') THEN json_extract(i1, '$.item') ELSE i1 END AS item,
  CASE WHEN json_extract_string(i1, '$.type') IN ('item.started', 'item.updated', 'item.completed') THEN json_extract_string(i1, '$.type') ELSE raw_type END AS phase_type
FROM (SELECT *, CASE WHEN raw_type LIKE 'item.%' THEN json_extract(rec, '$.item') END AS i1 FROM (
  SELECT *, CASE WHEN json_valid(value) THEN value END AS rec, CASE WHEN json_valid(value) THEN json_extract_string(value, '$.type') ELSE 'invalid_json' END AS raw_type FROM fx_stdout) AS a) AS b""")
cte("out_rows", f"""
SELECT *, json_extract_string(item, '$.type') AS it, CASE phase_type WHEN 'item.started' THEN 'started' WHEN 'item.updated' THEN 'updated' ELSE 'completed' END AS ph,
  last_value(CASE WHEN raw_type = 'thread.started' THEN json_extract_string(rec, '$.thread_id') END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seq) AS thread FROM out_items""")
cte("out_events", """
SELECT *, CASE WHEN raw_type = 'invalid_json' THEN 'raw.unparsed' WHEN it = 'agent_message' THEN 'message.agent' WHEN it = 'command_execution' THEN CASE WHEN ph = 'started' THEN 'shell.call' ELSE 'shell.result' END
  WHEN it = 'todo_list' THEN 'todo.update' WHEN it = 'collab_tool_call' THEN 'collab.spawn_agent' WHEN it = 'file_change' THEN 'file.change' WHEN it = 'mcp_tool_call' THEN CASE WHEN ph = 'started' THEN 'mcp.call' ELSE 'mcp.result' END
  WHEN it = 'tool_use' THEN 'stdin.write' WHEN it = 'tool_result' THEN 'tool.result' WHEN it = 'web_search' THEN 'web.open' WHEN raw_type = 'thread.started' THEN 'thread.started'
  WHEN raw_type = 'turn.started' THEN 'agent.started' WHEN raw_type = 'turn.completed' THEN 'agent.completed' WHEN raw_type = 'turn.failed' THEN 'agent.failed' WHEN raw_type = 'error' THEN 'error' ELSE 'raw.unparsed' END AS event_type,
  CASE it WHEN 'command_execution' THEN 'command_execution' WHEN 'mcp_tool_call' THEN json_extract_string(item, '$.tool') WHEN 'collab_tool_call' THEN json_extract_string(item, '$.tool') WHEN 'web_search' THEN 'web_search'
    WHEN 'tool_use' THEN json_extract_string(item, '$.name') WHEN 'tool_result' THEN json_extract_string(item, '$.name') END AS tool_name FROM out_rows""")


@query("normalize_stdout_records", """
SELECT run_id, seq, event_type, raw_type, CASE WHEN raw_type = 'invalid_json' THEN 'unparsed' ELSE 'parsed' END AS parse_status,
  CASE WHEN raw_type <> 'invalid_json' THEN CASE WHEN it = 'collab_tool_call' THEN 'th0' ELSE thread END END AS thread_id, tool_name,
  CASE WHEN it = 'tool_result' THEN json_extract_string(item, '$.tool_use_id') ELSE json_extract_string(item, '$.id') END AS operation_id,
  CASE WHEN it IN ('mcp_tool_call', 'web_search', 'todo_list', 'collab_tool_call') THEN ph WHEN it = 'tool_use' THEN 'started' END AS phase, json_extract_string(item, '$.status') AS status,
  CASE WHEN it = 'agent_message' THEN json_extract_string(item, '$.text') END AS text FROM out_events""")
def normalize_stdout_records(spark, sf):
    columns = ["run_id", "seq", "event_type", "raw_type", "parse_status", "thread_id", "tool_name", "operation_id", "phase", "status", "text"]
    return fixtures.stdout_events(spark, sf).select(*columns)


@query("todo_counts", "SELECT run_id, seq, CAST(3 AS BIGINT) AS todo_total, CAST(1 AS BIGINT) AS todo_completed FROM out_events WHERE it = 'todo_list'")
def todo_counts(spark, sf):
    return fixtures.stdout_events(spark, sf).where(F.col("todo_total").isNotNull()).select("run_id", "seq", "todo_total", "todo_completed")


@query("file_changes", """
SELECT run_id, seq, 'add' AS kind, json_extract_string(item, '$.changes[0].path') AS path FROM out_events WHERE it = 'file_change'
UNION ALL SELECT run_id, seq, 'update', '' FROM out_events WHERE it = 'file_change'""")
def file_changes(spark, sf):
    rows = fixtures.stdout_events(spark, sf).select("run_id", "seq", F.explode("file_changes").alias("c"))
    return rows.select("run_id", "seq", "c.kind", "c.path")


cte("out_text", """SELECT run_id, seq, event_type, CASE event_type WHEN 'message.agent' THEN json_extract_string(item, '$.text') WHEN 'error' THEN json_extract_string(rec, '$.message')
  WHEN 'agent.failed' THEN json_extract_string(rec, '$.error.message') END AS x FROM out_events WHERE event_type IN ('message.agent', 'error', 'agent.failed')""")


def rx(pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract(x, '{pattern}', {group}), '')"


LINKS = {
    "request_id": rx(r"\brequest ID ([0-9a-fA-F-]{8,})\b"), "reconnect_attempt": f"CAST({rx(r'Reconnecting\.\.\.\s*(\d+)\s*/\s*(\d+)')} AS INTEGER)",
    "reconnect_limit": f"CAST({rx(r'Reconnecting\.\.\.\s*(\d+)\s*/\s*(\d+)', 2)} AS INTEGER)", "status_code": f"CAST({rx(r'\bstatus\s+(\d{3})\s+([A-Za-z]+)\b')} AS INTEGER)",
    "status_text": rx(r"\bstatus\s+(\d{3})\s+([A-Za-z]+)\b", 2), "url": rx(r"\burl:\s*(https?://[^\s,)]+|wss?://[^\s,)]+)"),
    "scheme": rx(r"\burl:\s*(https?|wss?)://"), "host": rx(r"\burl:\s*(?:https?|wss?)://([^\s,)/]+)"), "cf_ray": rx(r"(?i)\bcf-ray:\s*([^\s,)]+)"),
}


@query("extract_text_links", f"""
SELECT * FROM (SELECT run_id, seq, {', '.join(f'{e} AS {n}' for n, e in LINKS.items())} FROM out_text) AS l
WHERE coalesce(request_id, CAST(reconnect_attempt AS VARCHAR), CAST(status_code AS VARCHAR), url, cf_ray) IS NOT NULL""")
def extract_text_links(spark, sf):
    rows = fixtures.stdout_events(spark, sf).where(F.col("text_links").isNotNull())
    return rows.select("run_id", "seq", *[F.col(f"text_links.{n}").alias(n) for n in LINKS])


@query("build_error_payload", f"""
SELECT run_id, seq, x AS message, 'error' AS error_type, {', '.join(f'{LINKS[n]} AS {n}' for n in ('request_id', 'reconnect_attempt', 'reconnect_limit'))} FROM out_text WHERE event_type = 'error'""")
def build_error_payload(spark, sf):
    rows = fixtures.stdout_events(spark, sf).where(F.col("event_type") == "error")
    lifted = [F.col(f"text_links.{n}").alias(n) for n in ("request_id", "reconnect_attempt", "reconnect_limit")]
    return rows.select("run_id", "seq", "message", F.col("error_text").alias("error_type"), *lifted)


@query("subagent_threads", """
SELECT run_id, thread_id, min(seq) AS first_seq FROM (SELECT run_id, seq, unnest(json_extract_string(item, '$.receiver_thread_ids[*]')) AS thread_id FROM out_events WHERE it = 'collab_tool_call') AS r GROUP BY run_id, thread_id""")
def subagent_threads(spark, sf):
    return N.subagent_threads(fixtures.stdout_events(spark, sf))


cte("out_turns", f"""
SELECT run_id, seq, event_type, raw_type, CASE WHEN event_type = 'message.agent' THEN json_extract_string(item, '$.text') END AS said,
  last_value(CASE WHEN event_type IN ('agent.started', 'agent.completed', 'agent.failed') THEN event_type END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seq {BEFORE}) AS turn0,
  last_value(CASE WHEN event_type IN ('agent.started', 'agent.completed', 'agent.failed') THEN seq END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seq {BEFORE}) AS turn0_seq,
  last_value(CASE WHEN event_type = 'message.agent' THEN json_extract_string(item, '$.text') END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seq {BEFORE}) AS said0,
  last_value(CASE WHEN event_type = 'message.agent' THEN seq END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seq {BEFORE}) AS said0_seq FROM out_events""")


@query("turn_outcome_state", """
SELECT run_id, NOT bool_or(raw_type = 'invalid_json') AS valid_json, bool_or(event_type = 'agent.completed') AS saw_turn_completed, bool_or(event_type = 'agent.failed') AS saw_turn_failed,
  bool_or(event_type = 'thread.started') AS saw_thread_started, bool_or(raw_type = 'error') AS saw_top_error,
  replace(arg_max(event_type, seq) FILTER (WHERE event_type IN ('agent.completed', 'agent.failed')), 'agent.', 'turn.') AS last_terminal,
  arg_max(final, seq) FILTER (WHERE final IS NOT NULL) AS final_agent_message
FROM (SELECT *, CASE WHEN event_type = 'agent.completed' AND turn0 = 'agent.started' AND said0_seq > turn0_seq THEN said0 WHEN said IS NOT NULL AND turn0 = 'agent.completed' THEN said END AS final FROM out_turns) AS f GROUP BY run_id""")
def turn_outcome_state(spark, sf):
    return N.turn_outcome_state(fixtures.stdout_events(spark, sf))
