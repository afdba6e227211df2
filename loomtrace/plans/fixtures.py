"""Log-shaped views over the given tables, in SQL text that both engines read.

The given tables hold no agent logs, so the registered queries run on projections of them with
the shape of the log model. Only the JSON getter and the timestamp formatter differ by engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.operators.normalize import normalize_session, normalize_stdout, parse_lines
from loomtrace.plans.tables import shared

SPARK = {
    "jk": "get_json_object(props, '$.k')",
    "ts_text": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")",
}
DUCK = {"jk": "json_extract_string(props, '$.k')", "ts_text": "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"}

BASE = """
SELECT event_id, user_id, event_type AS et, {ts_text} AS ts, CAST({jk} AS INT) AS k,
       CAST(floor(value * 100) AS BIGINT) AS v, event_id + 1 AS seq,
       concat('s', CAST(user_id AS VARCHAR(20))) AS session_id
FROM events
"""

MIXES = {
    "signup": {"task.started": 7, "message.user": 5, "message.agent": 4, "runtime.context": 4, "agent.reasoning": 1,
               "stderr.line": 1, "message.commentary": 1, "context.compacted": 1},
    "click": {"shell.call": 8, "tool.call": 8, "collab.spawn_agent": 2, "collab.wait": 2, "collab.send_input": 1,
              "collab.close_agent": 1, "web.search": 1, "web.open": 1},
    "view": {"shell.result": 10, "tool.result": 11, "todo.update": 2, "message.assistant": 1},
    "purchase": {"info.tokens": 14, "task.completed": 8, "agent.aborted": 1, "agent.failed": 1},
    "error": {"error": 5, "mcp.call": 5, "mcp.result": 6, "patch.apply": 4, "file.change": 1, "stdin.write": 1,
              "patch.apply.duplicate": 1, "user.input.request": 1},
}
MIX_CASE = " ".join(
    f"WHEN '{kind}' THEN '{','.join(t for t, n in mix.items() for _ in range(n))}'" for kind, mix in MIXES.items()
)

# The event id follows time, so it serves as the sequence number without any window.
TYPED = f"""
SELECT *, split_part(CASE et {MIX_CASE} END, ',', CAST((k * 13 + v) % 24 + 1 AS INT)) AS event_type
FROM base
"""

LOG_EVENTS = """
SELECT session_id, session_id AS run_id, concat('task', CAST(user_id % 5 AS VARCHAR(20))) AS task_id, seq, ts, k, v,
  event_type,
  CASE WHEN event_type = 'patch.apply' AND v % 3 = 0 AND v % 4 = 1 THEN 'item.updated' ELSE 'event' END AS raw_type,
  CASE WHEN k % 11 = 0 THEN NULL WHEN k % 3 = 0 THEN 'root' ELSE concat('t', CAST(k % 3 AS VARCHAR(20))) END AS thread_id,
  CASE WHEN k % 22 = 11 THEN 'root' END AS sender_thread_id,
  CASE WHEN k % 11 = 0 OR k % 3 = 0 THEN NULL WHEN k % 53 = 2 THEN 't1' ELSE 'root' END AS parent_thread_id,
  concat('turn', CAST(k % 2 AS VARCHAR(20))) AS turn_id,
  CASE WHEN et IN ('click', 'view', 'error') THEN concat('op', CAST((k - k % 2) % 10 AS VARCHAR(20))) END AS operation_id,
  CASE WHEN et IN ('view', 'error') OR event_type IN ('collab.spawn_agent', 'collab.wait', 'collab.close_agent') THEN
    CASE v % 7 WHEN 0 THEN 'failed' WHEN 1 THEN NULL WHEN 2 THEN 'Cancelled' ELSE 'completed' END END AS status,
  CASE WHEN event_type IN ('patch.apply', 'file.change', 'stdin.write', 'user.input.request') THEN
    CASE v % 3 WHEN 0 THEN CASE WHEN v % 4 = 1 THEN NULL ELSE 'started' END WHEN 1 THEN 'updated' ELSE 'completed' END
    WHEN event_type IN ('collab.spawn_agent', 'collab.wait', 'collab.send_input', 'collab.close_agent', 'web.search', 'web.open', 'todo.update')
    THEN CASE k % 2 WHEN 0 THEN 'started' ELSE 'completed' END END AS phase,
  CASE WHEN event_type = 'patch.apply.duplicate' THEN 'event_msg.patch_apply_end'
    WHEN event_type IN ('shell.result', 'patch.apply') THEN
    CASE v % 11 WHEN 0 THEN 'response_item.function_call_output' WHEN 1 THEN 'compacted' END END AS duplicate_of,
  CASE WHEN event_type = 'info.tokens' AND v % 9 <> 0 THEN seq * 1000 + v % 1000 END AS total_tokens,
  CASE WHEN event_type = 'info.tokens' THEN seq * 600 + v % 600 END AS input_tokens,
  CASE WHEN event_type = 'info.tokens' AND v % 4 <> 0 THEN seq * 100 + v % 100 END AS cached_input_tokens,
  CASE WHEN event_type = 'info.tokens' AND v % 3 <> 0 THEN seq * 300 - v % 300 END AS output_tokens,
  CASE WHEN event_type = 'info.tokens' AND v % 5 <> 0 THEN v % 70 END AS reasoning_output_tokens,
  CASE WHEN event_type LIKE 'message.%' OR event_type = 'agent.reasoning' THEN
    CASE WHEN v % 6 = 0 THEN concat('use <skill><name> skill', CAST(v % 4 AS VARCHAR(20)), ' </name></skill> now')
      WHEN v % 6 = 1 THEN concat('Intro', chr(10), '### Available skills', chr(10), '- alpha: first', chr(10), chr(10),
        '- `beta`', chr(10), '- gamma', CAST(v % 3 AS VARCHAR(20)), ': last', chr(10), 'Done', chr(10), '- not_a_skill: x')
      WHEN v % 6 = 2 THEN '   ' ELSE concat('note ', CAST(v % 50 AS VARCHAR(20))) END END AS text,
  CASE WHEN event_type LIKE 'tool.%' THEN CASE v % 6 WHEN 0 THEN 'web_fetch' WHEN 1 THEN 'apply_patch' WHEN 2 THEN 'run_tests'
      WHEN 3 THEN 'build_all' WHEN 4 THEN 'git' ELSE 'search_code' END
    WHEN event_type LIKE 'shell.%' THEN 'exec_command' END AS tool_name,
  CASE WHEN event_type = 'shell.call' THEN CASE v % 8 WHEN 0 THEN 'rg foo' WHEN 1 THEN 'pytest -q' WHEN 2 THEN 'cargo check'
      WHEN 3 THEN 'git status' WHEN 4 THEN 'ls -la' WHEN 5 THEN 'cat x' WHEN 6 THEN 'sed -i s/a/b/ f' ELSE 'echo hi' END END AS command,
  CASE WHEN event_type = 'agent.aborted' THEN CASE WHEN v % 2 = 0 THEN 'interrupted' ELSE 'user stop' END
    WHEN event_type = 'agent.failed' THEN concat('boom', CAST(v % 3 AS VARCHAR(20))) END AS error_text,
  CASE WHEN event_type = 'task.started' THEN CASE k % 7 WHEN 1 THEN 'worker' WHEN 2 THEN 'Reviewer' WHEN 3 THEN 'planner' END
    WHEN event_type = 'collab.wait' AND v % 5 = 0 THEN 'reviewer' END AS agent_role,
  CASE WHEN event_type = 'task.started' AND k % 9 = 1 THEN 'explorer' END AS requested_agent_type,
  CASE WHEN event_type = 'mcp.call' AND v % 6 = 2 THEN 'reviewer' END AS receiver_role,
  CASE WHEN event_type = 'task.started' AND k % 5 = 0 THEN 'plan' END AS collaboration_mode_kind,
  CASE WHEN event_type = 'task.started' AND v % 2 = 0 THEN '200000' END AS model_context_window,
  CASE WHEN v % 3 = 0 THEN 'agent' WHEN v % 3 = 1 THEN 'subagent' END AS actor_type,
  CASE WHEN event_type IN ('patch.apply', 'file.change') THEN CASE WHEN v % 4 = 0
      THEN concat('docs/review-', CAST(v % 3 AS VARCHAR(20)), '.md') ELSE concat('src/f', CAST(v % 10 AS VARCHAR(20)), '.rs') END
    END AS artifact_path,
  CASE WHEN event_type = 'runtime.context' AND v % 5 = 0 THEN v END AS runtime_start_context_size,
  CASE WHEN event_type = 'error' AND v % 9 = 4 THEN v END AS context_size,
  CASE WHEN event_type = 'runtime.context' AND v % 3 = 0 THEN v % 4 END AS runtime_mcp_servers,
  CASE WHEN event_type = 'runtime.context' AND v % 7 < 3 THEN v % 5 END AS runtime_skills,
  CASE WHEN event_type = 'shell.call' AND v % 5 = 1 THEN CASE WHEN v % 2 = 0 THEN concat('skill', CAST(v % 7 AS VARCHAR(20)))
      ELSE concat('skill', CAST(v % 7 AS VARCHAR(20)), ',extra') END END AS skill_list,
  CASE WHEN event_type LIKE 'collab.%' AND k % 11 <> 1 THEN CASE k % 3 WHEN 0 THEN 't1' WHEN 1 THEN 't2' ELSE 't1,t9' END END AS receiver_list,
  CASE WHEN event_type LIKE 'collab.%' THEN CASE v % 5 WHEN 0 THEN 't1:working:' WHEN 1 THEN concat('t2:completed:sub ', CAST(v % 90 AS VARCHAR(20)), ',t9::late')
    WHEN 2 THEN 't2:failed:,t7:pending_init:' END END AS state_list,
  CASE WHEN event_type LIKE 'shell.result' THEN v % 3 - 1 END AS exit_code,
  CASE WHEN event_type = 'task.started' AND v % 3 = 0 THEN concat('Task ', CAST(v % 40 AS VARCHAR(20))) END AS title,
  CASE WHEN event_type = 'thread.started' THEN NULL WHEN v % 31 = 0 THEN concat('nick', CAST(v % 5 AS VARCHAR(20))) END AS agent_nickname,
  CASE WHEN v % 37 = 0 THEN '/work/app' END AS cwd
FROM typed
"""

FX_SESSIONS = """
SELECT user_id, session_id, first_ts, last_ts,
  CASE WHEN user_id % 7 = 0 THEN NULL ELSE concat('/home/u/proj', CAST(user_id % 6 AS VARCHAR(20)), CASE WHEN user_id % 4 = 1 THEN '/./sub/..' ELSE '' END) END AS cwd,
  CASE WHEN user_id % 2 = 0 THEN 'main' END AS git_branch,
  CASE WHEN user_id % 3 = 0 THEN concat('git@host:r', CAST(user_id % 4 AS VARCHAR(20))) END AS git_origin_url,
  CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'cli'
    WHEN 2 THEN concat('{"subagent":{"thread_spawn":{"parent_thread_id":"s', CAST(user_id % 20 AS VARCHAR(20)), '","depth":', CAST(user_id % 3 AS VARCHAR(20)), '}}}')
    WHEN 3 THEN CASE WHEN user_id % 2 = 0 THEN '{"subagent":' ELSE '{"subagent":{"thread_spawn":{"parent_thread_id":" "}}}' END
    ELSE '{"other":1}' END AS source,
  CASE WHEN user_id % 3 = 1 THEN user_id * 100 END AS tokens_used,
  CASE user_id % 4 WHEN 0 THEN '{"type":"workspace-write"}' WHEN 1 THEN 'danger-full-access' WHEN 2 THEN '{"type":""}' END AS sandbox_policy,
  CASE WHEN user_id % 4 = 2 THEN concat('Title ', CAST(user_id AS VARCHAR(20))) WHEN user_id % 4 = 3 THEN '  ' END AS title,
  CASE WHEN user_id % 3 <> 2 THEN concat('please fix ', CAST(user_id % 9 AS VARCHAR(20))) END AS first_user_message,
  CASE WHEN user_id % 5 = 2 THEN concat('nick', CAST(user_id % 6 AS VARCHAR(20))) END AS agent_nickname,
  CASE WHEN user_id % 10 = 2 THEN 'reviewer' WHEN user_id % 10 = 7 THEN 'worker' END AS agent_role,
  CASE WHEN user_id % 8 = 0 THEN 'gpt-x' ELSE 'gpt-y' END AS model,
  CASE WHEN user_id % 6 = 0 THEN 'high' END AS reasoning_effort,
  CASE WHEN user_id % 6 < 4 THEN concat('1.', CAST(user_id % 4 AS VARCHAR(20))) END AS cli_version,
  CASE WHEN user_id % 9 = 0 THEN 'never' ELSE 'on-request' END AS approval_mode,
  1704067200 + user_id * 60 AS created_at, 1704070800 + user_id % 97 * 3600 AS updated_at
FROM (SELECT user_id, session_id, min(ts) AS first_ts, max(ts) AS last_ts FROM base GROUP BY user_id, session_id) AS u
"""

# Raw log lines as JSON text. `@name` stands for a column or an expression; `@b` for a backslash.
TOKENS = {
    "@ts": "ts", "@sid": "session_id", "@call": "concat('c', CAST(k % 4 AS VARCHAR(20)))", "@k": "CAST(k AS VARCHAR(20))",
    "@v": "CAST(v AS VARCHAR(20))", "@m": "CAST(v % 4 AS VARCHAR(20))", "@t": "CAST(v % 3 AS VARCHAR(20))", "@seq": "CAST(seq AS VARCHAR(20))", "@b": "chr(92)",
    "@turn": "concat('turn', CAST(k % 2 AS VARCHAR(20)))", "@word": "CASE v % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'completed' ELSE 'ok' END",
    "@role": "CASE v % 4 WHEN 0 THEN 'User' WHEN 1 THEN 'assistant' ELSE ' ' END",
}


def _text(template: str) -> str:
    """SQL that concatenates a template with its tokens."""
    parts = re.split("(" + "|".join(sorted(TOKENS, key=len, reverse=True)) + ")", template)
    pieces = [TOKENS.get(p) or "'" + p.replace("'", "''") + "'" for p in parts if p]
    return f"concat({', '.join(pieces)})"


def _record(kind: str, payload: str) -> str:
    return _text('{"timestamp":"@ts","type":"' + kind + '","payload":' + payload + "}")


RECORDS = [
    _record("session_meta", '{"id":"@sid","cwd":"/w@k","agent_nickname":"n@m","source":{"subagent":{"thread_spawn":{"parent_thread_id":"p@t"}}}}'),
    _record("session_meta", '{"id":"x@k","cwd":"/other"}'),
    _record("response_item", '{"type":"function_call","name":"exec_command","call_id":"@call","arguments":"{@b"cmd@b":@b"cat skills/s@m/SKILL.md@b"}"}'),
    _record("response_item", '{"type":"function_call","name":"spawn_agent","call_id":"@call","arguments":"{@b"message@b":@b"do it @k@b",@b"agent_type@b":@b"worker@b",@b"model@b":@b"m@t@b"}"}'),
    _record("response_item", '{"type":"function_call","name":"list_mcp_resources","call_id":"@call","arguments":"{}"}'),
    _record("response_item", '{"type":"function_call","name":"update_plan","call_id":"@call","arguments":"{@b"plan@b":[]}"}'),
    _record("response_item", '{"type":"function_call_output","call_id":"@call","output":"Chunk ID: a@bnProcess exited with code @t@bnOriginal token count: 1,@k@bnOutput:"}'),
    _record("response_item", '{"type":"function_call_output","call_id":"@call","output":"{@b"exit_code@b":@t,@b"agent_id@b":@b"a@k@b",@b"nickname@b":@b"nick@m@b"}"}'),
    _record("response_item", '{"type":"custom_tool_call","name":"apply_patch","call_id":"@call","status":"completed","input":"*** Begin Patch@bn*** Update File: src/f@k.rs@bn*** Add File: src/g@m.rs@bn*** End Patch"}'),
    _record("response_item", '{"type":"custom_tool_call_output","call_id":"@call","output":"Patch @word"}'),
    _record("event_msg", '{"type":"patch_apply_end","call_id":"@call","success":true,"stdout":"done @k"}'),
    _record("response_item", '{"type":"message","role":"@role","content":[{"type":"input_text","text":"hello @t"},{"type":"output_text","text":"world @bn"}]}'),
    _record("event_msg", '{"type":"agent_message","message":"hello @t@bnworld"}'),
    _record("event_msg", '{"type":"user_message","message":"hello @t@bnworld"}'),
    _record("response_item", '{"type":"reasoning","summary":[{"text":"think @k"},{"text":""},{"text":"more"}]}'),
    _record("compacted", '{"message":"short @k"}'),
    _record("event_msg", '{"type":"context_compacted"}'),
    _record("event_msg", '{"type":"token_count","info":{"total_token_usage":{"input_tokens":@v,"cached_input_tokens":@k,"output_tokens":"7","total_tokens":@v}}}'),
    _record("event_msg", '{"type":"task_started","turn_id":"@turn","model_context_window":200000,"collaboration_mode_kind":"plan"}'),
    _record("event_msg", '{"type":"task_complete","turn_id":"@turn","last_agent_message":"ok"}'),
    _record("event_msg", '{"type":"turn_aborted","turn_id":"@turn","reason":"interrupted"}'),
    _record("response_item", '{"type":"web_search_call","id":"w@k","status":"in_progress","action":{"type":"open_page","url":"u"}}'),
    _record("event_msg", '{"type":"exec_command_end","call_id":"@call","turn_id":"@turn","exit_code":@t,"command":["bash","-lc","cat /a/skills/e@m/SKILL.md"],"cwd":"/w"}'),
    _record("event_msg", '{"type":"collab_waiting_end","call_id":"@call","sender_thread_id":"s@t","agent_statuses":[{"thread_id":"r@t"},{"thread_id":"r@m"}],"statuses":{"z@t":{"completed":"x"}}}'),
    _record("event_msg", '{"type":"collab_agent_spawn_end","call_id":"q@k","new_thread_id":"nt@k","new_agent_role":"reviewer","status":{"pending_init":null}}'),
    _record("event_msg", '{"type":"item_completed","turn_id":"@turn","item":{"type":"Plan","id":"plan@k","text":"steps"}}'),
    _record("turn_context", '{"turn_id":"@turn","mcp_servers":["a","b"],"context":{"skills":["x"],"start_context_size":@v}}'),
    _record("mystery", '{"a":@k}'),
    _text('{"timestamp":"@ts","type":"event_msg","payload":@k}'),
    _text("not json @k {"),
]
FX_LINES = "SELECT session_id, seq, ts AS read_at, k, v, CASE CASE WHEN v % 3 = 0 THEN 11 + k % 3 WHEN v % 7 = 1 THEN 15 + k % 2 ELSE (k * 11 + v) % 30 END " + " ".join(
    f"WHEN {i} THEN {sql}" for i, sql in enumerate(RECORDS)
) + " END AS value FROM base"

STDOUT = [
    _text('{"type":"thread.started","thread_id":"th@t"}'),
    _text('{"type":"turn.started"}'),
    _text('{"type":"turn.completed","usage":{"input_tokens":@k}}'),
    _text('{"type":"turn.failed","error":{"message":"status 503 Unavailable url: https://h@k.example/x cf-ray: ab@m"}}'),
    _text('{"type":"error","message":"Reconnecting... @t/5 request ID abcdef@k0"}'),
    _text('{"type":"item.completed","item":{"type":"agent_message","id":"i@k","text":"answer @k"}}'),
    _text('{"type":"item.completed","item":{"type":"item.updated","item":{"type":"command_execution","id":"i@k","command":"cat skills/q@t/SKILL.md","exit_code":@t,"status":"completed"}}}'),
    _text('{"type":"item.started","item":{"type":"command_execution","id":"i@k","command":"ls","status":"in_progress"}}'),
    _text('{"type":"item.updated","item":{"type":"todo_list","id":"i@k","items":[{"text":"a","completed":true},{"text":"b"},{"text":"c","completed":false}]}}'),
    _text('{"type":"item.started","item":{"type":"collab_tool_call","id":"i@k","tool":"spawn_agent","sender_thread_id":"th0","receiver_thread_ids":["r@t","r@m"],"agents_states":{"r@t":{"status":"running","message":"m@k"},"x@m":"odd"}}}'),
    _text('{"type":"item.completed","item":{"type":"file_change","id":"i@k","status":"completed","changes":[{"kind":"add","path":"a@t"},{"kind":"update"}]}}'),
    _text('{"type":"item.completed","item":{"type":"mcp_tool_call","id":"i@k","server":"srv","tool":"find","status":"failed"}}'),
    _text('{"type":"item.started","item":{"type":"tool_use","id":"i@k","name":"write_stdin"}}'),
    _text('{"type":"item.completed","item":{"type":"tool_result","tool_use_id":"i@k","name":"grep"}}'),
    _text('{"type":"item.completed","item":{"type":"web_search","id":"i@k","action":"open_page"}}'),
    _text("plain text @k"),
]
FX_STDOUT = "SELECT session_id AS run_id, 'task1' AS task_id, seq, ts AS read_at, k, v, CASE (k * 5 + v) % 16 " + " ".join(
    f"WHEN {i} THEN {sql}" for i, sql in enumerate(STDOUT)
) + " END AS value FROM base"

FX_FILES = """
SELECT session_id, concat('sessions/rollout-2026-04-07T10-00-00-', session_id, '.jsonl') AS session_ref, updated_at AS mtime, user_id FROM fx_sessions
UNION ALL SELECT session_id, concat('sessions/b/rollout-2026-04-08T10-00-00-', session_id, '.jsonl'), updated_at + user_id % 3 - 1, user_id FROM fx_sessions WHERE source = 'cli'
"""

FX_INDEX = """
SELECT seq, CASE WHEN v % 31 = 0 THEN concat('bad line ', CAST(k AS VARCHAR(20))) ELSE concat('{"', CASE WHEN v % 2 = 0 THEN 'id' ELSE 'session_id' END, '":"', session_id,
  '","thread_name":"', CASE WHEN k % 5 = 0 THEN ' ' ELSE concat('name ', CAST(k AS VARCHAR(20))) END, '","updated_at":"', substr(ts, 1, 10), '"}') END AS value FROM base
"""

FX_EDGES = """
SELECT a.session_id AS parent, b.session_id AS child FROM (SELECT session_id, user_id * 2 AS kin FROM fx_sessions WHERE user_id > 0
  UNION ALL SELECT session_id, user_id * 2 + 1 FROM fx_sessions WHERE user_id > 0
  UNION ALL SELECT session_id, CAST(user_id / 16 AS BIGINT) FROM fx_sessions WHERE user_id % 16 = 0 AND user_id > 0) AS a JOIN fx_sessions b ON b.user_id = a.kin
"""

VIEWS = {
    "base": BASE, "typed": TYPED, "log_events": LOG_EVENTS, "fx_sessions": FX_SESSIONS, "fx_lines": FX_LINES, "fx_stdout": FX_STDOUT,
    "fx_files": FX_FILES, "fx_index": FX_INDEX, "fx_edges": FX_EDGES,
}


def _fill(text: str, engine: dict[str, str]) -> str:
    for name, expression in engine.items():
        text = text.replace("{" + name + "}", expression)
    return text


def duck_views() -> dict[str, str]:
    """The views as common table expressions for the other engine."""
    return {name: _fill(text, DUCK) for name, text in VIEWS.items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_planned: dict = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views, planned (not computed) once over the tables in `sf_dir`."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _planned:
        _planned[key] = _plan_view(spark, sf_dir, name)
    return _planned[key]


def _plan_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    needed = list(VIEWS)[: list(VIEWS).index(name) + 1]
    ctes = ", ".join(f"{n} AS ({_fill(VIEWS[n], SPARK)})" for n in needed)
    text = ctes.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {events}")
    return spark.sql(f"WITH {text} SELECT * FROM {name}", events=table(spark, sf_dir, "events"))


def _state(entry):
    parts = F.split(entry, ":")
    return F.struct(*[F.nullif(parts[i], F.lit("")).alias(name) for i, name in enumerate(("thread_id", "status", "message"))])


def _log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "log_events")
    return rows.withColumns(
        {"skill_identifiers": F.split("skill_list", ","), "receiver_thread_ids": F.split("receiver_list", ","), "agents_states": F.transform(F.split("state_list", ","), _state)}
    ).drop("skill_list", "receiver_list", "state_list")


@shared
def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The silver table: canonical event rows, written once and spread evenly whatever the session."""
    return _log_events(spark, sf_dir).repartition("seq")


@shared
def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed session-log lines, the bronze table."""
    lines = view(spark, sf_dir, "fx_lines").withColumn("path", F.concat(F.lit("rollout-"), "session_id", F.lit(".jsonl")))
    return parse_lines(lines.repartition("seq"))


@shared
def stdout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_stdout").repartition("seq")


@shared
def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised session-log events."""
    return normalize_session(bronze(spark, sf_dir))


@shared
def stdout_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_stdout(stdout_lines(spark, sf_dir))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_sessions")
