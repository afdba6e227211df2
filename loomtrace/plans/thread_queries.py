"""Registered queries and comparison SQL for the thread hierarchy and the timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.functions import covered as C
from loomtrace.operators import payloads as Y
from loomtrace.operators import threads as H
from loomtrace.operators import timeline as L
from loomtrace.operators.columns import TOKEN_COLUMNS
from loomtrace.operators.session_metrics import thread_count as count_threads
from loomtrace.operators.session_metrics import thread_fold
from loomtrace.plans import fixtures
from loomtrace.plans.metrics_queries import annotated, events
from loomtrace.plans.oracle import cte
from loomtrace.plans.tables import shared

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@shared
def marked(spark, sf):
    return annotated(spark, sf)


def root():
    """The views' main thread."""
    return F.lit("root")


QUOTED_BARRIERS = ", ".join(f"'{b}'" for b in H.BARRIERS)
OTHER = "(event_type LIKE 'message.%' AND event_type <> 'message.user')"
COMMENTARY = f"({OTHER} AND (event_type = 'message.commentary' OR coalesce(lower(phase) = 'commentary', false)))"
TOOL_CAT = "CASE WHEN receiver_list IS NOT NULL OR sender_thread_id IS NOT NULL THEN 'subagent' WHEN tool_name = 'exec_command' OR command IS NOT NULL THEN 'command' ELSE 'default' END"
cte("categorized", f"""
SELECT *, CASE WHEN {COMMENTARY} THEN 'subagent' WHEN {OTHER} THEN 'assistant'
  WHEN event_type IN ('message.user', 'task.started', 'task.completed', 'runtime.context', 'context.compacted', 'info.tokens', 'patch.apply.duplicate') THEN 'subagent'
  WHEN event_type LIKE 'tool.%' OR event_type LIKE 'shell.%' OR event_type LIKE 'mcp.%' OR event_type LIKE 'web.%' OR event_type LIKE 'collab.%' OR event_type = 'stdin.write' THEN {TOOL_CAT}
  WHEN event_type IN ('patch.apply', 'file.change') THEN 'file' WHEN event_type = 'todo.update' THEN 'default'
  WHEN event_type IN ('stderr.line', 'error', 'agent.failed', 'agent.aborted') THEN 'error' ELSE 'default' END AS category,
  CASE WHEN exit_code IS NOT NULL THEN exit_code <> 0 ELSE coalesce(lower(status) IN ('failed', 'error', 'cancelled'), false) END AS failed,
  coalesce(thread_id, sender_thread_id) AS own_thread, coalesce(thread_id, sender_thread_id, CASE WHEN actor_type = 'agent' THEN 'root' END) AS assigned_thread FROM log_events""")


@query("event_category", "SELECT session_id, seq, event_type, category FROM categorized")
def event_category(spark, sf):
    return H.event_category(events(spark, sf)).select("session_id", "seq", "event_type", "category")


@query("failed_result", "SELECT session_id, seq, failed FROM categorized")
def failed_result(spark, sf):
    return events(spark, sf).select("session_id", "seq", H.failed_result().alias("failed"))


@query("assign_event_thread", "SELECT session_id, seq, assigned_thread, assigned_thread IS NULL AS is_orphan FROM categorized")
def assign_event_thread(spark, sf):
    return H.assign_event_thread(events(spark, sf), root()).select("session_id", "seq", "assigned_thread", "is_orphan")


SUB = "coalesce(actor_type = 'subagent', false)"
cte("told_states", "SELECT *, unnest(string_split(state_list, ',')) AS s FROM categorized WHERE receiver_list IS NOT NULL AND state_list IS NOT NULL")
cte("assignments", f"""
SELECT session_id, seq, event_type, coalesce(own_thread, 'root') AS th, parent_thread_id AS parent, true AS direct, cwd,
  CASE WHEN event_type IN ('tool.call', 'shell.call') AND {SUB} THEN 'working' WHEN event_type IN ('todo.update', 'user.input.request', 'stdin.write') AND {SUB} AND phase = 'started' THEN 'working'
    WHEN event_type = 'patch.apply' AND {SUB} THEN CASE WHEN failed THEN 'failed' ELSE 'working' END WHEN event_type = 'task.started' THEN 'running' WHEN event_type = 'task.completed' THEN 'completed'
    WHEN event_type = 'agent.aborted' THEN 'interrupted' END AS st, seq * 10 AS spot
FROM categorized WHERE {OTHER} OR event_type IN ('message.user', 'task.started', 'task.completed', 'runtime.context', 'agent.aborted')
  OR ({SUB} AND event_type IN ('tool.call', 'shell.call', 'tool.result', 'shell.result', 'todo.update', 'user.input.request', 'stdin.write', 'patch.apply'))
UNION ALL SELECT session_id, seq, event_type, 'root', NULL, false, NULL, 'failed', seq * 10 + 1 FROM categorized WHERE event_type = 'agent.failed'
UNION ALL SELECT session_id, seq, event_type, coalesce(own_thread, 'root'), NULL, false, NULL, NULL, seq * 10 + 2 FROM categorized WHERE event_type LIKE 'collab.%' AND receiver_list IS NOT NULL
UNION ALL SELECT session_id, seq, event_type, trim(unnest(string_split(receiver_list, ','))), coalesce(own_thread, 'root'), false, NULL, status, seq * 10 + 3 FROM categorized WHERE event_type LIKE 'collab.%' AND receiver_list IS NOT NULL
UNION ALL SELECT session_id, seq, event_type, split_part(s, ':', 1), coalesce(own_thread, 'root'), false, NULL, nullif(split_part(s, ':', 2), ''), seq * 10 + 4 FROM told_states""")
cte("agents", """
SELECT session_id, th AS thread_id, arg_min(parent, spot) FILTER (WHERE parent IS NOT NULL) AS parent_thread_id, coalesce(arg_max(st, spot) FILTER (WHERE st IS NOT NULL), 'idle') AS status,
  arg_min(cwd, seq) FILTER (WHERE direct AND event_type = 'runtime.context' AND cwd IS NOT NULL) AS cwd FROM assignments GROUP BY session_id, th""")


@shared
def agents(spark, sf):
    return H.thread_state(events(spark, sf), root())


@query("thread_state", "SELECT session_id, thread_id, parent_thread_id, status, cwd FROM agents")
def thread_state(spark, sf):
    return agents(spark, sf).select("session_id", "thread_id", "parent_thread_id", "status", "cwd")


@query("thread_count", """
SELECT session_id, count(DISTINCT t) AS thread_count, 'known' AS thread_count_coverage FROM (
  SELECT session_id, own_thread AS t FROM categorized UNION ALL SELECT session_id, thread_id FROM agents) AS u GROUP BY session_id""")
def thread_count(spark, sf):
    return C.flatten_covered(count_threads(thread_fold(events(spark, sf)), agents(spark, sf)))


@query("pending_category", f"""
SELECT session_id, thread_id, arg_max_null(c, seq) AS pending_category FROM (
  SELECT session_id, seq, coalesce(assigned_thread, 'root') AS thread_id, CASE WHEN ({OTHER} AND NOT {COMMENTARY}) OR event_type = 'task.completed' THEN NULL
    WHEN event_type LIKE 'collab.%' AND receiver_list IS NOT NULL THEN {TOOL_CAT} WHEN {SUB} AND event_type IN ('todo.update', 'user.input.request') THEN 'default'
    WHEN {SUB} AND event_type = 'stdin.write' THEN 'command' WHEN {SUB} AND event_type = 'patch.apply' THEN 'file' ELSE {TOOL_CAT} END AS c
  FROM categorized WHERE ({OTHER} AND NOT {COMMENTARY}) OR event_type = 'task.completed' OR (event_type LIKE 'collab.%' AND receiver_list IS NOT NULL)
    OR ({SUB} AND event_type = 'patch.apply') OR event_type IN ({', '.join(repr(t) for t in H.ROOT_TOOL_TYPES)})) AS s GROUP BY session_id, thread_id""")
def pending_category(spark, sf):
    return H.pending_category(events(spark, sf), root())


@query("merge_thread_ids", """
SELECT session_id, trim(raw) AS thread_id, arg_min(parent_thread_id, raw) FILTER (WHERE parent_thread_id IS NOT NULL) AS parent_thread_id, arg_min(status, raw) AS status FROM (
  SELECT session_id, thread_id AS raw, parent_thread_id, status FROM agents UNION ALL SELECT session_id, concat(' ', thread_id, ' '), coalesce(parent_thread_id, 'p'), concat(status, '2') FROM agents) AS u GROUP BY session_id, trim(raw)""")
def merge_thread_ids(spark, sf):
    rows = agents(spark, sf)
    twin = rows.withColumns({"thread_id": F.concat(F.lit(" "), "thread_id", F.lit(" ")), "parent_thread_id": F.coalesce("parent_thread_id", F.lit("p")), "status": F.concat("status", F.lit("2"))})
    return H.merge_thread_ids(rows.unionByName(twin)).select("session_id", "thread_id", "parent_thread_id", "status")


cte("t_index", """
SELECT session_id, thread_id, parent_thread_id, first_seq, row_number() OVER (PARTITION BY session_id, parent_thread_id ORDER BY thread_id <> 'root', coalesce(first_seq, 9223372036854775807), thread_id) - 1 AS position FROM (
  SELECT t.session_id, t.thread_id, CASE WHEN p.thread_id IS NOT NULL THEN t.parent_thread_id END AS parent_thread_id, t.first_seq FROM (
    SELECT coalesce(s.session_id, a.session_id) AS session_id, coalesce(s.thread_id, a.thread_id) AS thread_id, a.parent_thread_id, s.first_seq
    FROM (SELECT session_id, assigned_thread AS thread_id, min(seq) AS first_seq FROM categorized WHERE assigned_thread IS NOT NULL GROUP BY session_id, assigned_thread) AS s
    FULL JOIN agents a ON a.session_id = s.session_id AND a.thread_id = s.thread_id) AS t
  LEFT JOIN (SELECT session_id, thread_id FROM agents UNION SELECT session_id, assigned_thread FROM categorized) AS p ON p.session_id = t.session_id AND p.thread_id = t.parent_thread_id) AS x""")


@shared
def index(spark, sf):
    return H.thread_index(events(spark, sf), agents(spark, sf), root())


@query("thread_index", "SELECT * FROM t_index")
def thread_index(spark, sf):
    return index(spark, sf).select("session_id", "thread_id", "parent_thread_id", "first_seq", "position")


cte("t_tree", """
SELECT session_id, thread_id, 0 AS depth, [thread_id] AS way FROM t_index WHERE parent_thread_id IS NULL
UNION ALL SELECT i.session_id, i.thread_id, t.depth + 1, list_append(t.way, i.thread_id) FROM t_tree t JOIN t_index i ON i.session_id = t.session_id AND i.parent_thread_id = t.thread_id WHERE NOT list_contains(t.way, i.thread_id)""")
cte("t_below", """
SELECT t.session_id, u.thread_id, min(i.first_seq) AS first_below FROM t_tree t JOIN t_index i ON i.session_id = t.session_id AND i.thread_id = t.thread_id
JOIN t_tree u ON u.session_id = t.session_id AND list_contains(t.way, u.thread_id) GROUP BY t.session_id, u.thread_id""")


@shared
def closure(spark, sf):
    return H.thread_closure(index(spark, sf))


@query("thread_closure", """
SELECT t.session_id, t.thread_id, t.depth, array_to_string(t.way, '>') AS way, coalesce(c.n, 0) AS children, b.first_below FROM t_tree t
LEFT JOIN (SELECT session_id, parent_thread_id, count(*) AS n FROM t_index WHERE parent_thread_id IS NOT NULL GROUP BY session_id, parent_thread_id) AS c ON c.session_id = t.session_id AND c.parent_thread_id = t.thread_id
LEFT JOIN t_below b ON b.session_id = t.session_id AND b.thread_id = t.thread_id""")
def thread_closure(spark, sf):
    tree = H.thread_paths(closure(spark, sf))
    return tree.select("session_id", "thread_id", "depth", F.array_join("way", ">").alias("way"), "children", "first_below")


@query("follow_up_parent", f"""
SELECT f.session_id, f.seq, b.seq AS parent_seq FROM categorized f JOIN categorized b ON b.session_id = f.session_id AND b.seq = (
  SELECT max(x.seq) FROM categorized x WHERE x.session_id = f.session_id AND x.own_thread IS NOT DISTINCT FROM f.own_thread AND x.seq < f.seq AND x.event_type IN ({QUOTED_BARRIERS}))
WHERE (f.event_type IN ('agent.reasoning', 'stderr.line') OR (f.event_type LIKE 'message.%' AND f.event_type <> 'message.user' AND f.phase = 'commentary')) AND b.event_type IN ('tool.result', 'shell.result')""")
def follow_up_parent(spark, sf):
    return H.follow_up_parent(events(spark, sf))


cte("kids", """SELECT t.session_id, t.thread_id, i.parent_thread_id, b.first_below AS first_seq FROM t_tree t JOIN t_index i ON i.session_id = t.session_id AND i.thread_id = t.thread_id
JOIN t_below b ON b.session_id = t.session_id AND b.thread_id = t.thread_id WHERE i.parent_thread_id IS NOT NULL AND b.first_below IS NOT NULL""")
cte("around", """
SELECT k.*, a.seq, coalesce(a.started_seq, a.seq) AS root_seq, a.event_type, c.receiver_list, c.phase FROM kids k JOIN categorized c ON c.session_id = k.session_id AND c.own_thread = k.parent_thread_id AND c.seq < k.first_seq
JOIN annotated a ON a.session_id = c.session_id AND a.seq = c.seq""")


@query("child_thread_anchor", """
SELECT k.session_id, k.thread_id, k.parent_thread_id, k.first_seq, coalesce(x.a, x.b, x.c, x.d) AS anchor_seq,
  CASE WHEN x.a IS NOT NULL THEN 'completed_spawn' WHEN x.b IS NOT NULL THEN 'any_spawn' WHEN x.c IS NOT NULL THEN 'result' WHEN x.d IS NOT NULL THEN 'any_event' END AS anchor_kind
FROM kids k LEFT JOIN (SELECT session_id, thread_id, arg_max(root_seq, seq) FILTER (WHERE event_type = 'collab.spawn_agent' AND phase = 'completed' AND list_contains(string_split(receiver_list, ','), thread_id)) AS a,
  arg_max(root_seq, seq) FILTER (WHERE event_type = 'collab.spawn_agent' AND list_contains(string_split(receiver_list, ','), thread_id)) AS b,
  max(seq) FILTER (WHERE event_type IN ('tool.result', 'shell.result')) AS c, max(seq) AS d FROM around GROUP BY session_id, thread_id) AS x ON x.session_id = k.session_id AND x.thread_id = k.thread_id""")
def child_thread_anchor(spark, sf):
    tree = closure(spark, sf).select("session_id", "thread_id", F.col("first_below").alias("first_seq"))
    kids = tree.join(index(spark, sf).select("session_id", "thread_id", "parent_thread_id"), ["session_id", "thread_id"])
    return H.child_thread_anchor(kids, marked(spark, sf))


# ---- agents ------------------------------------------------------------------------------------

cte("named_receivers", """
SELECT session_id, seq, ts, event_type, CASE WHEN event_type = 'collab.spawn_agent' THEN string_split(receiver_list, ',')[1] ELSE r END AS thread_id FROM (
  SELECT *, unnest(CASE WHEN receiver_list IS NULL THEN [NULL] WHEN event_type = 'collab.spawn_agent' THEN [string_split(receiver_list, ',')[1]] ELSE list_distinct(string_split(receiver_list, ',')) END) AS r
  FROM log_events WHERE event_type IN ('collab.spawn_agent', 'collab.wait', 'collab.send_input', 'collab.close_agent')) AS x""")
cte("bound", """SELECT n.* FROM named_receivers n JOIN t_tree t ON t.session_id = n.session_id AND t.thread_id = n.thread_id AND t.depth > 0""")
cte("graph", """
SELECT * FROM bound UNION ALL SELECT DISTINCT session_id, seq, ts, event_type, CAST(NULL AS VARCHAR) FROM named_receivers n WHERE NOT EXISTS (SELECT 1 FROM bound b WHERE b.session_id = n.session_id AND b.seq = n.seq)""")


def graph(spark, sf):
    return H.agent_graph(events(spark, sf), closure(spark, sf))


@query("agent_graph", "SELECT session_id, seq, ts, event_type, thread_id FROM graph")
def agent_graph(spark, sf):
    return graph(spark, sf)


@query("agent_status", """
SELECT t.session_id, t.thread_id, CASE WHEN o.failed THEN 'failed' WHEN o.aborted THEN 'aborted' WHEN g.closed THEN 'closed' WHEN o.done OR a.status = 'completed' THEN 'completed' WHEN g.waited THEN 'waiting'
  WHEN g.spawned OR o.failed IS NOT NULL OR a.status IS NOT NULL THEN 'running' ELSE 'unknown' END AS agent_status FROM t_tree t
LEFT JOIN agents a ON a.session_id = t.session_id AND a.thread_id = t.thread_id
LEFT JOIN (SELECT session_id, own_thread, bool_or(event_type = 'agent.failed') AS failed, bool_or(event_type = 'agent.aborted') AS aborted, bool_or(event_type = 'task.completed') AS done FROM categorized GROUP BY session_id, own_thread) AS o
  ON o.session_id = t.session_id AND o.own_thread = t.thread_id
LEFT JOIN (SELECT session_id, thread_id, bool_or(event_type = 'collab.close_agent') AS closed, bool_or(event_type = 'collab.wait') AS waited, bool_or(event_type = 'collab.spawn_agent') AS spawned FROM bound GROUP BY session_id, thread_id) AS g
  ON g.session_id = t.session_id AND g.thread_id = t.thread_id WHERE t.depth > 0""")
def agent_status(spark, sf):
    known = closure(spark, sf).select("session_id", "thread_id", "depth").join(agents(spark, sf).select("session_id", "thread_id", "status"), ["session_id", "thread_id"], "left")
    return H.agent_status(events(spark, sf), graph(spark, sf), known)


cte("step_rows", """
SELECT b.session_id, b.thread_id, min(b.seq) AS seq, 'spawn' AS step, 1 AS rk FROM bound b WHERE event_type = 'collab.spawn_agent' GROUP BY b.session_id, b.thread_id
UNION ALL SELECT session_id, own_thread, min(seq), 'activity', 2 FROM categorized WHERE event_type IN ('task.started', 'task.completed', 'agent.failed', 'agent.aborted', 'agent.reasoning') OR event_type LIKE 'message.%' GROUP BY session_id, own_thread
UNION ALL SELECT session_id, thread_id, seq, CASE event_type WHEN 'collab.wait' THEN 'wait' ELSE 'send_input' END, CASE event_type WHEN 'collab.wait' THEN 3 ELSE 4 END FROM bound WHERE event_type IN ('collab.wait', 'collab.send_input')
UNION ALL SELECT session_id, own_thread, max(seq), 'completed', 5 FROM categorized WHERE event_type = 'task.completed' GROUP BY session_id, own_thread
UNION ALL SELECT session_id, thread_id, max(seq), 'closed', 6 FROM bound WHERE event_type = 'collab.close_agent' GROUP BY session_id, thread_id
UNION ALL SELECT session_id, own_thread, max(seq), 'failed', 7 FROM categorized WHERE event_type = 'agent.failed' GROUP BY session_id, own_thread
UNION ALL SELECT session_id, own_thread, max(seq), 'aborted', 8 FROM categorized WHERE event_type = 'agent.aborted' GROUP BY session_id, own_thread""")


@query("agent_steps", """
SELECT s.session_id, s.thread_id, s.seq, arg_min(s.step, s.rk) AS step FROM step_rows s WHERE s.thread_id IS NOT NULL
  AND EXISTS (SELECT 1 FROM bound b WHERE b.session_id = s.session_id AND b.thread_id = s.thread_id) AND EXISTS (SELECT 1 FROM categorized c WHERE c.session_id = s.session_id AND c.own_thread = s.thread_id)
GROUP BY s.session_id, s.thread_id, s.seq""")
def agent_steps(spark, sf):
    return H.agent_steps(events(spark, sf), graph(spark, sf))


@query("agent_last_activity", """
SELECT session_id, thread_id, max(seq) AS seq, arg_max(event_type, seq) AS event_type, nullif(trim(replace(arg_max_null(text, seq), chr(10), ' ')), '') AS preview FROM (
  SELECT session_id, own_thread AS thread_id, seq, event_type, regexp_replace(replace(text, chr(10), ' '), ' +', ' ', 'g') AS text FROM categorized
  WHERE (event_type IN ('agent.failed', 'agent.aborted', 'task.completed') OR event_type LIKE 'message.%') AND own_thread IS NOT NULL
  UNION ALL SELECT session_id, thread_id, seq, event_type, NULL FROM bound WHERE event_type = 'collab.send_input') AS u GROUP BY session_id, thread_id""")
def agent_last_activity(spark, sf):
    return H.agent_last_activity(events(spark, sf), graph(spark, sf))


# ---- timeline ----------------------------------------------------------------------------------

FLAT = "trim(regexp_replace(replace({x}, chr(10), ' '), ' +', ' ', 'g'))"


@query("thread_recent_lines", f"""
SELECT session_id, thread, seq, line, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY session_id, thread ORDER BY seq DESC, place DESC) AS INTEGER) AS position FROM (
  SELECT session_id, split_part(s, ':', 1) AS thread, seq, 1 AS place, split_part(s, ':', 3) AS line FROM told_states WHERE split_part(s, ':', 3) <> ''
  UNION ALL SELECT session_id, own_thread AS thread, seq, 0, CASE WHEN length(l) <= 140 THEN l ELSE concat(substr(l, 1, 137), '...') END AS line FROM (
    SELECT session_id, own_thread, seq, {FLAT.format(x="CASE WHEN " + OTHER + " THEN coalesce(text, '') WHEN event_type = 'message.user' AND trim(text) <> '' THEN concat('user: ', trim(text)) WHEN actor_type = 'subagent' AND event_type IN ('tool.call', 'shell.call') THEN concat('tool: ', tool_name) WHEN actor_type = 'subagent' AND event_type IN ('tool.result', 'shell.result') THEN concat('result ', tool_name, ': ok') END")} AS l
    FROM categorized WHERE own_thread IS NOT NULL) AS a WHERE l IS NOT NULL) AS b) AS c WHERE position <= 4""")
def thread_recent_lines(spark, sf):
    return L.thread_recent_lines(events(spark, sf))


# A payload for every event, with the fields its text reads.
N = "CAST(v % 9 AS VARCHAR(20))"
LINE_END = "chr(92), 'n"
TEXT_PAYLOAD = f"""concat('{{"input":', CASE WHEN event_type = 'user.input.request' THEN concat('{{"questions":[{{"header":"H', {N}, '","question":"Q"}},{{"question":"R"}}]}}')
  WHEN event_type = 'stdin.write' THEN concat('{{"session_id":7,"chars":" yes ', {N}, ' "}}') WHEN event_type = 'patch.apply' THEN concat('"*** Update File: a', {N}, '.rs', {LINE_END}*** Add File: b.rs"')
  WHEN event_type = 'todo.update' AND v % 2 = 0 THEN concat('{{"explanation":"why ', {N}, '","plan":[1,2]}}')
  WHEN event_type LIKE 'web.%' THEN concat('{{"query":"q', {N}, '","action":{{"type":"', CASE WHEN k % 3 = 0 THEN 'search' ELSE 'open_page' END, '","url":"http://x/', {N}, '"}}}}')
  WHEN event_type LIKE 'tool.%' OR event_type LIKE 'shell.%' THEN CASE WHEN v % 2 = 0 THEN concat('{{"cmd":"run  ', {N}, {LINE_END}next"}}') ELSE '{{}}' END ELSE 'null' END,
  ',"output":', CASE WHEN event_type = 'user.input.request' THEN '{{"answers":{{"a":["x","y"],"b":{{"answers":["z"]}},"c":"t"}}}}'
    WHEN v % 3 = 0 THEN concat('{{"error":" ","output":{{"stdout":"out ', {N}, '"}}}}') WHEN v % 3 = 1 THEN concat('" plain', {LINE_END}line ', {N}, ' "') ELSE 'null' END,
  ',"changes":', CASE WHEN event_type = 'file.change' THEN concat('[{{"kind":"add","path":"p', {N}, '"}},{{"kind":"x"}}]') WHEN event_type = 'patch.apply' AND v % 2 = 1 THEN '{{"z.rs":1,"a.rs":2}}' ELSE 'null' END,
  ',"message":', CASE WHEN v % 2 = 0 THEN concat('"oops ', {N}, '"') ELSE 'null' END, ',"error":{{"message":"deep ', {N}, '"}},"last_agent_message":"did ', {N}, repeat(' abcdefg', CAST(v % 12 AS INT)),
  '","text_links":{{"request_id":"r', {N}, '","status_code":503,"is_fallback":true,"fallback_to":"http"}},"items":[{{"text":"one","completed":true}},{{"text":"two ', {N}, '"}}],"completed_count":1,"total_count":2,',
  '"replacement_history":[1,2,3],"collaboration_mode":{{"mode":"plan"}},"model":"m', {N}, '","reason":"r', {N}, '","arguments":{{"a":', {N}, '}},"server":"srv","tool":"find","prompt":"go ', {N}, '"}}')"""
TEXT_TOOL = "CASE WHEN event_type LIKE 'web.%' THEN 'web_search' WHEN event_type LIKE 'collab.%' THEN replace(event_type, 'collab.', '') ELSE tool_name END"


def _jt(path: str) -> str:
    return f"json_extract_string(p, '$.{path}')"


def _short(x: str, width: int) -> str:
    flat = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({flat}) <= {width} THEN {flat} ELSE substr({flat}, 1, {width - 3}) || '...' END"


def _words(*parts: str) -> str:
    return f"concat_ws(' ', {', '.join(parts)})"


def _headed(head: str, detail: str) -> str:
    return f"({head} || coalesce(': ' || nullif({detail}, ''), ''))"


PHASE_STATUS = "'phase=' || nullif(phase, ''), 'status=' || nullif(status, '')"
# what an output says: an object's first telling field, else the text
SAID = f"trim(replace(CASE WHEN json_type(p, '$.output') = 'OBJECT' THEN {_jt('output.output.stdout')} ELSE {_jt('output')} END, chr(10), ' '))"
COMMAND = f"({_short('split_part(' + _jt('input.cmd') + ', chr(10), 1)', 120)} || chr(10) || 'next')"
TASK_DETAIL = _words("'mode=' || collaboration_mode_kind", "'turn=' || turn_id", "'window=' || model_context_window")
COUNTS = ", ".join(f"'{n.removesuffix('_tokens').replace('_', ' ')}: ' || replace(format('{{:,}}', {n}), ',', ' ')" for n in TOKEN_COLUMNS)
STATE_DETAIL = _words(PHASE_STATUS, f"CASE WHEN tool = 'spawn_agent' THEN 'prompt=' || {_jt('prompt')} END", "'agents=' || receiver_list", "CASE WHEN event_type LIKE 'collab.%' THEN CASE v % 5 WHEN 0 THEN 'states=t1:working' WHEN 1 THEN 'states=t2:completed' WHEN 2 THEN 'states=t2:failed,t7:pending_init' END END")
WEB_DETAIL = f"CASE WHEN k % 3 = 0 THEN {_words(f"'query=' || {_jt('input.query')}", "'action=search'", f"'url=' || {_jt('input.action.url')}")} ELSE {_words(f"'url=' || {_jt('input.action.url')}", f"'query=' || {_jt('input.query')}")} END"
WORD_FOR = "CASE tool " + " ".join(f"WHEN '{t}' THEN '{w}'" for t, w in (("spawn_agent", "subagent launch"), ("send_input", "subagent input"), ("wait", "subagent wait"), ("close_agent", "subagent close"))) + " END"
AGENTS = "(receiver_list IS NOT NULL OR sender_thread_id IS NOT NULL OR (event_type LIKE 'collab.%' AND v % 5 < 3))"


def _root_text(result: str) -> str:
    command = f"(tool = 'exec_command' OR {_jt('input.cmd')} IS NOT NULL)"
    head = f"""CASE WHEN {WORD_FOR} IS NOT NULL THEN {WORD_FOR} WHEN tool = 'web_search' THEN CASE WHEN k % 3 = 0 THEN 'search' ELSE 'open page' END || CASE WHEN {result} THEN ' result' ELSE '' END
      WHEN {command} THEN CASE WHEN {result} THEN CASE WHEN failed THEN 'command fail' ELSE 'command ok' END ELSE 'command' END WHEN {result} THEN 'tool result' ELSE 'tool' END"""
    detail = f"CASE WHEN {AGENTS} THEN {STATE_DETAIL} WHEN tool = 'web_search' THEN {WEB_DETAIL} ELSE {COMMAND} END"
    body = _words(f"nullif({detail}, '')", f"CASE WHEN {result} THEN 'exit=' || exit_code END")
    # the error of an object payload is looked at before the output
    why = f"CASE WHEN {result} AND failed THEN {_short(_jt('error.message'), 120)} END"
    return f"({_headed(f"{head} || ' [' || coalesce(tool, '?') || ']'", body)} || coalesce(CASE WHEN {body} = '' THEN ': ' ELSE ' -> ' END || {why}, ''))"


LINK_TEXT = f"' [request_id=' || {_jt('text_links.request_id')} || ' status=503 fallback=http]'"
IS_PLAN = f"(tool IS NOT DISTINCT FROM 'update_plan' OR operation_id IS NOT NULL OR {_jt('input.plan')} IS NOT NULL)"
PATCH_TARGET = f"CASE WHEN v % 2 = 1 THEN 'file=a.rs (+1)' ELSE 'file=a' || {N} || '.rs (+1)' END"
cte("described", f"SELECT *, {TEXT_PAYLOAD} AS p, {TEXT_TOOL} AS tool FROM categorized")
cte("summaries", f"""
SELECT run_id, session_id, seq, ts, event_type, tool, CASE WHEN event_type LIKE 'message.%' THEN coalesce({_short('text', 100)}, '') WHEN event_type = 'agent.session' THEN {_headed("'ready'", _words("'role=' || agent_role", "'nickname=' || agent_nickname", "'cwd=' || cwd"))}
  WHEN event_type = 'task.started' THEN {_headed("'started'", TASK_DETAIL)} WHEN event_type = 'task.completed' THEN {_headed("'done'", _short(_jt('last_agent_message'), 80))}
  WHEN event_type = 'runtime.context' THEN {_headed("'context'", _words("'cwd=' || cwd", f"'model=' || {_jt('model')}", "'mode=plan'"))} WHEN event_type = 'context.compacted' THEN {_headed("'context compacted'", _words("'items=3'", f"'message=' || {_jt('message')}"))}
  WHEN event_type = 'context.compacted.duplicate' THEN {_headed("'context compacted duplicate'", "coalesce('source=' || duplicate_of, '')")} WHEN event_type = 'info.tokens' THEN {_headed("'tokens'", f"concat_ws(', ', {COUNTS})")}
  WHEN event_type IN ('tool.call', 'shell.call') THEN CASE WHEN {SUB} THEN {_headed("'tool ' || coalesce(tool, '?')", f"coalesce({COMMAND}, '')")} ELSE {_root_text('false')} END
  WHEN event_type IN ('tool.result', 'shell.result') THEN CASE WHEN {SUB} THEN {_headed("'result ' || coalesce(tool, '?')", f"coalesce({_short(SAID, 60)}, '')")} ELSE {_root_text('true')} END
  WHEN event_type LIKE 'web.%' OR event_type LIKE 'collab.%' THEN {_root_text("coalesce(phase = 'completed', false)")}
  WHEN event_type IN ('mcp.call', 'mcp.result') THEN {_headed("CASE event_type WHEN 'mcp.call' THEN 'mcp call' ELSE 'mcp result' END", _words(PHASE_STATUS, f"'arguments=' || json_extract(p, '$.arguments')::VARCHAR", f"'error=' || json_extract(p, '$.error')::VARCHAR", "'server=srv'", "'tool=find'"))}
  WHEN event_type = 'stdin.write' THEN {_headed("'stdin write'", _words(PHASE_STATUS, "'session_id=7'", f"'chars=' || trim({_jt('input.chars')})", f"'output=' || {_short(SAID, 100)}"))}
  WHEN event_type = 'todo.update' AND {IS_PLAN} THEN {_headed("'todo update'", _words("'phase=' || phase", f"'explanation=' || {_jt('input.explanation')}", f"CASE WHEN {_jt('input.plan')} IS NOT NULL THEN 'steps=2' WHEN json_type(p, '$.input') = 'OBJECT' THEN NULL END"))}
  WHEN event_type = 'todo.update' THEN 'todo ' || coalesce(phase, '') || ': 1/2 next=' || {_jt('items[1].text')}
  WHEN event_type = 'user.input.request' THEN {_headed("'user input request'", _words("'phase=' || phase", "'questions=2'", f"'first=' || {_jt('input.questions[0].header')}", "'answers=4'"))}
  WHEN event_type = 'patch.apply' THEN {_headed("'patch apply'", _words(PHASE_STATUS, PATCH_TARGET, f"CASE WHEN v % 2 = 0 THEN 'output=' || {_short(SAID, 100)} END"))}
  WHEN event_type = 'patch.apply.duplicate' THEN {_headed("'patch apply duplicate'", _words(PHASE_STATUS, f"'output=' || {_short(SAID, 100)}"))}
  WHEN event_type = 'file.change' THEN 'files: add p' || {N} || ' (+1)' WHEN event_type = 'stderr.line' THEN 'stderr: ' || coalesce({_short('text', 100)}, '')
  WHEN event_type = 'error' THEN 'error: ' || coalesce({_jt('message')}, '') || {LINK_TEXT} WHEN event_type = 'agent.failed' THEN 'agent failed: ' || coalesce({_jt('message')}, {_jt('error.message')}) || {LINK_TEXT}
  WHEN event_type = 'agent.aborted' THEN 'agent aborted: reason=' || {_jt('reason')} ELSE event_type END AS summary FROM described""")


def described(spark, sf):
    payload = F.parse_json(F.expr(TEXT_PAYLOAD))
    return events(spark, sf).withColumns({"payload": payload, "tool_name": F.expr(TEXT_TOOL)})


@query("event_summary", "SELECT session_id, seq, event_type, summary FROM summaries")
def event_summary(spark, sf):
    return L.event_summary(described(spark, sf)).select("session_id", "seq", "event_type", "summary")


@query("run_timeline", f"""
SELECT run_id, seq, ts, event_type, label, position FROM (SELECT run_id, seq, ts, event_type, CASE WHEN length(l) <= 160 THEN l ELSE concat(substr(l, 1, 157), '...') END AS label,
  CAST(row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS INTEGER) AS position FROM (SELECT *, {FLAT.format(x='summary')} AS l FROM summaries) AS s) AS t WHERE position <= 12""")
def run_timeline(spark, sf):
    return L.run_timeline(described(spark, sf))


# A plan event and the response after it share their text when v agrees modulo two.
cte("plan_rows", """
SELECT session_id, own_thread AS thread, seq, event_type, CASE WHEN event_type = 'todo.update' THEN 'event_msg' WHEN event_type LIKE 'message.%' THEN 'response_item' ELSE 'event' END AS raw_type,
  CASE WHEN event_type = 'todo.update' THEN 'response_item.message' END AS duplicate_of, CASE WHEN event_type LIKE 'message.%' THEN 'agent' END AS role,
  CASE WHEN event_type = 'todo.update' OR event_type LIKE 'message.%' THEN concat('plan ', CAST(v % 2 AS VARCHAR)) END AS plan_text FROM categorized""")


def plan_rows(spark, sf):
    message, todo = F.col("event_type").startswith("message."), F.col("event_type") == "todo.update"
    plan = F.concat(F.lit("plan "), (F.col("v") % 2).cast("string"))
    wrapped = F.concat(F.lit("<proposed_plan>\n"), plan, F.lit("\n</proposed_plan>"))
    return events(spark, sf).select(
        "session_id", F.coalesce("thread_id", "sender_thread_id").alias("thread"), "seq", "event_type",
        F.when(todo, "event_msg").when(message, "response_item").otherwise("event").alias("raw_type"),
        F.when(todo, "response_item.message").alias("duplicate_of"), F.when(message, "agent").alias("role"),
        L.plan_text(F.col("event_type"), wrapped, plan).alias("plan_text"),
    )


cte("plan_near", """
SELECT *, lead(seq) OVER w AS n_seq, lead(raw_type) OVER w AS n_raw, lead(plan_text) OVER w AS n_plan, lag(raw_type) OVER w AS p_raw, lag(plan_text) OVER w AS p_plan
FROM plan_rows WINDOW w AS (PARTITION BY session_id, thread ORDER BY seq)""")


@query("merge_plan_messages", """
SELECT session_id, thread, seq, 'message.plan' AS event_type, plan_text, CASE WHEN raw_type = 'event_msg' AND n_raw = 'response_item' AND n_plan = plan_text THEN n_seq END AS merged_seq,
  CASE WHEN raw_type = 'response_item' OR (n_raw = 'response_item' AND n_plan = plan_text) THEN 'agent' ELSE 'assistant' END AS role FROM plan_near
WHERE plan_text IS NOT NULL AND NOT coalesce(raw_type = 'response_item' AND p_raw = 'event_msg' AND p_plan = plan_text, false)""")
def merge_plan_messages(spark, sf):
    return L.merge_plan_messages(plan_rows(spark, sf))


@query("patch_targets", """
SELECT session_id, seq, regexp_extract(json_extract_string(p, '$.input'), 'Update File: (\\S+)', 1) || ',' || regexp_extract(json_extract_string(p, '$.input'), 'Add File: (\\S+)', 1) AS targets
FROM normal WHERE t = 'custom_tool_call'""")
def patch_targets(spark, sf):
    rows = fixtures.silver(spark, sf).where(F.try_variant_get("payload", "$.type", "string") == "custom_tool_call")
    return rows.select("session_id", "seq", F.array_join(L.patch_targets(F.try_variant_get("payload", "$.input", "string")), ",").alias("targets"))


@query("patch_status", """
SELECT session_id, seq, CASE lower(status) WHEN 'completed' THEN 'success' WHEN 'failed' THEN 'failure' WHEN 'error' THEN 'failure' ELSE 'unknown' END AS variant,
  CASE WHEN lower(status) = 'completed' THEN NULL ELSE coalesce(status, phase) END AS detail FROM log_events WHERE event_type = 'patch.apply'""")
def patch_status(spark, sf):
    rows = events(spark, sf).where(F.col("event_type") == "patch.apply")
    return rows.select("session_id", "seq", *L.patch_status(F.col("status"), F.col("phase")))


cte("marked", """
SELECT a.session_id, a.kind, a.root_event_id, a.is_root, a.terminal_seq, a.seq, a.event_type, c.event_phase, c.duplicate_of, c.artifact_path, c.status, c.exit_code, c.thread_id
FROM annotated a JOIN classified c ON c.session_id = a.session_id AND c.seq = a.seq""")
PHASED = ", ".join(f"'{t}'" for t in L.PAIRED_PHASED)
cte("pairs", f"""
SELECT session_id, kind, root_event_id, call_seq, CASE WHEN terminal_seq IS NOT NULL AND terminal_seq <> call_seq THEN terminal_seq ELSE best END AS result_seq FROM (
  SELECT session_id, kind, root_event_id, min(seq) FILTER (WHERE is_root AND (event_type = 'shell.call' OR (event_type IN ({PHASED}) AND event_phase = 'started'))) AS call_seq, max(terminal_seq) AS terminal_seq,
    arg_max(seq, (duplicate_of IS NOT DISTINCT FROM 'response_item.function_call_output')::INT * 8e12 + (artifact_path IS NOT NULL)::INT * 4e12 + (status IS NOT NULL)::INT * 2e12 + (exit_code IS NOT NULL)::INT * 1e12 + seq)
      FILTER (WHERE NOT is_root AND (event_type = 'shell.result' OR (event_type IN ({PHASED}) AND event_phase = 'completed'))) AS best
  FROM marked WHERE root_event_id IS NOT NULL GROUP BY session_id, kind, root_event_id) AS g
WHERE call_seq IS NOT NULL AND coalesce(CASE WHEN terminal_seq <> call_seq THEN terminal_seq END, best) IS NOT NULL""")


@query("pair_call_result", "SELECT session_id, kind, root_event_id, call_seq, result_seq FROM pairs")
def pair_call_result(spark, sf):
    return L.pair_call_result(marked(spark, sf))


@query("drop_redundant_results", """
SELECT m.session_id, m.seq, m.event_type FROM marked m WHERE m.event_type <> 'patch.apply.duplicate' AND NOT EXISTS (
  SELECT 1 FROM pairs p JOIN marked r ON r.session_id = p.session_id AND r.seq = p.result_seq WHERE r.duplicate_of LIKE 'response_item.%' AND p.session_id = m.session_id AND p.kind = m.kind AND p.root_event_id = m.root_event_id
    AND m.seq <> p.result_seq AND NOT m.is_root AND m.duplicate_of IS NULL AND (m.event_type = 'shell.result'
    OR (m.event_type IN ('patch.apply', 'todo.update', 'collab.spawn_agent', 'collab.wait', 'collab.send_input', 'collab.close_agent') AND m.event_phase = 'completed')))""")
def drop_redundant_results(spark, sf):
    rows = marked(spark, sf)
    return L.drop_redundant_results(rows, L.pair_call_result(rows)).select("session_id", "seq", "event_type")


@query("merge_plan_updates", """
SELECT p.session_id, p.call_seq, p.result_seq, coalesce(CASE WHEN r.v % 3 = 0 THEN 'why ' || r.v END, 'how ' || c.v) AS explanation, CASE WHEN r.v % 2 = 0 THEN 's' || r.v || ',t' ELSE 's' || c.v END AS steps
FROM pairs p JOIN log_events c ON c.session_id = p.session_id AND c.seq = p.call_seq JOIN log_events r ON r.session_id = p.session_id AND r.seq = p.result_seq WHERE p.kind = 'todo.update'""")
def merge_plan_updates(spark, sf):
    pairs = L.pair_call_result(marked(spark, sf)).where(F.col("kind") == "todo.update")
    v = F.col("v")
    rows = events(spark, sf).select("session_id", "seq", "v")
    text = v.cast("string")
    call = rows.select("session_id", F.col("seq").alias("call_seq"), F.concat(F.lit("how "), text).alias("call_explanation"), F.array(F.concat(F.lit("s"), text)).alias("call_steps"))
    result = rows.select(
        "session_id", F.col("seq").alias("result_seq"), F.when(v % 3 == 0, F.concat(F.lit("why "), text)).otherwise(" ").alias("result_explanation"),
        F.when(v % 2 == 0, F.array(F.concat(F.lit("s"), text), F.lit("t"))).otherwise(F.array().cast("array<string>")).alias("result_steps"),
    )
    joined = pairs.join(call, ["session_id", "call_seq"]).join(result, ["session_id", "result_seq"])
    return L.merge_plan_updates(joined).withColumn("steps", F.array_join("steps", ","))


@query("task_segments", """
SELECT s.session_id, s.thread, s.turn_id, s.start_seq, CASE WHEN f IS NOT NULL AND (n IS NULL OR f < n) THEN f WHEN n IS NOT NULL THEN n - 1 ELSE l END AS end_seq, f IS NOT NULL AND (n IS NULL OR f < n) AS is_closed FROM (
  SELECT a.session_id, a.own_thread AS thread, a.turn_id, a.seq AS start_seq,
    (SELECT min(x.seq) FROM categorized x WHERE x.session_id = a.session_id AND x.own_thread IS NOT DISTINCT FROM a.own_thread AND x.event_type = 'task.started' AND x.seq > a.seq) AS n,
    (SELECT min(x.seq) FROM categorized x WHERE x.session_id = a.session_id AND x.own_thread IS NOT DISTINCT FROM a.own_thread AND x.event_type = 'task.completed' AND x.turn_id = a.turn_id AND x.seq > a.seq) AS f,
    (SELECT max(x.seq) FROM categorized x WHERE x.session_id = a.session_id AND x.own_thread IS NOT DISTINCT FROM a.own_thread) AS l
  FROM categorized a WHERE a.event_type = 'task.started') AS s""")
def task_segments(spark, sf):
    return L.task_segments(events(spark, sf))


@query("render_order", "SELECT session_id, thread_id, seq, coalesce(terminal_seq, seq) AS render_seq FROM marked WHERE is_root OR root_event_id IS NULL")
def render_order(spark, sf):
    return L.render_order(marked(spark, sf))


@query("thread_render_order", "SELECT session_id, thread_id, max(coalesce(terminal_seq, seq)) AS render_seq FROM marked GROUP BY session_id, thread_id")
def thread_render_order(spark, sf):
    return L.thread_render_order(marked(spark, sf))


@query("user_input_answers", """
SELECT session_id, seq, 'q1' AS id, 'Why ' || k || '?' AS question, CASE WHEN v % 2 = 0 THEN 'a' || v || ',b' END AS answers FROM log_events
UNION ALL SELECT session_id, seq, 'q2', 'How?', CASE WHEN v % 2 = 1 THEN 'c' || v END FROM log_events UNION ALL SELECT session_id, seq, 'q9', NULL, 'z' FROM log_events WHERE v % 2 = 1""")
def user_input_answers(spark, sf):
    k, v = F.col("k").cast("string"), F.col("v").cast("string")
    asked = F.concat(F.lit('{"questions":[{"id":"q1","question":"Why '), k, F.lit('?"},{"id":" q2","question":"How?"}]}'))
    given = F.when(F.col("v") % 2 == 0, F.concat(F.lit('{"answers":{"q1":{"answers":["a'), v, F.lit('","b"]}}}'))).otherwise(
        F.concat(F.lit('{"answers":{"q2":["c'), v, F.lit('"],"q9":"z"}}'))
    )
    requests = events(spark, sf).select("session_id", "seq", F.parse_json(asked).alias("input"), F.parse_json(given).alias("output"))
    return L.user_input_answers(requests).withColumn("answers", F.array_join("answers", ","))


@query("collab_states", """
SELECT session_id, seq, json_keys(p, '$.statuses')[1] AS thread_id, 'completed' AS state FROM normal WHERE t = 'collab_waiting_end'
UNION ALL SELECT session_id, seq, json_extract_string(p, '$.new_thread_id'), 'pending_init' FROM normal WHERE t = 'collab_agent_spawn_end'""")
def collab_states(spark, sf):
    rows = fixtures.silver(spark, sf).where(F.col("detection_confidence").isNotNull())
    return L.collab_states(rows)


@query("reported_states", """
SELECT run_id, seq, t AS thread_id, json_extract_string(item, concat('$.agents_states."', t, '".status')) AS status, json_extract_string(item, concat('$.agents_states."', t, '".message')) AS message
FROM (SELECT *, unnest(json_keys(item, '$.agents_states')) AS t FROM out_events WHERE it = 'collab_tool_call') AS s WHERE t LIKE 'r%'""")
def reported_states(spark, sf):
    return fixtures.stdout_events(spark, sf).select("run_id", "seq", F.inline("agents_states"))


@query("event_attributes", """
SELECT c.session_id, c.seq, c.event_type, CASE WHEN c.event_type LIKE 'collab.%' THEN 'subagent' WHEN s.tool = 'web_search' AND c.receiver_list IS NULL AND c.sender_thread_id IS NULL THEN 'search' ELSE c.category END AS category, s.summary, c.turn_id, s.tool AS tool_name, c.exit_code, c.total_tokens FROM categorized c JOIN summaries s ON s.session_id = c.session_id AND s.seq = c.seq""")
def event_attributes(spark, sf):
    return L.event_attributes(described(spark, sf)).select("session_id", "seq", "event_type", "category", "summary", "turn_id", "tool_name", "exit_code", "total_tokens")


@query("typed_payload", """
SELECT session_id, seq, event_type, CASE WHEN event_type IN ('tool.call', 'shell.call') THEN 'tool_call' WHEN event_type IN ('tool.result', 'shell.result', 'patch.apply', 'web.search', 'web.open', 'stdin.write', 'user.input.request')
    OR event_type LIKE 'collab.%' OR event_type = 'todo.update' THEN 'tool_result' WHEN event_type = 'mcp.call' THEN 'mcp_call' WHEN event_type = 'mcp.result' THEN 'mcp_result' WHEN event_type = 'info.tokens' THEN 'info_tokens'
  WHEN event_type = 'error' THEN 'error' WHEN event_type = 'file.change' THEN 'file_change' WHEN event_type = 'agent.failed' THEN 'agent_turn' WHEN event_type IN ('message.agent', 'agent.reasoning') THEN 'agent_message' ELSE 'value' END AS payload_view
FROM log_events""")
def typed_payload(spark, sf):
    return L.typed_payload(events(spark, sf)).select("session_id", "seq", "event_type", "payload_view")


# Payloads in which some fields have a type of their own now and then.
PAYLOAD_TEXT = """CASE WHEN k % 17 = 3 THEN '[1]' ELSE concat('{"thread_id":"', coalesce(thread_id, 'none'), '","tool_name":', CASE WHEN k % 7 = 0 THEN '7' ELSE '"sh"' END,
  ',"exit_code":', CASE WHEN k % 5 = 0 THEN '"1"' WHEN k % 5 = 1 THEN 'null' ELSE CAST(v % 300 AS VARCHAR(20)) END, ',"text":"t', CAST(v % 90 AS VARCHAR(20)),
  '","receiver_thread_ids":["a",', CASE WHEN k % 6 = 0 THEN '1' ELSE '"b"' END, '],"changes":[{"kind":"add","path":"p', CAST(v % 9 AS VARCHAR(20)), '"},5,{"path":3}],"total_tokens":',
  CASE WHEN k % 8 = 0 THEN '-1' ELSE CAST(v AS VARCHAR(20)) END, ',"status":', CASE WHEN k % 9 = 0 THEN 'true' ELSE '"ok"' END, '}') END"""
cte("payloads", f"SELECT session_id, seq, event_type, {PAYLOAD_TEXT} AS p FROM log_events")
cte("payload_kinds", f"""
SELECT session_id, seq, event_type, p, CASE WHEN json_type(p) <> 'OBJECT' THEN NULL {' '.join(f"WHEN event_type IN ({', '.join(repr(t) for t in types.split())}) THEN '{view}'" for view, types in Y.VIEW_OF.items())}
  WHEN event_type = 'todo.update' THEN 'todo_update' END AS view,
  json_type(p, '$.tool_name') <> 'VARCHAR' AS bad_name, json_type(p, '$.exit_code') NOT IN ('NULL', 'UBIGINT', 'BIGINT') AS bad_exit, json_type(p, '$.receiver_thread_ids[1]') <> 'VARCHAR' AS bad_ids,
  json_type(p, '$.total_tokens') = 'BIGINT' AS bad_tokens, json_type(p, '$.status') <> 'VARCHAR' AS bad_status FROM payloads""")


@query("typed_payload_fields", """
SELECT session_id, seq, event_type, CASE WHEN bad IS NULL AND view IS NOT NULL THEN view ELSE 'value' END AS payload_view, bad AS payload_error,
  CASE WHEN good AND view IN ('tool_call', 'tool_result') THEN json_extract_string(p, '$.tool_name') END AS tool_name,
  CASE WHEN good AND view = 'tool_result' THEN CAST(json_extract_string(p, '$.exit_code') AS BIGINT) END AS exit_code,
  CASE WHEN good AND view = 'agent_message' THEN json_extract_string(p, '$.text') END AS text,
  CASE WHEN good AND view = 'info_tokens' THEN CAST(json_extract_string(p, '$.total_tokens') AS BIGINT) END AS total_tokens,
  CASE WHEN good AND view = 'file_change' THEN concat('add:', json_extract_string(p, '$.changes[0].path'), ',:') END AS changes
FROM (SELECT *, bad IS NULL AND view IS NOT NULL AS good FROM (SELECT *, CASE
  WHEN view IN ('tool_call', 'tool_result') AND bad_name THEN 'tool_name' WHEN view IN ('tool_call', 'tool_result', 'mcp_call', 'mcp_result', 'file_change', 'todo_update', 'error') AND bad_status THEN 'status'
  WHEN view = 'tool_result' AND bad_exit THEN 'exit_code' WHEN view IN ('tool_call', 'tool_result') AND bad_ids THEN 'receiver_thread_ids' WHEN view = 'info_tokens' AND bad_tokens THEN 'total_tokens' END AS bad
  FROM payload_kinds) AS a) AS b""")
def typed_payload_fields(spark, sf):
    rows = fixtures.view(spark, sf, "log_events").select("session_id", "seq", "event_type", F.parse_json(F.expr(PAYLOAD_TEXT)).alias("payload"))
    typed = Y.typed_payloads(rows)
    changes = F.array_join(F.transform("as_file_change.changes", lambda c: F.concat(c["kind"], F.lit(":"), c["path"])), ",")
    return typed.select(
        "session_id", "seq", "event_type", "payload_view", "payload_error", F.coalesce("as_tool_call.tool_name", "as_tool_result.tool_name").alias("tool_name"),
        F.col("as_tool_result.exit_code").alias("exit_code"), F.col("as_agent_message.text").alias("text"), F.col("as_info_tokens.total_tokens").alias("total_tokens"), changes.alias("changes"),
    )
