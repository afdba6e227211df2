"""Registered queries and comparison SQL for the session catalog and linked sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import catalog as K
from loomtrace.plans import fixtures
from loomtrace.plans.metrics_queries import events
from loomtrace.plans.oracle import cte
from loomtrace.sources import logs as L

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def sessions(spark, sf):
    return fixtures.sessions(spark, sf)


def files(spark, sf):
    rows = fixtures.view(spark, sf, "fx_files")
    return rows.select("session_id", "session_ref", F.timestamp_seconds("mtime").alias("modified"), "mtime")


def index(spark, sf):
    return L.index_rows(fixtures.view(spark, sf, "fx_index"))


def state(spark, sf):
    # sessions without tokens stand in the catalog under an id that no file has, so each place is asked
    named = F.when(F.col("tokens_used").isNull(), F.concat("session_id", F.lit("-old"))).otherwise(F.col("session_id"))
    threads = sessions(spark, sf).withColumn("session_id", named)
    return K.from_state(threads.select("*", F.col("session_id").alias("id"), F.concat(F.lit("sessions/b/rollout-2026-04-08T10-00-00-"), "session_id", F.lit(".jsonl")).alias("rollout_path"), F.lit(0).alias("archived")))


cte("idx", """
SELECT session_id, thread_name, updated_at, seq FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY updated_at DESC, seq DESC) AS rn FROM (
  SELECT seq, coalesce(json_extract_string(value, '$.id'), json_extract_string(value, '$.session_id')) AS session_id, nullif(trim(json_extract_string(value, '$.thread_name')), '') AS thread_name,
    json_extract_string(value, '$.updated_at') AS updated_at FROM fx_index WHERE json_valid(value)) AS g) AS r WHERE rn = 1""")


@query("scan_session_index", "SELECT * FROM idx")
def scan_session_index(spark, sf):
    return index(spark, sf)


@query("index_diagnostics", "SELECT seq, 'invalid index line' AS diagnostic FROM fx_index WHERE NOT json_valid(value)")
def index_diagnostics(spark, sf):
    return L.index_diagnostics(fixtures.view(spark, sf, "fx_index"))


cte("newest_files", """
SELECT session_id, session_ref, mtime FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY mtime DESC, session_ref) AS rn FROM fx_files) AS f WHERE rn = 1""")
cte("listed", """
SELECT f.session_id, f.session_ref, i.thread_name, coalesce(i.updated_at, strftime(to_timestamp(f.mtime) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%fZ')) AS updated_at
FROM newest_files f LEFT JOIN idx i ON i.session_id = f.session_id""")


@query("list_sessions", "SELECT session_id, session_ref, thread_name, updated_at FROM listed ORDER BY updated_at DESC, session_ref LIMIT 50 OFFSET 10")
def list_sessions(spark, sf):
    page = K.list_sessions(files(spark, sf), index(spark, sf), None, 10)
    return page.select("session_id", "session_ref", "thread_name", "updated_at")


@query("search_sessions", """
SELECT session_id, session_ref, thread_name FROM listed WHERE contains(lower(session_id), 'name 1') OR contains(lower(session_ref), 'name 1') OR contains(lower(coalesce(thread_name, '')), 'name 1')""")
def search_sessions(spark, sf):
    rows = K.session_list(files(spark, sf), index(spark, sf)).where(K.matches(" Name 1", K.SEARCH_FILES))
    return rows.select("session_id", "session_ref", "thread_name")


@query("duplicate_files", """
SELECT session_id, session_ref, row_number() OVER (PARTITION BY session_id ORDER BY mtime DESC, session_ref) - 1 AS position, files FROM (
  SELECT *, count(*) OVER (PARTITION BY session_id) AS files FROM fx_files) AS f WHERE files > 1""")
def duplicate_files(spark, sf):
    return K.duplicate_files(files(spark, sf)).select("session_id", "session_ref", "position", "files")


cte("state_rows", """
SELECT CASE WHEN tokens_used IS NULL THEN s.session_id || '-old' ELSE s.session_id END AS session_id, concat('sessions/b/rollout-2026-04-08T10-00-00-', CASE WHEN tokens_used IS NULL THEN s.session_id || '-old' ELSE s.session_id END, '.jsonl') AS session_ref, coalesce(nullif(trim(title), ''), first_user_message, agent_nickname) AS thread_name,
  CASE WHEN trim(title) <> '' THEN 'title' WHEN first_user_message IS NOT NULL THEN 'first_user_message' WHEN agent_nickname IS NOT NULL THEN 'agent_nickname' END AS name_source,
  updated_at, model, tokens_used, cwd, agent_role FROM fx_sessions AS s""")


@query("list_indexed_sessions", """
SELECT session_id, thread_name, updated_at FROM (SELECT session_id, thread_name, updated_at, 0 AS rank FROM state_rows
  UNION ALL SELECT session_id, NULL, mtime, -1 FROM newest_files WHERE session_id = 's11' AND session_id NOT IN (SELECT session_id FROM state_rows)) AS u ORDER BY rank, updated_at DESC, session_id LIMIT 20""")
def list_indexed_sessions(spark, sf):
    page = K.list_indexed_sessions(state(spark, sf), K.from_files(K.newest_files(files(spark, sf))), 20, 0, None, "s11")
    return page.select("session_id", "thread_name", F.unix_seconds("updated_at").alias("updated_at"))


@query("find_session", """
SELECT session_id, arg_min(origin, r) AS origin, arg_min_null(thread_name, r) AS thread_name FROM (SELECT session_id, 'state' AS origin, 0 AS r, thread_name FROM state_rows
  UNION ALL SELECT session_id, 'index', 1, thread_name FROM idx UNION ALL SELECT session_id, 'file', 2, NULL FROM newest_files) AS u GROUP BY session_id""")
def find_session(spark, sf):
    found = K.find_sessions(state(spark, sf), K.from_index(index(spark, sf)), K.from_files(K.newest_files(files(spark, sf))))
    return found.select("session_id", "origin", "thread_name")


@query("resolve_session_ref", """
SELECT n.session_id, CASE WHEN EXISTS (SELECT 1 FROM fx_files f JOIN state_rows s ON s.session_ref = f.session_ref WHERE f.session_id = n.session_id)
  THEN (SELECT s.session_ref FROM state_rows s WHERE s.session_id = n.session_id) ELSE n.session_ref END AS session_ref FROM newest_files n""")
def resolve_session_ref(spark, sf):
    return K.resolve_session_refs(state(spark, sf), files(spark, sf))


@query("parse_rollout_name", "SELECT session_ref, session_id AS parsed_id FROM fx_files")
def parse_rollout_name(spark, sf):
    return files(spark, sf).select("session_ref", K.rollout_id(L.file_name(F.col("session_ref"))).alias("parsed_id"))


@query("match_thread_file", """
SELECT f.session_ref, concat('s', CAST(user_id AS VARCHAR)) = session_id AS names_own, regexp_matches(session_ref, concat('(^|[^A-Za-z0-9])', substr(session_id, 1, 2), '([^A-Za-z0-9]|$)')) AS names_prefix FROM fx_files f""")
def match_thread_file(spark, sf):
    name = F.col("session_ref")
    return files(spark, sf).select(
        name, K.names_thread(name, F.col("session_id")).alias("names_own"), K.names_thread(name, F.substring("session_id", 1, 2)).alias("names_prefix")
    )


@query("thread_name_precedence", """
SELECT session_id, coalesce(nullif(trim(title), ''), first_user_message, agent_nickname) AS thread_name,
  CASE WHEN trim(title) <> '' THEN 'title' WHEN first_user_message IS NOT NULL THEN 'first_user_message' WHEN agent_nickname IS NOT NULL THEN 'agent_nickname' END AS name_source FROM fx_sessions""")
def thread_name_precedence(spark, sf):
    return sessions(spark, sf).select("session_id", K.thread_name().alias("thread_name"), K.thread_name_source().alias("name_source"))


@query("sandbox_kind", "SELECT * FROM sandbox")
def sandbox_kind(spark, sf):
    return sessions(spark, sf).select("session_id", K.sandbox_kind(F.col("sandbox_policy")).alias("sandbox_policy_kind"))


@query("active_like", "SELECT session_ref, 1704330000 - mtime < 120 AS active FROM fx_files")
def active_like(spark, sf):
    return files(spark, sf).select("session_ref", K.active_like(F.col("modified"), F.timestamp_seconds(F.lit(1704330000))).alias("active"))


@query("catalog_summary", """
SELECT 'state' AS origin, session_id, session_ref, thread_name, name_source, updated_at, model, tokens_used FROM state_rows
UNION ALL SELECT 'index', session_id, NULL, thread_name, CASE WHEN thread_name IS NOT NULL THEN 'index' END, CAST(epoch(CAST(updated_at AS TIMESTAMP)) AS BIGINT), NULL, NULL FROM idx
UNION ALL SELECT 'file', session_id, session_ref, NULL, NULL, mtime, NULL, NULL FROM newest_files""")
def catalog_summary(spark, sf):
    parts = [("state", state(spark, sf)), ("index", K.from_index(index(spark, sf))), ("file", K.from_files(K.newest_files(files(spark, sf))))]
    rows = [df.withColumn("origin", F.lit(n)) for n, df in parts]
    united = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return united.select("origin", "session_id", "session_ref", "thread_name", "name_source", F.unix_seconds("updated_at").alias("updated_at"), "model", "tokens_used")


@query("project_identity", "SELECT session_id, project_key, degraded, project_cwd FROM identity")
def project_identity(spark, sf):
    return K.with_identity(sessions(spark, sf)).select("session_id", "project_key", "degraded", "project_cwd")


@query("normalize_path", """
SELECT session_id, replace(cwd, '/./sub/..', '') AS path, ('/root/' || replace(replace(cwd, '/./sub/..', ''), '/home/u/', '')) AS home_path FROM fx_sessions""")
def normalize_path(spark, sf):
    rows = sessions(spark, sf)
    tilde = F.regexp_replace("cwd", "^/home/u/", "~/x/../")
    return rows.select("session_id", K.normalize_path(F.col("cwd")).alias("path"), K.normalize_path(tilde, "/root").alias("home_path"))


@query("session_scope", "SELECT * FROM scopes")
def session_scope(spark, sf):
    return sessions(spark, sf).select("session_id", K.session_scope(F.col("source")).alias("session_scope"))


@query("source_fields", """
SELECT session_id, CASE WHEN source IS NULL THEN NULL WHEN NOT json_valid(source) THEN source WHEN json_exists(source, '$.subagent.thread_spawn') THEN 'subagent' ELSE 'structured' END AS source_label,
  CASE WHEN json_valid(source) THEN nullif(trim(json_extract_string(source, '$.subagent.thread_spawn.parent_thread_id')), '') END AS source_parent,
  CASE WHEN json_valid(source) THEN json_extract_string(source, '$.subagent.thread_spawn.depth') END AS source_depth FROM fx_sessions""")
def source_fields(spark, sf):
    return sessions(spark, sf).select("session_id", *K.source_fields(F.col("source")))


cte("projects", """
SELECT catalog_key, count(*) AS sessions, count(DISTINCT project_key) AS backend_keys, string_agg(DISTINCT project_key, ',' ORDER BY project_key) AS backend_key_list, count(*) FILTER (WHERE session_scope = 'main') AS main_sessions,
  count(*) FILTER (WHERE session_scope = 'subsession') AS subsession_sessions, count(*) FILTER (WHERE session_scope = 'unknown') AS unknown_sessions, bool_or(degraded) AS degraded,
  arg_max_null(cwd, o) AS cwd, arg_max_null(git_branch, o) AS branch, arg_max_null(git_origin_url, o) AS origin
FROM (SELECT i.*, s.cwd, s.git_branch, s.git_origin_url, c.session_scope, i.project_group AS catalog_key, s.updated_at * 1000000 + s.rk AS o FROM identity i
  JOIN (SELECT *, row_number() OVER (ORDER BY session_id DESC) AS rk FROM fx_sessions) AS s ON s.session_id = i.session_id JOIN scopes c ON c.session_id = i.session_id) AS p GROUP BY catalog_key""")


def catalog(spark, sf):
    return K.project_catalog(K.with_identity(sessions(spark, sf)))


@query("project_catalog", "SELECT catalog_key, sessions, backend_keys, backend_key_list, main_sessions, subsession_sessions, unknown_sessions, degraded FROM projects")
def project_catalog(spark, sf):
    return catalog(spark, sf).drop("label", "description")


@query("project_label", """
SELECT catalog_key, CASE WHEN degraded THEN coalesce(cwd, 'Degraded project') ELSE list_extract(string_split(cwd, '/'), -1) END AS label,
  concat_ws(' · ', CASE WHEN degraded THEN 'degraded identity' END, CASE WHEN main_sessions > 0 THEN concat('main ', main_sessions) END, CASE WHEN subsession_sessions > 0 THEN concat('subsession ', subsession_sessions) END,
    CASE WHEN unknown_sessions > 0 THEN concat('unknown ', unknown_sessions) END, branch, origin, cwd) AS description FROM projects""")
def project_label(spark, sf):
    return catalog(spark, sf).select("catalog_key", "label", "description")


@query("session_preview", """
SELECT e.session_id, e.position, e.seq, e.ts, e.event_type, e.raw_type, e.text, s.event_count, s.first_ts, s.last_ts FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS INTEGER) AS position FROM log_events) AS e
JOIN (SELECT session_id, count(*) AS event_count, arg_min(ts, seq) AS first_ts, arg_max(ts, seq) AS last_ts FROM log_events GROUP BY session_id) AS s ON s.session_id = e.session_id WHERE e.position <= 80""")
def session_preview(spark, sf):
    return K.session_preview(events(spark, sf))


@query("latest_event", "SELECT session_id, max(seq) AS seq, arg_max(ts, seq) AS ts, arg_max(event_type, seq) AS event_type FROM log_events GROUP BY session_id")
def latest_event(spark, sf):
    return K.latest_event(events(spark, sf))


cte("reach", """
SELECT session_id AS root, session_id, [session_id] AS way FROM fx_sessions
UNION ALL SELECT r.root, e.child, list_append(r.way, e.child) FROM reach r JOIN fx_edges e ON e.parent = r.session_id WHERE NOT list_contains(r.way, e.child)""")
cte("linked", "SELECT root, session_id, min(way) AS way FROM reach GROUP BY root, session_id")


def linked(spark, sf):
    roots = sessions(spark, sf).select(F.col("session_id").alias("root"))
    return K.linked_sessions(roots, fixtures.view(spark, sf, "fx_edges"))


@query("load_linked_sessions", """
SELECT l.root, l.session_id, e.seq AS session_seq, row_number() OVER (PARTITION BY l.root ORDER BY l.way, e.seq) AS seq FROM linked l JOIN log_events e ON e.session_id = l.session_id""")
def load_linked_sessions(spark, sf):
    return K.linked_events(linked(spark, sf), events(spark, sf))


@query("linked_sessions", "SELECT root, session_id, array_to_string(way, '>') AS way FROM linked")
def linked_sessions(spark, sf):
    return linked(spark, sf).withColumn("way", F.array_join("way", ">"))


@query("collect_receiver_ids", """
SELECT session_id, seq, array_to_string(list_sort(list_distinct([CAST('t' || (k % 3) AS VARCHAR), CAST('u' || (v % 4) AS VARCHAR)])), ',') AS receivers FROM log_events""")
def collect_receiver_ids(spark, sf):
    inner = F.concat(F.lit('{\\"receiver_thread_ids\\":[\\"t'), (F.col("k") % 3).cast("string"), F.lit('\\"]}'))
    outer = F.concat(F.lit('{"a":{"b":"'), inner, F.lit('"},"receiver_thread_ids":[" u'), (F.col("v") % 4).cast("string"), F.lit('",""]}'))
    rows = L.collect_receiver_ids(events(spark, sf).withColumn("payload_text", outer))
    return rows.select("session_id", "seq", F.array_join("receivers", ",").alias("receivers"))
