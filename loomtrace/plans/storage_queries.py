"""Registered queries for sources, the metrics store and streams, on files Spark writes from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomtrace.functions import json as J
from loomtrace.functions.covered import flatten_covered
from loomtrace.operators import catalog as K
from loomtrace.operators import operations as O
from loomtrace.operators import session_metrics as M
from loomtrace.operators.columns import EVENT_COLUMNS
from loomtrace.operators.projects import project_rollup
from loomtrace.plans import fixtures
from loomtrace.plans.log_queries import silver
from loomtrace.plans.metrics_queries import OPS_COLUMNS, events, metric_sessions
from loomtrace.plans.oracle import cte
from loomtrace.plans.project_queries import COVERED, DOCUMENT, ROLLUP_BODY, build_metrics, metrics
from loomtrace.session import cut_lineage, ensure_checkpoint_dir
from loomtrace.sources import logs as L
from loomtrace.sources import metrics_store as S
from loomtrace.streaming import tail as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def shared_folder(spark, label: str) -> str:
    """A fresh path in the folder all executors reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"


# ---- sources -----------------------------------------------------------------------------------


def write_session_files(rows, label: str, order: str) -> str:
    """One text file per session, lines in order, below `session_id=…` folders."""
    path = shared_folder(rows.sparkSession, label)
    rows.repartition("session_id").sortWithinPartitions("session_id", order).select("session_id", "value").write.partitionBy("session_id").text(path)
    return path


FOLDER = r"session_id=([^/]+)/"


@query("scan_session_log", "SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS seq, value FROM fx_lines")
def scan_session_log(spark, sf):
    path = write_session_files(fixtures.view(spark, sf, "fx_lines"), "sessions", "seq")
    lines = L.read_lines(spark, path, "*.txt")
    return lines.select(F.regexp_extract("path", FOLDER, 1).alias("session_id"), "seq", "value")


@query("discover_session_files", """
SELECT l.session_id AS folder, CASE WHEN l.raw_type = 'session_meta' AND p IS NOT NULL THEN json_extract_string(p, '$.id') END AS session_id,
  CASE WHEN l.raw_type = 'session_meta' AND p IS NOT NULL THEN NULL ELSE 'session id not found' END AS diagnostic
FROM parsed l JOIN (SELECT session_id, min(seq) AS seq FROM fx_lines GROUP BY session_id) AS f ON f.session_id = l.session_id AND f.seq = l.seq""")
def discover_session_files(spark, sf):
    path = write_session_files(fixtures.view(spark, sf, "fx_lines"), "sessions", "seq")
    found = L.files_of(L.read_lines(spark, path, "*.txt"))
    return found.select(F.regexp_extract("session_ref", FOLDER, 1).alias("folder"), "session_id", "diagnostic")


CANONICAL = """concat('{"ts":"', ts, '","seq":', CAST(seq AS VARCHAR(20)), CASE WHEN v % 4 = 0 THEN '' ELSE concat(',"event_type":"', event_type, '"') END,
  ',"run_id":"', session_id, '","payload":', CASE WHEN v % 5 = 0 THEN '7' ELSE concat('{"k":', CAST(k AS VARCHAR(20)), '}') END, '}')"""
CANONICAL_SQL = """ts, seq, CASE WHEN v % 4 = 0 THEN 'raw.unparsed' ELSE event_type END AS event_type, session_id AS run_id, 1 AS schema_version, CASE WHEN v % 5 = 0 THEN NULL ELSE k END AS k"""


def canonical_out(rows):
    return rows.select("ts", "seq", "event_type", "run_id", F.col("schema_version").cast("int").alias("schema_version"), F.try_variant_get("payload", "$.k", "int").alias("k"))


@query("scan_event_log", f"SELECT {CANONICAL_SQL} FROM log_events WHERE v % 6 <> 0")
def scan_event_log(spark, sf):
    lines = fixtures.view(spark, sf, "log_events").select(F.expr(CANONICAL).alias("good"), "v")
    broken = F.when(F.col("v") % 12 == 0, F.lit("[1,2]")).when(F.col("v") % 6 == 0, F.lit("{broken")).otherwise(F.col("good"))
    path = shared_folder(spark, "events")
    lines.select(broken.alias("value")).write.text(path)
    return canonical_out(L.scan_event_log(spark, path))


@query("scan_event_array", f"SELECT {CANONICAL_SQL} FROM log_events")
def scan_event_array(spark, sf):
    rows = fixtures.view(spark, sf, "log_events").select("session_id", "seq", F.concat(F.expr(CANONICAL), F.lit(",")).alias("value"))
    ids = rows.select("session_id").distinct()
    marks = ids.select("session_id", F.lit(0).cast("bigint").alias("seq"), F.lit("[").alias("value")).unionByName(
        ids.select("session_id", F.lit((1 << 62)).alias("seq"), F.lit("]").alias("value"))
    )
    path = write_session_files(rows.unionByName(marks), "arrays", "seq")
    return canonical_out(L.scan_event_array(spark, path))


def logged_events(spark, sf):
    """Flat events read back from canonical log lines that hold the event table."""
    rows = fixtures.log_events(spark, sf)
    top = [c for c in ("ts", "seq", "event_type", "raw_type", "parse_status", "task_id") if c in rows.columns]
    rest = [c for c in EVENT_COLUMNS if c in rows.columns and c not in ("artifact_path", "run_id", "source", "agents_states", *top)]
    states = F.map_from_entries(F.transform("agents_states", lambda s: F.struct(s["thread_id"], F.struct(s["status"].alias("status"), s["message"].alias("message")))))
    # half of the artefacts stand under the other name
    other = F.col("v") % 2 == 0
    paths = [F.when(~other, F.col("artifact_path")).alias("artifact_path"), F.when(other, F.col("artifact_path")).alias("path")]
    line = F.to_json(F.struct(*top, F.col("session_id").alias("run_id"), F.struct(*rest, *paths, states.alias("agents_states")).alias("payload")))
    path = shared_folder(spark, "events")
    rows.select(line.alias("value")).write.text(path)
    return cut_lineage(L.flat_events(L.scan_event_log(spark, path)).drop("payload"))


@query("event_log_session_detail", f"SELECT {', '.join([*DOCUMENT, *[c + '_coverage' for c in COVERED]])} FROM metrics")
def event_log_session_detail(spark, sf):
    return flatten_covered(build_metrics(spark, sf, logged_events(spark, sf)).select(*DOCUMENT))


@query("event_log_project_rollup", f"SELECT project_key, count(*) AS sessions, {ROLLUP_BODY} FROM metrics GROUP BY project_key")
def event_log_project_rollup(spark, sf):
    return flatten_covered(project_rollup(build_metrics(spark, sf, logged_events(spark, sf))))


@query("event_log_task_outcome", "SELECT * FROM task_outcomes")
def event_log_task_outcome(spark, sf):
    from loomtrace.operators import tasks

    found = tasks.task_outcome(tasks.task_intervals(logged_events(spark, sf)))
    return found.select("session_id", "started_seq", "outcome", "outcome_coverage", "error_type")


STDERR = "SELECT run_id, 'task1' AS task_id, k, v, seq AS at, read_at FROM fx_stdout"
cte("err_rows", f"""
SELECT e.run_id, row_number() OVER (PARTITION BY e.run_id ORDER BY e.at) + m.last_seq AS seq, 'stderr.line' AS event_type, 'stderr ' || e.k AS text
FROM ({STDERR}) AS e JOIN (SELECT run_id, max(seq) AS last_seq FROM fx_stdout GROUP BY run_id) AS m ON m.run_id = e.run_id""")


def stderr_lines(spark, sf):
    from loomtrace.operators.ordered import row_index

    rows = fixtures.stdout_lines(spark, sf)
    numbered = row_index(rows, ["run_id"], F.floor(F.col("seq") / 100_000), [F.col("seq")], "at")
    return numbered.select("run_id", "task_id", (F.col("at") + 1).alias("seq"), "read_at", F.concat(F.lit("stderr "), F.col("k").cast("string")).alias("value"))


@query("scan_stderr", "SELECT run_id, seq, event_type, text FROM err_rows")
def scan_stderr(spark, sf):
    return L.stderr_events(stderr_lines(spark, sf), fixtures.stdout_lines(spark, sf)).select("run_id", "seq", "event_type", "text")


@query("scan_run_dir", """
SELECT run_id, event_type, count(*) AS n FROM (SELECT run_id, event_type FROM out_events UNION ALL SELECT run_id, event_type FROM err_rows UNION ALL SELECT session_id, event_type FROM normal) AS u GROUP BY run_id, event_type""")
def scan_run_dir(spark, sf):
    stdout = fixtures.stdout_lines(spark, sf)
    owners = fixtures.bronze(spark, sf).select("session_id", F.col("session_id").alias("owner_run"), F.lit("task1").alias("owner_task")).distinct()
    replayed = L.replay(fixtures.stdout_events(spark, sf), L.stderr_events(stderr_lines(spark, sf), stdout), silver(spark, sf), owners)
    return replayed.groupBy("run_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("scan_thread_catalog", """
SELECT r.session_id, thread_name, name_source, r.updated_at, r.tokens_used, r.model, s.user_id % 2 = 1 AS has_user_event, CASE WHEN s.user_id % 3 = 0 THEN s.updated_at + 60 END AS archived_at, s.user_id % 3 = 0 AS archived
FROM state_rows r JOIN fx_sessions s ON s.session_id = replace(r.session_id, '-old', '')""")
def scan_thread_catalog(spark, sf):
    path = shared_folder(spark, "threads")
    rows = fixtures.sessions(spark, sf)
    named = F.when(F.col("tokens_used").isNull(), F.concat("session_id", F.lit("-old"))).otherwise(F.col("session_id"))
    gone = (F.col("user_id") % 3 == 0).cast("int")
    flags = [gone.alias("archived"), F.when(gone == 1, F.col("updated_at") + 60).alias("archived_at"), (F.col("user_id") % 2).alias("has_user_event")]
    rows.select("*", named.alias("id"), F.lit(None).cast("string").alias("rollout_path"), *flags).write.parquet(path)
    state = K.from_state(L.scan_thread_catalog(spark, path))
    return state.select("session_id", "thread_name", "name_source", F.unix_seconds("updated_at").alias("updated_at"), "tokens_used", "model", "has_user_event", F.unix_seconds("archived_at").alias("archived_at"), "archived")


@query("newest_state", """
SELECT generation, path FROM (SELECT CAST(user_id % 7 AS BIGINT) AS generation, concat('db/', session_id, '/state_', user_id % 7, '.sqlite') AS path, updated_at FROM fx_sessions WHERE user_id % 5 <> 0) AS s
ORDER BY generation DESC, updated_at DESC, path DESC LIMIT 1""")
def newest_state(spark, sf):
    part = (F.col("user_id") % 7).cast("string")
    name = F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("state_"), part, F.lit(".sqlite"))).otherwise("other.sqlite")
    files = fixtures.sessions(spark, sf).select(F.concat(F.lit("db/"), "session_id", F.lit("/"), name).alias("path"), F.timestamp_seconds("updated_at").alias("modified"))
    return L.newest_state(files).select("generation", "path")


@query("operation_identity", """
SELECT session_id, seq, CASE WHEN v % 3 = 0 THEN NULL WHEN v % 3 = 1 THEN 'i' || k ELSE 'c' || k END AS operation_id, CASE WHEN v % 5 = 0 THEN NULL WHEN v % 5 = 1 THEN 's' || k ELSE 't' || k END AS scope_thread_id FROM log_events""")
def operation_identity(spark, sf):
    k = F.col("k").cast("string")
    ids = F.when(F.col("v") % 3 == 0, F.lit('"tool_use_id":null,"item_id":"x"')).when(F.col("v") % 3 == 1, F.concat(F.lit('"item_id":" i'), k, F.lit('","call_id":"y"'))).otherwise(F.concat(F.lit('"call_id":"c'), k, F.lit('"')))
    scope = F.when(F.col("v") % 5 == 0, F.lit('"thread_id":5,"sender_thread_id":"z"')).when(F.col("v") % 5 == 1, F.concat(F.lit('"sender_thread_id":"s'), k, F.lit('"'))).otherwise(F.concat(F.lit('"thread_id":"t'), k, F.lit('"')))
    rows = events(spark, sf).withColumn("payload", F.parse_json(F.concat(F.lit("{"), ids, F.lit(","), scope, F.lit("}"))))
    return rows.select("session_id", "seq", *O.operation_identity(F.col("payload")))


# ---- the metrics store -------------------------------------------------------------------------


def document(spark, sf):
    return metrics(spark, sf).drop("degraded", "project_group", "project_cwd")


@query("sink_metrics_upsert", "SELECT session_id, event_count, CASE WHEN session_scope = 'main' THEN 5 ELSE 4 END AS metrics_schema_version FROM metrics")
def sink_metrics_upsert(spark, sf):
    path = shared_folder(spark, "store")
    old = document(spark, sf).withColumn("metrics_schema_version", F.lit(4))
    S.upsert(spark, path, old)
    S.upsert(spark, path, document(spark, sf).where(F.col("session_scope") == "main"))
    return S.load(spark, path).select("session_id", F.col("event_count.value").alias("event_count"), "metrics_schema_version")


@query("load_metrics_by_id", "SELECT session_id, event_count FROM metrics WHERE session_id IN ('s1', 's2', 'missing')")
def load_metrics_by_id(spark, sf):
    path = shared_folder(spark, "store")
    S.upsert(spark, path, document(spark, sf))
    return S.load_by_id(spark, path, ["s1", "s2", "missing"]).select("session_id", F.col("event_count.value").alias("event_count"))


def half_stored(spark, sf):
    """A store with current rows, rows of an old version, and no row for unknown scopes."""
    rows = document(spark, sf).where(F.col("session_scope") != "unknown")
    return rows.withColumn("source_projection_version", F.when(F.col("session_scope") == "subsession", 8).otherwise(F.col("source_projection_version")))


@query("needs_rebuild", "SELECT session_id, session_scope <> 'main' AS needs_rebuild FROM scopes")
def needs_rebuild(spark, sf):
    return S.needs_rebuild(fixtures.sessions(spark, sf), half_stored(spark, sf))


@query("materialize_stale", "SELECT m.session_id, m.event_count, m.tokens_total, m.operation_count, 9 AS source_projection_version FROM metrics m")
def materialize_stale(spark, sf):
    path = shared_folder(spark, "store")
    S.upsert(spark, path, half_stored(spark, sf))
    S.materialize_stale(spark, path, events(spark, sf), metric_sessions(spark, sf))
    names = ["event_count", "tokens_total", "operation_count"]
    return S.load(spark, path).select("session_id", *[F.col(f"{n}.value").alias(n) for n in names], "source_projection_version")


@query("session_detail", """
SELECT m.session_id, m.event_count, CASE WHEN p.task_class <> 'unknown' THEN p.task_class END AS task_class, coalesce(p.task_class_confidence, 'unknown') AS task_class_confidence,
  coalesce(s.first_user_message, f.user_message) AS start_user_request FROM metrics m JOIN fx_sessions s ON s.session_id = m.session_id JOIN fold f ON f.session_id = m.session_id
LEFT JOIN (SELECT session_id, task_class, task_class_confidence FROM (SELECT t.session_id, c.task_class, c.task_class_confidence,
  row_number() OVER (PARTITION BY t.session_id ORDER BY t.parent_thread_id IS NOT NULL, t.started_seq, t.task_key) AS rn FROM task_iv t JOIN task_classes c ON c.session_id = t.session_id AND c.started_seq = t.started_seq) AS r WHERE rn = 1) AS p
  ON p.session_id = m.session_id""")
def session_detail(spark, sf):
    from loomtrace.operators import tasks
    from loomtrace.plans.task_queries import signals

    requests = M.session_request_and_title(M.session_fold(events(spark, sf)), metric_sessions(spark, sf))
    primaries = M.primary_task(tasks.task_class(signals(spark, sf)))
    detail = M.session_detail(document(spark, sf).select("session_id", "event_count"), requests, primaries)
    return detail.select("session_id", F.col("event_count.value").alias("event_count"), "task_class", "task_class_confidence", "start_user_request")


# ---- streams -----------------------------------------------------------------------------------


def run_to_end(stream, out: str, mode: str) -> None:
    """Run a stream over what has landed, appending each batch to a table."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-cursor").trigger(availableNow=True)
    running = writer.foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)).start()
    running.awaitTermination()


def land(spark, rows, at: str) -> str:
    """Rows written in three appends, early to late, as a stream would see them land."""
    path = shared_folder(spark, "landing")
    low, high = rows.agg(F.min(at), F.max(at)).first()
    step = (high - low) // 3 + 1
    for i in range(3):
        part = rows.where((F.col(at) >= low + i * step) & (F.col(at) < low + (i + 1) * step))
        part.repartition(4).write.mode("append").parquet(path)
    return path


@query("stream_operations", f"SELECT {', '.join(OPS_COLUMNS)} FROM ops")
def stream_operations(spark, sf):
    rows = events(spark, sf)
    path, out = land(spark, rows, "seq"), shared_folder(spark, "snapshots")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(path)
    run_to_end(T.stream_operations(stream), out, "update")
    fields = [c for c in OPS_COLUMNS if c not in O.KEY]
    newest = spark.read.parquet(out).groupBy(*O.KEY).agg(F.max_by(F.struct(*fields), "revision").alias("s"))
    return newest.select(*O.KEY, "s.*")


@query("stream_dedup", """
SELECT session_id, count(DISTINCT value) AS kept FROM fx_lines GROUP BY session_id""")
def stream_dedup(spark, sf):
    lines = fixtures.view(spark, sf, "fx_lines").select("session_id", "seq", "value", "read_at")
    tree = J.parse(F.col("value"))
    rows = lines.select("session_id", "seq", "value", F.timestamp_seconds(F.lit(1_700_000_000) - 3600 * (F.col("seq") % 50)).alias("event_time"), F.lit("t").alias("ts"), F.try_variant_get(tree, "$.type", "string").alias("raw_type"))
    twice = rows.unionByName(rows)
    path, out = land(spark, twice, "seq"), shared_folder(spark, "unique")
    stream = spark.readStream.schema(twice.schema).option("maxFilesPerTrigger", 4).parquet(path)
    run_to_end(T.stream_dedup(stream).drop("key"), out, "append")
    return spark.read.parquet(out).groupBy("session_id").agg(F.count(F.lit(1)).alias("kept"))


def landed_lines(spark, sf):
    """The raw lines as a stream of chunks of one line each."""
    lines = fixtures.view(spark, sf, "fx_lines").select("session_id", F.col("seq").alias("chunk"), F.lit(0).cast("bigint").alias("place"), "value")
    return spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 4).parquet(land(spark, lines, "chunk"))


@query("tail_session", """
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS seq, value, parent_thread_id, false AS is_reset FROM named""")
def tail_session(spark, sf):
    out = shared_folder(spark, "tail")
    run_to_end(T.tail_session(landed_lines(spark, sf)), out, "append")
    return spark.read.parquet(out).select("session_id", "seq", "value", "parent_thread_id", "is_reset")


@query("stream_call_names", "SELECT session_id, call_id, seq AS chunk, call_name FROM named WHERE call_id <> ''")
def stream_call_names(spark, sf):
    out = shared_folder(spark, "names")
    run_to_end(T.stream_call_names(landed_lines(spark, sf)), out, "append")
    return spark.read.parquet(out).select("session_id", "call_id", "chunk", "call_name")


@query("stream_parent", "SELECT session_id, parent_thread_id, count(*) AS n, CAST(max(place) AS BIGINT) AS last_seq FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS place FROM named) AS p GROUP BY session_id, parent_thread_id")
def stream_parent(spark, sf):
    return tail_session(spark, sf).groupBy("session_id", "parent_thread_id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))


@query("tail_reset", """
SELECT session_id, count(*) AS told, CAST(0 AS BIGINT) AS told_again FROM fx_lines GROUP BY session_id""")
def tail_reset(spark, sf):
    lines = fixtures.view(spark, sf, "fx_lines").select("session_id", F.col("seq").alias("chunk"), F.lit(0).cast("bigint").alias("place"), F.concat("value", F.lit(" "), F.col("seq").cast("string")).alias("value"))
    path, out = shared_folder(spark, "landing"), shared_folder(spark, "tail")
    for _ in range(2):  # the same file lands a second time, as after a replacement
        lines.repartition(4).write.mode("append").parquet(path)
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 4).parquet(path)
    run_to_end(T.tail_session(stream), out, "append")
    return spark.read.parquet(out).groupBy("session_id").agg(F.count(F.lit(1)).alias("told"), F.count_if("is_reset").alias("told_again"))


@query("stream_session_metrics", "SELECT session_id, event_count, operation_count FROM metrics")
def stream_session_metrics(spark, sf):
    rows = events(spark, sf)
    path, store = land(spark, rows, "seq"), shared_folder(spark, "store")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(path)
    catalog = cut_lineage(metric_sessions(spark, sf))
    refresh = T.refresh_metrics(store, shared_folder(spark, "landed"), lambda s: catalog)
    stream.writeStream.option("checkpointLocation", f"{store}-cursor").trigger(availableNow=True).foreachBatch(refresh).start().awaitTermination()
    return S.load(spark, store).select("session_id", F.col("event_count.value").alias("event_count"), F.col("operation_count.value").alias("operation_count"))
