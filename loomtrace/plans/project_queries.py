"""Registered queries and comparison SQL for project rollups and series statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.functions import covered as C
from loomtrace.operators import operations as O
from loomtrace.operators import projects as P
from loomtrace.operators import series as S
from loomtrace.operators import session_metrics as M
from loomtrace.plans import fixtures
from loomtrace.plans.metrics_queries import COUNT_NAMES, OPS_COUNT_NAMES, events, metric_sessions
from loomtrace.plans.oracle import covered_sum, cte, known, partial
from loomtrace.plans.tables import shared
from loomtrace.plans.task_queries import facts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
GROUP = "project_group"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def build_metrics(spark, sf, rows=None):
    rows = events(spark, sf) if rows is None else rows
    catalog = metric_sessions(spark, sf)
    made = M.session_metrics(rows, O.project_operations(rows), catalog)
    group = F.coalesce(F.concat(F.lit("cwd:"), F.col("project_cwd")), F.col("project_key"))
    return made.join(catalog.select("session_id", "degraded", group.alias(GROUP)), "session_id")


@shared
def metrics(spark, sf):
    return build_metrics(spark, sf)


@shared
def points(spark, sf):
    return S.metric_series(metrics(spark, sf), GROUP)


@shared
def fences(spark, sf):
    return S.outlier_fences(points(spark, sf))


@shared
def charted(spark, sf):
    return S.chart_rows(points(spark, sf), "keep")


def skill_pairs(spark, sf):
    return M.used_skill_ids(events(spark, sf))


def rounded(name: str, digits: int = 6):
    """Rounded for comparison; large values keep three decimals, which doubles can hold."""
    value = F.col(name)
    return F.when(F.abs(value) >= 1000, F.round(value, 3)).otherwise(F.round(value, digits)).alias(name)


def six(df, *names):
    return df.withColumns({n: rounded(n) for n in names})


def rd(value: str, digits: int = 6) -> str:
    return f"(CASE WHEN abs({value}) >= 1000 THEN round({value}, 3) ELSE round({value}, {digits}) + 0 END)"


# ---- catalog identity, as the metrics carry it -------------------------------------------------

cte("identity_base", """
SELECT *, nullif(replace(trim(cwd), '/./sub/..', ''), '') AS ncwd FROM fx_sessions""")
cte("identity", """
SELECT session_id, ncwd AS project_cwd, ncwd IS NULL AS degraded, coalesce('cwd:' || ncwd, project_key) AS project_group, project_key FROM (
  SELECT *, CASE WHEN ncwd IS NULL THEN 'degraded:' || substr(sha256('degraded-session:' || session_id), 1, 8)
    ELSE 'project:' || substr(sha256(CASE WHEN git_origin_url IS NOT NULL THEN concat_ws('|', git_origin_url, git_branch, ncwd) ELSE concat_ws('|', ncwd, git_branch) END), 1, 8) END AS project_key
  FROM identity_base) AS i""")
cte("scopes", """
SELECT session_id, CASE WHEN source IS NULL OR source NOT LIKE '{%' THEN 'main' WHEN NOT json_valid(source) THEN 'unknown'
  WHEN NOT json_exists(source, '$.subagent') THEN 'main'
  WHEN trim(json_extract_string(source, '$.subagent.thread_spawn.parent_thread_id')) <> '' THEN 'subsession' ELSE 'unknown' END AS session_scope
FROM fx_sessions""")

LEDGER_SQL = ", ".join(f"l.{n} AS tokens_{n}, l.{n}_coverage AS tokens_{n}_coverage" for n in [*M.TOKENS, "spawn_agent", "task", "tool_call"])
cte("metrics", f"""
SELECT i.session_id, i.project_key, i.project_group, i.degraded, s.session_scope, d.started_at, d.ended_at, {known('d.duration_ms', 'duration_ms')},
  {known('b.total_ms', 'total_ms')}, {', '.join(partial('b.' + n, n) for n in ['tool_ms', 'shell_ms', 'mcp_ms', 'spawn_agent_ms', 'idle_ms'])}, o.outcome, o.outcome_coverage, o.error_type,
  {', '.join(known('f.' + n, n) for n in COUNT_NAMES)}, {LEDGER_SQL}, {', '.join(f'c.{n}, c.{n}_coverage' for n in OPS_COUNT_NAMES)},
  {known('e.skills_count', 'skills_count')}, {known('f.mcp_server_count', 'mcp_server_count')}, {known('x.start_context_size', 'start_context_size')},
  {known('u.n', 'used_skills')}, {partial('f.review_cycles', 'review_cycles')}, {partial('f.review_findings', 'review_findings')},
  {known('y.tokens_per_successful_session', 'tokens_per_successful_session')}, {partial('y.review_findings_per_1k_tokens', 'review_findings_per_1k_tokens')}
FROM identity i JOIN scopes s ON s.session_id = i.session_id JOIN durations d ON d.session_id = i.session_id JOIN breakdown b ON b.session_id = i.session_id
JOIN outcomes o ON o.session_id = i.session_id JOIN fold f ON f.session_id = i.session_id JOIN ledger l ON l.session_id = i.session_id
JOIN op_counts c ON c.session_id = i.session_id JOIN enabled_skills e ON e.session_id = i.session_id JOIN start_context x ON x.session_id = i.session_id
JOIN efficiency y ON y.session_id = i.session_id
LEFT JOIN (SELECT session_id, count(*) AS n FROM skill_ids GROUP BY session_id) AS u ON u.session_id = i.session_id""")

DOCUMENT = [
    "session_id", "project_key", "session_scope", "started_at", "ended_at", "outcome", "outcome_coverage", "error_type", "duration_ms", "tool_ms",
    "shell_ms", "mcp_ms", "spawn_agent_ms", "idle_ms", *COUNT_NAMES[:-1], *[f"tokens_{n}" for n in [*M.TOKENS, "spawn_agent", "task"]], *OPS_COUNT_NAMES,
    "skills_count", "mcp_server_count", "start_context_size", "used_skills", "review_cycles", "review_findings", "tokens_per_successful_session",
]
COVERED = [c for c in DOCUMENT if c not in ("session_id", "project_key", "session_scope", "started_at", "ended_at", "outcome", "outcome_coverage", "error_type")]


@query("session_detail_document", f"SELECT {', '.join([*DOCUMENT, *[c + '_coverage' for c in COVERED]])} FROM metrics")
def session_detail_document(spark, sf):
    return C.flatten_covered(metrics(spark, sf).select(*DOCUMENT))


# ---- project rollups ---------------------------------------------------------------------------

ROLLUP_BODY = ", ".join(covered_sum(m) for m in P.ROLLUP)


@query("project_sessions", """
SELECT project_key, session_id, started_at, session_scope FROM metrics
WHERE coalesce(started_at, ended_at, '') >= '2024-01-01T00:00:00' AND coalesce(started_at, ended_at, '') <= '2024-12-31T00:00:00'""")
def project_sessions(spark, sf):
    chosen = P.project_sessions(metrics(spark, sf), None, "2024-01-01T00:00:00", "2024-12-31T00:00:00")
    return chosen.select("project_key", "session_id", "started_at", "session_scope")


@query("scope_filter_counts", f"""
SELECT project_key, {', '.join(f"count(*) FILTER (WHERE session_scope = '{s}') AS {s}_sessions" for s in P.SCOPES)},
  count(*) FILTER (WHERE session_scope = 'main') AS kept_sessions FROM metrics GROUP BY project_key""")
def scope_filter_counts(spark, sf):
    return P.scope_counts(metrics(spark, sf), "main")


@query("spawn_agent_mode", """
SELECT session_id, CASE WHEN tokens_total IS NOT NULL AND tokens_spawn_agent IS NOT NULL THEN greatest(tokens_total - tokens_spawn_agent, 0) ELSE tokens_total END AS tokens_total,
  tokens_total_coverage, CASE WHEN duration_ms IS NOT NULL AND spawn_agent_ms IS NOT NULL THEN greatest(duration_ms - spawn_agent_ms, 0) ELSE duration_ms END AS duration_ms,
  duration_ms_coverage FROM metrics""")
def spawn_agent_mode(spark, sf):
    return C.flatten_covered(P.spawn_agent_mode(metrics(spark, sf), False).select("session_id", "tokens_total", "duration_ms"))


@query("project_rollup", f"SELECT project_key, count(*) AS sessions, {ROLLUP_BODY} FROM metrics GROUP BY project_key")
def project_rollup(spark, sf):
    # Straight from the events: the optimiser drops every metric the rollup does not read.
    return C.flatten_covered(P.project_rollup(build_metrics(spark, sf)))


@query("merge_project_keys", f"SELECT project_group, count(*) AS sessions, {ROLLUP_BODY} FROM metrics GROUP BY project_group")
def merge_project_keys(spark, sf):
    return C.flatten_covered(P.project_rollup(metrics(spark, sf), GROUP))


@query("project_task_facts", """
SELECT i.project_key, t.session_id, t.task_key, t.started_seq, t.started_at, o.outcome, c.task_class,
  row_number() OVER (PARTITION BY i.project_key ORDER BY t.started_at, t.session_id, t.task_key, t.started_seq) - 1 AS position
FROM task_iv t JOIN identity i ON i.session_id = t.session_id JOIN task_outcomes o ON o.session_id = t.session_id AND o.started_seq = t.started_seq
JOIN task_classes c ON c.session_id = t.session_id AND c.started_seq = t.started_seq""")
def project_task_facts(spark, sf):
    columns = ["project_key", "session_id", "task_key", "started_seq", "started_at", "outcome", "task_class", "position"]
    return P.project_task_facts(facts(spark, sf)).select(*columns)


cte("skill_rollup", """
SELECT m.project_key, k.skill, count(*) AS usage_count, count(*) AS session_count, any_value(c.coverage) AS coverage
FROM skill_ids k JOIN metrics m ON m.session_id = k.session_id
JOIN (SELECT project_key, CASE WHEN bool_and(used_skills_coverage = 'known') THEN 'known' ELSE 'partial' END AS coverage FROM metrics GROUP BY project_key) AS c
  ON c.project_key = m.project_key GROUP BY m.project_key, k.skill""")


@query("used_skills_rollup", "SELECT * FROM skill_rollup")
def used_skills_rollup(spark, sf):
    return P.by_usage(P.used_skills_rollup(metrics(spark, sf), skill_pairs(spark, sf)))


cte("summary_sums", f"""SELECT project_key, count(*) AS sessions, bool_or(degraded) AS degraded, {covered_sum('tokens_total', 'all_tokens')}, {covered_sum('tokens_cached_input', 'cached_tokens')},
    {covered_sum('duration_ms', 'total_duration_ms')} FROM metrics GROUP BY project_key""")


@query("project_summary", """
SELECT r.*, CASE WHEN all_tokens IS NOT NULL AND cached_tokens IS NOT NULL THEN greatest(all_tokens - cached_tokens, 0) ELSE all_tokens END AS tokens,
  CASE WHEN all_tokens IS NULL OR cached_tokens IS NULL THEN all_tokens_coverage WHEN all_tokens_coverage = 'known' AND cached_tokens_coverage = 'known' THEN 'known' ELSE 'partial' END AS tokens_coverage,
  k.n AS used_skills, coalesce(k.c, 'unknown') AS used_skills_coverage
FROM summary_sums r LEFT JOIN (SELECT project_key, count(*) AS n, any_value(coverage) AS c FROM skill_rollup GROUP BY project_key) AS k ON k.project_key = r.project_key""")
def project_summary(spark, sf):
    table = metrics(spark, sf)
    skills = P.used_skills_rollup(table, skill_pairs(spark, sf))
    return C.flatten_covered(P.project_summary(P.project_rollup(table), skills, table))


VIEW_TOKENS = """CASE WHEN tokens_total IS NOT NULL AND tokens_cached_input IS NOT NULL THEN greatest(tokens_total - tokens_cached_input, 0) ELSE tokens_total END"""
VIEW_TOKENS_COVERAGE = """CASE WHEN tokens_total IS NULL OR tokens_cached_input IS NULL THEN tokens_total_coverage
  WHEN tokens_total_coverage = 'known' AND tokens_cached_input_coverage = 'known' THEN 'known' ELSE 'partial' END"""
FAILURES = "CASE WHEN failed_operations_coverage <> 'unknown' THEN failed_operations ELSE error_count END"
FAILURES_COVERAGE = "CASE WHEN failed_operations_coverage <> 'unknown' THEN failed_operations_coverage ELSE error_count_coverage END"


@query("contributing_sessions", f"""
SELECT project_key, session_id, started_at, outcome, session_scope, {FAILURES_COVERAGE} AS coverage, duration_ms AS duration, duration_ms_coverage AS duration_coverage,
  {VIEW_TOKENS} AS tokens, {VIEW_TOKENS_COVERAGE} AS tokens_coverage, tool_calls, tool_calls_coverage, {FAILURES} AS failures, {FAILURES_COVERAGE} AS failures_coverage FROM metrics""")
def contributing_sessions(spark, sf):
    return C.flatten_covered(P.contributing_sessions(metrics(spark, sf)))


@query("failure_preference", f"SELECT session_id, {FAILURES} AS failures, {FAILURES_COVERAGE} AS failures_coverage FROM metrics")
def failure_preference(spark, sf):
    return C.flatten_covered(metrics(spark, sf).select("session_id", P.failure_preference().alias("failures")))


# ---- series statistics -------------------------------------------------------------------------

PLAIN = {
    "duration": "duration_ms", "allTokens": "tokens_total", "tokenInput": "tokens_input", "tokenOutput": "tokens_output", "tokenCachedInput": "tokens_cached_input",
    "tokenReasoningOutput": "tokens_reasoning_output", "tokenTask": "tokens_task", "tokenSpawnAgent": "tokens_spawn_agent", "toolCalls": "tool_calls",
    "startContext": "start_context_size", "skillsCount": "skills_count", "usedSkillsCount": "used_skills", "mcpServerCount": "mcp_server_count", "taskCount": "task_count",
    "spawnAgentCalls": "spawn_agent_calls", "tokensPerSuccess": "tokens_per_successful_session", "reviewFindingsPer1k": "review_findings_per_1k_tokens",
}
cte("numbered", """
SELECT *, row_number() OVER (PARTITION BY project_group ORDER BY coalesce(started_at, ended_at, ''), session_id) - 1 AS idx FROM metrics""")
cte("points", " UNION ALL ".join(
    [f"SELECT project_group AS project, idx, session_id, started_at, '{n}' AS series, CAST({c} AS DOUBLE) AS value, {c}_coverage AS coverage FROM numbered" for n, c in PLAIN.items()]
    + [f"SELECT project_group, idx, session_id, started_at, 'tokens', CAST({VIEW_TOKENS} AS DOUBLE), {VIEW_TOKENS_COVERAGE} FROM numbered",
       f"SELECT project_group, idx, session_id, started_at, 'failures', CAST({FAILURES} AS DOUBLE), {FAILURES_COVERAGE} FROM numbered"]))


@query("metric_series", 'SELECT project, idx, session_id, started_at, series, round(value, 6) AS value, coverage FROM points')
def metric_series(spark, sf):
    return six(S.metric_series(metrics(spark, sf), GROUP), "value")


@query("series_coverage", """
SELECT project, series, count(*) FILTER (WHERE coverage <> 'unknown' AND value IS NOT NULL) AS available_points,
  count(*) FILTER (WHERE coverage = 'partial') AS partial_points, count(*) FILTER (WHERE coverage = 'unknown') AS unknown_points FROM points GROUP BY project, series""")
def series_coverage(spark, sf):
    return S.series_coverage(points(spark, sf))


@query("quantile", f"""
SELECT project, series, {rd('quantile_cont(value, 0.1)')} AS p10, {rd('quantile_cont(value, 0.5)')} AS p50, {rd('quantile_cont(value, 0.9)')} AS p90
FROM points WHERE value IS NOT NULL GROUP BY project, series""")
def quantile(spark, sf):
    from loomtrace.operators.ordered import exact_percentiles

    return six(exact_percentiles(points(spark, sf), S.KEYS, "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9}), "p10", "p50", "p90")


cte("fences", """
SELECT project, series, n AS available, CASE WHEN n >= 4 AND q3 <> q1 THEN q1 - (q3 - q1) * 1.5 END AS lower_fence,
  CASE WHEN n >= 4 AND q3 <> q1 THEN q3 + (q3 - q1) * 1.5 END AS upper_fence
FROM (SELECT project, series, count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM points GROUP BY project, series) AS q""")
cte("flagged", """
SELECT p.*, f.lower_fence, f.upper_fence, coalesce(p.value < f.lower_fence OR p.value > f.upper_fence, false) AS is_outlier
FROM points p JOIN fences f ON f.project = p.project AND f.series = p.series""")


@query("outlier_fences", f"SELECT project, series, available, {rd('lower_fence')} AS lower_fence, {rd('upper_fence')} AS upper_fence FROM fences")
def outlier_fences(spark, sf):
    return six(S.outlier_fences(points(spark, sf)), "lower_fence", "upper_fence")


def flagged(spark, sf):
    return S.outlier_flags(points(spark, sf), fences(spark, sf))


@query("outlier_flags", 'SELECT project, series, idx, is_outlier FROM flagged')
def outlier_flags(spark, sf):
    return flagged(spark, sf).select("project", "series", "idx", "is_outlier")


@query("outlier_mode", f"""
SELECT project, series, idx, {rd('CASE WHEN is_outlier THEN least(upper_fence, greatest(lower_fence, value)) ELSE value END')} AS clamped,
  {rd('CASE WHEN NOT is_outlier THEN value END')} AS excluded, {rd('value')} AS kept FROM flagged""")
def outlier_mode(spark, sf):
    rows = flagged(spark, sf)
    for mode, name in (("clamp", "clamped"), ("exclude", "excluded"), ("keep", "kept")):
        rows = S.outlier_mode(rows, mode).withColumn(name, rounded("processed"))
    return rows.select("project", "series", "idx", "clamped", "excluded", "kept")


cte("sizes", """
SELECT project, series, n AS processed_count, CAST(greatest(1, s - CASE WHEN s % 2 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS window_size FROM (
  SELECT project, series, count(value) AS n, CASE WHEN count(value) <= 1 THEN 1 WHEN count(value) <= 4 THEN count(value)
    ELSE CAST(greatest(3, least(9, floor(count(value) / 4.0 + 0.5))) AS BIGINT) END AS s FROM points GROUP BY project, series) AS c""")


@query("smoothing_window", "SELECT * FROM sizes")
def smoothing_window(spark, sf):
    return S.smoothing_window(points(spark, sf).withColumn("processed", F.col("value")))


cte("moved", """
SELECT p.project, p.series, p.idx, CASE WHEN any_value(p.value) IS NOT NULL THEN avg(q.value) END AS moving_average,
  CASE WHEN any_value(p.value) IS NOT NULL THEN quantile_cont(q.value, 0.5) END AS moving_median
FROM points p JOIN sizes s ON s.project = p.project AND s.series = p.series
JOIN points q ON q.project = p.project AND q.series = p.series AND q.idx BETWEEN p.idx - s.window_size // 2 AND p.idx + s.window_size // 2
GROUP BY p.project, p.series, p.idx""")


def moved(spark, sf):
    processed = points(spark, sf).withColumn("processed", F.col("value"))
    return S.moving_values(processed, S.smoothing_window(processed))


@query("moving_average", f"SELECT project, series, idx, {rd('moving_average', 4)} AS moving_average FROM moved")
def moving_average(spark, sf):
    return moved(spark, sf).select("project", "series", "idx", rounded("moving_average", 4))


@query("moving_median", f"SELECT project, series, idx, {rd('moving_median', 4)} AS moving_median FROM moved")
def moving_median(spark, sf):
    return moved(spark, sf).select("project", "series", "idx", rounded("moving_median", 4))


cte("slopes", """
SELECT a.project, a.series, quantile_cont((b.value - a.value) / (b.idx - a.idx), 0.5) AS slope
FROM points a JOIN points b ON b.project = a.project AND b.series = a.series AND b.idx > a.idx AND b.value IS NOT NULL WHERE a.value IS NOT NULL GROUP BY a.project, a.series""")
cte("trends", """
SELECT p.project, p.series, p.idx, CASE WHEN p.value IS NOT NULL THEN c.intercept + coalesce(s.slope, 0) * p.idx END AS trend
FROM points p LEFT JOIN slopes s ON s.project = p.project AND s.series = p.series
LEFT JOIN (SELECT q.project, q.series, quantile_cont(q.value - coalesce(t.slope, 0) * q.idx, 0.5) AS intercept FROM points q
  LEFT JOIN slopes t ON t.project = q.project AND t.series = q.series WHERE q.value IS NOT NULL GROUP BY q.project, q.series) AS c
  ON c.project = p.project AND c.series = p.series""")


@query("theil_sen_trend", f"SELECT project, series, idx, {rd('trend', 4)} AS trend FROM trends")
def theil_sen_trend(spark, sf):
    processed = points(spark, sf).withColumn("processed", F.col("value"))
    return S.theil_sen_trend(processed).select("project", "series", "idx", rounded("trend", 4))


cte("bases", 'SELECT project, series, coalesce(arg_min(value, idx) FILTER (WHERE value IS NOT NULL), 0) AS base FROM points GROUP BY project, series')
BASED = "asinh(CASE WHEN abs(b.base) < 1e-6 THEN {x} ELSE ({x} - b.base) / abs(b.base) END)"
cte("raws", f"""
SELECT p.project, p.series, p.idx, p.session_id, p.started_at, {BASED.format(x='p.value')} AS r_value, {BASED.format(x='t.trend')} AS r_trend,
  {BASED.format(x='m.moving_average')} AS r_average, {BASED.format(x='m.moving_median')} AS r_median
FROM points p JOIN trends t ON t.project = p.project AND t.series = p.series AND t.idx = p.idx
JOIN moved m ON m.project = p.project AND m.series = p.series AND m.idx = p.idx JOIN bases b ON b.project = p.project AND b.series = p.series""")
cte("scales", """
SELECT project, least(min(r_value), min(r_trend), min(r_average), min(r_median)) AS lo, greatest(max(r_value), max(r_trend), max(r_average), max(r_median)) AS hi FROM raws GROUP BY project """)
NORM = "CASE WHEN {x} IS NULL THEN NULL WHEN abs(s.hi - s.lo) < 1e-6 THEN 0.5 ELSE ({x} - s.lo) / (s.hi - s.lo) END"
cte("normed", f"""
SELECT r.project, r.series, r.idx, r.session_id, r.started_at, {NORM.format(x='r_value')} AS norm_processed, {NORM.format(x='r_trend')} AS norm_trend, {NORM.format(x='r_average')} AS norm_moving_average,
  {NORM.format(x='r_median')} AS norm_moving_median, s.lo, s.hi FROM raws r JOIN scales s ON s.project = r.project """)
NORMS = ["norm_processed", "norm_trend", "norm_moving_average", "norm_moving_median"]


@query("series_normalize", f'SELECT project, series, idx, {", ".join(f"round({n}, 5) AS {n}" for n in NORMS)} FROM normed')
def series_normalize(spark, sf):
    return charted(spark, sf).select("project", "series", "idx", *[F.round(n, 5).alias(n) for n in NORMS])


@query("chart_analysis", f"""
SELECT f.project, f.series, f.available AS available_count, z.processed_count, g.n AS outlier_count, {rd('f.lower_fence', 4)} AS lower_fence, {rd('f.upper_fence', 4)} AS upper_fence,
  z.window_size, round(s.lo, 5) AS scale_min, round(s.hi, 5) AS scale_max, {rd('m.med', 4)} AS project_median, round({NORM.format(x=BASED.format(x='m.med'))}, 5) AS normalized_median
FROM fences f JOIN sizes z ON z.project = f.project AND z.series = f.series JOIN scales s ON s.project = f.project
JOIN bases b ON b.project = f.project AND b.series = f.series
JOIN (SELECT project, series, count(*) FILTER (WHERE is_outlier) AS n FROM flagged GROUP BY project, series) AS g ON g.project = f.project AND g.series = f.series
JOIN (SELECT project, series, quantile_cont(value, 0.5) AS med FROM points GROUP BY project, series) AS m ON m.project = f.project AND m.series = f.series""")
def chart_analysis(spark, sf):
    rows = S.chart_analysis(charted(spark, sf))
    four, five = ("lower_fence", "upper_fence", "project_median"), ("scale_min", "scale_max", "normalized_median")
    return rows.withColumns({n: rounded(n, 4) for n in four} | {n: F.round(n, 5) for n in five})


cte("totals", 'SELECT project_group AS project, count(*) AS rows FROM metrics GROUP BY project_group')


def totals(spark, sf):
    return metrics(spark, sf).groupBy(F.col(GROUP).alias("project")).agg(F.count(F.lit(1)).alias("rows"))


@query("row_window", """
SELECT p.project, p.idx, p.session_id, p.series, round(p.value, 6) AS value FROM points p JOIN totals t ON t.project = p.project
WHERE p.idx BETWEEN least(2, t.rows - 1) AND greatest(least(2, t.rows - 1), least(9, t.rows - 1))""")
def row_window(spark, sf):
    chosen = S.row_window(points(spark, sf), totals(spark, sf), 2, 9)
    return chosen.select("project", "idx", "session_id", "series", F.round("value", 6).alias("value"))


cte("dominant", """
SELECT project, idx, session_id, CASE WHEN bool_or(coverage = 'partial') THEN 'partial' WHEN bool_and(coverage = 'unknown') THEN 'unknown' ELSE 'known' END AS coverage
FROM points GROUP BY project, idx, session_id""")


@query("dominant_coverage", "SELECT * FROM dominant")
def dominant_coverage(spark, sf):
    return S.dominant_coverage(points(spark, sf))


cte("an_metric", """
SELECT project, 'Metric' AS class, concat('metric:', session_id) AS item_id, session_id, started_at, CAST(least(3, count(*) + 1) AS INTEGER) AS severity,
  string_agg(series, ', ' ORDER BY series) AS detail FROM flagged WHERE is_outlier GROUP BY project, session_id, started_at""")
cte("an_session", f"""
SELECT project_group AS project, 'Session' AS class, concat('session:', session_id) AS item_id, session_id, started_at, CASE WHEN f > 0 THEN 3 ELSE 2 END AS severity,
  concat(outcome, ' · failures ', CAST(f AS VARCHAR)) AS detail FROM (SELECT *, coalesce({FAILURES}, 0) AS f FROM metrics) AS m WHERE f > 0 OR outcome <> 'completed'""")
cte("an_data", """
SELECT project, 'Data issue' AS class, concat('data:', session_id) AS item_id, session_id, started_at, CASE WHEN a + b + c + d >= 2 THEN 3 ELSE 2 END AS severity,
  concat_ws(' · ', CASE WHEN a = 1 THEN 'partial metric coverage' END, CASE WHEN b = 1 THEN 'unknown chart values' END, CASE WHEN c = 1 THEN 'degraded project identity' END,
  CASE WHEN d = 1 THEN 'unknown scope' END) AS detail
FROM (SELECT m.project_group AS project, m.session_id, m.started_at, CAST(x.coverage = 'partial' AS INT) AS a, CAST(x.coverage = 'unknown' AS INT) AS b, CAST(m.degraded AS INT) AS c,
  CAST(m.session_scope = 'unknown' AS INT) AS d FROM metrics m JOIN dominant x ON x.session_id = m.session_id) AS r WHERE a + b + c + d > 0""")
cte("an_jumps", """
SELECT j.project, 'Baseline' AS class, concat('baseline:', j.session_id, ':', CAST(j.idx AS VARCHAR)) AS item_id, j.session_id, j.started_at, CASE WHEN j.jump >= 0.7 THEN 3 ELSE 2 END AS severity,
  j.jump, greatest(0, j.idx - 2) AS start_index, least(t.rows - 1, j.idx + 1) AS end_index
FROM (SELECT *, abs(norm_moving_median - lag(norm_moving_median) OVER (PARTITION BY project ORDER BY idx)) AS jump FROM normed WHERE series = 'startContext') AS j
JOIN totals t ON t.project = j.project WHERE j.jump >= 0.45""")


@query("anomalies_metric", "SELECT * FROM an_metric")
def anomalies_metric(spark, sf):
    return S.anomalies_metric(flagged(spark, sf))


@query("anomalies_session", "SELECT * FROM an_session")
def anomalies_session(spark, sf):
    return S.anomalies_session(metrics(spark, sf), GROUP)


@query("anomalies_data", "SELECT * FROM an_data")
def anomalies_data(spark, sf):
    return S.anomalies_data(metrics(spark, sf), S.dominant_coverage(points(spark, sf)), GROUP)


def jumps(spark, sf):
    return S.anomalies_baseline(charted(spark, sf), totals(spark, sf), "startContext", "norm_moving_median")


@query("anomalies_baseline", 'SELECT project, class, item_id, session_id, started_at, severity, start_index, end_index FROM an_jumps')
def anomalies_baseline(spark, sf):
    return jumps(spark, sf).drop("detail")


@shared
def anomalies(spark, sf):
    parts = [anomalies_metric(spark, sf), anomalies_session(spark, sf), anomalies_data(spark, sf), jumps(spark, sf).drop("start_index", "end_index")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


cte("an_all", " UNION ALL ".join(f'SELECT project, class, item_id, session_id, started_at, severity FROM {t}' for t in ("an_metric", "an_session", "an_data", "an_jumps")))


@query("anomaly_groups", """
SELECT a.*, t.class_severity, t.class_items FROM an_all a
JOIN (SELECT project, class, max(severity) AS class_severity, count(*) AS class_items FROM an_all GROUP BY project, class) AS t ON t.project = a.project AND t.class = a.class""")
def anomaly_groups(spark, sf):
    return S.anomaly_groups(anomalies(spark, sf)).drop("detail")


@query("session_flags", """
SELECT d.project, d.idx, d.session_id, EXISTS (SELECT 1 FROM an_metric a WHERE a.session_id = d.session_id) AS anomaly,
  EXISTS (SELECT 1 FROM an_jumps j WHERE j.project = d.project AND d.idx BETWEEN j.start_index AND j.end_index) AS baseline,
  d.coverage = 'partial' AS partial, d.coverage = 'unknown' OR m.session_scope = 'unknown' AS unknown, m.degraded
FROM dominant d JOIN metrics m ON m.session_id = d.session_id""")
def session_flags(spark, sf):
    return S.session_flags(S.dominant_coverage(points(spark, sf)), metrics(spark, sf), flagged(spark, sf), jumps(spark, sf), GROUP)


@query("window_pulse", """
SELECT n.*, k.known_sessions, d.completed_sessions, u.used_skills, coalesce(a.anomalies, 0) AS anomalies, CAST(round(d.completed_sessions * 100.0 / n.sessions) AS BIGINT) AS completion_percent
FROM (SELECT project, count(*) FILTER (WHERE series = 'tokens') AS sessions, coalesce(sum(value) FILTER (WHERE series = 'tokens'), 0) AS tokens,
    round(avg(value) FILTER (WHERE series = 'duration')) AS average_duration_ms,
    arg_max(value, idx) FILTER (WHERE series = 'tokens' AND value IS NOT NULL) - arg_min(value, idx) FILTER (WHERE series = 'tokens' AND value IS NOT NULL) AS token_drift
  FROM points GROUP BY project) AS n
JOIN (SELECT project, count(*) FILTER (WHERE coverage = 'known') AS known_sessions FROM dominant GROUP BY project) AS k ON k.project = n.project
JOIN (SELECT project_group, count(*) FILTER (WHERE outcome = 'completed') AS completed_sessions FROM metrics GROUP BY project_group) AS d ON d.project_group = n.project
LEFT JOIN (SELECT m.project_group, count(DISTINCT s.skill) AS used_skills FROM skill_ids s JOIN metrics m ON m.session_id = s.session_id GROUP BY m.project_group) AS u ON u.project_group = n.project
LEFT JOIN (SELECT project, count(*) AS anomalies FROM an_all GROUP BY project) AS a ON a.project = n.project """)
def window_pulse(spark, sf):
    table = metrics(spark, sf)
    skills = P.used_skills_rollup(table, skill_pairs(spark, sf), GROUP)
    return S.window_pulse(points(spark, sf), table, skills, anomalies(spark, sf), GROUP)
