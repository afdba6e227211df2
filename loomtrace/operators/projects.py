"""Project rollups over the stored session metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions import covered as C
from loomtrace.operators.ordered import row_index
from loomtrace.operators.session_metrics import TOKENS

LEDGER = [f"tokens_{n}" for n in [*TOKENS, "tool_call", "task", "spawn_agent"]]
ROLLUP = [*LEDGER, "duration_ms", "start_context_size", "skills_count", "mcp_server_count", "spawn_agent_calls", "task_count"]
SCOPES = ["main", "subsession", "unknown"]


def session_time() -> Column:
    return F.coalesce("started_at", "ended_at", F.lit(""))


def project_sessions(
    metrics: DataFrame, keys: Sequence[str] | None = None, start: str | None = None, end: str | None = None, scope: str = "all"
) -> DataFrame:
    """Sessions of the given projects in an inclusive time range, in time order.

    All conditions are on stored columns and reach the scan. Several keys are one `isin`.
    """
    rows = metrics
    if keys is not None:
        rows = rows.where(F.col("project_key").isin(*keys))
    if start is not None:
        rows = rows.where(session_time() >= start)
    if end is not None:
        rows = rows.where(session_time() <= end)
    if scope != "all":
        rows = rows.where(F.col("session_scope") == scope)
    return rows.orderBy(session_time(), "session_id")


def scope_counts(metrics: DataFrame, scope: str = "all", by: str = "project_key") -> DataFrame:
    """Sessions per scope before the filter, and how many the filter keeps."""
    kept = F.count(F.lit(1)) if scope == "all" else F.count_if(F.col("session_scope") == scope)
    return metrics.groupBy(by).agg(
        *[F.count_if(F.col("session_scope") == s).alias(f"{s}_sessions") for s in SCOPES], kept.alias("kept_sessions")
    )


def spawn_agent_mode(metrics: DataFrame, include: bool) -> DataFrame:
    """Without spawned agents, their tokens and time leave the totals; coverage stays as it was."""
    if include:
        return metrics

    def less(total: str, part: str) -> Column:
        whole, spawned = F.col(f"{total}.value"), F.col(f"{part}.value")
        rest = F.greatest(whole - spawned, F.lit(0).cast("bigint"))
        value = F.when(whole.isNotNull() & spawned.isNotNull(), rest).otherwise(whole)
        return F.col(total).withField("value", value)

    return metrics.withColumns(
        {"tokens_total": less("tokens_total", "tokens_spawn_agent"), "duration_ms": less("duration_ms", "spawn_agent_ms")}
    )


def project_rollup(metrics: DataFrame, by: str = "project_key") -> DataFrame:
    """Coverage sums of tokens, time, factors, spawn calls and tasks per project."""
    return metrics.groupBy(by).agg(F.count(F.lit(1)).alias("sessions"), *[C.covered_sum(m).alias(m) for m in ROLLUP])


def project_task_facts(tasks: DataFrame) -> DataFrame:
    """Task facts of a project, numbered by start, session and key."""
    order = [F.col("started_at"), F.col("session_id"), F.col("task_key"), F.col("started_seq")]
    return row_index(tasks, ["project_key"], F.substring("started_at", 1, 13), order, "position")


def used_skills_rollup(sessions: DataFrame, skills: DataFrame, by: str = "project_key") -> DataFrame:
    """Per project and skill: uses, sessions, and the coverage of the project's skill data.

    `sessions` gives the project, the session id and its covered used_skills count; `skills` the
    distinct (session, skill) pairs.
    """
    coverage = sessions.groupBy(by).agg(
        F.when(F.bool_and(F.col("used_skills.coverage") == C.KNOWN), C.KNOWN).otherwise(C.PARTIAL).alias("coverage")
    )
    counts = (
        skills.join(sessions.select(by, "session_id"), "session_id")
        .groupBy(by, "skill")
        .agg(F.count(F.lit(1)).alias("usage_count"), F.count(F.lit(1)).alias("session_count"))
    )
    return counts.join(coverage, by)


def by_usage(skills: DataFrame) -> DataFrame:
    """View order: most used first, then by name. The stored order is by name."""
    return skills.orderBy(F.col("usage_count").desc(), "skill")


def project_summary(rollup: DataFrame, skills: DataFrame, metrics: DataFrame, by: str = "project_key", include_spawn: bool = True) -> DataFrame:
    """Headline numbers of a project under the view's subtraction rule."""
    spawned = metrics.groupBy(by).agg(C.covered_sum("spawn_agent_ms").alias("spawned_ms"), F.bool_or("degraded").alias("degraded"))
    distinct = skills.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.first("coverage").alias("c"))
    row = rollup.join(spawned, by).join(distinct, by, "left")
    total, duration = F.col("tokens_total"), F.col("duration_ms")
    if not include_spawn:
        total = C.covered_subtract_view(total, F.col("tokens_spawn_agent"))
        duration = C.covered_subtract_view(duration, F.col("spawned_ms"))
    return row.select(
        by, "sessions", "degraded",
        duration.alias("total_duration_ms"),
        C.covered_subtract_view(total, F.col("tokens_cached_input")).alias("tokens"),
        total.alias("all_tokens"),
        F.col("tokens_cached_input").alias("cached_tokens"),
        C.covered(F.col("n"), F.coalesce("c", F.lit(C.UNKNOWN)), C.DERIVED).alias("used_skills"),
    )


def failure_preference() -> Column:
    """Failed operations unless unknown, else the error count."""
    return F.when(F.col("failed_operations.coverage") != C.UNKNOWN, F.col("failed_operations")).otherwise(F.col("error_count"))


def contributing_sessions(metrics: DataFrame, include_spawn: bool = True) -> DataFrame:
    """Per session: outcome, scope, coverage, duration, tokens, calls and failures."""
    total, duration = F.col("tokens_total"), F.col("duration_ms")
    if not include_spawn:
        total = C.covered_subtract_view(total, F.col("tokens_spawn_agent"))
        duration = C.covered_subtract_view(duration, F.col("spawn_agent_ms"))
    failures = failure_preference()
    return metrics.select(
        "project_key", "session_id", "started_at", "outcome", "session_scope",
        failures["coverage"].alias("coverage"),
        duration.alias("duration"),
        C.covered_subtract_view(total, F.col("tokens_cached_input")).alias("tokens"),
        F.col("tool_calls"),
        failures.alias("failures"),
    )
