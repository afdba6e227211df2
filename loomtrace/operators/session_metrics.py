"""Session metrics: one row per session, every number with its coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions import covered as C
from loomtrace.functions import exprs as X
from loomtrace.operators.columns import (
    METRICS_PROJECTION_VERSION,
    METRICS_SCHEMA_VERSION,
    ensure_columns,
    event_thread,
    has_tokens,
)
from loomtrace.operators.operations import is_failed

# Event types that count as messages, and the phrases that mark skills in a text.
MESSAGE_TYPES = ["message.user", "message.agent", "message.commentary", "agent.reasoning"]
AVAILABLE_SKILLS = "### Available skills"

# Ledger metric -> token column it sums.
TOKENS = {
    "total": "total_tokens", "input": "input_tokens", "output": "output_tokens",
    "cached_input": "cached_input_tokens", "reasoning_output": "reasoning_output_tokens",
}
SNAPSHOT = list(TOKENS.values())

# Metrics the document names but no log can support; they stay typed unknowns.
UNSUPPORTED_COUNTS = [
    "feedback_score", "evaluator_result_count", "guardrail_trigger_count", "handoff_count", "context_growth",
    "token_usage_delta", "duration_delta_ms",
]
UNSUPPORTED_RATES = ["error_rate_delta", "outcome_rate_delta"]


def _is(*types: str) -> Column:
    return F.col("event_type").isin(*types)


def _first(value: Column) -> Column:
    """Aggregate: the first non-null value by seq."""
    return F.min_by(value, F.when(value.isNotNull(), F.col("seq")))


def session_fold(events: DataFrame) -> DataFrame:
    """One pass over the events: every plain per-session aggregate the metrics need.

    Operators select what they use; the optimiser drops the aggregates nobody reads.
    """
    events = ensure_columns(events)
    text = F.struct(F.col("error_text").alias("text"))
    positive = F.coalesce(*[F.when(F.col(c) > 0, F.col(c)) for c in ("input_tokens", "total_tokens")])
    role = F.coalesce("agent_role", "receiver_role")
    return events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(_is(*MESSAGE_TYPES)).alias("n_messages"),
        F.count_if(_is("message.assistant")).alias("n_assistant"),
        F.count_if(_is("error")).alias("n_errors"),
        F.count_if(_is("agent.aborted")).alias("n_aborts"),
        F.count_if(_is("agent.failed")).alias("n_failures"),
        F.count_if(_is("context.compacted")).alias("n_compactions"),
        F.count_if(_is("task.started")).alias("n_tasks"),
        F.count_if(_is("mcp.call")).alias("n_mcp_calls"),
        F.max_by(text, F.when(_is("agent.aborted"), F.col("seq"))).alias("abort"),
        F.max_by(text, F.when(_is("agent.failed"), F.col("seq"))).alias("failure"),
        F.bool_or(_is("agent.completed", "task.completed")).alias("completed"),
        F.min_by("ts", "seq").alias("first_ts"),
        F.max_by("ts", "seq").alias("last_ts"),
        _first(F.when(_is("runtime.context"), F.col("runtime_mcp_servers"))).alias("runtime_mcp_servers"),
        _first(F.when(_is("runtime.context"), F.col("runtime_skills"))).alias("runtime_skills"),
        _first(F.when(_is("runtime.context"), F.col("runtime_start_context_size"))).alias("context_runtime"),
        _first(F.when(_is("info.tokens"), positive)).alias("context_tokens"),
        _first(F.col("context_size")).alias("context_legacy"),
        F.min_by(F.struct("text"), F.when(F.col("event_type").startswith("message."), F.col("seq"))).alias("first_message"),
        F.count_if(F.lower(role) == "reviewer").alias("n_reviews"),
        F.count_if(X.contains_any(F.col("artifact_path"), "review", "finding")).alias("n_findings"),
        _first(F.when(_is("message.user"), X.trim_null(F.col("text")))).alias("user_message"),
        _first(F.when(_is("task.started"), X.trim_null(F.col("title")))).alias("task_title"),
    )


def _counts() -> list[Column]:
    return [
        C.known(F.col("n_events")).alias("event_count"),
        C.known(F.col("n_messages")).alias("message_count"),
        C.known(F.col("n_assistant")).alias("assistant_message_count"),
        C.known(F.col("n_errors")).alias("error_count"),
        C.known(F.col("n_aborts")).alias("abort_count"),
        C.known(F.col("n_failures")).alias("failure_count"),
        C.known(F.col("n_compactions")).alias("compaction_count"),
        C.known(F.nullif("n_tasks", F.lit(0))).alias("task_count"),
        C.known(F.col("n_mcp_calls")).alias("mcp_call_count"),
    ]


def outcome_columns(last_abort: Column, last_failure: Column, completed: Column) -> list[Column]:
    """Outcome, coverage and error text from the last abort and failure (struct<text>) and a flag."""
    reason, failure = X.trim_null(last_abort["text"]), X.trim_null(last_failure["text"])
    outcome = (
        F.when(last_abort.isNotNull(), F.when(reason == "interrupted", "interrupted").otherwise("aborted"))
        .when(last_failure.isNotNull(), "failed")
        .when(completed, "completed")
        .otherwise("unknown")
    )
    return [
        outcome.alias("outcome"),
        F.when(outcome == "unknown", C.UNKNOWN).otherwise(C.KNOWN).alias("outcome_coverage"),
        F.when(last_abort.isNotNull(), reason).when(last_failure.isNotNull(), failure).alias("error_type"),
    ]


def _outcome() -> list[Column]:
    return outcome_columns(F.col("abort"), F.col("failure"), F.col("completed"))


def _duration() -> list[Column]:
    started, ended = X.trim_null(F.col("first_ts")), X.trim_null(F.col("last_ts"))
    gap = X.millis_between(X.parse_rfc3339(started), X.parse_rfc3339(ended))
    return [started.alias("started_at"), ended.alias("ended_at"), C.known(gap).alias("duration_ms")]


def _start_context() -> Column:
    return C.known(F.coalesce("context_runtime", "context_tokens", "context_legacy")).alias("start_context_size")


def _skills_count() -> Column:
    listed = F.size(available_skills(F.col("first_message.text")))
    listed = F.when(F.col("first_message.text").isNotNull() & (listed > 0), listed.cast("bigint"))
    return C.known(F.coalesce(listed, F.col("runtime_skills"))).alias("skills_count")


def _review_cycles() -> Column:
    return C.partial(F.nullif("n_reviews", F.lit(0))).alias("review_cycles")


def _review_findings() -> Column:
    return C.partial(F.nullif("n_findings", F.lit(0))).alias("review_findings")


def _per_session(events: DataFrame, *columns: Column) -> DataFrame:
    return session_fold(events).select("session_id", *columns)


def session_counts(events: DataFrame) -> DataFrame:
    """Event, message, error, abort, failure, compaction and task counts."""
    return _per_session(events, *_counts())


def session_outcome(events: DataFrame) -> DataFrame:
    """Aborted over failed over completed; the error text of the last such event."""
    return _per_session(events, *_outcome())


def session_duration(events: DataFrame) -> DataFrame:
    """Time from the first to the last event by seq."""
    return _per_session(events, *_duration())


def runtime_context_values(events: DataFrame) -> DataFrame:
    """First runtime array lengths and the first runtime context size."""
    return _per_session(
        events,
        C.known(F.col("runtime_mcp_servers")).alias("mcp_server_count"),
        C.known(F.col("runtime_skills")).alias("runtime_skills_count"),
        C.known(F.col("context_runtime")).alias("runtime_start_context_size"),
    )


def start_context_size(events: DataFrame) -> DataFrame:
    """Runtime value, else the first positive token count, else the legacy field."""
    return _per_session(events, _start_context())


def enabled_skills_count(events: DataFrame) -> DataFrame:
    """Skills listed in the first message of the session, else the length of the runtime list."""
    return _per_session(events, _skills_count())


def review_findings(events: DataFrame) -> DataFrame:
    """Events whose artifact path speaks of a review or a finding."""
    return _per_session(events, _review_findings())


def operation_fold(operations: DataFrame) -> DataFrame:
    """Per session: operation counters and attributed time, in one aggregation."""
    kind, spent = F.col("kind"), F.col("duration_ms")
    timed = spent.isNotNull()
    return operations.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("operation_count"),
        F.count_if(F.col("last_status") == "completed").alias("successful_operations"),
        F.count_if(is_failed(F.col("last_status"))).alias("failed_operations"),
        F.count_if(kind != "file.change").alias("tool_calls"),
        F.count_if(kind == "shell").alias("shell_calls"),
        F.count_if(kind == "mcp").alias("mcp_calls"),
        F.count_if(kind.startswith("collab.")).alias("collaboration_calls"),
        F.count_if(kind == "collab.spawn_agent").alias("spawn_agent_calls"),
        F.sum(F.when(timed & ~kind.isin("shell", "mcp", "collab.spawn_agent"), spent).when(timed, 0)).alias("tool_spent"),
        F.sum(F.when(timed & (kind == "shell"), spent).when(timed, 0)).alias("shell_spent"),
        F.sum(F.when(timed & (kind == "mcp"), spent).when(timed, 0)).alias("mcp_spent"),
        F.sum(F.when(timed & (kind == "collab.spawn_agent"), spent).when(timed, 0)).alias("spawn_agent_spent"),
    )


OPERATION_COUNTS = [
    "operation_count", "successful_operations", "failed_operations", "tool_calls", "shell_calls", "mcp_calls",
    "collaboration_calls", "spawn_agent_calls",
]
SPENT = ["tool", "shell", "mcp", "spawn_agent"]


def _operation_counts() -> list[Column]:
    return [C.known(F.col(n), C.FROM_OPERATIONS).alias(n) for n in OPERATION_COUNTS]


def _time_spent(total: Column) -> list[Column]:
    attributed = sum((F.coalesce(f"{n}_spent", F.lit(0)) for n in SPENT), F.lit(0))
    idle = F.greatest(total["value"] - attributed, F.lit(0)).cast("bigint")
    return [
        total.alias("total_ms"),
        C.unknown().alias("generation_ms"),
        *[C.partial(F.col(f"{n}_spent"), C.FROM_OPERATIONS).alias(f"{n}_ms") for n in SPENT],
        C.partial(F.when(total["value"].isNotNull(), idle), C.DERIVED).alias("idle_ms"),
    ]


def operation_metrics(sessions: DataFrame, operations: DataFrame) -> DataFrame:
    """Eight operation counters; a session without operations is unknown, not zero."""
    joined = sessions.select("session_id").join(operation_fold(operations), "session_id", "left")
    return joined.select("session_id", *_operation_counts())


def duration_breakdown(durations: DataFrame, operations: DataFrame) -> DataFrame:
    """Attributed time per kind and the idle rest; `durations` is session_duration's result."""
    joined = durations.select("session_id", "duration_ms").join(operation_fold(operations), "session_id", "left")
    return joined.select("session_id", *_time_spent(F.col("duration_ms")))


def thread_fold(events: DataFrame) -> DataFrame:
    """One pass per (session, thread), null thread included: tokens, parents and turn-free counts."""
    rows = ensure_columns(events).withColumn("thread", event_thread())
    tokens = F.struct(*SNAPSHOT, "seq")
    parent = X.trim_null(F.col("parent_thread_id"))
    return rows.groupBy("session_id", "thread").agg(
        F.max_by(tokens, F.when(_is("info.tokens") & has_tokens(), F.col("seq"))).alias("latest"),
        F.max_by(tokens, F.when(_is("info.tokens"), F.col("seq"))).alias("newest"),
        F.min_by(parent, F.when(parent.isNotNull(), F.col("seq"))).alias("parent"),
        (F.min(parent) != F.max(parent)).alias("ambiguous"),
        F.bool_or(F.col("thread_id").isNotNull()).alias("own_id"),
    )


def token_latest_by_thread(threads: DataFrame) -> DataFrame:
    """Last cumulative token snapshot of every thread."""
    return threads.where(F.col("thread").isNotNull() & F.col("latest").isNotNull()).select("session_id", "thread", "latest.*")


def token_unscoped(threads: DataFrame) -> DataFrame:
    """Last token event without a thread; a last one without counters counts as none."""
    loose = threads.where(F.col("thread").isNull()).select("session_id", *[F.col(f"newest.{c}").alias(c) for c in SNAPSHOT])
    return loose.where(has_tokens())


def thread_parent_state(threads: DataFrame) -> DataFrame:
    """First parent seen per thread, and whether a later event names another."""
    return threads.where(F.col("thread").isNotNull() & F.col("parent").isNotNull()).select(
        "session_id", "thread", "parent", "ambiguous"
    )


def _ledger_sums(threads: DataFrame) -> DataFrame:
    """Per session: what the ledger needs from its threads, in one aggregation."""
    scoped = F.col("thread").isNotNull() & F.col("latest").isNotNull()
    loose = F.col("thread").isNull()
    is_child = scoped & F.col("parent").isNotNull()
    own = {c: F.when(scoped, F.col(f"latest.{c}")) for c in SNAPSHOT}
    return threads.groupBy("session_id").agg(
        F.nullif(F.count_if(scoped), F.lit(0)).alias("threads"),
        F.count_if(scoped & F.col("parent").isNull()).alias("parentless"),
        F.count_if(is_child).alias("children"),
        *[F.sum(v).alias(f"sum_{c}") for c, v in own.items()],
        *[F.count(v).alias(f"n_{c}") for c, v in own.items()],
        F.sum(F.when(is_child, own["total_tokens"])).alias("child_sum"),
        F.count(F.when(is_child, own["total_tokens"])).alias("child_n"),
        F.coalesce(F.bool_or(F.col("ambiguous") & ~loose), F.lit(False)).alias("ambiguous"),
        *[F.max(F.when(loose, F.col(f"newest.{c}"))).alias(f"u_{c}") for c in SNAPSHOT],
        F.count_if(F.col("thread").isNotNull()).alias("n_threads"),
        F.nullif(F.count_if("own_id"), F.lit(0)).alias("n_own_threads"),
    )


def _ledger(tokens_used: Column) -> list[Column]:
    scoped = F.col("threads").isNotNull()
    loose = F.coalesce(*[F.col(f"u_{c}") for c in SNAPSHOT]).isNotNull()

    def part(name: str) -> Column:
        column = TOKENS[name]
        full = (F.col(f"n_{column}") == F.col("threads")) & ~loose
        from_threads = C.covered(F.col(f"sum_{column}"), F.when(full, C.KNOWN).otherwise(C.PARTIAL), C.FROM_EVENTS)
        from_catalog = C.partial(tokens_used, C.FROM_CATALOG) if name == "total" else C.unknown()
        from_loose = C.partial(F.col(f"u_{column}"), C.FROM_EVENTS)
        return F.when(scoped, from_threads).when(loose, from_loose).otherwise(from_catalog)

    forced = loose | F.coalesce("ambiguous", F.lit(False)) | (F.col("parentless") > 1)
    child_value = F.when(F.col("children") == 0, F.lit(0).cast("bigint")).otherwise(F.col("child_sum"))
    child_full = ~forced & (F.col("child_n") == F.col("children"))
    spawn = F.when(
        scoped, C.covered(child_value, F.when(child_full, C.KNOWN).otherwise(C.PARTIAL), C.DERIVED)
    ).otherwise(C.unknown())
    return [*[part(n).alias(n) for n in TOKENS], spawn.alias("spawn_agent")]


def _with_task(ledger: DataFrame) -> DataFrame:
    return ledger.withColumns({"task": C.covered_subtract(F.col("total"), F.col("spawn_agent")), "tool_call": C.unknown()})


def token_ledger(threads: DataFrame, sessions: DataFrame) -> DataFrame:
    """Tokens per session: scoped threads, else the unscoped snapshot, else the catalog's number.

    `threads` is thread_fold's result; `sessions` gives session_id and tokens_used.
    """
    row = sessions.select("session_id", "tokens_used").join(_ledger_sums(threads), "session_id", "left")
    return _with_task(row.select("session_id", *_ledger(F.col("tokens_used"))))


def turn_count(events: DataFrame) -> DataFrame:
    """Distinct non-empty turns; none at all is unknown."""
    turns = ensure_columns(events).groupBy("session_id").agg(F.count_distinct(X.trim_null(F.col("turn_id"))).alias("n"))
    return turns.select("session_id", C.known(F.nullif("n", F.lit(0))).alias("turn_count"))


def turn_and_thread_counts(events: DataFrame, threads: DataFrame) -> DataFrame:
    """Distinct turns, and distinct threads as the agent work items."""
    items = threads.groupBy("session_id").agg(F.count_if("own_id").alias("n"))
    items = items.select("session_id", C.partial(F.nullif("n", F.lit(0))).alias("agent_work_item_count"))
    return turn_count(events).join(items, "session_id")


def thread_count(threads: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """Threads of the hierarchy: those events name plus those the thread state knows."""
    ids = threads.select("session_id", "thread")
    if agents is not None:
        ids = ids.unionByName(agents.select("session_id", F.col("thread_id").alias("thread")))
    return ids.groupBy("session_id").agg(C.known(F.count_distinct("thread"), C.FROM_TREE).alias("thread_count"))


def available_skills(text: Column) -> Column:
    """Distinct skill ids listed after the heading, up to the first line that is no list item."""
    lines = F.transform(F.split(text, "\r?\n"), lambda x: X.strip(x))
    heading = F.array_position(lines, AVAILABLE_SKILLS)
    after = F.slice(lines, (heading + 1).cast("int"), F.size(lines))
    item = lambda line: F.regexp_extract(line, r"^- +`*([^:`\s]+)", 1)
    ends = F.transform(after, lambda line: (line != "") & (item(line) == ""))
    stop = F.array_position(ends, True)
    block = F.when(stop > 0, F.slice(after, F.lit(1), (stop - 1).cast("int"))).otherwise(after)
    ids = F.filter(F.transform(block, item), lambda name: name != "")
    return F.when(heading > 0, F.array_distinct(ids))


def used_skill_ids(events: DataFrame) -> DataFrame:
    """Distinct (session, skill) from skill tags in messages and from shell calls."""
    block = F.regexp_extract("text", r"(?s)<skill>(.*?)</skill>", 1)
    tagged = F.regexp_extract(block, r"(?s)<name>(.*?)</name>", 1)
    found = F.when(_is(*MESSAGE_TYPES) & F.col("text").contains("<skill>"), F.array(tagged)).when(
        _is("shell.call"), F.col("skill_identifiers")
    )
    rows = ensure_columns(events).where(_is(*MESSAGE_TYPES, "shell.call"))
    exploded = rows.select("session_id", F.explode(F.transform(found, lambda x: X.strip(x))).alias("skill"))
    return exploded.where(F.col("skill") != "").distinct()


def used_skills(sessions: DataFrame, skills: DataFrame) -> DataFrame:
    """Skill count per session; none is unknown."""
    counts = skills.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return sessions.select("session_id").join(counts, "session_id", "left").select(
        "session_id", C.known(F.col("n")).alias("used_skills")
    )


def review_cycles(fold: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """Events by or for a reviewer; without any, reviewer threads of the hierarchy."""
    fold = fold.select("session_id", "n_reviews")
    if agents is not None:
        threads = agents.groupBy("session_id").agg(F.count_if(F.col("role") == "reviewer").alias("t"))
        fold = fold.join(threads, "session_id", "left").withColumn("n_reviews", F.coalesce(F.nullif("n_reviews", F.lit(0)), "t"))
    return fold.select("session_id", _review_cycles())


def _efficiency(tokens: Column, outcome: Column, findings: Column) -> list[Column]:
    per_success = F.when(outcome == "completed", tokens.cast("double"))
    rate = F.when(tokens > 0, findings * 1000.0 / tokens)
    return [
        C.known(per_success, C.DERIVED).alias("tokens_per_successful_session"),
        C.unknown("double").alias("tokens_per_accepted_task"),
        C.partial(rate, C.DERIVED).alias("review_findings_per_1k_tokens"),
    ]


def derived_efficiency(fold: DataFrame, ledger: DataFrame) -> DataFrame:
    """Tokens per successful session and findings per thousand tokens."""
    row = fold.select("session_id", *_outcome(), _review_findings()).join(
        ledger.select("session_id", F.col("total.value").alias("tokens")), "session_id"
    )
    return row.select("session_id", *_efficiency(F.col("tokens"), F.col("outcome"), F.col("review_findings.value")))


def _catalog_factor_names() -> list[str]:
    return ["model", "reasoning_effort", "cli_version", "approval_mode", "agent_role", "sandbox_policy_kind"]


def _catalog_factors() -> list[Column]:
    return [X.trim_null(F.col(c)).alias(c) for c in _catalog_factor_names()]


def _log_factors() -> list[Column]:
    return [
        _skills_count(),
        C.known(F.col("n_mcp_calls")).alias("mcp_call_count"),
        _start_context(),
        C.known(F.col("runtime_mcp_servers")).alias("mcp_server_count"),
    ]


def factor_metadata(fold: DataFrame, sessions: DataFrame) -> DataFrame:
    """Catalog attributes next to skills, MCP servers, MCP calls and start context of the log."""
    catalog = sessions.select("session_id", *_catalog_factors())
    return fold.select("session_id", *_log_factors()).join(catalog, "session_id", "left")


def session_request_and_title(fold: DataFrame, sessions: DataFrame) -> DataFrame:
    """Opening request and task summary of a session, each with the place it came from."""
    row = sessions.select("session_id", "title", "first_user_message", "thread_name").join(
        fold.select("session_id", "user_message", "task_title"), "session_id", "left"
    )
    asked, named, thread = (X.trim_null(F.col(c)) for c in ("first_user_message", "title", "thread_name"))
    return row.select(
        "session_id",
        F.coalesce(asked, "user_message").alias("start_user_request"),
        F.when(asked.isNotNull(), "indexed_first_user_message").when(F.col("user_message").isNotNull(), "message_user")
        .otherwise("unavailable").alias("start_user_request_source"),
        F.coalesce(named, "task_title", thread).alias("task_summary"),
        F.when(named.isNotNull(), "indexed_title").when(F.col("task_title").isNotNull(), "task_started")
        .when(thread.isNotNull(), "indexed_title").otherwise("unavailable").alias("task_summary_source"),
    )


def primary_task(tasks: DataFrame) -> DataFrame:
    """The earliest root task of a session, else its earliest task."""
    rank = F.struct(F.col("parent_thread_id").isNotNull().alias("child"), F.col("started_seq"), F.col("task_key"))
    fields = F.struct("task_key", "started_seq", "task_class", "task_class_confidence")
    return tasks.groupBy("session_id").agg(F.min_by(fields, rank).alias("t")).select("session_id", "t.*")


def session_detail(metrics: DataFrame, requests: DataFrame, primaries: DataFrame) -> DataFrame:
    """Detail row: request, summary and primary task class beside the session's metrics."""
    task_class = F.when(F.col("task_class") != "unknown", F.col("task_class"))
    return (
        metrics.join(requests, "session_id", "left")
        .join(primaries.select("session_id", "task_class", "task_class_confidence"), "session_id", "left")
        .withColumn("task_class_confidence", F.coalesce("task_class_confidence", F.lit("unknown")))
        .withColumn("task_class", task_class)
    )


def session_metrics(events: DataFrame, operations: DataFrame, sessions: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """The stored document: every metric group of a session in one row.

    `sessions` is a catalog with project_key, session_scope, tokens_used and the factor columns.
    Metrics the logs cannot support stay as typed unknowns. The events are read once per
    grouping: by session, by thread, by turn and by skill; all later joins are one row a session.
    """
    events = ensure_columns(events)
    catalog = sessions.select("session_id", "project_key", "session_scope", "tokens_used", *_catalog_factors())
    skills = used_skill_ids(events).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_skills"))
    row = session_fold(events).join(catalog, "session_id", "left")
    threads = thread_fold(events)
    for part in (_ledger_sums(threads), operation_fold(operations), turn_count(events), skills):
        row = row.join(part, "session_id", "left")
    n_threads = C.known(F.col("n_threads"), C.FROM_TREE)
    if agents is not None:
        known = agents.groupBy("session_id").agg(F.count_if(F.col("role") == "reviewer").alias("n_reviewers"))
        row = row.join(known, "session_id", "left").join(
            thread_count(threads, agents).withColumnRenamed("thread_count", "tree"), "session_id", "left"
        )
        row = row.withColumn("n_reviews", F.coalesce(F.nullif("n_reviews", F.lit(0)), "n_reviewers"))
        n_threads = F.col("tree")
    ledger = [c.alias(f"tokens_{n}") for c, n in zip(_ledger(F.col("tokens_used")), [*TOKENS, "spawn_agent"], strict=True)]
    out = row.select(
        "session_id", "project_key", "session_scope", *_catalog_factor_names(),
        *_duration(), *_outcome(), *_counts()[:-1], *_log_factors(), _review_cycles(), _review_findings(),
        *_operation_counts(), "turn_count", n_threads.alias("thread_count"),
        (n_threads if agents is not None else C.partial(F.col("n_own_threads"))).alias("agent_work_item_count"),
        C.known(F.col("n_skills")).alias("used_skills"), *ledger, *[f"{n}_spent" for n in SPENT],
    )
    efficiency = _efficiency(F.col("tokens_total.value"), F.col("outcome"), F.col("review_findings.value"))
    return out.select(
        *[c for c in out.columns if not c.endswith("_spent")],
        *_time_spent(F.col("duration_ms")),
        C.covered_subtract(F.col("tokens_total"), F.col("tokens_spawn_agent")).alias("tokens_task"),
        C.unknown().alias("tokens_tool_call"),
        *efficiency,
        *[C.unknown().alias(n) for n in UNSUPPORTED_COUNTS],
        *[C.unknown("double").alias(n) for n in UNSUPPORTED_RATES],
        F.lit(METRICS_SCHEMA_VERSION).alias("metrics_schema_version"),
        F.lit(METRICS_PROJECTION_VERSION).alias("source_projection_version"),
    )
