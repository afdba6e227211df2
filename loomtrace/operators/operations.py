"""Operation projection: fold the events of one operation into a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions import exprs as X
from loomtrace.functions import json as J
from loomtrace.operators.columns import ensure_columns
from loomtrace.operators.ordered import carry, lookup, running_total
from loomtrace.session import cut_lineage

# Operation kinds in their sorting order. "split" kinds have a call and a result
# event type; "phased" kinds have one event type that carries a phase. Kinds marked immutable
# take no further event once they have ended.
SPLIT_KINDS = {"tool": ("tool.call", "tool.result"), "shell": ("shell.call", "shell.result"), "mcp": ("mcp.call", "mcp.result")}
PHASED_KINDS = [
    "stdin.write", "web.search", "web.open", "user.input.request", "patch.apply", "collab.spawn_agent",
    "collab.send_input", "collab.wait", "collab.close_agent", "collab.resume_agent", "file.change", "todo.update",
]
KIND_ORDER = [*SPLIT_KINDS, *PHASED_KINDS]
IMMUTABLE_KINDS = ["stdin.write", "user.input.request", "file.change"]
LIFECYCLE_TYPES = [*[t for pair in SPLIT_KINDS.values() for t in pair], *PHASED_KINDS]
MUTABLE_TYPES = [t for t in LIFECYCLE_TYPES if t not in IMMUTABLE_KINDS]
DUPLICATE_MARKERS = ["patch.apply.duplicate", "context.compacted.duplicate"]
TERMINAL_WORDS = ["completed", "failed", "cancelled", "error"]
RESULT_TYPES = [result for _, result in SPLIT_KINDS.values()]
FAILED_STATUSES = ["failed", "error", "cancelled"]

KEY = ["session_id", "kind", "run_id", "scope_thread_id", "operation_id"]


def kind_of(event_type: Column) -> Column:
    """Operation kind of an event type, null for the others: one literal-map lookup."""
    kinds = {t: kind for kind, pair in SPLIT_KINDS.items() for t in pair} | {t: t for t in PHASED_KINDS}
    table = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return F.try_element_at(table, event_type)


def event_phase(phase: Column, raw_type: Column) -> Column:
    """Phase from the payload, else from the raw item type."""
    return F.coalesce(
        F.lower(X.trim_null(phase)),
        F.when(raw_type.isin("item.started", "item.updated", "item.completed"), F.substring_index(raw_type, ".", -1)),
    )


def is_terminal(event_type: Column, phase: Column, status: Column) -> Column:
    return (
        F.coalesce(phase.isin(*TERMINAL_WORDS), F.lit(False))
        | F.coalesce(F.lower(X.trim_null(status)).isin(*TERMINAL_WORDS), F.lit(False))
        | event_type.isin(*RESULT_TYPES)
    )


def terminal_preference(duplicate_of: Column) -> Column:
    return (
        F.when(X.trim_null(duplicate_of).isNull(), 0)
        .when(X.strip(duplicate_of).startswith("response_item."), 2)
        .otherwise(1)
    )


def classify_events(events: DataFrame) -> DataFrame:
    """Add class (atomic, duplicate_marker, lifecycle), kind, role, event_phase, is_terminal, mutable."""
    events = ensure_columns(events)
    phase = F.col("event_phase")
    starts = [start for start, _ in SPLIT_KINDS.values()]
    role = (
        F.when(F.col("kind").isNull(), None)
        .when(F.col("event_type").isin(*starts), "start")
        .when(F.col("event_type").isin(*RESULT_TYPES), F.lit("terminal"))
        .when(phase == "started", "start")
        .when(phase == "updated", "update")
        .when(phase.isin(*TERMINAL_WORDS) | F.col("is_terminal"), "terminal")
        .otherwise("update")
    )
    return (
        events.withColumn("event_phase", event_phase(F.col("phase"), F.col("raw_type")))
        .withColumn("is_terminal", is_terminal(F.col("event_type"), phase, F.col("status")))
        .withColumn("kind", kind_of(F.col("event_type")))
        .withColumn("role_in_operation", role)
        .withColumn("mutable", F.when(F.col("kind").isNotNull(), ~F.col("kind").isin(*IMMUTABLE_KINDS)))
        .withColumn(
            "event_class",
            F.when(F.col("event_type").isin(*DUPLICATE_MARKERS), "duplicate_marker")
            .when(F.col("kind").isNotNull(), "lifecycle")
            .otherwise("atomic"),
        )
    )


def scope_thread(events: DataFrame) -> DataFrame:
    """Scope of an operation when the normaliser has not set it: thread, sender, else parent."""
    return events.withColumn(
        "scope_thread_id",
        F.coalesce("scope_thread_id", "thread_id", "sender_thread_id", "parent_thread_id"),
    )


def operation_identity(payload: Column) -> list[Column]:
    """Operation id and scope thread of an open payload.

    The first key that is present decides, even when it holds null or no text.
    """

    def first_present(*keys: str) -> Column:
        found = None
        for key in keys:
            value = J.node(payload, f"$.{key}")
            test, text = value.isNotNull(), J.clean(payload, f"$.{key}")
            found = F.when(test, text) if found is None else found.when(test, text)
        return found

    return [
        first_present("tool_use_id", "item_id", "call_id").alias("operation_id"),
        first_present("thread_id", "sender_thread_id", "parent_thread_id").alias("scope_thread_id"),
    ]


def lifecycle_events(events: DataFrame, types: list[str] = LIFECYCLE_TYPES) -> DataFrame:
    """Events that belong to an operation, with its key; the type filter reaches the scan."""
    work = scope_thread(classify_events(events.where(F.col("event_type").isin(*types))))
    return work.where((X.strip(F.col("operation_id")) != "") & (F.col("seq") > 0)).withColumns({"operation_id": X.strip(F.col("operation_id")), "run_id": X.strip(F.col("run_id"))})


def _accepted(events: DataFrame) -> DataFrame:
    """Lifecycle events without those an already ended immutable operation refuses."""
    mutable, fixed = lifecycle_events(events, MUTABLE_TYPES), lifecycle_events(events, IMMUTABLE_KINDS)
    ended = carry(fixed, KEY, "seq", {"ended_before": F.when(F.col("is_terminal"), F.col("seq"))}, inclusive=False)
    return mutable.unionByName(ended.where(F.col("ended_before").isNull()).drop("ended_before"))


def project_operations(events: DataFrame) -> DataFrame:
    """One snapshot per (session, kind, run, thread, operation id), folded by one aggregation."""
    rows = _accepted(events).withColumn("event_time", X.parse_rfc3339(F.col("ts")))
    seq = F.col("seq")
    ending = F.when(F.col("is_terminal"), F.struct(terminal_preference(F.col("duplicate_of")).alias("p"), seq.alias("s")))
    opening = F.struct(
        F.lower("tool_name").alias("tool_name"), F.lower("command").alias("command"), F.col("event_time").alias("at")
    )
    folded = rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("revision"),
        F.min("seq").alias("started_seq"),
        F.max("seq").alias("last_seq"),
        F.max_by(F.struct("event_type", "event_phase", F.col("status")), "seq").alias("last"),
        F.bool_or("is_terminal").alias("terminal"),
        F.max(ending).alias("ending"),
        F.max_by("event_time", ending).alias("ended_at"),
        F.min_by(opening, "seq").alias("opening"),
        F.first("mutable").alias("mutable"),
    )
    return folded.select(
        *KEY,
        "revision", "started_seq", F.col("ending.s").alias("terminal_seq"), "last_seq",
        F.col("last.event_type").alias("last_event_type"),
        F.col("last.event_phase").alias("last_phase"),
        X.trim_null(F.col("last.status")).alias("last_status"),
        "terminal", "mutable",
        F.col("ending.p").alias("terminal_preference"),
        F.col("opening.tool_name").alias("tool_name"), F.col("opening.command").alias("command"),
        F.col("opening.at").alias("started_at"), "ended_at",
        X.millis_between(F.col("opening.at"), F.col("ended_at")).alias("duration_ms"),
    )


def operation_updates(events: DataFrame) -> DataFrame:
    """Change log: one row per accepted event, numbered within its operation."""
    return running_total(_accepted(events), KEY, "seq", {"revision": F.lit(1)}).select(*KEY, "seq", "revision")


def duplicate_markers(events: DataFrame) -> DataFrame:
    """Known duplicates, kept beside the snapshots."""
    return (
        scope_thread(classify_events(events))
        .where(F.col("event_class") == "duplicate_marker")
        .select(
            "session_id", "seq", "event_type", X.strip(F.col("run_id")).alias("run_id"), "scope_thread_id",
            X.trim_null(F.col("operation_id")).alias("operation_id"), X.trim_null(F.col("duplicate_of")).alias("duplicate_of"),
        )
    )


def kind_ordinal(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), kind)


def order_operations(operations: DataFrame) -> DataFrame:
    return operations.orderBy(
        "session_id", F.coalesce("started_seq", "last_seq"), kind_ordinal(F.col("kind")), "operation_id", "run_id", "scope_thread_id"
    )


def annotate_events(events: DataFrame, operations: DataFrame) -> DataFrame:
    """Each event with its operation's revision, status, preferred terminal and root event id.

    The snapshots are stored first: they are read several times, and each time would fold all events anew.
    """
    rows = scope_thread(classify_events(events)).withColumn("operation_id", X.trim_null(F.col("operation_id")))
    facts = cut_lineage(operations.select(
        *KEY, "revision", "started_seq", "terminal_seq", F.col("last_status").alias("operation_status"), F.col("terminal").alias("operation_ended")
    ))
    joined = lookup(rows.withColumn("run_id", X.strip(F.col("run_id"))), facts, KEY, "seq", null_safe=True, weight="revision")
    root = F.concat_ws(":", F.col("run_id"), F.col("started_seq").cast("string"))
    return joined.withColumn("root_event_id", F.when(F.col("started_seq").isNotNull(), root)).withColumn(
        "is_root", F.coalesce(F.col("seq") == F.col("started_seq"), F.lit(False))
    )


def operation_parent(annotated: DataFrame) -> DataFrame:
    """Edge from every non-root event of an operation to the event that opened it."""
    return annotated.where(F.col("root_event_id").isNotNull() & ~F.col("is_root")).select(
        "session_id", "seq", F.concat_ws(":", "run_id", F.col("seq").cast("string")).alias("event_id"),
        F.col("root_event_id").alias("parent_event_id"),
    )


def tool_category(kind: Column, tool_name: Column, command: Column) -> Column:
    """Category of an operation: by kind first, then by ordered words in the tool name and command."""
    words = F.concat(F.lower(F.coalesce(tool_name, F.lit(""))), F.lit(" "), F.lower(F.coalesce(command, F.lit(""))))
    return (
        F.when(kind == "mcp", "mcp")
        .when(kind.isin("web.search", "web.open"), "web_search")
        .when(kind.isin("file.change", "patch.apply"), "edit")
        .when(kind.startswith("collab."), "collaboration")
        .when(X.contains_any(words, "search", "rg ") | words.startswith("rg"), "search")
        .when(words.contains("web"), "web_search")
        .when(X.contains_any(words, "apply_patch", "sed -i", "edit"), "edit")
        .when(words.contains("test"), "test")
        .when(X.contains_any(words, "build", "cargo check"), "build")
        .when(words.contains("git ") | words.startswith("git"), "git")
        .when(X.contains_any(words, "ls ", "find ", "cat "), "filesystem")
        .otherwise("other")
    )


def is_failed(status: Column) -> Column:
    return F.coalesce(status.isin(*FAILED_STATUSES), F.lit(False))


def tool_breakdown(operations: DataFrame) -> DataFrame:
    """Per session and category: operations, failures and summed duration (always partial)."""
    return (
        operations.withColumn("category", tool_category(F.col("kind"), F.col("tool_name"), F.col("command")))
        .groupBy("session_id", "category")
        .agg(
            F.count(F.lit(1)).alias("operations"),
            F.count_if(is_failed(F.col("last_status"))).alias("failures"),
            F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"),
        )
    )


def operation_durations(operations: DataFrame) -> DataFrame:
    return operations.where(F.col("duration_ms").isNotNull()).select(*KEY, "duration_ms")


def loaded_operation_stats(events: DataFrame, operations: DataFrame) -> DataFrame:
    """Fallback counters when no stored metrics exist: rates over tool and over all operations."""
    rows = lifecycle_events(events)
    tools = rows.groupBy(*KEY).agg(
        F.min_by(X.trim_null(F.col("tool_name")), F.when(X.trim_null(F.col("tool_name")).isNotNull(), F.col("seq"))).alias("tool")
    )
    same = [operations[k].eqNullSafe(tools[k]) for k in KEY]
    facts = operations.join(tools, same).select(operations["session_id"], operations["kind"], "last_status", "tool")
    is_tool = F.col("kind") != "file.change"
    tool_count, all_count = F.count_if(is_tool), F.count(F.lit(1))
    done = F.count_if(is_tool & (F.col("last_status") == "completed"))
    failed = F.count_if(F.col("last_status").isin("error", "failed"))
    per_operation = facts.groupBy("session_id").agg(
        F.when(tool_count > 0, tool_count).alias("tool_calls"),
        F.when(tool_count > 0, done).alias("successful_operations"),
        failed.alias("failed_operations"),
        F.count_if(F.col("kind") == "collab.spawn_agent").alias("spawn_agent_calls"),
        F.when(tool_count > 0, F.count_distinct(F.when(is_tool, F.col("tool")))).alias("unique_tools"),
        F.when(tool_count > 0, done / tool_count).alias("success_rate"),
        (failed / all_count).alias("error_rate"),
    )
    direct = events.groupBy("session_id").agg(
        F.count_if(F.col("event_type").startswith("message.")).alias("messages"),
        F.count_if(F.col("event_type") == "error").alias("direct_errors"),
    )
    errors = F.col("direct_errors") + F.coalesce("failed_operations", F.lit(0))
    return direct.join(per_operation, "session_id", "left").withColumn("errors", errors).drop("direct_errors")
