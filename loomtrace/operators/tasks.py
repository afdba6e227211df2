"""Task facts: intervals, signals, token deltas, operations and the roll-up over child tasks.

Every interval question is answered by as-of lookups on running totals, so the work stays linear
in the number of events, however long a session is and however many tasks overlap.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions import covered as C
from loomtrace.functions import exprs as X
from loomtrace.operators.columns import TOKEN_COLUMNS, ensure_columns, event_thread, has_tokens
from loomtrace.operators.operations import is_failed
from loomtrace.operators.ordered import SPAN, asof, asof_values, carry, lookup, row_index, running_total, spread_levels
from loomtrace.operators.session_metrics import TOKENS, outcome_columns
from loomtrace.session import cut_lineage

TERMINALS = ["task.completed", "agent.aborted", "agent.failed"]
SIGNALS = ["agent_role", "requested_agent_type", "receiver_role", "collaboration_mode_kind", "model_context_window", "actor_type"]
PART = 10_000  # numbers of children listed at once

# Words that name a task class, and the order and labels of the signals they are
# looked for in.
CLASS_WORDS = {
    "implementation": ["implementation", "implementer", "worker"],
    "review": ["review", "review_loop", "reviewer"],
    "analysis": ["analysis", "docs_researcher", "explorer", "research", "researcher"],
    "planning": ["plan", "planner", "planning"],
    "approval": ["approval", "approver"],
}
CLASS_SIGNALS = {
    "collaboration_mode_kind": "collaboration_mode",
    "agent_role": "agent_role",
    "requested_agent_type": "requested_agent_type",
    "receiver_role": "receiver_role",
}


def task_intervals(events: DataFrame) -> DataFrame:
    """One interval per task.started that names a turn, with its terminal event if there is one."""
    rows = ensure_columns(events).withColumn("thread", event_thread()).withColumn("turn", X.trim_null(F.col("turn_id")))
    starts = rows.where(F.col("event_type") == "task.started").select(
        "session_id", "task_id", F.col("turn").alias("turn_id"), F.col("thread").alias("thread_id"),
        X.trim_null(F.col("parent_thread_id")).alias("parent_thread_id"), F.col("seq").alias("started_seq"), F.col("ts").alias("started_at"),
    )
    # Starts and ends are few next to the events: they are pinned, since every running value reads
    # its input twice. The next start of another turn on the thread opens the next run of equal turns.
    here = ["session_id", "thread_id"]
    starts = cut_lineage(starts)
    runs = carry(starts, here, "started_seq", {"previous": F.struct("turn_id")}, inclusive=False)
    opens = F.col("previous").isNull() | ~F.col("previous.turn_id").eqNullSafe(F.col("turn_id"))
    runs = carry(cut_lineage(runs), here, "started_seq", {"next_seq": F.when(opens, F.col("started_seq"))}, inclusive=False, backwards=True)
    tasks = cut_lineage(runs.drop("previous").where(F.col("turn_id").isNotNull()))

    ends = rows.where(F.col("event_type").isin(*TERMINALS) & F.col("turn").isNotNull()).select(
        "session_id", F.col("turn").alias("turn_id"), F.col("thread").alias("thread_id"), F.col("seq").alias("ended_seq"),
        F.col("ts").alias("ended_at"), F.col("event_type").alias("terminal_type"), X.trim_null(F.col("error_text")).alias("terminal_text"),
    )
    ends = cut_lineage(ends)
    found = ["ended_seq", "ended_at", "terminal_type", "terminal_text"]

    def first_end(part: DataFrame, keys: list[str]) -> DataFrame:
        return asof(part, ends.select(*keys, *found), keys, "started_seq", "ended_seq", found, inclusive=False, backwards=True)

    threaded = first_end(tasks.where(F.col("thread_id").isNotNull()), ["session_id", "turn_id", "thread_id"])
    loose = first_end(tasks.where(F.col("thread_id").isNull()), ["session_id", "turn_id"])
    last = rows.groupBy("session_id").agg(F.max("seq").alias("last_seq"))
    tasks = lookup(threaded.unionByName(loose), last, ["session_id"], "started_seq")
    return tasks.withColumn("end_seq", F.coalesce("ended_seq", F.col("next_seq") - 1, "last_seq")).select(
        task_key().alias("task_key"), "session_id", "task_id", "turn_id", "thread_id", "parent_thread_id",
        "started_seq", "started_at", *found, "end_seq", task_coverage().alias("interval_coverage"),
    )


def task_key() -> Column:
    return F.concat(
        F.lit("task:"),
        F.concat_ws("|", X.strip(F.col("session_id")), X.strip(F.col("task_id")), X.strip(F.col("turn_id")), F.coalesce("thread_id", F.lit("unknown"))),
    )


def task_coverage() -> Column:
    """Known with a terminal, partial when the interval spans more than its start, else unknown."""
    return (
        F.when(F.col("ended_seq").isNotNull(), C.KNOWN)
        .when(F.col("end_seq") > F.col("started_seq"), C.PARTIAL)
        .otherwise(C.UNKNOWN)
    )


def task_outcome(tasks: DataFrame) -> DataFrame:
    """Outcome, coverage and error text from the terminal event."""
    text = F.struct(F.col("terminal_text").alias("text"))
    kind = F.col("terminal_type")
    return tasks.select(
        "*",
        *outcome_columns(
            F.when(kind == "agent.aborted", text), F.when(kind == "agent.failed", text), F.coalesce(kind == "task.completed", F.lit(False))
        ),
    )


def task_signals(tasks: DataFrame, events: DataFrame, sessions: DataFrame) -> DataFrame:
    """First value of each signal on the task's thread inside its interval.

    A task without a thread reads all events; a root task without a role takes the catalog's.
    """
    rows = ensure_columns(events).withColumn("thread_id", event_thread())
    values = {s: X.trim_null(F.col(s)) for s in SIGNALS}
    rows = rows.where(F.coalesce(*values.values()).isNotNull()).select("session_id", "thread_id", "seq", *SIGNALS)
    tasks, rows = cut_lineage(tasks), cut_lineage(rows)

    def first_in(part: DataFrame, keys: list[str]) -> DataFrame:
        return asof_values(part, rows, keys, "started_seq", "seq", values, inclusive=True, backwards=True)

    found = first_in(tasks.where(F.col("thread_id").isNotNull()), ["session_id", "thread_id"]).unionByName(
        first_in(tasks.where(F.col("thread_id").isNull()), ["session_id"])
    )
    found = found.withColumns({s: F.when(F.col(f"{s}.at") <= F.col("end_seq"), F.col(f"{s}.value")) for s in SIGNALS})
    catalog = sessions.select("session_id", X.trim_null(F.col("agent_role")).alias("catalog_role"))
    found = lookup(found, catalog, ["session_id"], "started_seq")
    role = F.coalesce("agent_role", F.when(F.col("parent_thread_id").isNull(), F.col("catalog_role")))
    return found.withColumn("agent_role", role).drop("catalog_role")


def _class_of(value: Column) -> Column:
    words = F.create_map(*[F.lit(x) for name, group in CLASS_WORDS.items() for word in group for x in (word, name)])
    return F.try_element_at(words, F.lower(X.strip(value)))


def task_class(tasks: DataFrame) -> DataFrame:
    """One class among the signals is confident, several are ambiguous, none is unknown."""
    found = F.array_compact(
        F.array(*[F.struct(_class_of(F.col(c)).alias("c"), F.lit(label).alias("s")) for c, label in CLASS_SIGNALS.items()])
    )
    named = F.filter(found, lambda x: x["c"].isNotNull())
    classes = F.size(F.array_distinct(F.transform(named, lambda x: x["c"])))
    return tasks.select(
        "*",
        F.when(classes == 1, named[0]["c"]).otherwise("unknown").alias("task_class"),
        F.when(classes == 1, named[0]["s"]).when(classes > 1, "ambiguous_signals").otherwise("unclassified").alias("task_class_source"),
        F.when(classes == 1, "confident").when(classes > 1, "partial").otherwise("unknown").alias("task_class_confidence"),
    )


def task_token_delta(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Cumulative tokens at the end of the interval minus those before its start, per thread."""
    points = (
        ensure_columns(events)
        .where((F.col("event_type") == "info.tokens") & has_tokens() & event_thread().isNotNull())
        .select("session_id", event_thread().alias("thread_id"), F.col("seq").alias("at"), F.struct(*TOKEN_COLUMNS).alias("point"))
    )
    keys = ["session_id", "thread_id"]
    tasks, points = cut_lineage(tasks), cut_lineage(points)
    threaded = tasks.where(F.col("thread_id").isNotNull())
    ended = asof(threaded, points, keys, "end_seq", "at", ["point"], inclusive=True).withColumnRenamed("point", "end_point")
    both = asof(cut_lineage(ended), points, keys, "started_seq", "at", ["point"], inclusive=False)
    both = both.unionByName(tasks.where(F.col("thread_id").isNull()), allowMissingColumns=True)

    def delta(column: str) -> Column:
        end, before = F.col(f"end_point.{column}"), F.col(f"point.{column}")
        base = F.when(F.col("point").isNull(), F.lit(0)).otherwise(before)
        return C.covered(F.when(end >= base, end - base), F.col("interval_coverage"), C.FROM_EVENTS)

    return both.select("*", *[delta(c).alias(f"own_{n}") for n, c in TOKENS.items()]).drop("end_point", "point")


# Counter -> condition on a snapshot; the last three add durations instead of ones.
def _operation_measures() -> dict[str, Column]:
    kind, spent = F.col("kind"), F.coalesce("duration_ms", F.lit(0))
    tests = {
        "operation_count": F.lit(True),
        "successful_operations": F.col("last_status") == "completed",
        "failed_operations": is_failed(F.col("last_status")),
        "tool_calls": kind != "file.change",
        "shell_calls": kind == "shell",
        "mcp_calls": kind == "mcp",
        "collaboration_calls": kind.startswith("collab."),
        "spawn_agent_calls": kind == "collab.spawn_agent",
    }
    measures = {n: F.when(t, 1).otherwise(0) for n, t in tests.items()}
    return measures | {
        "tool_ms": F.when(~kind.isin("shell", "mcp"), spent).otherwise(0),
        "shell_ms": F.when(kind == "shell", spent).otherwise(0),
        "mcp_ms": F.when(kind == "mcp", spent).otherwise(0),
    }


def task_operations(tasks: DataFrame, operations: DataFrame) -> DataFrame:
    """Operations that start inside the interval on the task's thread, counted by running totals."""
    measures = _operation_measures()
    names = list(measures)
    keys = ["session_id", "thread_id"]
    anchored = operations.where(F.col("scope_thread_id").isNotNull()).select(
        "session_id", F.col("scope_thread_id").alias("thread_id"), F.col("started_seq").alias("at"), "kind", "last_status", "duration_ms"
    )
    totals = running_total(cut_lineage(anchored), keys, "at", measures).select(*keys, "at", F.struct(*names).alias("sums"))
    tasks, totals = cut_lineage(tasks), cut_lineage(totals)
    threaded = tasks.where(F.col("thread_id").isNotNull())
    ended = asof(threaded, totals, keys, "end_seq", "at", ["sums"], inclusive=True).withColumnRenamed("sums", "end_sums")
    both = asof(cut_lineage(ended), totals, keys, "started_seq", "at", ["sums"], inclusive=False)
    both = both.unionByName(tasks.where(F.col("thread_id").isNull()), allowMissingColumns=True)

    def inside(name: str) -> Column:
        end, before = (F.coalesce(F.col(f"{side}.{name}"), F.lit(0)) for side in ("end_sums", "sums"))
        value = (end - before).cast("bigint")
        counts = name in names[:8]
        # Counters of a task without a thread are unknown, its durations are zero.
        usable = F.when(F.col("thread_id").isNotNull(), value) if counts else F.when(F.col("thread_id").isNotNull(), value).otherwise(0)
        return C.covered(usable, F.col("interval_coverage"), C.FROM_OPERATIONS)

    return both.select("*", *[inside(n).alias(n) for n in names]).drop("end_sums", "sums")


def task_total() -> Column:
    gap = X.millis_between(X.parse_rfc3339(F.col("started_at")), X.parse_rfc3339(F.col("ended_at")))
    return C.known(gap)


def task_duration(tasks: DataFrame) -> DataFrame:
    """Time from the start to the terminal event."""
    return tasks.withColumn("total_ms", task_total())


def _interval_sums(tasks: DataFrame, children: DataFrame, values: list[str], span: int) -> DataFrame:
    """Sums of the children's values inside each task: differences of running totals at its two ends.

    `children` gives session_id, parent_thread_id, started_seq and the values. A child of a task names the task's thread
    as its parent thread and starts after the task's start, up to its end. Starts, ends and children are swept together
    along the sequence numbers of a thread, so nothing is paired however many tasks overlap.
    """
    here = ["session_id", "thread"]
    owner = [c for c in tasks.columns if c not in values]
    points = children.select("session_id", F.col("parent_thread_id").alias("thread"), (F.col("started_seq") * 2).alias("at"), *values)
    ends = F.explode(F.array(F.struct(F.col("started_seq").alias("seq"), F.lit(-1).alias("sign")), F.struct(F.col("end_seq").alias("seq"), F.lit(1).alias("sign"))))
    parents = tasks.where(F.col("thread_id").isNotNull() & (F.col("end_seq") >= F.col("started_seq")))
    marks = parents.select("session_id", F.col("thread_id").alias("thread"), F.struct(*owner).alias("task"), ends.alias("end"))
    marks = marks.select(*here, (F.col("end.seq") * 2 + 1).alias("at"), "task", F.col("end.sign").alias("sign"))
    swept = points.where(F.col("parent_thread_id").isNotNull()).unionByName(marks, allowMissingColumns=True)
    totals = running_total(swept, here, "at", {v: F.col(v) for v in values}, span=2 * span).where(F.col("sign").isNotNull())
    inside = totals.groupBy("session_id", F.col("task.started_seq").alias("started_seq")).agg(
        F.first("task").alias("task"), *[F.sum(F.col("sign") * F.col(v)).alias(v) for v in values]
    )
    return inside.select(*[F.col(f"task.{c}") for c in owner], *values)


def task_children(tasks: DataFrame, span: int = SPAN) -> DataFrame:
    """Edges parent -> child: the child's parent thread is the parent's and it starts in its interval.

    The children of a thread are numbered along its sequence numbers. Those of one task are a range of numbers, found by
    counting at its two ends and joined by equality, so work grows with the edges that there are.
    """
    here = ["session_id", "thread"]
    tasks = cut_lineage(tasks.select("session_id", "thread_id", "parent_thread_id", "started_seq", "end_seq", "task_key"))
    children = tasks.where(F.col("parent_thread_id").isNotNull()).select(
        "session_id", F.col("parent_thread_id").alias("thread"), F.col("started_seq").alias("child_seq"), F.col("task_key").alias("child_key")
    )
    children = cut_lineage(row_index(children, here, F.floor(F.col("child_seq") / span), [F.col("child_seq")], "number"))
    parents = tasks.where(F.col("thread_id").isNotNull() & (F.col("end_seq") >= F.col("started_seq"))).select(
        "session_id", F.col("thread_id").alias("thread"), F.col("started_seq").alias("parent_seq"), F.col("task_key").alias("parent_key"), "end_seq"
    )
    last = ["number"]
    opened = asof(parents, children, here, "parent_seq", "child_seq", last, inclusive=True, span=span).withColumnRenamed("number", "before")
    ranged = asof(cut_lineage(opened), children, here, "end_seq", "child_seq", last, inclusive=True, span=span).withColumnRenamed("number", "upto")
    first = F.coalesce(F.col("before") + 1, F.lit(0).cast("bigint"))
    ranged = ranged.where(F.col("upto") >= first).withColumn("first", first)
    # in two steps, so that a row never holds more than PART numbers
    part = F.explode(F.sequence(F.floor(F.col("first") / PART), F.floor(F.col("upto") / PART)))
    parted = ranged.withColumn("part", part)
    number = F.explode(F.sequence(F.greatest("first", F.col("part") * PART), F.least("upto", (F.col("part") + 1) * PART - 1)))
    met = parted.select(*here, "parent_seq", "parent_key", number.alias("number")).join(children, [*here, "number"])
    return met.select("session_id", "parent_seq", "child_seq", "parent_key", "child_key")


def task_rollup(tasks: DataFrame, span: int = SPAN) -> DataFrame:
    """Totals with everything below added, level by level.

    A task reached over several paths counts once per path. A level's sums below every task are differences of running
    totals over the level before, so no edges are listed; sums of values travel with the number of values in them, since
    a sum of nothing is unknown. Values become partial, since a leaf adds an unknown child sum; the task's own part keeps
    its coverage.
    """
    names = list(TOKENS)
    sums, counts = [f"sum_{n}" for n in names], [f"count_{n}" for n in names]
    node = ["session_id", "started_seq"]
    place = ["session_id", "started_seq", "end_seq", "thread_id", "parent_thread_id"]
    tasks = cut_lineage(tasks)
    nodes = tasks.select(*place)
    start = tasks.select(
        *place, F.lit(0).alias("level"), F.lit(1).cast("bigint").alias("paths"),
        *[F.coalesce(F.col(f"own_{n}.value"), F.lit(0)).cast("bigint").alias(s) for n, s in zip(names, sums)],
        *[F.col(f"own_{n}.value").isNotNull().cast("bigint").alias(c) for n, c in zip(names, counts)],
    )

    depth = itertools.count(1)

    def raise_one_level(frontier: DataFrame, nodes: DataFrame) -> DataFrame:
        above = _interval_sums(nodes, frontier, ["paths", *sums, *counts], span)
        return above.where("paths > 0").withColumn("level", F.lit(next(depth))).select(*start.columns)

    levels = spread_levels(nodes, start, raise_one_level)
    below = F.col("level") > 0
    totals = levels.groupBy(*node).agg(
        *[F.when(F.sum(c) > 0, F.sum(s)).alias(s) for s, c in zip(sums, counts)],
        F.when(F.sum(F.when(below, F.col("count_total"))) > 0, F.sum(F.when(below, F.col("sum_total")))).alias("below"),
    )
    ms = tasks.select(
        "session_id", "parent_thread_id", "started_seq", F.lit(1).cast("bigint").alias("children"),
        F.coalesce(F.col("total_ms.value"), F.lit(0)).alias("ms"), F.col("total_ms.value").isNotNull().cast("bigint").alias("with_ms"),
        (F.col("total_ms.coverage") == C.KNOWN).cast("bigint").alias("known_ms"),
    )
    spans = _interval_sums(nodes, ms, ["children", "ms", "with_ms", "known_ms"], span).where("children > 0")
    complete = F.when(F.col("known_ms") == F.col("children"), C.KNOWN).otherwise(C.PARTIAL)
    spans = spans.select(*node, C.covered(F.when(F.col("with_ms") > 0, F.col("ms")), complete, C.DERIVED).alias("children_ms"))
    joined = tasks.join(totals, node, "left").join(spans, node, "left")
    return joined.select(
        *tasks.columns,
        *[C.partial(F.col(f"sum_{n}"), C.DERIVED).alias(n) for n in names],
        F.col("own_total").alias("task"),
        C.partial(F.col("below"), C.DERIVED).alias("spawn_agent"),
        F.coalesce("children_ms", C.unknown()).alias("spawn_agent_ms"),
    )


def task_facts(events: DataFrame, operations: DataFrame, sessions: DataFrame) -> DataFrame:
    """The flat task table: interval, outcome, class, tokens, operations, durations, roll-up."""
    tasks = task_class(task_signals(task_outcome(task_intervals(events)), events, sessions))
    tasks = task_duration(task_operations(task_token_delta(tasks, events), operations))
    tasks = cut_lineage(tasks)
    tasks = task_rollup(tasks)
    identity = sessions.select("session_id", "project_key", "session_scope")
    return lookup(tasks, identity, ["session_id"], "started_seq")


def task_order(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy("session_id", "started_at", "started_seq", "task_key")
