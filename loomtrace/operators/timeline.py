"""Timeline of a session: summaries, recent lines, segments, paired results, plans, patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions import exprs as X
from loomtrace.functions import json as J
from loomtrace.operators.columns import ensure_columns
from loomtrace.operators.event_text import event_summary
from loomtrace.operators.ordered import asof_values, carry, lookup
from loomtrace.operators.threads import event_category, is_other_message, named_receivers
from loomtrace.session import cut_lineage

LINE_WIDTH, TIMELINE_WIDTH = 140, 160
LINES_DEFAULT, TIMELINE_DEFAULT = 4, 12
RESPONSE_OUTPUT = "response_item.function_call_output"

# What a patch text calls its files, and the words for its outcome.
PATCH_FILE = r"(?m)^\*\*\* (?:Update|Add|Delete) File: *(.+?) *$"
PATCH_GOOD, PATCH_BAD = ["completed", "success", "succeeded"], ["failed", "error"]
PLAN_WRAPPER = r"(?s)^\s*<proposed_plan>(.*)</proposed_plan>\s*$"


def _type() -> Column:
    return F.col("event_type")


def _last_lines(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The newest rows per key; the rank limit is applied before the shuffle as well."""
    newest = Window.partitionBy(*keys).orderBy(F.col("seq").desc(), *[F.col(c).desc() for c in rows.columns if c == "place"])
    return rows.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= limit)


def thread_recent_lines(events: DataFrame, limit: int = LINES_DEFAULT) -> DataFrame:
    """Last lines each thread said, ran, or was reported to have said; an event's report comes after its own line."""
    rows = ensure_columns(events).withColumn("thread", F.coalesce("thread_id", "sender_thread_id"))
    tool = F.coalesce("tool_name", F.lit("unknown"))
    sub = F.coalesce(F.col("actor_type") == "subagent", F.lit(False))
    line = (
        F.when(is_other_message(), F.coalesce(X.trim_null(F.col("text")), F.lit("")))
        .when((_type() == "message.user") & X.trim_null(F.col("text")).isNotNull(), F.concat(F.lit("user: "), X.strip(F.col("text"))))
        .when(sub & _type().isin("tool.call", "shell.call"), F.concat(F.lit("tool: "), tool))
        .when(sub & _type().isin("tool.result", "shell.result"), F.concat(F.lit("result "), tool, F.lit(": "), F.coalesce(X.trim_null(F.col("text")), F.lit("ok"))))
    )
    own = F.struct(F.col("thread").alias("thread"), line.alias("line"))
    told = F.transform("agents_states", lambda s: F.struct(X.strip(s["thread_id"]).alias("thread"), s["message"].alias("line")))
    lines = F.concat(F.array(own), F.when(named_receivers(), told).otherwise(F.array().cast("array<struct<thread:string,line:string>>")))
    said = rows.select("session_id", "seq", F.posexplode(F.coalesce(lines, F.array(own))).alias("place", "l"))
    said = said.select("session_id", F.col("l.thread").alias("thread"), "seq", "place", X.truncate(F.col("l.line"), LINE_WIDTH).alias("line"))
    return _last_lines(said.where("line IS NOT NULL AND thread <> ''"), ["session_id", "thread"], limit).drop("place")


def run_timeline(events: DataFrame, limit: int = TIMELINE_DEFAULT) -> DataFrame:
    """Last entries of each run with their summary; only theirs are worded."""
    rows = event_summary(_last_lines(events, ["run_id"], limit))
    return rows.select("run_id", "seq", "ts", "event_type", X.truncate(F.col("summary"), TIMELINE_WIDTH).alias("label"), "position")


def plan_text(event_type: Column, text: Column, output_text: Column) -> Column:
    """Plan an event carries: the wrapped plan of a message, or the text of a plan update."""
    wrapped = F.regexp_extract(text, PLAN_WRAPPER, 1)
    return F.when(event_type.startswith("message."), X.trim_null(wrapped)).when(event_type == "todo.update", X.trim_null(output_text))


def merge_plan_messages(events: DataFrame) -> DataFrame:
    """Plan messages, an event and the response right after it with the same plan being one.

    `events` needs thread, raw_type, duplicate_of and plan_text.
    """
    rows = cut_lineage(events.select("session_id", "thread", "seq", "event_type", "raw_type", "duplicate_of", "plan_text", "role"))
    has = F.col("plan_text").isNotNull()
    first_half = has & (_type() == "todo.update") & (F.col("raw_type") == "event_msg") & F.coalesce(F.col("duplicate_of") == "response_item.message", F.lit(False))
    second_half = has & _type().startswith("message.") & (F.col("raw_type") == "response_item")
    rows = rows.withColumns({"is_event": F.coalesce(first_half, F.lit(False)), "is_response": F.coalesce(second_half, F.lit(False))})
    near = F.struct("seq", "is_event", "is_response", "plan_text", "role")
    keys = ["session_id", "thread"]
    after = carry(rows, keys, "seq", {"after": near}, inclusive=False, backwards=True)
    both = carry(cut_lineage(after), keys, "seq", {"before": F.struct("is_event", "plan_text")}, inclusive=False)
    same = F.coalesce(F.col("is_event") & F.col("after.is_response") & (F.col("after.plan_text") == F.col("plan_text")), F.lit(False))
    taken = F.coalesce(F.col("is_response") & F.col("before.is_event") & (F.col("before.plan_text") == F.col("plan_text")), F.lit(False))
    return both.where((F.col("is_event") | F.col("is_response")) & ~taken).select(
        "session_id", "thread", "seq", F.lit("message.plan").alias("event_type"), "plan_text",
        F.when(same, F.col("after.seq")).alias("merged_seq"), F.coalesce(F.when(same, F.col("after.role")), "role", F.lit("assistant")).alias("role"),
    )


def patch_targets(text: Column) -> Column:
    """Files a patch text names, in order, once each."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(PATCH_FILE), 1))


def patch_status(status: Column, phase: Column) -> list[Column]:
    """success, failure or unknown from the status, with what to show next to it."""
    word, stage = X.trim_null(status), X.trim_null(phase)
    key = F.lower(word)
    good = F.coalesce(key.isin(*PATCH_GOOD), F.lit(False))
    variant = F.when(good, "success").when(key.isin(*PATCH_BAD), "failure").otherwise("unknown")
    return [variant.alias("variant"), F.when(~good, F.coalesce(word, stage)).alias("detail")]


def merge_plan_updates(pairs: DataFrame) -> DataFrame:
    """Explanation and steps of a plan update: the result's if it has them, else the call's."""
    return pairs.select(
        "session_id", "call_seq", "result_seq",
        F.coalesce(X.trim_null(F.col("result_explanation")), X.trim_null(F.col("call_explanation"))).alias("explanation"),
        F.coalesce(F.when(F.size("result_steps") > 0, F.col("result_steps")), F.when(F.size("call_steps") > 0, F.col("call_steps"))).alias("steps"),
    )


PAIRED_PHASED = ["patch.apply", "todo.update", "user.input.request", "collab.spawn_agent", "collab.send_input", "collab.wait", "collab.close_agent"]


def pair_call_result(annotated: DataFrame) -> DataFrame:
    """Each call with the best result of its operation.

    The operation's preferred terminal if it is another event, else the highest scoring one:
    echoes of response outputs first, then those that carry more, then the latest.
    """
    rows = ensure_columns(annotated).where(F.col("root_event_id").isNotNull())
    phase = F.col("event_phase")
    is_call = F.col("is_root") & ((_type() == "shell.call") | _type().isin(*PAIRED_PHASED) & (phase == "started"))
    is_result = ~F.col("is_root") & ((_type() == "shell.result") | _type().isin(*PAIRED_PHASED) & (phase == "completed"))
    yes = lambda test: F.coalesce(test, F.lit(False)).cast("int")
    score = F.struct(
        yes(F.col("duplicate_of") == RESPONSE_OUTPUT), yes(F.col("artifact_path").isNotNull()), yes(F.col("status").isNotNull()),
        yes(F.col("exit_code").isNotNull()), F.col("seq"),
    )
    key = ["session_id", "kind", "root_event_id"]
    folded = rows.groupBy(*key).agg(
        F.min(F.when(is_call, F.col("seq"))).alias("call_seq"),
        F.max("terminal_seq").alias("terminal_seq"),
        F.max_by("seq", F.when(is_result, score)).alias("best_seq"),
    )
    preferred = F.when(F.col("terminal_seq") != F.col("call_seq"), F.col("terminal_seq"))
    return folded.where(F.col("call_seq").isNotNull()).select(
        *key, "call_seq", F.coalesce(preferred, "best_seq").alias("result_seq")
    ).where(F.col("result_seq").isNotNull())


def drop_redundant_results(annotated: DataFrame, pairs: DataFrame) -> DataFrame:
    """Events without the plain results a richer one stands for, and without patch duplicates."""
    chosen = pairs.select("session_id", "kind", "root_event_id", "result_seq")
    results = annotated.where(~F.col("is_root") & _type().isin("shell.result", "patch.apply", "todo.update", "collab.spawn_agent", "collab.wait", "collab.send_input", "collab.close_agent"))
    rich = annotated.where(F.coalesce(F.col("duplicate_of").startswith("response_item."), F.lit(False))).select("session_id", F.col("seq").alias("result_seq"))
    richer = chosen.join(rich, ["session_id", "result_seq"], "left_semi")
    plain = results.where(F.col("duplicate_of").isNull() & F.col("event_phase").eqNullSafe("completed") | (_type() == "shell.result") & F.col("duplicate_of").isNull())
    hidden = lookup(plain, richer, ["session_id", "kind", "root_event_id"], "seq", how="inner").where(F.col("seq") != F.col("result_seq")).select("session_id", "seq")
    kept = annotated.where(_type() != "patch.apply.duplicate")
    return kept.join(hidden, ["session_id", "seq"], "left_anti")


def task_segments(events: DataFrame) -> DataFrame:
    """Timeline runs from a task's start to the completion of its turn, or to before the next start.

    A completion without a turn, or any when the start has none, closes it too.
    """
    rows = ensure_columns(events).select("session_id", F.coalesce("thread_id", "sender_thread_id").alias("thread"), "seq", "event_type", "turn_id")
    marks = cut_lineage(rows.where(_type().isin("task.started", "task.completed")))
    keys = ["session_id", "thread"]
    starts = marks.where(_type() == "task.started").select(*keys, "turn_id", F.col("seq").alias("start_seq"))
    nexts = carry(starts, keys, "start_seq", {"next_seq": F.col("start_seq")}, inclusive=False, backwards=True)
    ends = marks.where(_type() == "task.completed").select(*keys, "turn_id", "seq")
    by_turn = asof_values(cut_lineage(nexts), ends, [*keys, "turn_id"], "start_seq", "seq", {"own": F.col("seq")}, inclusive=False, backwards=True)
    loose = {"untold": F.when(F.col("end_turn").isNull(), F.col("seq")), "any": F.col("seq")}
    by_any = asof_values(
        cut_lineage(by_turn), ends.withColumnRenamed("turn_id", "end_turn"), keys, "start_seq", "seq", loose, inclusive=False, backwards=True
    )
    found = F.when(F.col("turn_id").isNull(), F.col("any.value")).otherwise(F.least("own.value", "untold.value"))
    found = F.when(F.col("next_seq").isNull() | (found < F.col("next_seq")), found)
    last = rows.groupBy(*keys).agg(F.max("seq").alias("last_seq"))
    joined = lookup(by_any.withColumn("found", found), last, keys, "start_seq", null_safe=True)
    return joined.select(
        *keys, "turn_id", "start_seq", F.coalesce("found", F.col("next_seq") - 1, "last_seq").alias("end_seq"), F.col("found").isNotNull().alias("is_closed")
    )


def render_order(annotated: DataFrame) -> DataFrame:
    """Display order: an operation by its terminal event, other events by their own; newest first."""
    seq = F.coalesce("terminal_seq", "seq")
    rows = annotated.where(F.col("is_root") | F.col("root_event_id").isNull())
    return rows.select("session_id", "thread_id", "seq", seq.alias("render_seq")).orderBy("session_id", F.col("render_seq").desc(), "seq")


def thread_render_order(annotated: DataFrame) -> DataFrame:
    """A thread shows where its newest item does."""
    return annotated.groupBy("session_id", "thread_id").agg(F.max(F.coalesce("terminal_seq", "seq")).alias("render_seq"))


def user_input_answers(requests: DataFrame) -> DataFrame:
    """Questions and answers of an input request matched by id; answers without a question stay.

    `requests` has session_id, seq and the trees input and output; call and result rows of one
    request share their seq.
    """
    asked = requests.select("session_id", "seq", F.explode(F.try_variant_get("input", "$.questions", "array<variant>")).alias("q"))
    asked = asked.select("session_id", "seq", J.clean(F.col("q"), "$.id").alias("id"), J.clean(F.col("q"), "$.question").alias("question"), F.lit(None).cast("array<string>").alias("answers"))
    given = requests.select("session_id", "seq", F.explode(F.try_variant_get("output", "$.answers", "map<string,variant>")).alias("id", "a"))
    texts = F.coalesce(J.texts(F.col("a"), "$.answers"), J.texts(F.col("a"), "$"), F.array_compact(F.array(J.text(F.col("a"), "$"))))
    given = given.select("session_id", "seq", F.trim("id").alias("id"), F.lit(None).cast("string").alias("question"), texts.alias("answers"))
    united = asked.unionByName(given).where(F.col("id").isNotNull())
    paired = united.groupBy("session_id", "seq", "id").agg(F.max("question").alias("question"), F.max("answers").alias("answers"))
    return paired.where(F.col("question").isNotNull() | (F.size("answers") > 0))


def collab_states(events: DataFrame) -> DataFrame:
    """Distinct (thread, state) a collaboration result reports, from its status maps and lists."""
    p = F.col("payload")

    def said(value: Column) -> Column:
        keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
        return F.coalesce(J.clean(value, "$"), J.clean(value, "$.status"), F.get(F.array_sort(keys), F.lit(0)))

    maps = [F.explode(F.try_variant_get(p, f"$.{name}", "map<string,variant>")).alias("thread_id", "v") for name in ("statuses", "agents_states")]
    keyed = events.select("session_id", "seq", maps[0]).unionByName(events.select("session_id", "seq", maps[1]))
    listed = events.select("session_id", "seq", F.explode(F.try_variant_get(p, "$.agent_statuses", "array<variant>")).alias("e"))
    listed = listed.select("session_id", "seq", J.clean(F.col("e"), "$.thread_id").alias("thread_id"), J.node(F.col("e"), "$.status").alias("v"))
    fallback = F.get("receiver_thread_ids", F.lit(0))
    direct = events.select("session_id", "seq", fallback.alias("thread_id"), J.node(p, "$.status").alias("v"))
    united = keyed.unionByName(listed).unionByName(direct)
    return united.select("session_id", "seq", "thread_id", said(F.col("v")).alias("state")).where(F.col("state").isNotNull()).distinct()


ATTRIBUTES = [
    "session_id", "seq", "ts", "event_type", "raw_type", "category", "summary", "thread_id", "sender_thread_id", "parent_thread_id", "turn_id", "role", "direction",
    "text", "phase", "status", "duplicate_of", "tool_name", "operation_id", "exit_code", "command", "receiver_thread_ids", "agent_nickname", "agent_role",
    "requested_agent_type", "collaboration_mode_kind", "model_context_window", "input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens",
    "total_tokens", "artifact_path", "skill_identifiers", "cwd",
]


def event_attributes(events: DataFrame) -> DataFrame:
    """The display row of an event: all optional columns beside its category and summary."""
    return event_category(event_summary(events)).select(*ATTRIBUTES)


# Event type -> the typed view its payload is read as.
TYPED_VIEWS = {
    "tool.call": "tool_call", "shell.call": "tool_call", "tool.result": "tool_result", "shell.result": "tool_result", "mcp.call": "mcp_call",
    "mcp.result": "mcp_result", "info.tokens": "info_tokens", "error": "error", "file.change": "file_change", "agent.started": "agent_turn",
    "agent.completed": "agent_turn", "agent.failed": "agent_turn", "message.agent": "agent_message", "agent.reasoning": "agent_message", "raw.unparsed": "raw",
}


def typed_payload(events: DataFrame) -> DataFrame:
    """Name of the typed view of each event; plan updates with a life cycle read as tool results."""
    rows = ensure_columns(events)
    table = F.create_map(*[F.lit(x) for pair in TYPED_VIEWS.items() for x in pair])
    lifecycle = (_type() == "todo.update") & F.col("operation_id").isNotNull()
    view = (
        F.when(lifecycle | _type().startswith("collab.") | _type().isin("patch.apply", "web.search", "web.open", "stdin.write", "user.input.request"), "tool_result")
        .when(_type() == "todo.update", "todo_update")
        .otherwise(F.coalesce(F.try_element_at(table, _type()), F.lit("value")))
    )
    return rows.withColumn("payload_view", view)
