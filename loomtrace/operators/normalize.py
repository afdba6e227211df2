"""Log normalisation: raw JSON lines of many files to canonical flat event rows, in bulk.

`parse_lines` is the bronze step (one parse per line), `normalize_session` and `normalize_stdout`
are the silver steps. State that runs along a file (call names, parent thread, duplicates, echoes)
comes from running values that spread a long file over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions import exprs as X
from loomtrace.functions import json as J
from loomtrace.functions import tools as T
from loomtrace.operators.ordered import SPAN, carry, dealt, enough_parts
from loomtrace.session import cut_lineage

UNPARSED = "raw.unparsed"
ROOT_PARENT = "standalone-root"

# Record and payload types whose event type does not depend on anything else.
EVENT_MESSAGES = {
    "token_count": "info.tokens",
    "task_started": "task.started",
    "task_complete": "task.completed",
    "user_message": "message.user",
    "turn_aborted": "agent.aborted",
    "patch_apply_end": "patch.apply",
}
COLLAB_ENDS = ["collab_agent_spawn_end", "collab_waiting_end", "collab_close_end", "collab_agent_interaction_end"]
STDOUT_TYPES = {
    "thread.started": "thread.started",
    "turn.started": "agent.started",
    "turn.completed": "agent.completed",
    "turn.failed": "agent.failed",
    "error": "error",
}
TOKEN_FIELDS = ["input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"]


def parse_lines(lines: DataFrame) -> DataFrame:
    """Bronze: one row per line with the parsed record and the columns dispatch needs.

    `lines` has session_id, path, seq, value and read_at (the file's time, for lines without one). A line that is no
    UTF-8 has no record; its value shows U+FFFD for what cannot be read.
    """
    readable = F.is_valid_utf8("value")
    lines = lines.withColumn("readable", readable).withColumn("value", F.when(F.col("readable"), F.col("value")).otherwise(F.make_valid_utf8("value")))
    tree = F.when(F.col("readable"), J.parse(F.col("value")))
    rows = lines.withColumn("record", tree).withColumn("valid", J.is_object(F.col("record")))
    payload = F.when(F.col("valid"), J.node(F.col("record"), "$.payload"))
    rows = rows.withColumn("p", F.when(J.is_object(payload), payload))
    return rows.select(
        "session_id", "path", "seq", "value", "valid", "p",
        F.coalesce(J.text(F.col("record"), "$.timestamp"), F.col("read_at")).alias("ts"),
        F.when(F.col("valid"), F.coalesce(J.text(F.col("record"), "$.type"), F.lit("unknown"))).when(F.col("readable"), "invalid_json").otherwise("invalid_utf8").alias("raw_type"),
        F.coalesce(J.text(F.col("p"), "$.type"), F.lit("unknown")).alias("p_type"),
        F.coalesce(J.text(F.col("p"), "$.call_id"), F.lit("")).alias("call_id"),
        J.text(F.col("p"), "$.name").alias("name"),
        J.text(F.col("p"), "$.id").alias("p_id"),
    )


# ---- state along a file ------------------------------------------------------------------------


def resolve_call_names(bronze: DataFrame, parts: int | None = None) -> DataFrame:
    """Add call_name, the tool of the latest earlier call with the id, and patch_ended before it."""
    is_call = (F.col("raw_type") == "response_item") & F.col("p_type").isin("function_call", "custom_tool_call")
    named = F.when(is_call & F.col("p").isNotNull(), F.coalesce("name", F.lit("unknown")))
    patched = F.when((F.col("raw_type") == "event_msg") & (F.col("p_type") == "patch_apply_end"), F.lit(True))
    with_id = carry(
        bronze.where(F.col("call_id") != ""), ["session_id", "call_id"], "seq",
        {"call_name": named, "patch_ended": patched}, inclusive=False, parts=parts,
    )
    return with_id.unionByName(bronze.where(F.col("call_id") == ""), allowMissingColumns=True)


def own_parent() -> Column:
    """Parent thread a file's own session_meta names."""
    own = (F.col("raw_type") == "session_meta") & F.col("p").isNotNull() & (F.coalesce("p_id", "session_id") == F.col("session_id"))
    return F.when(own, J.clean(F.col("p"), "$.source.subagent.thread_spawn.parent_thread_id"))


def carry_context(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Add the running parent thread and the raw type of the previous considered record."""
    considered = F.col("valid") & ((F.col("raw_type") != "event_msg") | F.col("p").isNotNull())
    with_parent = rows.withColumn("own_parent", own_parent()).withColumn("considered_type", F.when(considered, F.col("raw_type")))
    both = carry(
        with_parent, ["session_id"], "seq",
        {"parent_before": F.col("own_parent"), "previous_type": F.col("considered_type")}, inclusive=False, parts=parts,
    )
    parent = F.coalesce("own_parent", "parent_before")
    return both.withColumn("parent_thread_id", F.nullif(parent, F.lit(ROOT_PARENT))).drop("own_parent", "parent_before", "considered_type")


# ---- the session log ---------------------------------------------------------------------------


def _is(raw_type: str, *payload_types: str) -> Column:
    test = (F.col("raw_type") == raw_type) & F.col("p").isNotNull()
    return test & F.col("p_type").isin(*payload_types) if payload_types else test


def _open_page(p: Column) -> Column:
    return T.is_open_page(J.text(p, "$.action"), J.text(p, "$.action.type"))


def message_role(p: Column) -> Column:
    return F.coalesce(F.lower(J.clean(p, "$.role")), F.lit("assistant"))


def joined_text(p: Column, path: str) -> Column:
    """Non-empty texts of a list of parts, one per line."""
    parts = F.try_variant_get(p, path, "array<variant>")
    texts = F.filter(F.transform(parts, lambda x: J.text(x, "$.text")), lambda t: t != "")
    return F.coalesce(X.strip(F.array_join(texts, "\n")), F.lit(""))


def message_direction(p: Column) -> Column:
    parts = F.try_variant_get(p, "$.content", "array<variant>")
    kinds = F.filter(F.transform(parts, lambda x: J.clean(x, "$.type")), lambda t: t.isin("input_text", "output_text"))
    return F.get(kinds, F.lit(0))


def _tool_name() -> Column:
    legacy = F.coalesce("call_name", T.legacy_name(F.col("p_type")))
    return (
        F.when(_is("response_item", "function_call", "custom_tool_call"), F.coalesce("name", F.lit("unknown")))
        .when(_is("response_item", "function_call_output", "custom_tool_call_output"), F.coalesce("call_name", F.lit("unknown")))
        .when(_is("response_item", "web_search_call") | _is("event_msg", "web_search_end"), "web_search_call")
        .when(_is("event_msg", "patch_apply_end"), "apply_patch")
        .when(_is("event_msg", "exec_command_end", *COLLAB_ENDS), legacy)
        .when(_is("event_msg", "item_completed"), "update_plan")
    )


def session_event_type() -> Column:
    """Dispatch on record type, payload type and the resolved tool name."""
    p, tool = F.col("p"), F.col("tool_name")
    plain = F.create_map(*[F.lit(x) for pair in EVENT_MESSAGES.items() for x in pair])
    resource = tool.isin(*T.RESOURCE_TOOLS)
    plan = J.text(p, "$.item.type") == "Plan"
    return (
        F.when(~F.col("valid"), UNPARSED)
        .when(_is("session_meta"), F.when(F.coalesce("p_id", "session_id") == F.col("session_id"), "agent.session").otherwise("agent.session.foreign"))
        .when(_is("response_item", "function_call"), F.when(resource, "mcp.call").otherwise(T.tool_event_type(tool, False)))
        .when(_is("response_item", "function_call_output"), F.when(resource, "mcp.result").otherwise(T.tool_event_type(tool, True)))
        .when(_is("response_item", "custom_tool_call"), F.when(tool == "apply_patch", "patch.apply").otherwise("tool.call"))
        .when(
            _is("response_item", "custom_tool_call_output"),
            F.when(tool == "apply_patch", F.when(F.col("patch_ended"), "patch.apply.duplicate").otherwise("patch.apply")).otherwise("tool.result"),
        )
        .when(_is("response_item", "web_search_call") | _is("event_msg", "web_search_end"), F.when(_open_page(p), "web.open").otherwise("web.search"))
        .when(_is("response_item", "message") | _is("event_msg", "agent_message"), F.concat(F.lit("message."), message_role(p)))
        .when(_is("response_item", "reasoning"), "agent.reasoning")
        .when(F.col("raw_type") == "compacted", "context.compacted")
        .when(
            _is("event_msg", "context_compacted"),
            F.when(F.col("previous_type") == "compacted", "context.compacted.duplicate").otherwise("context.compacted"),
        )
        .when(_is("event_msg", *EVENT_MESSAGES), F.try_element_at(plain, F.col("p_type")))
        .when(_is("event_msg", "exec_command_end", *COLLAB_ENDS), T.tool_event_type(tool, True))
        .when(_is("event_msg", "item_completed") & F.coalesce(plan, F.lit(False)), "todo.update")
        .when(F.col("raw_type") == "turn_context", "runtime.context")
        .otherwise(UNPARSED)
    )


def quarantine_reason() -> Column:
    """Why a line has no event type of its own; null for parsed ones."""
    p, raw = F.col("p"), F.col("raw_type")
    item = J.node(p, "$.item")
    return F.when(F.col("event_type") == UNPARSED, (
        F.when(~F.col("valid"), raw)
        .when(raw.isin("session_meta", "response_item", "event_msg") & p.isNull(), F.concat(F.lit("missing "), raw, F.lit(" payload object")))
        .when(raw == "response_item", F.concat(F.lit("unsupported response_item.type="), F.col("p_type")))
        .when(_is("event_msg", "item_completed") & ~J.is_object(item), "missing item_completed item object")
        .when(_is("event_msg", "item_completed"), F.concat(F.lit("unsupported item_completed item.type="), F.coalesce(J.text(item, "$.type"), F.lit("unknown"))))
        .when(raw == "event_msg", F.concat(F.lit("unsupported event_msg.type="), F.col("p_type")))
        .otherwise(F.concat(F.lit("unsupported subagent record type="), raw))
    ))


def legacy_status(p: Column) -> Column:
    """Status of an end message: text, the key of a one-key object, a flag; completed by default."""
    status = J.node(p, "$.status")
    keys = F.map_keys(F.try_variant_get(status, "$", "map<string,variant>"))
    as_text = J.text(p, "$.status")
    flag = F.try_variant_get(status, "$", "boolean")
    return (
        F.when(X.strip(as_text) != "", as_text)
        .when(J.is_object(status) & (F.size(keys) == 1), F.get(keys, F.lit(0)))
        .when((J.kind(status) == "BOOLEAN") & ~flag, "failed")
        .otherwise("completed")
    )


def legacy_receivers(p: Column, message_type: Column) -> Column:
    """Threads an end message is about, in the order it names them; null for none."""
    one = lambda path: F.array_compact(F.array(J.text(p, path)))
    listed = F.filter(
        F.transform(F.try_variant_get(p, "$.agent_statuses", "array<variant>"), lambda x: J.text(x, "$.thread_id")), lambda x: x.isNotNull()
    )
    keyed = F.map_keys(F.try_variant_get(p, "$.statuses", "map<string,variant>"))
    empty = F.array().cast("array<string>")
    waited = F.array_distinct(F.concat(F.coalesce(listed, empty), F.coalesce(F.array_sort(keyed), empty)))
    found = (
        F.when(message_type == "collab_agent_spawn_end", one("$.new_thread_id"))
        .when(message_type.isin("collab_close_end", "collab_agent_interaction_end"), one("$.receiver_thread_id"))
        .when(message_type == "collab_waiting_end", waited)
    )
    return F.when(F.size(found) > 0, found)


def legacy_states(p: Column, message_type: Column) -> Column:
    """What an end message reports of each thread, as (thread_id, status, message); null for nothing."""

    def alone(thread: str, status: Column, message: Column) -> Column:
        name = J.text(p, thread)
        return F.when(name.isNotNull(), F.array(F.struct(name.alias("thread_id"), status.alias("status"), message.alias("message"))))

    blank = F.lit(None).cast("string")
    listed = F.filter(F.try_variant_get(p, "$.agent_statuses", "array<variant>"), lambda x: J.text(x, "$.thread_id").isNotNull())
    listed = F.transform(listed, lambda x: F.struct(J.text(x, "$.thread_id").alias("thread_id"), J.text(x, "$.status").alias("status"), blank.alias("message")))
    waited = F.when(J.is_object(J.node(p, "$.statuses")), J.agent_states(p, "$.statuses")).otherwise(listed)
    found = (
        F.when(message_type == "collab_agent_spawn_end", alone("$.new_thread_id", J.text(p, "$.status"), blank))
        .when(
            message_type.isin("collab_close_end", "collab_agent_interaction_end"),
            alone("$.receiver_thread_id", F.coalesce(J.text(p, "$.status"), J.text(p, "$.status.status")), J.text(p, "$.status.message")),
        )
        .when(message_type == "collab_waiting_end", waited)
    )
    return F.when(F.size(found) > 0, found)


def _phase() -> Column:
    p, kind = F.col("p"), F.col("event_type")
    call = F.when(T.is_singleton_type(kind) | (kind == "mcp.call"), "started")
    return (
        F.when(_is("response_item", "function_call"), call)
        .when(_is("response_item", "custom_tool_call"), F.when(kind == "patch.apply", "started"))
        .when(_is("response_item", "function_call_output", "custom_tool_call_output"), "completed")
        .when(_is("response_item", "web_search_call"), T.response_phase(J.text(p, "$.phase"), J.text(p, "$.status")))
        .when(_is("response_item", "message", "reasoning") | _is("event_msg", "agent_message"), J.text(p, "$.phase"))
        .when(_is("event_msg", "patch_apply_end", "exec_command_end", "web_search_end", *COLLAB_ENDS), "completed")
        .when(kind == "todo.update", "completed")
    )


def _status() -> Column:
    p, kind = F.col("p"), F.col("event_type")
    output = J.text(p, "$.output")
    success = F.when(J.kind(J.node(p, "$.success")) == "BOOLEAN", F.try_variant_get(p, "$.success", "boolean"))
    return (
        F.when(_is("response_item", "function_call_output"), F.when(~T.is_singleton_type(kind), "completed"))
        .when(_is("response_item", "custom_tool_call", "web_search_call"), J.text(p, "$.status"))
        .when(_is("response_item", "custom_tool_call_output"), F.when(kind.startswith("patch.apply"), T.custom_tool_status(output)))
        .when(_is("event_msg", "patch_apply_end"), F.when(success, "completed").when(~success, "failed"))
        .when(_is("event_msg", "exec_command_end"), F.coalesce(J.text(p, "$.status"), F.lit("completed")))
        .when(_is("event_msg", *COLLAB_ENDS), legacy_status(p))
        .when(_is("event_msg", "web_search_end") | (kind == "todo.update") & _is("event_msg", "item_completed"), "completed")
    )


def _duplicate_of() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind == "patch.apply.duplicate", "event_msg.patch_apply_end")
        .when(kind == "context.compacted.duplicate", "compacted")
        .when(_is("event_msg", "exec_command_end", *COLLAB_ENDS), "response_item.function_call_output")
        .when(_is("event_msg", "web_search_end"), "response_item.web_search_call")
        .when(_is("event_msg", "item_completed") & (kind == "todo.update"), "response_item.message")
    )


def _text() -> Column:
    p = F.col("p")
    return (
        F.when(_is("response_item", "message"), joined_text(p, "$.content"))
        .when(_is("response_item", "reasoning"), joined_text(p, "$.summary"))
        .when(_is("event_msg", "agent_message", "user_message"), F.coalesce(J.text(p, "$.message"), F.lit("")))
    )


def _silver_columns(resource_server: str) -> dict[str, Column]:
    p, kind, tool = F.col("p"), F.col("event_type"), F.col("tool_name")
    call = _is("response_item", "function_call")
    spawn_call, spawn_end = call & (tool == "spawn_agent"), F.col("is_output") & (tool == "spawn_agent")
    args, out = F.col("arguments"), F.col("output")
    raw_output = F.when(_is("response_item", "function_call_output"), J.text(p, "$.output"))
    shell_output = F.col("is_output") & tool.isin(*T.SHELL_TOOLS)
    message = _is("response_item", "message") | _is("event_msg", "agent_message")
    collab = _is("event_msg", *COLLAB_ENDS)
    command_end = _is("event_msg", "exec_command_end")
    plan = _is("event_msg", "item_completed") & (kind == "todo.update")
    context = F.when(_is("turn_context"), p)
    new_thread = F.coalesce(J.clean(out, "$.agent_id"), J.clean(out, "$.thread_id"))
    meta = F.when(kind.startswith("agent.session"), p)
    skills = F.when(call & tool.isin(*T.SHELL_TOOLS), T.skill_ids(J.as_text(args))).when(
        command_end, T.skill_ids(F.concat_ws(" ", J.as_text(J.node(p, "$.command")), J.as_text(J.node(p, "$.parsed_cmd"))))
    )
    plain = X.trim_null
    return {
        "operation_id": plain(
            F.when(_is("response_item", "web_search_call"), F.col("p_id"))
            .when(plan, J.text(p, "$.item.id"))
            .when(tool.isNotNull(), F.col("call_id"))
        ),
        "scope_thread_id": F.col("session_id"),
        "sender_thread_id": F.when(collab, J.clean(p, "$.sender_thread_id")),
        "turn_id": F.when(_is("event_msg", "task_started", "task_complete", "turn_aborted", "exec_command_end"), J.clean(p, "$.turn_id")),
        "role": F.when(message, message_role(p)).when(_is("event_msg", "user_message"), "user").when(_is("response_item", "reasoning"), J.text(p, "$.role")),
        "direction": F.when(_is("response_item", "message"), message_direction(p))
        .when(_is("event_msg", "agent_message"), "output_text").when(_is("event_msg", "user_message"), "input_text"),
        "mcp_server": F.when(kind.isin("mcp.call", "mcp.result"), T.resource_server(tool, resource_server)),
        "reason": F.when(kind == "agent.aborted", J.clean(p, "$.reason")),
        "error_text": F.when(kind == "agent.aborted", J.clean(p, "$.reason")),
        "collaboration_mode_kind": F.when(kind == "task.started", J.clean(p, "$.collaboration_mode_kind")),
        "model_context_window": F.when(kind == "task.started", J.clean(p, "$.model_context_window")),
        **{c: F.when(kind == "info.tokens", J.whole(p, f"$.info.total_token_usage.{c}")) for c in TOKEN_FIELDS},
        "cwd": F.when(command_end, J.text(p, "$.cwd")).otherwise(J.text(meta, "$.cwd")),
        "agent_nickname": J.clean(meta, "$.agent_nickname"),
        "agent_role": J.clean(meta, "$.agent_role"),
        "forked_from_id": J.clean(meta, "$.forked_from_id"),
        "foreign_thread_id": F.when(kind == "agent.session.foreign", F.col("p_id")),
        "prompt": F.when(spawn_call, F.coalesce(J.clean(args, "$.message"), J.clean(args, "$.prompt"))).when(collab, J.text(p, "$.prompt")),
        "requested_agent_type": F.when(spawn_call, J.clean(args, "$.agent_type")),
        "model": F.when(spawn_call, J.clean(args, "$.model")).when(collab, J.clean(p, "$.model")),
        "reasoning_effort": F.when(spawn_call, J.clean(args, "$.reasoning_effort")).when(collab, J.clean(p, "$.reasoning_effort")),
        "new_thread_id": F.when(spawn_end, new_thread).when(collab, J.text(p, "$.new_thread_id")),
        "new_agent_nickname": F.when(spawn_end, F.coalesce(J.clean(out, "$.nickname"), J.clean(out, "$.agent_nickname"))).when(collab, J.text(p, "$.new_agent_nickname")),
        "receiver_role": F.when(spawn_end, J.clean(out, "$.agent_role")).when(collab, F.coalesce(J.clean(p, "$.new_agent_role"), J.clean(p, "$.receiver_agent_role"))),
        "receiver_thread_ids": F.when(spawn_end & new_thread.isNotNull(), F.array(new_thread)).when(collab, legacy_receivers(p, F.col("p_type"))),
        "agents_states": F.when(collab, legacy_states(p, F.col("p_type"))),
        "detection_confidence": F.when(collab, F.when(T.is_subagent_tool(tool), "high").otherwise("medium")),
        "exit_code": F.when(shell_output, F.coalesce(J.whole(out, "$.exit_code").try_cast("int"), T.exit_code_in(raw_output)))
        .when(command_end, J.whole(p, "$.exit_code").try_cast("int")),
        "original_token_count": F.when(shell_output, F.coalesce(J.whole(out, "$.original_token_count"), T.token_count_in(raw_output))),
        "input_command": F.when(call, T.shell_command(F.coalesce(J.text(args, "$.command"), J.text(args, "$.cmd")), F.coalesce(J.texts(args, "$.command"), J.texts(args, "$.cmd"))))
        .when(command_end, T.shell_command(J.text(p, "$.command"), J.texts(p, "$.command"))),
        "skill_identifiers": F.when(F.size(skills) > 0, skills),
        "runtime_start_context_size": F.coalesce(J.whole(context, "$.start_context_size"), J.whole(context, "$.context.start_context_size")),
        "runtime_mcp_servers": F.coalesce(J.size(context, "$.mcp_servers"), J.size(context, "$.context.mcp_servers")),
        "runtime_skills": F.coalesce(J.size(context, "$.skills"), J.size(context, "$.context.skills")),
    }


def normalize_session(bronze: DataFrame, task_id: str | None = None, resource_server: str = "agent") -> DataFrame:
    """Canonical events of session logs; `bronze` is parse_lines' result, stored or pinned.

    `resource_server` names the MCP server the agent host gives its own resource tools.
    """
    parts = enough_parts(bronze)
    rows = carry_context(resolve_call_names(bronze, parts), parts).withColumn("tool_name", _tool_name())
    rows = rows.withColumn("event_type", session_event_type())
    rows = rows.withColumns(
        {
            "reason_unparsed": quarantine_reason(),
            "is_output": _is("response_item", "function_call_output"),
            "arguments": F.when(
                _is("response_item", "function_call"),
                F.coalesce(J.parse(J.text(F.col("p"), "$.arguments")), J.node(F.col("p"), "$.arguments")),
            ),
            "output": F.when(
                _is("response_item", "function_call_output"), F.coalesce(J.parse(J.text(F.col("p"), "$.output")), J.node(F.col("p"), "$.output"))
            ),
        }
    )
    status = F.when(~F.col("valid"), "unparsed").when(F.col("event_type") == UNPARSED, "best_effort").otherwise("parsed")
    silver = rows.select(
        F.lit(1).alias("schema_version"), "session_id", F.col("session_id").alias("run_id"),
        (F.lit(task_id) if task_id else F.col("session_id")).alias("task_id"), "seq", "ts", "event_type", "raw_type",
        status.alias("parse_status"), F.lit("subagent_session").alias("source"), F.lit("subagent").alias("actor_type"),
        F.col("session_id").alias("thread_id"), "parent_thread_id", F.col("path").alias("session_path"),
        F.when(F.col("event_type") != UNPARSED, F.col("tool_name")).alias("tool_name"),
        _phase().alias("phase"), _status().alias("status"), _duplicate_of().alias("duplicate_of"), _text().alias("text"),
        F.col("reason_unparsed"), *[c.alias(n) for n, c in _silver_columns(resource_server).items()],
        F.when(F.col("event_type") == UNPARSED, F.col("value")).alias("raw_line"), F.col("p").alias("payload"), "p_type",
        F.coalesce("arguments", J.node(F.col("p"), "$.input")).alias("input"), F.coalesce("output", J.node(F.col("p"), "$.output")).alias("output"),
    )
    return drop_message_echo(cut_lineage(silver)).drop("p_type")


def _is_message() -> Column:
    return (F.col("raw_type") == "response_item") & (F.col("p_type") == "message") | (F.col("raw_type") == "event_msg") & F.col(
        "p_type"
    ).isin("agent_message", "user_message")


def _breaks_or_joins() -> Column:
    """Records that reach the end of dispatch; the early returns leave the echo state alone."""
    early = (
        F.col("event_type").isin("agent.session.foreign", "patch.apply.duplicate", "context.compacted.duplicate")
        | (F.col("parse_status") == "unparsed")
        | F.coalesce(F.col("reason_unparsed").startswith("missing "), F.lit(False))
    )
    return ~early


def _continues(before: Column, message: Column) -> Column:
    same = before.isNotNull() & (message["text"] != "") & before.eqNullSafe(message)
    return F.coalesce(same, F.lit(False))


def _echo_seeds(considered: DataFrame) -> DataFrame:
    """(session_id, span, seed): the last message and the opener of its run before each span.

    A span does to this state what its first record, its last one and its last sure opener say; a span that goes on with
    one message throughout hands the opener on. So spans are put together by two windows over one row each.
    """
    here = Window.partitionBy("session_id", "span").orderBy("seq")
    before = F.lag(F.struct("message")).over(here)
    opens = F.col("message").isNotNull() & before.isNotNull() & ~_continues(before["message"], F.col("message"))
    marked = considered.withColumn("opens", F.coalesce(opens, F.lit(False)))
    spans = marked.groupBy("session_id", "span").agg(
        F.min_by(F.struct("message", "origin"), "seq").alias("first"), F.max_by(F.struct("message"), "seq").alias("last"),
        F.max_by("origin", F.when(F.col("opens"), F.col("seq"))).alias("opener"),
    )
    earlier = Window.partitionBy("session_id").orderBy("span")
    spans = spans.withColumn("before", F.lag("last").over(earlier))
    first_opens = F.col("first.message").isNotNull() & ~_continues(F.col("before.message"), F.col("first.message"))
    spans = spans.withColumn("told", F.coalesce("opener", F.when(first_opens, F.col("first.origin"))))
    opener = F.last("told", ignorenulls=True).over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    return spans.select("session_id", "span", F.struct(F.col("before.message").alias("message"), opener.alias("opener")).alias("seed"))


def drop_message_echo(silver: DataFrame, span: int = SPAN) -> DataFrame:
    """Drop a message that repeats the one just before it from the other source.

    Runs of equal messages keep the source that opened the run. Events are dealt once, by spans of their session; what a
    span has to know of earlier ones comes from one row per span.
    """
    message = F.struct(F.col("role"), X.trim_null(F.col("phase")).alias("phase"), X.strip(F.col("text")).alias("text"))
    rows = silver.withColumns(
        {"__span": F.floor(F.col("seq") / span), "__counts": F.coalesce(_breaks_or_joins(), F.lit(False)), "__message": F.when(_is_message(), message)}
    )
    considered = rows.where("__counts").select("session_id", "seq", F.col("__span").alias("span"), F.col("__message").alias("message"), F.col("raw_type").alias("origin"))
    seeds = _echo_seeds(considered).withColumnsRenamed({"session_id": "__session", "span": "__its_span", "seed": "__seed"})
    rows = dealt(rows, enough_parts(silver), "session_id", "__span")
    seeded = rows.join(seeds, (F.col("session_id") == F.col("__session")) & (F.col("__span") == F.col("__its_span")), "left")
    here = Window.partitionBy("session_id", "__span").orderBy("seq")
    said = F.when(F.col("__counts"), F.struct(F.col("__message").alias("message")))
    last = F.last(said, ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, -1))
    # a record of the span itself tells, be it a message or not; else what came before the span
    before = F.when(last.isNotNull(), last["message"]).otherwise(F.col("__seed.message"))
    seeded = seeded.withColumn("__before", before)
    is_message = F.col("__counts") & F.col("__message").isNotNull()
    opened = F.when(is_message & ~_continues(F.col("__before"), F.col("__message")), F.col("raw_type"))
    opener = F.coalesce(F.last(opened, ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0)), F.col("__seed.opener"))
    echo = F.coalesce(is_message & (F.col("raw_type") != opener), F.lit(False))
    return seeded.withColumn("__echo", echo).where("NOT __echo").select(*silver.columns)


def run_counters(events: DataFrame) -> DataFrame:
    """How often each event type, tool and sub-agent tool occurs in a run; calls and results both count."""
    tool = F.when(F.col("event_type") != UNPARSED, F.col("tool_name"))
    kinds = F.array(
        F.struct(F.lit("event").alias("counter"), F.col("event_type").alias("name")),
        F.when(tool.isNotNull(), F.struct(F.lit("tool").alias("counter"), tool.alias("name"))),
        F.when(T.is_subagent_tool(tool), F.struct(F.lit("subagent").alias("counter"), tool.alias("name"))),
    )
    rows = events.select("run_id", F.explode(F.array_compact(kinds)).alias("c"))
    return rows.groupBy("run_id", F.col("c.counter").alias("counter"), F.col("c.name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


def subagent_threads(events: DataFrame) -> DataFrame:
    """Distinct receivers of collaboration calls with the first event that names them."""
    rows = events.where(F.col("receiver_thread_ids").isNotNull()).select(
        "run_id", "seq", F.explode(F.transform("receiver_thread_ids", lambda x: X.strip(x))).alias("thread_id")
    )
    return rows.where(F.col("thread_id") != "").groupBy("run_id", "thread_id").agg(F.min("seq").alias("first_seq"))


def quarantine(events: DataFrame) -> DataFrame:
    """Events without a type of their own, with the reason and the line."""
    return events.where(F.col("event_type") == UNPARSED).select("session_id", "seq", "parse_status", "reason_unparsed", "raw_line")


# ---- the stdout log ----------------------------------------------------------------------------


def unwrap_item(item: Column, raw_type: Column, value: Column) -> Column:
    """struct(item, kind): the innermost item of nested `item.*` records and the type of the record around it.

    A line has at most as many levels as opening braces, so the walk ends at any depth.
    """
    # Records that wrap an item.
    nested = lambda x: F.coalesce(
        J.text(x, "$.type").isin("item.started", "item.updated", "item.completed") & J.is_object(J.node(x, "$.item")), F.lit(False)
    )
    start = F.struct(item.alias("item"), raw_type.alias("kind"))
    levels = F.sequence(F.lit(1), F.length(value) - F.length(F.replace(value, F.lit("{"), F.lit(""))))
    step = lambda acc, _: F.when(
        nested(acc["item"]), F.struct(J.node(acc["item"], "$.item").alias("item"), J.text(acc["item"], "$.type").alias("kind"))
    ).otherwise(acc)
    return F.when(nested(item), F.aggregate(levels, start, step)).otherwise(start)


def normalize_stdout(bronze_lines: DataFrame) -> DataFrame:
    """Canonical events of stdout logs: run_id, task_id, seq, value, read_at per line.

    Nested `item.*` records are unwrapped; the thread is the last one started.
    """
    tree = J.parse(F.col("value"))
    rows = bronze_lines.withColumn("record", tree).withColumn("valid", J.is_object(F.col("record")))
    rows = rows.withColumn(
        "raw_type", F.when(F.col("valid"), F.coalesce(J.text(F.col("record"), "$.type"), F.lit("unknown"))).otherwise("invalid_json")
    )
    item_record = F.col("raw_type").startswith("item.")
    first = J.node(F.col("record"), "$.item")
    inner = F.when(item_record & J.is_object(first), unwrap_item(first, F.col("raw_type"), F.col("value")))
    inner_type = F.coalesce(inner["kind"], F.col("raw_type"))
    rows = rows.withColumns(
        {
            "item": inner["item"],
            "item_phase": F.when(item_record, F.when(inner_type == "item.started", "started").when(inner_type == "item.updated", "updated").otherwise("completed")),
            "started_thread": F.when(F.col("raw_type") == "thread.started", F.struct(J.text(F.col("record"), "$.thread_id").alias("id"))),
        }
    )
    rows = rows.withColumn("item_type", F.when(F.col("item").isNotNull(), F.coalesce(J.text(F.col("item"), "$.type"), F.lit("unknown"))))
    keep = ["run_id", "task_id", "seq", "value", "read_at", "valid", "raw_type", "record", "item", "item_phase", "item_type", "started_thread"]
    rows = cut_lineage(rows.select(*keep))
    rows = carry(rows, ["run_id"], "seq", {"thread": F.col("started_thread")}, parts=enough_parts(rows))
    item, record, kind = F.col("item"), F.col("record"), F.col("item_type")
    it = lambda *types: F.coalesce(kind.isin(*types), F.lit(False))
    phase = F.col("item_phase")
    # The tool name an item without one stands for.
    tool = (
        F.when(it("command_execution"), "command_execution")
        .when(it("mcp_tool_call"), F.coalesce(J.text(item, "$.tool"), F.lit("mcp_tool_call")))
        .when(it("web_search"), "web_search")
        .when(it("collab_tool_call"), F.coalesce(J.text(item, "$.tool"), F.lit("collab_tool_call")))
        .when(it("tool_use", "tool_result"), F.coalesce(J.text(item, "$.name"), F.lit("unknown")))
    )
    plain = F.create_map(*[F.lit(x) for pair in STDOUT_TYPES.items() for x in pair])
    collab_type = F.when(T.is_subagent_tool(tool), T.tool_event_type(tool, True))
    started = phase == "started"
    event_type = (
        F.when(~F.col("valid"), UNPARSED)
        .when(it("agent_message"), "message.agent")
        .when(it("reasoning"), "agent.reasoning")
        .when(it("error"), "error")
        .when(it("command_execution"), F.when(started, "shell.call").otherwise("shell.result"))
        .when(it("mcp_tool_call"), F.when(started, "mcp.call").otherwise("mcp.result"))
        .when(it("web_search"), F.when(_open_page(item), "web.open").otherwise("web.search"))
        .when(it("todo_list"), "todo.update")
        .when(it("collab_tool_call"), F.coalesce(collab_type, F.when(phase == "completed", "tool.result").otherwise("tool.call")))
        .when(it("tool_use"), T.tool_event_type(tool, False))
        .when(it("tool_result"), T.tool_event_type(tool, True))
        .when(it("file_change"), "file.change")
        .when(kind.isNotNull(), UNPARSED)
        .otherwise(F.coalesce(F.try_element_at(plain, F.col("raw_type")), F.lit(UNPARSED)))
    )
    rows = rows.withColumn("tool_name", tool).withColumn("event_type", event_type)
    et = F.col("event_type")
    parsed = F.when(~F.col("valid"), "unparsed").when(et == UNPARSED, "best_effort").otherwise("parsed")
    sender = J.text(item, "$.sender_thread_id")
    thread = F.when(it("collab_tool_call"), F.coalesce(sender, F.col("thread.id"))).otherwise(F.col("thread.id"))
    message = F.coalesce(J.text(item, "$.message"), J.text(record, "$.message"))
    failure = F.when(et == "agent.failed", F.coalesce(J.text(record, "$.message"), J.text(record, "$.error.message")))
    text = F.when(it("agent_message", "reasoning"), F.coalesce(J.text(item, "$.text"), F.lit("")))
    todos = F.when(it("todo_list"), F.filter(F.try_variant_get(item, "$.items", "array<variant>"), J.is_object))
    changes = F.when(it("file_change"), F.filter(F.try_variant_get(item, "$.changes", "array<variant>"), J.is_object))
    receivers = F.when(it("collab_tool_call"), J.texts(item, "$.receiver_thread_ids"))
    skills = F.when(it("command_execution"), T.skill_ids(J.as_text(J.node(item, "$.command"))))
    item_has_phase = it("error", "mcp_tool_call", "web_search", "todo_list", "collab_tool_call")
    singleton = T.is_singleton_type(et)
    columns = {
        "thread_id": F.when(F.col("valid"), X.trim_null(thread)),
        "sender_thread_id": F.when(it("collab_tool_call"), X.trim_null(sender)),
        "operation_id": X.trim_null(
            F.when(it("tool_result"), F.coalesce(J.text(item, "$.tool_use_id"), J.text(item, "$.id"))).otherwise(J.text(item, "$.id"))
        ),
        "phase": F.when(item_has_phase, phase).when(it("tool_use") & singleton, "started").when(it("tool_result") & singleton, "completed"),
        "status": J.text(item, "$.status"),
        "text": text,
        "message": F.when(et == "error", message).when(et == "agent.failed", J.text(record, "$.message")),
        "error_text": F.when(et == "error", F.coalesce(J.text(item, "$.type"), J.text(record, "$.type"))).when(
            et == "agent.failed", J.clean(record, "$.message")
        ),
        "text_links": T.text_links(F.coalesce(text, F.when(et == "error", message), failure)),
        "exit_code": F.when(it("command_execution") & ~started, J.whole(item, "$.exit_code").try_cast("int")),
        "input_command": F.when(it("command_execution"), T.shell_command(J.text(item, "$.command"), J.texts(item, "$.command"))),
        "mcp_server": F.when(it("mcp_tool_call"), J.text(item, "$.server")),
        "receiver_thread_ids": receivers,
        "agents_states": F.when(it("collab_tool_call"), J.agent_states(item, "$.agents_states")),
        "prompt": F.when(it("collab_tool_call"), J.text(item, "$.prompt")),
        "detection_confidence": F.when(it("collab_tool_call"), F.when(T.is_subagent_tool(tool), "high").otherwise("medium")).when(
            it("tool_use") & T.is_subagent_tool(tool), "high"
        ),
        "todo_total": F.size(todos).cast("bigint"),
        "todo_completed": F.size(F.filter(todos, lambda x: F.coalesce(F.try_variant_get(x, "$.completed", "boolean"), F.lit(False)))).cast("bigint"),
        "file_changes": F.transform(
            changes, lambda x: F.struct(F.coalesce(J.text(x, "$.kind"), F.lit("")).alias("kind"), F.coalesce(J.text(x, "$.path"), F.lit("")).alias("path"))
        ),
        "skill_identifiers": F.when(F.size(skills) > 0, skills),
    }
    return rows.select(
        F.lit(1).alias("schema_version"), F.col("run_id").alias("session_id"), "run_id", "task_id", "seq", F.col("read_at").alias("ts"),
        "event_type", "raw_type", parsed.alias("parse_status"), F.lit("json_output").alias("source"), F.lit("agent").alias("actor_type"),
        "tool_name", *[c.alias(n) for n, c in columns.items()],
        F.when(et == UNPARSED, F.col("value")).alias("raw_line"), F.coalesce(item, record).alias("payload"),
    )


def turn_outcome_state(events: DataFrame) -> DataFrame:
    """Per run: flags, last terminal turn, and the final agent message.

    The last message of a closed turn is final; one after `turn.completed` replaces it.
    """
    rows = events.where(
        F.col("event_type").isin("agent.started", "agent.completed", "agent.failed", "thread.started", "error", "message.agent", UNPARSED)
    )
    turn = F.when(F.col("event_type").isin("agent.started", "agent.completed", "agent.failed"), F.col("event_type"))
    said = F.when((F.col("event_type") == "message.agent") & (X.strip(F.col("text")) != ""), F.col("text"))
    rows = cut_lineage(rows.select("run_id", "seq", "event_type", "parse_status", "raw_type", said.alias("said"), turn.alias("turn")))
    rows = carry(rows, ["run_id"], "seq", {"turn_before": F.when(F.col("turn").isNotNull(), F.struct("turn", "seq")), "said_before": F.when(F.col("said").isNotNull(), F.struct("said", "seq"))}, inclusive=False)
    opened = F.when(F.col("turn_before.turn") == "agent.started", F.col("turn_before.seq"))
    closing = (F.col("event_type") == "agent.completed") & (F.col("said_before.seq") > opened)
    late = F.col("said").isNotNull() & (F.col("turn_before.turn") == "agent.completed")
    final = F.when(closing, F.col("said_before.said")).when(late, F.col("said"))
    is_ = lambda name: F.coalesce(F.bool_or(F.col("event_type") == name), F.lit(False))
    ended = F.when(F.col("turn").isin("agent.completed", "agent.failed"), F.col("seq"))
    return rows.groupBy("run_id").agg(
        F.coalesce(~F.bool_or(F.col("parse_status") == "unparsed"), F.lit(True)).alias("valid_json"),
        is_("agent.completed").alias("saw_turn_completed"),
        is_("agent.failed").alias("saw_turn_failed"),
        is_("thread.started").alias("saw_thread_started"),
        F.bool_or((F.col("event_type") == "error") & (F.col("raw_type") == "error")).alias("saw_top_error"),
        F.max_by(F.regexp_replace("turn", "^agent", "turn"), ended).alias("last_terminal"),
        F.max_by(final, F.when(final.isNotNull(), F.col("seq"))).alias("final_agent_message"),
    )
