"""Typed views of event payloads: the VARIANT of an event shredded into one struct per kind of event.

A field keeps its JSON type: text that looks like a number is no number. A field of another type than its view says
spoils the view: the payload stays a plain value then, and `payload_error` names the field. Missing fields and JSON nulls
are null; the payload itself is kept beside the views.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions import json as J

# The fields of each view and their types, `!` marking those that stand for nothing else when missing.
ACTOR = "actor_type text, thread_id text"
PLACE = f"{ACTOR}, parent_thread_id text, session_path text"
COLLAB = (
    "sender_thread_id text, receiver_thread_ids texts, prompt text, agents_states object, detection_source text, detection_confidence text, raw_ref text, "
    "skill_identifiers texts"
)
TOOL = f"{PLACE}, tool_name text!unknown, tool_use_id text, input value, status text, phase text, server text"
MCP = f"{ACTOR}, tool_use_id text, status text, phase text, arguments value, server text, tool text"
TOKENS = ", ".join(f"{n} u64" for n in ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"))
VIEWS = {
    "agent_turn": f"{ACTOR}, usage value, result value, error value, message text, text_links links",
    "agent_message": f"{PLACE}, item_id text, text text!, role text, phase text, text_links links",
    "agent_session": f"{PLACE}, forked_from_id text, cwd text, agent_nickname text, agent_role text",
    "agent_meta": f"{PLACE}, meta_type text!meta",
    "info_tokens": f"{PLACE}, {TOKENS}, total_token_usage value, rate_limits value",
    "tool_call": f"{TOOL}, {COLLAB}",
    "tool_result": f"{TOOL}, output value, error value, stderr value, exit_code i32, {COLLAB}",
    "mcp_call": MCP,
    "mcp_result": f"{MCP}, result value, error value",
    "file_change": f"{ACTOR}, item_id text, status text, changes changes",
    "todo_update": f"{ACTOR}, item_id text, status text, phase text, items items, completed_count u32!0, total_count u32!0",
    "error": f"{ACTOR}, item_id text, status text, phase text, message text, error_type text, request_id text, reconnect_attempt u32, reconnect_limit u32, "
    "is_fallback bool, fallback_from text, fallback_to text, text_links links",
    "raw": f"{ACTOR}, raw value, text text",
    "stderr": "text text!",
}
LINKS = (
    "request_id text, reconnect_attempt u32, reconnect_limit u32, is_fallback bool, fallback_from text, fallback_to text, status_code u16, status_text text, url text, "
    "scheme text, host text, cf_ray text, disconnect_reason text"
)
# The view of each event type.
VIEW_OF = {
    "agent_turn": "agent.started agent.completed agent.failed",
    "agent_message": "message.agent agent.reasoning message.commentary message.user",
    "agent_session": "agent.session",
    "agent_meta": "agent.session.foreign agent.meta task.started task.completed runtime.context context.compacted context.compacted.duplicate agent.aborted",
    "info_tokens": "info.tokens",
    "tool_call": "tool.call shell.call",
    "tool_result": "tool.result shell.result stdin.write web.search web.open patch.apply patch.apply.duplicate collab.spawn_agent collab.send_input collab.wait "
    "collab.close_agent collab.resume_agent",
    "mcp_call": "mcp.call",
    "mcp_result": "mcp.result",
    "file_change": "file.change",
    "error": "error",
    "raw": "raw.unparsed",
    "stderr": "stderr.line",
}
RANGES = {"u64": (0, (1 << 63) - 1), "u32": (0, (1 << 32) - 1), "u16": (0, (1 << 16) - 1), "i32": (-(1 << 31), (1 << 31) - 1)}


class Field(NamedTuple):
    name: str
    value: Column
    fits: Column


def _entries(tree: Column, name: str) -> Column:
    """Objects of the array at the name; no array has none."""
    items = F.coalesce(F.try_variant_get(J.node(tree, f"$.{name}"), "$", "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(items, J.is_object)


def _field(tree: Column, spec: str) -> Field:
    name, kind = spec.split(" ", 1)
    kind, needed, default = kind.partition("!")
    found = J.node(tree, f"$.{name}")
    type_ = J.kind(found)
    absent = found.isNull() | F.coalesce(type_ == "VOID", F.lit(False))
    if kind == "text":
        value, fits = J.text(found, "$"), type_ == "STRING"
    elif kind == "bool":
        value, fits = F.try_variant_get(found, "$", "boolean"), type_ == "BOOLEAN"
    elif kind in RANGES:
        value = J.whole(found, "$")
        fits = value.between(*RANGES[kind])
    elif kind == "value":
        value, fits = F.when(~absent, found), F.lit(True)
    elif kind == "object":
        value, fits = F.when(J.is_object(found), found), type_.startswith("OBJECT")
    elif kind == "texts":
        items = F.try_variant_get(found, "$", "array<variant>")
        value, fits = J.texts(found, "$"), type_.startswith("ARRAY") & F.forall(items, lambda x: F.coalesce(J.kind(x) == "STRING", F.lit(False)))
    elif kind == "changes":
        text = lambda x, n: F.coalesce(J.text(x, f"$.{n}"), F.lit("")).alias(n)
        value, fits = F.transform(_entries(tree, name), lambda x: F.struct(text(x, "kind"), text(x, "path"))), F.lit(True)
    elif kind == "items":
        done = lambda x: F.coalesce(F.when(J.kind(J.node(x, "$.completed")) == "BOOLEAN", F.try_variant_get(x, "$.completed", "boolean")), F.lit(False))
        value = F.transform(_entries(tree, name), lambda x: F.struct(F.coalesce(J.text(x, "$.text"), F.lit("")).alias("text"), done(x).alias("completed")))
        fits = F.lit(True)
    elif kind == "links":
        parts = [_field(found, s) for s in LINKS.split(", ")]
        sizes = {s.split(" ")[0]: RANGES.get(s.split(" ")[1]) for s in LINKS.split(", ")}
        # read leniently, what does not fit is left out and a number wraps round; messages of users and commentary are strict
        wrapped = lambda p: F.when(p.value >= 0, F.pmod(p.value, F.lit(sizes[p.name][1] + 1))) if sizes[p.name] else F.when(p.fits, p.value)
        value = F.when(J.is_object(found), F.struct(*[wrapped(p).alias(p.name) for p in parts]))
        strict = F.col("event_type").isin("message.user", "message.commentary")
        fits = J.is_object(found) & (~strict | reduce(and_, [p.fits for p in parts]))
    if kind in ("changes", "items"):
        return Field(name, value, fits)
    if needed:  # a null is no value for such a field, a missing one is the default
        fits = found.isNull() | F.coalesce(fits & ~absent, F.lit(False))
        value = F.when(found.isNull(), F.lit(int(default) if kind in RANGES else default)).otherwise(value)
    else:
        fits = absent | F.coalesce(fits, F.lit(False))
    return Field(name, value, fits)


def payload_view() -> Column:
    """Name of the view an event type is read as; a plan update with a tool's life cycle is a tool result."""
    table = F.create_map(*[F.lit(x) for view, types in VIEW_OF.items() for t in types.split() for x in (t, view)])
    tree = F.col("payload")
    lifecycle = F.coalesce(J.text(tree, "$.tool_name") == "update_plan", F.lit(False))
    for name in ("tool_use_id", "input", "output"):
        lifecycle = lifecycle | J.node(tree, f"$.{name}").isNotNull()
    update = F.when(lifecycle, "tool_result").otherwise("todo_update")
    kind = F.col("event_type")
    return F.when(J.is_object(tree), F.when(kind == "todo.update", update).otherwise(F.try_element_at(table, kind)))


def typed_payloads(events: DataFrame, views: list[str] | None = None) -> DataFrame:
    """Events with `payload_view`, `payload_error` and one struct column `as_<view>` per view asked for (all by default).

    `events` needs event_type and payload (VARIANT). At most one struct is filled. `payload_view` is `value` where the
    payload is no object, the type has no view, or a field does not fit; `payload_error` then names the first such field.
    Numbers are integers up to 2^63 - 1. Views that are not read are not computed.
    """
    views = list(VIEWS) if views is None else views
    rows = events.withColumn("__view", payload_view())
    tree = F.col("payload")
    fields = {view: [_field(tree, spec) for spec in VIEWS[view].split(", ")] for view in views}
    errors = {
        view: F.when(F.col("__view") == view, F.get(F.array_compact(F.array(*[F.when(~f.fits, F.lit(f.name)) for f in found])), F.lit(0)))
        for view, found in fields.items()
    }
    rows = rows.withColumn("payload_error", F.coalesce(*errors.values()))
    good = F.col("__view").isNotNull() & F.col("payload_error").isNull()
    rows = rows.withColumn("payload_view", F.when(good, F.col("__view")).otherwise("value"))
    shredded = {
        f"as_{view}": F.when(F.col("payload_view") == view, F.struct(*[f.value.alias(f.name) for f in found])) for view, found in fields.items()
    }
    return rows.withColumns(shredded).drop("__view")
