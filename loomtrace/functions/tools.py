"""Rules on tool names, tool outputs and log text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtrace.functions import exprs as X

# Tool names and the event types they become.
SINGLETON_TOOLS = {
    "update_plan": "todo.update",
    "request_user_input": "user.input.request",
    "write_stdin": "stdin.write",
    "spawn_agent": "collab.spawn_agent",
    "send_input": "collab.send_input",
    "wait": "collab.wait",
    "wait_agent": "collab.wait",
    "close_agent": "collab.close_agent",
    "resume_agent": "collab.resume_agent",
}
SUBAGENT_TOOLS = ["spawn_agent", "send_input", "wait", "wait_agent", "close_agent", "resume_agent"]
SHELL_TOOLS = ["command_execution", "exec_command"]
RESOURCE_TOOLS = ["list_mcp_resources", "list_mcp_resource_templates", "read_mcp_resource"]
SINGLETON_TYPES = sorted(set(SINGLETON_TOOLS.values()))
LEGACY_NAMES = {
    "exec_command_end": "exec_command",
    "collab_agent_spawn_end": "spawn_agent",
    "collab_waiting_end": "wait_agent",
    "collab_close_end": "close_agent",
    "collab_agent_interaction_end": "send_input",
}

# Patterns read from error and message text.
REQUEST_ID = r"\brequest ID ([0-9a-fA-F-]{8,})\b"
RECONNECT = r"Reconnecting\.\.\.\s*(\d+)\s*/\s*(\d+)"
STATUS = r"\bstatus\s+(\d{3})\s+([A-Za-z]+)\b"
URL = r"\burl:\s*(https?://[^\s,)]+|wss?://[^\s,)]+)"
CF_RAY = r"(?i)\bcf-ray:\s*([^\s,)]+)"
DISCONNECT = r"(?i)^(stream disconnected before completion)\b"
FALLBACK = r"(?i)Falling back from ([A-Za-z]+)s? to ([A-Za-z]+) transport"
WEBSOCKET_NAMES = ["websocket", "websockets", "ws", "wss"]
EXIT_LINE = r"(?m)^\s*Process exited with code ([+-]?\d+)\s*$"
TOKEN_COUNT_LINE = r"(?m)^\s*Original token count: ([\d,]+)\s*$"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def tool_event_type(name: Column, is_result: bool) -> Column:
    plain = ("shell.result", "tool.result") if is_result else ("shell.call", "tool.call")
    return F.coalesce(_lookup(SINGLETON_TOOLS, name), F.when(name.isin(*SHELL_TOOLS), plain[0]).otherwise(plain[1]))


def is_singleton_type(event_type: Column) -> Column:
    return event_type.isin(*SINGLETON_TYPES)


def is_subagent_tool(name: Column) -> Column:
    return name.isin(*SUBAGENT_TOOLS)


def resource_server(name: Column, server: str) -> Column:
    """The agent host's own MCP server for the resource tools, null for all others."""
    return F.when(name.isin(*RESOURCE_TOOLS), F.lit(server))


def legacy_name(message_type: Column) -> Column:
    return F.coalesce(_lookup(LEGACY_NAMES, message_type), F.lit("unknown"))


def is_open_page(action_text: Column, action_type: Column) -> Column:
    """The action is the text open_page, or an object of that type."""
    return F.coalesce(X.strip(F.coalesce(action_text, action_type)) == "open_page", F.lit(False))


def response_phase(phase: Column, status: Column) -> Column:
    return F.coalesce(
        X.trim_null(phase),
        F.when(status.isin("started", "in_progress", "running"), "started").when(status == "updated", "updated").otherwise("completed"),
    )


def custom_tool_status(output: Column) -> Column:
    text = F.lower(F.coalesce(output, F.lit("")))
    return F.when(X.contains_any(text, "failed", "error"), "failed").otherwise("completed")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    hit = F.regexp_extract(text, pattern, group)
    return F.when(hit != "", hit)


def exit_code_in(text: Column) -> Column:
    return _found(text, EXIT_LINE).try_cast("int")


def token_count_in(text: Column) -> Column:
    return F.regexp_replace(_found(text, TOKEN_COUNT_LINE), ",", "").try_cast("bigint")


def _transport(name: Column) -> Column:
    lower = F.lower(name)
    return F.when(lower.isin(*WEBSOCKET_NAMES), "websocket").otherwise(lower)


LINK_FIELDS = [
    "request_id", "reconnect_attempt", "reconnect_limit", "status_code", "status_text", "url", "scheme", "host", "cf_ray",
    "disconnect_reason", "is_fallback", "fallback_from", "fallback_to",
]


def text_links(text: Column) -> Column:
    """What a message says about requests, retries, status, address and transport; null if nothing."""
    url = _found(text, URL)
    host = _found(F.regexp_extract(url, r"://([^/]*)", 1), r"^\s*(.*?)\s*$")
    source = _found(text, FALLBACK)
    fields = [
        _found(text, REQUEST_ID),
        _found(text, RECONNECT).try_cast("int"),
        _found(text, RECONNECT, 2).try_cast("int"),
        _found(text, STATUS).try_cast("int"),
        _found(text, STATUS, 2),
        url,
        F.when(host.isNotNull(), _found(url, r"^([^:]+)://")),
        host,
        _found(text, CF_RAY),
        _found(text, DISCONNECT),
        F.when(source.isNotNull(), F.lit(True)),
        _transport(source),
        _transport(_found(text, FALLBACK, 2)),
    ]
    any_found = F.coalesce(*[f.cast("string") for f in fields]).isNotNull()
    return F.when(any_found, F.struct(*[f.alias(n) for n, f in zip(LINK_FIELDS, fields, strict=True)]))


def skill_ids(text: Column) -> Column:
    """Names of the folders whose SKILL.md file a command or its JSON mentions, sorted."""
    plain = F.regexp_replace(text, r'\\[ntr"]', " ")
    tokens = F.transform(
        F.split(plain, r"[\s\"',;()]+"), lambda t: F.regexp_replace(t, r"^[\"'\[\]{}]+|[\"'\[\]{}]+$", "")
    )
    names = F.transform(tokens, lambda t: X.strip(F.regexp_extract(t, r"([^/]+)/+[^/]*SKILL\.md$", 1)))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: ~n.isin("", ".", ".."))))


# Shells and flags whose lead is cut from a rendered command line.
SHELL_NAMES = ["bash", "/bin/bash", "sh", "/bin/sh"]
SHELL_FLAGS = ["-c", "-lc"]


def shell_command(text: Column, words: Column) -> Column:
    """Command line from a string, or from a word list without its shell lead."""
    parts = F.filter(F.transform(words, lambda w: X.strip(w)), lambda w: w != "")
    led = (F.size(parts) >= 3) & F.get(parts, F.lit(0)).isin(*SHELL_NAMES) & F.get(parts, F.lit(1)).isin(*SHELL_FLAGS)
    kept = F.when(led, F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0)))).otherwise(parts)
    return F.coalesce(X.trim_null(text), F.when(F.size(parts) > 0, F.array_join(kept, " ")))
