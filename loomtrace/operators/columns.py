"""The flat event row every operator reads; absent columns are added as typed nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS_SCHEMA_VERSION = 5
METRICS_PROJECTION_VERSION = 9

EVENT_COLUMNS = {
    "session_id": "string", "run_id": "string", "task_id": "string", "seq": "bigint", "ts": "string",
    "event_type": "string", "raw_type": "string", "parse_status": "string", "source": "string",
    "thread_id": "string", "sender_thread_id": "string", "parent_thread_id": "string", "turn_id": "string",
    "operation_id": "string", "scope_thread_id": "string", "phase": "string", "status": "string",
    "duplicate_of": "string", "role": "string", "direction": "string", "text": "string", "tool_name": "string",
    "command": "string", "error_text": "string", "title": "string", "reason": "string",
    "input_tokens": "bigint", "cached_input_tokens": "bigint", "output_tokens": "bigint",
    "reasoning_output_tokens": "bigint", "total_tokens": "bigint",
    "agent_role": "string", "receiver_role": "string", "requested_agent_type": "string",
    "collaboration_mode_kind": "string", "model_context_window": "string", "actor_type": "string",
    "artifact_path": "string", "runtime_start_context_size": "bigint", "context_size": "bigint",
    "runtime_mcp_servers": "bigint", "runtime_skills": "bigint", "exit_code": "int",
    "agent_nickname": "string", "cwd": "string", "skill_identifiers": "array<string>",
    "receiver_thread_ids": "array<string>",
    "agents_states": "array<struct<thread_id:string,status:string,message:string>>",
}

TOKEN_COLUMNS = ["input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"]


def ensure_columns(events: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast(t) for c, t in EVENT_COLUMNS.items() if c not in events.columns}
    return events.withColumns(missing) if missing else events


def event_thread() -> Column:
    """Thread of an event for metrics: its own id, else the sender's."""
    return F.coalesce(F.col("thread_id"), F.col("sender_thread_id"))


def has_tokens() -> Column:
    found = F.lit(False)
    for name in TOKEN_COLUMNS:
        found = found | F.col(name).isNotNull()
    return found
