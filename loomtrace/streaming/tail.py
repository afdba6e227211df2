"""Live tail over Structured Streaming.

Appended log chunks land as files; the stream's checkpoint is the cursor. A keyed processor
numbers the lines and carries what the batch job gets from running values. Operation snapshots are
updated per operation, and session metrics are rebuilt for the sessions a batch touches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomtrace.functions import exprs as X
from loomtrace.functions import json as J
from loomtrace.operators import operations as O
from loomtrace.operators.catalog import rollout_id
from loomtrace.session import cut_lineage
from loomtrace.sources import metrics_store
from loomtrace.sources.logs import file_name

POLL = "2500 milliseconds"
CHUNK = r"^(.*\.jsonl)(?:\.(\d+))?$"


def event_key(ts: Column, raw_type: Column, value: Column) -> Column:
    """Identity of a line: its time, type and content, or its content alone when it is no record."""
    digest = X.hash8(value)
    return F.when(raw_type.isNotNull(), F.concat_ws(":", F.lit("event"), ts, raw_type, digest)).otherwise(F.concat(F.lit("line:"), digest))


def tail_lines(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Stream of lines from landed chunk files `rollout-…-<id>.jsonl.<n>`, with chunk and place.

    A chunk is what one poll found appended, so it is read as one value and split in order. Empty lines are not numbered,
    lines of blanks are, as in a batch. A chunk has to end with a line's end; one that does not fails the stream.
    """
    reader = spark.readStream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger)
    name = file_name(F.col("_metadata.file_path"))
    # a line that is still being written belongs to the next chunk
    whole = F.when(F.col("value").endswith("\n"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("chunk ends inside a line: "), name)))
    chunks = reader.text(path, wholetext=True).withColumn("value", whole).select(
        rollout_id(F.regexp_extract(name, CHUNK, 1)).alias("session_id"),
        F.coalesce(F.regexp_extract(name, CHUNK, 2).try_cast("bigint"), F.lit(0)).alias("chunk"),
        F.posexplode(F.split("value", "\r?\n")).alias("place", "value"),
    )
    return chunks.where(F.col("value") != "").withColumn("place", F.col("place").cast("bigint"))


def with_tail_columns(lines: DataFrame) -> DataFrame:
    """Columns the processor reads, parsed on the JVM: key, call id and name, own parent."""
    tree = J.parse(F.col("value"))
    record = F.when(J.is_object(tree), tree)
    raw_type, p_type = J.text(record, "$.type"), J.text(record, "$.payload.type")
    is_call = (raw_type == "response_item") & p_type.isin("function_call", "custom_tool_call")
    own = (raw_type == "session_meta") & (F.coalesce(J.text(record, "$.payload.id"), F.col("session_id")) == F.col("session_id"))
    return lines.select(
        "session_id", "chunk", "place", "value",
        event_key(F.coalesce(J.text(record, "$.timestamp"), F.lit("")), raw_type, F.col("value")).alias("key"),
        F.coalesce(J.text(record, "$.payload.call_id"), F.lit("")).alias("call_id"),
        F.when(is_call, F.coalesce(J.text(record, "$.payload.name"), F.lit("unknown"))).alias("called"),
        F.when(own, J.clean(record, "$.payload.source.subagent.thread_spawn.parent_thread_id")).alias("own_parent"),
    )


TAIL_SCHEMA = "session_id string, seq bigint, chunk bigint, place bigint, value string, parent_thread_id string, is_reset boolean"
TAIL_STATE = "next_seq bigint, chunk bigint, parent string, keys binary"
KEY_BYTES = 8


def _tail_session(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Number the new lines of one session and carry its parent and a digest of every line told.

    A chunk number that falls back means the file was replaced: numbering starts again and lines
    that were told before are not told twice, however long ago.
    """
    next_seq, last_chunk, parent, keys = state.get if state.exists else (1, -1, None, b"")
    told = {keys[i : i + KEY_BYTES] for i in range(0, len(keys), KEY_BYTES)}
    frames = list(batches)
    rows = (frames[0] if len(frames) == 1 else pd.concat(frames)).sort_values(["chunk", "place"])
    replaced = last_chunk >= 0 and int(rows["chunk"].min()) <= last_chunk
    if replaced:
        next_seq, parent = 1, None
    digests = [blake2b(k.encode(), digest_size=KEY_BYTES).digest() for k in rows["key"].tolist()]
    parents = []
    for own in _plain(rows["own_parent"]):
        parent = own or parent
        parents.append(parent)
    new = [not (replaced and d in told) for d in digests]
    state.update((next_seq + len(rows), int(rows["chunk"].max()), parent, b"".join(told.union(digests))))
    if any(new):
        out = pd.DataFrame({
            "session_id": key[0], "seq": range(next_seq, next_seq + len(rows)), "chunk": rows["chunk"].to_numpy(), "place": rows["place"].to_numpy(),
            "value": rows["value"].to_numpy(), "parent_thread_id": pd.Series(parents, dtype=object), "is_reset": replaced,
        })
        yield out if all(new) else out[new]


def tail_session(lines: DataFrame) -> DataFrame:
    """Numbered new lines of every session with their parent, kept across batches."""
    return with_tail_columns(lines).groupBy("session_id").applyInPandasWithState(
        _tail_session, TAIL_SCHEMA, TAIL_STATE, "append", GroupStateTimeout.NoTimeout
    )


# Small states are kept by the thousand: a call into Python costs the same for one key as for many.
BUCKETS = 4096


def _by_key(fold: Callable, width: int, columns: list[str], fields: list[str], order: list[str]) -> Callable:
    """State function over buckets of keys of `width` columns; each key's state and rows go to `fold` as plain values.

    `fold(key, state, rows)` gets the key's new rows (`columns` behind the key) in order, and gives its state and the rows to tell.
    """

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        states = {tuple(held[:width]): held[width:] for held in json.loads(state.get[0])} if state.exists else {}
        frames = list(batches)
        rows = frames[0] if len(frames) == 1 else pd.concat(frames)
        rows = rows.sort_values(order)
        mine: dict[tuple, list[tuple]] = {}
        for row in zip(*[_plain(rows[c]) for c in columns]):
            mine.setdefault(row[:width], []).append(row[width:])
        out = []
        for key, its in mine.items():
            states[key], told = fold(key, states.get(key), its)
            out += told
        state.update((json.dumps([[*key, *held] for key, held in states.items() if held is not None]),))
        if out:
            yield pd.DataFrame(out, columns=fields, dtype=object)  # whole numbers stay whole beside nulls

    return step


def _plain(values: pd.Series) -> list:
    """Values of a column as Python has them, None for nulls."""
    return values.astype(object).where(values.notna(), None).tolist()


def _bucketed(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))


NAME_SCHEMA = "session_id string, call_id string, chunk bigint, place bigint, call_name string"


def _name_call(key: tuple, state: list | None, rows: list[tuple]) -> tuple[list, list[tuple]]:
    """Give each line of one call id the tool its latest earlier call named."""
    last_chunk, name = state or (-1, None)
    if last_chunk >= 0 and min(chunk for chunk, _, _ in rows) <= last_chunk:
        name = None
    out = []
    for chunk, place, called in rows:
        out.append((*key, chunk, place, name))
        name = called if called is not None else name
    return [max(chunk for chunk, _, _ in rows), name], out


def stream_call_names(lines: DataFrame) -> DataFrame:
    """Tool name per line with a call id, kept across batches; a small state per call id, stored by buckets of them."""
    keys = ["session_id", "call_id"]
    calls = _bucketed(with_tail_columns(lines).where(F.col("call_id") != ""), keys).select("bucket", *keys, "chunk", "place", "called")
    names = [part.split()[0] for part in NAME_SCHEMA.split(", ")]
    step = _by_key(_name_call, len(keys), [*keys, "chunk", "place", "called"], names, ["chunk", "place"])
    return calls.groupBy("bucket").applyInPandasWithState(step, NAME_SCHEMA, "held string", "append", GroupStateTimeout.NoTimeout)


def stream_dedup(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Drop re-landed lines of a session, whenever they come; no line is late.

    `events` has session_id, event_time, ts, raw_type and value. A caller who knows that nothing lands again after some
    time may give a `delay`: keys are then forgotten behind that watermark.
    """
    keyed = events.withColumn("key", event_key(F.col("ts"), F.col("raw_type"), F.col("value")))
    if delay is None:
        return keyed.dropDuplicates(["session_id", "key"])
    return keyed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["session_id", "key"])


OPERATION_STATE = (
    "revision bigint, started_seq bigint, terminal_seq bigint, last_seq bigint, last_event_type string, last_phase string, "
    "last_status string, terminal boolean, preference int"
)
OPERATION_FIELDS = [*O.KEY, "mutable", *[part.split()[0] for part in OPERATION_STATE.split(", ")]]
OPERATION_SCHEMA = ", ".join(f"{k} string" for k in O.KEY) + ", mutable boolean, " + OPERATION_STATE


def _fold_operation(key: tuple, state: list | None, rows: list[tuple]) -> tuple[list | None, list[tuple]]:
    """Apply the new events of one operation in order; late ones and those after a final end are ignored."""
    revision, started, ended, last, kind, phase, status, terminal, best = state or (0, None, None, 0, None, None, None, False, -1)
    mutable, changed = True, False
    for seq, event_type, event_phase, its_status, is_terminal, its_mutable, preference in rows:
        mutable = bool(its_mutable)
        if seq <= last or (terminal and not mutable):
            continue
        started = started if started is not None else seq
        last, kind, phase, status = seq, event_type, event_phase, its_status
        if is_terminal:
            terminal = True
            if preference >= best:
                ended, best = last, preference
        revision, changed = revision + 1, True
    if not changed:
        return state, []
    values = [revision, started, ended, last, kind, phase, status, terminal, best]
    return values, [(*key, mutable, *values)]


def stream_operations(events: DataFrame) -> DataFrame:
    """Snapshots of the operations a batch changes, in update mode; a small state per operation, stored by buckets of them."""
    said = ["seq", "event_type", "event_phase", "status", "is_terminal", "mutable", "preference"]
    rows = O.lifecycle_events(events).select(
        *O.KEY, "seq", "event_type", "event_phase", X.trim_null(F.col("status")).alias("status"), "is_terminal", "mutable",
        O.terminal_preference(F.col("duplicate_of")).alias("preference"),
    )
    step = _by_key(_fold_operation, len(O.KEY), [*O.KEY, *said], OPERATION_FIELDS, ["seq"])
    return _bucketed(rows, O.KEY).groupBy("bucket").applyInPandasWithState(
        step, OPERATION_SCHEMA, "held string", "update", GroupStateTimeout.NoTimeout
    )


def land_batch(landed: str, batch: DataFrame, batch_id: int) -> None:
    """Add a batch of events to the landed table; a batch that is tried again replaces what it wrote before."""
    rows = batch.withColumn("batch", F.lit(batch_id).cast("bigint"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(landed)


def refresh_metrics(store: str, landed: str, sessions: Callable[[SparkSession], DataFrame]):
    """foreachBatch function: land a batch and rebuild the stored metrics of the sessions it touches.

    Only events that have landed are read, so the store shows each session as the stream has told it so far. An empty
    batch changes nothing.
    """

    def refresh(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        land_batch(landed, batch, batch_id)
        events = spark.read.parquet(landed)
        touched = cut_lineage(events.where(F.col("batch") == batch_id).select("session_id").distinct())
        metrics_store.materialize(spark, store, events.drop("batch"), sessions(spark), touched)

    return refresh
