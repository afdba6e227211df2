"""Session catalog: identity, scope, naming, search, paging, de-duplication of files."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions import exprs as X
from loomtrace.functions import json as J
from loomtrace.operators.ordered import lookup, row_index, running_total, spread_levels
from loomtrace.session import cut_lineage

ACTIVE_SECONDS = 120
PAGE_DEFAULT = 50

# The pattern of a session file's name, and the catalog's columns with their types.
ROLLOUT_NAME = r"^rollout-\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}-(.+)\.jsonl$"
CATALOG_COLUMNS = {
    "session_id": "string", "session_ref": "string", "thread_name": "string", "name_source": "string", "updated_at": "timestamp",
    "created_at": "timestamp", "cwd": "string", "source": "string", "model_provider": "string", "model": "string",
    "reasoning_effort": "string", "cli_version": "string", "sandbox_policy_kind": "string", "approval_mode": "string",
    "tokens_used": "bigint", "git_sha": "string", "git_branch": "string", "git_origin_url": "string", "agent_nickname": "string",
    "agent_role": "string", "agent_path": "string", "memory_mode": "string", "has_user_event": "boolean", "archived": "boolean", "archived_at": "timestamp", "first_user_message": "string",
}


def sandbox_kind(policy: Column) -> Column:
    """The `type` of a JSON policy, else the policy text itself."""
    return F.coalesce(J.clean(J.parse(X.trim_null(policy)), "$.type"), X.trim_null(policy))


def thread_name() -> Column:
    """Title, else first user message, else the agent's nickname."""
    return F.coalesce(*[X.trim_null(F.col(c)) for c in ("title", "first_user_message", "agent_nickname")])


def thread_name_source() -> Column:
    out = None
    for column, label in (("title", "title"), ("first_user_message", "first_user_message"), ("agent_nickname", "agent_nickname")):
        test = X.trim_null(F.col(column)).isNotNull()
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def normalize_path(path: Column, home: str | None = None) -> Column:
    """Lexical clean-up: `~` expands to `home`, `.` vanishes, `..` drops the part before it."""
    text = path
    if home is not None:
        text = F.when(path == "~", home).when(path.startswith("~/"), F.concat(F.lit(home), F.substring(path, 2, 1 << 20))).otherwise(path)
    absolute = text.startswith("/")
    parts = F.filter(F.split(text, "/"), lambda p: (p != "") & (p != "."))

    def push(stack, part):
        top = F.try_element_at(stack, F.lit(-1))
        pops = (part == "..") & top.isNotNull() & (top != "..")
        ignored = (part == "..") & absolute & top.isNull()
        return (
            F.when(pops, F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
            .when(ignored, stack)
            .otherwise(F.array_append(stack, part))
        )

    folded = F.aggregate(parts, F.array().cast("array<string>"), push)
    return F.concat(F.when(absolute, "/").otherwise(""), F.array_join(folded, "/"))


def project_identity() -> list[Column]:
    """Key, kind and normalised folder of the project a session belongs to."""
    cwd = normalize_path(X.trim_null(F.col("cwd")))
    branch, origin = X.trim_null(F.col("git_branch")), X.trim_null(F.col("git_origin_url"))
    parts = F.when(origin.isNotNull(), F.concat_ws("|", origin, branch, cwd)).otherwise(F.concat_ws("|", cwd, branch))
    key = F.when(cwd.isNotNull(), F.concat(F.lit("project:"), X.hash8(parts))).otherwise(
        F.concat(F.lit("degraded:"), X.hash8(F.concat(F.lit("degraded-session:"), F.col("session_id"))))
    )
    return [key.alias("project_key"), cwd.isNull().alias("degraded"), cwd.alias("project_cwd"), branch.alias("project_branch"), origin.alias("project_origin")]


def session_scope(source: Column) -> Column:
    """main, subsession or unknown, read from the catalog's source text."""
    text = X.trim_null(source)
    tree = J.parse(text)
    spawn = F.try_variant_get(tree, "$.subagent.thread_spawn", "variant")
    parent = F.try_variant_get(tree, "$.subagent.thread_spawn.parent_thread_id", "variant")
    named = (F.schema_of_variant(parent) == "STRING") & X.trim_null(F.try_variant_get(parent, "$", "string")).isNotNull()
    return (
        F.when(text.isNull() | ~text.startswith("{"), "main")
        .when(tree.isNull(), "unknown")
        .when(F.try_variant_get(tree, "$.subagent", "variant").isNull(), "main")
        .when(spawn.isNotNull() & F.coalesce(named, F.lit(False)), "subsession")
        .otherwise("unknown")
    )


def with_identity(sessions: DataFrame) -> DataFrame:
    return sessions.select("*", *project_identity(), session_scope(F.col("source")).alias("session_scope"))


def catalog_row(source: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Rows in the catalog's shape; what a source does not know is a typed null."""
    return source.select(
        *[columns.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in CATALOG_COLUMNS.items()]
    )


def from_state(threads: DataFrame) -> DataFrame:
    """Catalog rows from the state table `threads` (times in epoch seconds); older tables lack some columns."""
    plain = ["cwd", "source", "model_provider", "model", "reasoning_effort", "cli_version", "approval_mode", "git_sha", "git_branch", "git_origin_url", "agent_nickname", "agent_role", "agent_path", "memory_mode", "first_user_message"]
    columns = {n: X.trim_null(F.col(n)) for n in plain if n in threads.columns}
    columns |= {
        "session_id": F.col("id"), "session_ref": F.col("rollout_path"), "thread_name": thread_name(), "name_source": thread_name_source(),
        "updated_at": F.timestamp_seconds("updated_at"), "created_at": F.timestamp_seconds("created_at"),
        "sandbox_policy_kind": sandbox_kind(F.col("sandbox_policy")), "tokens_used": F.col("tokens_used"), "archived": F.col("archived") != 0,
    }
    if "has_user_event" in threads.columns:
        columns["has_user_event"] = F.col("has_user_event") != 0
    if "archived_at" in threads.columns:
        columns["archived_at"] = F.timestamp_seconds("archived_at")
    return catalog_row(threads, columns)


def from_index(index: DataFrame) -> DataFrame:
    """Catalog rows from the newest index entries."""
    columns = {
        "session_id": F.col("session_id"), "thread_name": F.col("thread_name"),
        "name_source": F.when(F.col("thread_name").isNotNull(), "index"), "updated_at": F.try_to_timestamp("updated_at"),
    }
    return catalog_row(index, columns)


def from_files(files: DataFrame) -> DataFrame:
    """Catalog rows from log files alone."""
    columns = {"session_id": F.col("session_id"), "session_ref": F.col("session_ref"), "updated_at": F.col("modified")}
    return catalog_row(files, columns)


def newest_files(files: DataFrame) -> DataFrame:
    """The newest file of each session; equal times go to the smaller reference."""
    rank = F.struct((-F.unix_micros("modified")).alias("age"), F.col("session_ref"))
    picked = F.min_by(F.struct("session_ref", "modified"), rank)
    return files.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(picked.alias("f"), F.count(F.lit(1)).alias("files")).select("session_id", "f.*", "files")


def duplicate_files(files: DataFrame) -> DataFrame:
    """All files of sessions that have several, numbered newest first."""
    several = files.groupBy("session_id").agg(F.count(F.lit(1)).alias("files")).where(F.col("files") > 1)
    rows = lookup(files, several, ["session_id"], "session_ref", how="inner")
    age = -F.unix_micros("modified")
    return row_index(rows, ["session_id"], F.floor(age / 86_400_000_000), [age, F.col("session_ref")], "position")


def active_like(modified: Column, now: Column) -> Column:
    """Changed less than two minutes before `now`; a time in the future counts as active."""
    return F.unix_seconds(now) - F.unix_seconds(modified) < ACTIVE_SECONDS


SEARCH_FILES = ["session_id", "session_ref", "thread_name", "cwd"]
SEARCH_CATALOG = ["session_id", "thread_name", "cwd", "agent_nickname", "agent_role", "model", "reasoning_effort", "git_branch", "git_sha"]


def matches(query: str | None, columns: list[str]) -> Column:
    """Case-insensitive substring in any column; an empty query matches all."""
    wanted = (query or "").strip().lower()
    if not wanted:
        return F.lit(True)
    return reduce(or_, [F.coalesce(F.lower(F.col(c)).contains(wanted), F.lit(False)) for c in columns])


def page_size(limit: int | None) -> int:
    """Rows of a page: as many as asked for, at least one."""
    return max(limit if limit is not None else PAGE_DEFAULT, 1)


def session_list(files: DataFrame, index: DataFrame) -> DataFrame:
    """Every session's newest file with the index entry's name and time over it."""
    overlay = index.select("session_id", "thread_name", F.col("updated_at").alias("index_time"))
    rows = newest_files(files).join(overlay, "session_id", "left")
    return rows.select(
        "session_id", "session_ref", "thread_name", F.lit(None).cast("string").alias("cwd"), "modified",
        F.coalesce("index_time", X.rfc3339(F.col("modified"))).alias("updated_at"),
    )


def list_sessions(files: DataFrame, index: DataFrame, limit: int | None = None, offset: int = 0, query: str | None = None) -> DataFrame:
    """One page of sessions, newest first."""
    rows = session_list(files, index).where(matches(query, SEARCH_FILES))
    return rows.orderBy(F.col("updated_at").desc(), "session_ref").offset(offset).limit(page_size(limit))


def list_indexed_sessions(
    catalog: DataFrame, file_catalog: DataFrame, limit: int | None = None, offset: int = 0, query: str | None = None, exact_id: str | None = None
) -> DataFrame:
    """One page of the catalog, newest first.

    On the first page a wanted id the catalog lacks comes first, from its file, and takes a slot.
    """
    rows = catalog.where(matches(query, SEARCH_CATALOG))
    order = [F.col("rank"), F.col("updated_at").desc(), F.col("session_id")]
    if exact_id and exact_id.strip() and offset == 0:
        wanted = file_catalog.where((F.col("session_id") == exact_id.strip()) & matches(query, SEARCH_CATALOG))
        missing = wanted.join(rows.select("session_id"), "session_id", "left_anti")
        rows = rows.withColumn("rank", F.lit(0)).unionByName(missing.withColumn("rank", F.lit(-1)).select(*rows.columns, "rank"))
    else:
        rows = rows.withColumn("rank", F.lit(0))
    return rows.orderBy(*order).offset(offset).limit(page_size(limit)).drop("rank")


def find_sessions(state: DataFrame, index: DataFrame, files: DataFrame) -> DataFrame:
    """Every session's catalog row by precedence: state table, then index, then file."""
    ranked = [df.withColumn("origin", F.lit(name)).withColumn("rank", F.lit(i)) for i, (name, df) in enumerate((("state", state), ("index", index), ("file", files)))]
    united = reduce(lambda a, b: a.unionByName(b), ranked)
    fields = [c for c in united.columns if c not in ("session_id", "rank")]
    return united.groupBy("session_id").agg(F.min_by(F.struct(*fields), "rank").alias("r")).select("session_id", "r.*")


def resolve_session_refs(state: DataFrame, files: DataFrame) -> DataFrame:
    """File of each session: the one the state table names if it exists, else the newest."""
    newest = newest_files(files).select("session_id", F.col("session_ref").alias("newest"))
    named = state.select("session_id", F.col("session_ref").alias("wanted"))
    present = files.select("session_id", F.col("session_ref").alias("wanted")).distinct().withColumn("exists", F.lit(True))
    rows = newest.join(named, "session_id", "full").join(present, ["session_id", "wanted"], "left")
    return rows.select("session_id", F.coalesce(F.when(F.col("exists"), F.col("wanted")), "newest").alias("session_ref")).where(
        F.col("session_ref").isNotNull()
    )


def rollout_id(name: Column) -> Column:
    """Session id in a log file's name."""
    return F.nullif(F.regexp_extract(name, ROLLOUT_NAME, 1), F.lit(""))


def names_thread(name: Column, thread: Column) -> Column:
    """The file name holds the thread id with no letter or digit next to it."""
    quoted = F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), thread, F.lit(r"\E(?![A-Za-z0-9])"))
    return F.rlike(name, quoted)


def source_fields(source: Column) -> list[Column]:
    """Label, parent thread and depth the source text gives away."""
    text = X.trim_null(source)
    tree = F.when(text.startswith("{"), J.parse(text))
    spawn = J.node(tree, "$.subagent.thread_spawn")
    depth = J.node(tree, "$.subagent.thread_spawn.depth")
    label = (
        F.when(text.isNull(), None).when(~text.startswith("{") | tree.isNull(), text).when(spawn.isNotNull(), "subagent").otherwise("structured")
    )
    return [
        label.alias("source_label"),
        J.clean(tree, "$.subagent.thread_spawn.parent_thread_id").alias("source_parent"),
        F.when(J.kind(depth).isin("BIGINT", "STRING"), F.try_variant_get(depth, "$", "string")).alias("source_depth"),
    ]


def project_catalog(identified: DataFrame) -> DataFrame:
    """Projects by folder: sessions, backend keys, scope counts, and the newest session's attributes.

    `identified` is with_identity's result with updated_at; equal times go to the smaller id.
    """
    rows = identified.withColumn("catalog_key", F.coalesce(F.concat(F.lit("cwd:"), "project_cwd"), "project_key"))
    scope = F.col("session_scope")
    newest_first = F.struct(F.col("updated_at").isNull().alias("unknown"), (-F.col("updated_at").cast("double")).alias("age"), "session_id")
    made = rows.groupBy("catalog_key").agg(
        F.count_distinct("session_id").alias("sessions"),
        F.count_distinct("project_key").alias("backend_keys"),
        *[F.count_if(scope == s).alias(f"{s}_sessions") for s in ("main", "subsession", "unknown")],
        F.bool_or("degraded").alias("degraded"),
        F.array_join(F.array_sort(F.collect_set("project_key")), ",").alias("backend_key_list"),
        F.min_by(F.struct("cwd", "project_branch", "project_origin"), newest_first).alias("n"),
    )
    return made.select("*", *project_label()).drop("n").orderBy("degraded", "label", "catalog_key")


def project_label() -> list[Column]:
    """Label (last folder, else branch) and a one-line description of a project."""
    cwd, branch, origin = (X.trim_null(F.col(f"n.{c}")) for c in ("cwd", "project_branch", "project_origin"))
    last = F.element_at(F.filter(F.split(cwd, r"[/\\]"), lambda p: p != ""), -1)
    label = F.when(F.col("degraded"), F.coalesce(cwd, F.lit("Degraded project"))).otherwise(F.coalesce(last, branch, F.lit("Project")))
    counted = [
        F.when(F.col(f"{s}_sessions") > 0, F.concat(F.lit(f"{s} "), F.col(f"{s}_sessions").cast("string"))) for s in ("main", "subsession", "unknown")
    ]
    text = F.concat_ws(" · ", F.when(F.col("degraded"), "degraded identity"), *counted, branch, origin, cwd)
    return [label.alias("label"), text.alias("description")]


def session_preview(events: DataFrame, limit: int = 80) -> DataFrame:
    """Newest `limit` events of each session beside the session's size and time span."""
    newest = Window.partitionBy("session_id").orderBy(F.col("seq").desc())
    recent = events.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= limit)
    spans = events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.min_by("ts", "seq").alias("first_ts"), F.max_by("ts", "seq").alias("last_ts")
    )
    return recent.select("session_id", "position", "seq", "ts", "event_type", "raw_type", F.col("text")).join(spans, "session_id")


def latest_event(events: DataFrame) -> DataFrame:
    """The event with the greatest seq of each session."""
    return events.groupBy("session_id").agg(F.max_by(F.struct("seq", "ts", "event_type"), "seq").alias("e")).select("session_id", "e.*")


def linked_sessions(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Sessions reachable from each root over `parent`, `child` edges, with their smallest path.

    A session is never entered twice on one path, so cycles end. Each level keeps one path per
    session, which is the smallest of that length.
    """
    start = roots.select("root", F.col("root").alias("session_id"), F.array("root").alias("way"))

    def follow(frontier: DataFrame, edges: DataFrame) -> DataFrame:
        found = frontier.join(edges, frontier["session_id"] == edges["parent"]).where(~F.array_contains("way", F.col("child")))
        step = found.select("root", F.col("child").alias("session_id"), F.array_append("way", F.col("child")).alias("way"))
        return step.groupBy("root", "session_id").agg(F.min("way").alias("way"))

    return spread_levels(edges, start, follow).groupBy("root", "session_id").agg(F.min("way").alias("way"))


def linked_events(linked: DataFrame, events: DataFrame) -> DataFrame:
    """Events of all linked sessions of a root in path order, numbered anew from 1."""
    placed = row_index(linked, ["root"], F.array_join(F.slice("way", 1, 2), "\x01"), [F.col("way")], "place")
    inside = row_index(events.select("session_id", "seq"), ["session_id"], F.floor(F.col("seq") / 100_000), [F.col("seq")], "idx")
    inside = cut_lineage(inside)
    sizes = inside.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    sized = cut_lineage(placed.join(sizes, "session_id"))
    shifted = running_total(sized, ["root"], "place", {"upto": F.col("n")})
    offsets = shifted.select("root", "session_id", (F.col("upto") - F.col("n")).alias("offset"))
    # A session may hang under several roots, so it can meet several offsets.
    return lookup(inside, offsets, ["session_id"], "seq", how="inner").select(
        "root", "session_id", F.col("seq").alias("session_seq"), (F.col("offset") + F.col("idx") + 1).alias("seq")
    )
