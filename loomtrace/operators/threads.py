"""Thread hierarchy: state per thread, parents, closure, anchors of child threads, agents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions import exprs as X
from loomtrace.functions import tools as T
from loomtrace.operators.columns import ensure_columns
from loomtrace.operators.normalize import ROOT_PARENT
from loomtrace.operators.operations import FAILED_STATUSES, KIND_ORDER
from loomtrace.operators.ordered import asof_values, carry, lookup, row_index, running_total
from loomtrace.operators.trees import double
from loomtrace.session import cut_lineage

RESULTS = ["tool.result", "shell.result"]
COLLAB_TYPES = [k for k in KIND_ORDER if k.startswith("collab.")]

# Events that end the run of follow-ups after a result.
BARRIERS = [
    "tool.call", "tool.result", "shell.call", "shell.result", "mcp.call", "mcp.result", "stdin.write", "web.search", "web.open",
    "todo.update", "user.input.request", "patch.apply", *COLLAB_TYPES, "agent.started", "agent.completed", "agent.failed",
    "agent.aborted", "task.started", "task.completed", "runtime.context", "context.compacted", "context.compacted.duplicate",
    "message.user", "message.commentary", "thread.started", "agent.session", "agent.session.foreign", "patch.apply.duplicate",
]
# Event types that set a category on the root's behalf.
ROOT_TOOL_TYPES = [
    "tool.call", "tool.result", "shell.call", "shell.result", "mcp.call", "mcp.result", "stdin.write", "web.search", "web.open",
    "todo.update", "user.input.request", "collab.spawn_agent", "collab.wait",
]
SUBAGENT_EVENTS = [
    "agent.session", "agent.session.foreign", "agent.meta", "message.user", "task.started", "task.completed", "runtime.context",
    "context.compacted", "context.compacted.duplicate", "info.tokens", "patch.apply.duplicate",
]
TOOL_EVENTS = ["tool.call", "tool.result", "shell.call", "shell.result", "mcp.call", "mcp.result", "stdin.write", "web.search", "web.open", *COLLAB_TYPES]
ERROR_EVENTS = ["stderr.line", "error", "agent.failed", "agent.aborted", "raw.unparsed"]
WEB_TOOLS = ["web_search", "web_search_call"]
COMMAND_TOOLS = ["command_execution", "exec_command", "write_stdin"]


def _type() -> Column:
    return F.col("event_type")


def is_other_message() -> Column:
    """Any message but the user's."""
    return _type().startswith("message.") & (_type() != "message.user")


def is_commentary() -> Column:
    return is_other_message() & ((_type() == "message.commentary") | F.coalesce(F.lower(X.trim_null(F.col("phase"))) == "commentary", F.lit(False)))


def tool_category() -> Column:
    """Category of a tool event: sub-agent work, web search, command, else default."""
    name = F.coalesce("tool_name", F.lit(""))
    about_agents = T.is_subagent_tool(name) | F.col("receiver_thread_ids").isNotNull() | F.col("sender_thread_id").isNotNull()
    command = name.isin(*COMMAND_TOOLS) | X.trim_null(F.col("command")).isNotNull()
    return F.when(about_agents, "subagent").when(name.isin(*WEB_TOOLS), "search").when(command, "command").otherwise("default")


def event_category(events: DataFrame) -> DataFrame:
    """One of eight categories for every event."""
    return ensure_columns(events).withColumn(
        "category",
        F.when(is_commentary(), "subagent")
        .when(is_other_message(), "assistant")
        .when(_type().isin(*SUBAGENT_EVENTS), "subagent")
        .when(_type().isin(*TOOL_EVENTS), tool_category())
        .when(_type().isin("patch.apply", "file.change"), "file")
        .when(_type() == "todo.update", F.when(F.coalesce(F.col("tool_name") == "update_plan", F.lit(False)) | F.col("operation_id").isNotNull(), "default").otherwise("todo"))
        .when(_type().isin(*ERROR_EVENTS), "error")
        .otherwise("default"),
    )


def failed_result() -> Column:
    """A non-zero exit code, else a failed status."""
    status = F.lower(X.trim_null(F.col("status"))).isin(*FAILED_STATUSES)
    return F.when(F.col("exit_code").isNotNull(), F.col("exit_code") != 0).otherwise(F.coalesce(status, F.lit(False)))


def assign_event_thread(events: DataFrame, root: Column) -> DataFrame:
    """Thread of every event: its own, the sender's, the root for the main agent; else an orphan."""
    own = F.coalesce(X.trim_null(F.col("thread_id")), X.trim_null(F.col("sender_thread_id")))
    thread = F.coalesce(own, F.when(F.col("actor_type") == "agent", root))
    return ensure_columns(events).withColumn("assigned_thread", thread).withColumn("is_orphan", thread.isNull())


def named_receivers() -> Column:
    """A result or collaboration event that names threads."""
    return (_type().isin("tool.result") | _type().isin(*COLLAB_TYPES)) & (F.size("receiver_thread_ids") > 0)


def _real_parent(parent: Column) -> Column:
    return F.nullif(X.trim_null(parent), F.lit(ROOT_PARENT))


def thread_state(events: DataFrame, root: Column) -> DataFrame:
    """Status, parent, nickname, role and folder of every thread, by its last or first assignment.

    Events are exploded to assignments, which then fold in one aggregation. Of one event, the states it reports of its
    receivers come last. A session's own metadata decides the parent; other events only fill it in. Threads nobody sets
    are idle.
    """
    rows = ensure_columns(events)
    own = F.coalesce(X.trim_null(F.col("thread_id")), X.trim_null(F.col("sender_thread_id")))
    sub = F.coalesce(F.col("actor_type") == "subagent", F.lit(False))
    phase = F.lower(X.trim_null(F.col("phase")))
    parent = _real_parent(F.col("parent_thread_id"))
    is_session = _type() == "agent.session"
    status = (
        F.when(_type() == "thread.started", "running")
        .when(_type().isin("tool.call", "shell.call") & sub, "working")
        .when(_type().isin("todo.update", "user.input.request", "stdin.write") & sub & (phase == "started"), "working")
        .when((_type() == "patch.apply") & sub, F.when(failed_result(), "failed").otherwise("working"))
        .when(_type() == "task.started", "running")
        .when(_type() == "task.completed", "completed")
        .when(_type() == "agent.aborted", "interrupted")
    )
    on_root = F.when(_type() == "agent.completed", "completed").when(_type() == "agent.failed", "failed")
    touches = (
        is_other_message() | status.isNotNull() | is_session | _type().isin("message.user", "task.started", "task.completed", "runtime.context")
        | _type().isin("tool.result", "shell.result", "todo.update", "user.input.request", "stdin.write") & sub
    )
    blank = F.lit(None).cast("string")
    entry = lambda thread, state, up, meta: F.struct(
        thread.alias("thread_id"), state.alias("status"), up.alias("parent"), meta.alias("meta")
    )
    no_meta = F.lit(False)
    direct = F.when(touches, F.array(entry(F.coalesce(own, root), status, parent, F.lit(True))))
    rooted = F.when(on_root.isNotNull(), F.array(entry(root, on_root, blank, no_meta)))
    none = F.array().cast("array<struct<thread_id:string,status:string,parent:string,meta:boolean>>")
    sender = F.coalesce(own, root)
    received = F.when(
        named_receivers(),
        F.concat(
            F.array(entry(sender, blank, blank, no_meta)),
            F.transform("receiver_thread_ids", lambda r: entry(X.strip(r), X.trim_null(F.col("status")), sender, no_meta)),
            F.coalesce(F.transform("agents_states", lambda s: entry(X.strip(s["thread_id"]), X.trim_null(s["status"]), sender, no_meta)), none),
        ),
    )
    found = F.concat(F.coalesce(direct, none), F.coalesce(rooted, none), F.coalesce(received, none))
    exploded = rows.select(
        "session_id", "seq", "event_type", "agent_nickname", "agent_role", "cwd", F.posexplode(found).alias("place", "a")
    ).where(X.trim_null(F.col("a.thread_id")).isNotNull())
    seq = F.struct("seq", "place")
    meta = F.when(is_session & F.col("a.meta"), seq)
    details = F.struct("agent_nickname", "agent_role", "cwd", F.col("a.parent").alias("parent"))
    context_cwd = F.when((_type() == "runtime.context") & F.col("a.meta"), X.trim_null(F.col("cwd")))
    folded = exploded.groupBy("session_id", F.col("a.thread_id").alias("thread_id")).agg(
        F.max_by("a.status", F.when(F.col("a.status").isNotNull(), seq)).alias("last_status"),
        F.min_by("a.parent", F.when(F.col("a.parent").isNotNull(), seq)).alias("first_parent"),
        F.max_by(F.col("a.parent"), F.when(meta.isNotNull() & F.col("a.parent").isNotNull(), seq)).alias("stated_parent"),
        F.max_by(details, meta).alias("details"),
        F.min_by(context_cwd, F.when(context_cwd.isNotNull(), seq)).alias("context_cwd"),
    )
    return folded.select(
        "session_id", "thread_id",
        F.coalesce("stated_parent", "first_parent").alias("parent_thread_id"),
        F.coalesce("last_status", F.when(F.col("details").isNotNull(), "session_loaded").otherwise("idle")).alias("status"),
        F.col("details.agent_nickname").alias("nickname"), F.col("details.agent_role").alias("role"),
        F.coalesce("details.cwd", "context_cwd").alias("cwd"),
    )


def pending_category(events: DataFrame, root: Column) -> DataFrame:
    """Category of the last tool event per thread, cleared by a reply or the end of its task."""
    rows = assign_event_thread(events, root)
    sub = F.coalesce(F.col("actor_type") == "subagent", F.lit(False))
    thread = F.coalesce("assigned_thread", root)
    category = (
        F.when(is_other_message() & ~is_commentary() | (_type() == "task.completed"), F.struct(F.lit(None).cast("string").alias("c")))
        .when(named_receivers(), F.struct(tool_category().alias("c")))
        .when(sub & _type().isin("todo.update", "user.input.request"), F.struct(F.lit("default").alias("c")))
        .when(sub & (_type() == "stdin.write"), F.struct(F.lit("command").alias("c")))
        .when(sub & (_type() == "patch.apply"), F.struct(F.lit("file").alias("c")))
        .when(_type().isin(*ROOT_TOOL_TYPES), F.struct(tool_category().alias("c")))
    )
    set_rows = rows.select("session_id", thread.alias("thread_id"), "seq", category.alias("set")).where(F.col("set").isNotNull())
    return set_rows.groupBy("session_id", "thread_id").agg(F.max_by("set", "seq").alias("s")).select(
        "session_id", "thread_id", F.col("s.c").alias("pending_category")
    )


def merge_thread_ids(agents: DataFrame) -> DataFrame:
    """One row per trimmed thread id; colliding rows fill each other's nulls, in id order."""
    rows = agents.withColumn("raw_id", F.col("thread_id")).withColumn("thread_id", X.trim_null(F.col("thread_id")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("raw_id"))).alias(c)
    return rows.where(F.col("thread_id").isNotNull()).groupBy("session_id", "thread_id").agg(
        *[first(c) for c in ("parent_thread_id", "status", "nickname", "role", "cwd")]
    )


def thread_index(events: DataFrame, agents: DataFrame, root: Column) -> DataFrame:
    """Every thread with its existing parent, first event and place among its siblings."""
    seen = (
        assign_event_thread(events, root).where(~F.col("is_orphan"))
        .groupBy("session_id", F.col("assigned_thread").alias("thread_id")).agg(F.min("seq").alias("first_seq"))
    )
    known = agents.select("session_id", "thread_id", "parent_thread_id")
    rows = cut_lineage(seen.join(known, ["session_id", "thread_id"], "full"))
    parents = rows.select("session_id", F.col("thread_id").alias("parent_thread_id"), F.lit(True).alias("exists"))
    rows = rows.join(parents, ["session_id", "parent_thread_id"], "left")
    rows = rows.withColumn("parent_thread_id", F.when(F.col("exists"), F.col("parent_thread_id"))).drop("exists")
    far = F.coalesce("first_seq", F.lit((1 << 63) - 1))
    order = [(F.col("thread_id") != root).cast("int"), far, F.col("thread_id")]
    top = F.when(F.col("parent_thread_id").isNull() & (F.col("thread_id") == root), F.lit(-1)).otherwise(F.floor(far / 100_000))
    return row_index(rows, ["session_id", "parent_thread_id"], top, order, "position")


def thread_closure(index: DataFrame) -> DataFrame:
    """Tree of threads: depth, place in preorder, size and first event of the subtree, direct children.

    One thread lies below another when its preorder lies in [preorder, preorder + size) of the other. Siblings keep their
    `position`. Threads on or below a cycle hang on no root and have no row. Rounds grow with the logarithm of the depth.
    """
    here = ["session_id"]
    rows = index.select(*here, "thread_id", "parent_thread_id", "first_seq", "position", F.col("first_seq").alias("first_below"), F.lit(1).cast("bigint").alias("size"))
    rows = rows.withColumn("depth", F.col("parent_thread_id").isNotNull().cast("int"))
    add = lambda own, other: own + other
    sized = double(
        rows, here, "thread_id", "parent_thread_id", above={"depth": add},
        below={"size": (F.sum, add), "first_below": (F.min, lambda own, other: F.least(own, other))},
    )
    # a node comes after its parent and the subtrees of its earlier siblings
    placed = running_total(sized, ["session_id", "parent_thread_id"], "position", {"upto": F.col("size")})
    own_step = F.col("parent_thread_id").isNotNull().cast("bigint")
    placed = placed.withColumn("preorder", F.col("upto") - F.col("size") + own_step).drop("upto")
    placed = double(placed, here, "thread_id", "parent_thread_id", above={"preorder": add})
    children = placed.where(F.col("parent_thread_id").isNotNull()).groupBy("session_id", F.col("parent_thread_id").alias("thread_id")).agg(F.count(F.lit(1)).alias("children"))
    return placed.join(children, ["session_id", "thread_id"], "left").withColumn("children", F.coalesce("children", F.lit(0)))


def thread_paths(tree: DataFrame) -> DataFrame:
    """The tree with `way`: the threads from the root to each thread, for showing. As long as the depth, so ask for few rows."""
    rows = tree.withColumn("way", F.array("thread_id"))
    return double(rows, ["session_id"], "thread_id", "parent_thread_id", above={"way": lambda own, its: F.concat(its, own)})


def follow_up_parent(events: DataFrame) -> DataFrame:
    """Reasoning, stderr and commentary after a result belong to it, until a barrier event."""
    rows = ensure_columns(events)
    thread = F.coalesce("thread_id", "sender_thread_id")
    commentary = is_other_message() & F.coalesce(F.col("phase") == "commentary", F.lit(False))
    follows = _type().isin("agent.reasoning", "stderr.line") | commentary
    marked = rows.select("session_id", thread.alias("thread"), "seq", "event_type", follows.alias("follows"))
    barrier = F.when(_type().isin(*BARRIERS), F.struct("seq", "event_type"))
    before = carry(cut_lineage(marked.where(F.col("follows") | barrier.isNotNull())), ["session_id", "thread"], "seq", {"barrier": barrier}, inclusive=False)
    hit = F.col("follows") & F.col("barrier.event_type").isin(*RESULTS)
    return before.where(hit).select("session_id", "seq", F.col("barrier.seq").alias("parent_seq"))


def is_spawn() -> Column:
    return (_type() == "collab.spawn_agent") | F.coalesce(F.col("tool_name") == "spawn_agent", F.lit(False))


def child_thread_anchor(threads: DataFrame, annotated: DataFrame) -> DataFrame:
    """Where a child thread hangs in its parent: the last event before it, by precedence.

    A completed spawn that names it, any spawn that names it, a tool or shell result, any event.
    `threads` gives session_id, thread_id, parent_thread_id, first_seq.
    """
    rows = ensure_columns(annotated).withColumn("parent_thread_id", F.coalesce("thread_id", "sender_thread_id"))
    rows = rows.withColumn("root_seq", F.coalesce("started_seq", "seq"))
    rows = cut_lineage(rows.where(F.col("parent_thread_id").isNotNull()).select("session_id", "parent_thread_id", "seq", "root_seq", "event_type", "tool_name", "phase", "receiver_thread_ids"))
    spawned = rows.where(is_spawn()).withColumn("thread_id", F.explode("receiver_thread_ids"))
    kids = threads.where(F.col("parent_thread_id").isNotNull() & F.col("first_seq").isNotNull())
    kids = cut_lineage(kids.select("session_id", "thread_id", "parent_thread_id", "first_seq"))
    named = asof_values(
        kids, spawned, ["session_id", "parent_thread_id", "thread_id"], "first_seq", "seq",
        {"completed_spawn": F.when(F.col("phase") == "completed", F.col("root_seq")), "any_spawn": F.col("root_seq")}, inclusive=False,
    )
    placed = asof_values(
        cut_lineage(named), rows, ["session_id", "parent_thread_id"], "first_seq", "seq",
        {"result": F.when(_type().isin(*RESULTS), F.col("seq")), "any_event": F.col("seq")}, inclusive=False,
    )
    steps = ["completed_spawn", "any_spawn", "result", "any_event"]
    kind = F.coalesce(*[F.when(F.col(s).isNotNull(), F.lit(s)) for s in steps])
    return placed.select(
        "session_id", "thread_id", "parent_thread_id", "first_seq", F.coalesce(*[F.col(f"{s}.value") for s in steps]).alias("anchor_seq"), kind.alias("anchor_kind")
    )


# ---- agents ------------------------------------------------------------------------------------

AGENT_EVENTS = ["collab.spawn_agent", "collab.wait", "collab.send_input", "collab.close_agent"]


def agent_graph(events: DataFrame, threads: DataFrame) -> DataFrame:
    """Collaboration events bound to the known sub-agents they name; the rest are unbound."""
    rows = ensure_columns(events).where(_type().isin(*AGENT_EVENTS)).select("session_id", "seq", "ts", "event_type", "receiver_thread_ids")
    spawn = _type() == "collab.spawn_agent"
    receivers = F.when(spawn, F.slice("receiver_thread_ids", 1, 1)).otherwise(F.array_distinct("receiver_thread_ids"))
    named = rows.withColumn("thread_id", F.explode_outer(receivers)).drop("receiver_thread_ids")
    known = threads.where(F.col("depth") > 0).select("session_id", "thread_id", F.lit(True).alias("known"))
    marked = lookup(named, known, ["session_id", "thread_id"], "seq").withColumn("known", F.coalesce("known", F.lit(False)))
    bound = marked.where("known").select("session_id", "seq", "ts", "event_type", "thread_id")
    loose = marked.groupBy("session_id", "seq").agg(F.first("ts").alias("ts"), F.first("event_type").alias("event_type"), F.bool_or("known").alias("any_known"))
    loose = loose.where(~F.col("any_known")).select("session_id", "seq", "ts", "event_type", F.lit(None).cast("string").alias("thread_id"))
    return bound.unionByName(loose)


def agent_status(events: DataFrame, graph: DataFrame, threads: DataFrame) -> DataFrame:
    """failed over aborted over closed over completed over waiting over running.

    `threads` gives session_id, thread_id, depth, status.
    """
    own = ensure_columns(events).withColumn("thread_id", F.coalesce("thread_id", "sender_thread_id")).groupBy("session_id", "thread_id").agg(
        F.bool_or(_type() == "agent.failed").alias("failed"), F.bool_or(_type() == "agent.aborted").alias("aborted"), F.bool_or(_type() == "task.completed").alias("done")
    )
    bound = graph.where(F.col("thread_id").isNotNull()).groupBy("session_id", "thread_id").agg(
        F.bool_or(_type() == "collab.close_agent").alias("closed"), F.bool_or(_type() == "collab.wait").alias("waited"), F.bool_or(_type() == "collab.spawn_agent").alias("spawned")
    )
    rows = threads.where(F.col("depth") > 0).join(own, ["session_id", "thread_id"], "left").join(bound, ["session_id", "thread_id"], "left")
    state = X.trim_null(F.col("status"))
    alive = F.coalesce("spawned", F.lit(False)) | F.col("failed").isNotNull() | state.isNotNull()
    return rows.select(
        "session_id", "thread_id",
        F.when(F.col("failed"), "failed").when(F.col("aborted"), "aborted").when(F.col("closed"), "closed")
        .when(F.col("done") | (F.lower(state) == "completed"), "completed").when(F.col("waited"), "waiting").when(alive, "running").otherwise("unknown").alias("agent_status"),
    )


def is_activity() -> Column:
    return _type().isin("task.started", "task.completed", "agent.failed", "agent.aborted", "agent.reasoning") | _type().startswith("message.")


def agent_steps(events: DataFrame, graph: DataFrame) -> DataFrame:
    """Causal steps of each agent, once per event: spawn, first activity, waits and inputs, endings."""
    own = ensure_columns(events).withColumn("thread_id", F.coalesce("thread_id", "sender_thread_id")).where(F.col("thread_id").isNotNull())
    seq = F.col("seq")
    firsts = own.groupBy("session_id", "thread_id").agg(
        F.min(F.when(is_activity(), seq)).alias("activity"),
        *[F.max(F.when(_type() == t, seq)).alias(n) for n, t in (("completed", "task.completed"), ("failed", "agent.failed"), ("aborted", "agent.aborted"))],
    )
    bound = graph.where(F.col("thread_id").isNotNull())
    edges = bound.groupBy("session_id", "thread_id").agg(
        F.min(F.when(_type() == "collab.spawn_agent", seq)).alias("spawn"), F.max(F.when(_type() == "collab.close_agent", seq)).alias("closed")
    )
    many = bound.where(_type().isin("collab.wait", "collab.send_input")).select(
        "session_id", "thread_id", "seq", F.when(_type() == "collab.wait", "wait").otherwise("send_input").alias("step")
    )
    # Fixed value: the order in which a step claims an event several of them mean.
    kinds = ["spawn", "activity", "wait", "send_input", "completed", "closed", "failed", "aborted"]
    single = firsts.join(edges, ["session_id", "thread_id"]).select(
        "session_id", "thread_id", F.explode(F.array(*[F.struct(F.col(k).alias("seq"), F.lit(k).alias("step")) for k in kinds if k not in ("wait", "send_input")])).alias("s")
    )
    steps = single.select("session_id", "thread_id", "s.*").where(seq.isNotNull()).unionByName(many.join(firsts.select("session_id", "thread_id"), ["session_id", "thread_id"]))
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("step"))
    return steps.groupBy("session_id", "thread_id", "seq").agg(F.min_by("step", rank).alias("step"))


def agent_last_activity(events: DataFrame, graph: DataFrame) -> DataFrame:
    """Last meaningful event of each agent: an ending, a message, or input sent to it."""
    own = ensure_columns(events).withColumn("thread_id", F.coalesce("thread_id", "sender_thread_id"))
    meaningful = _type().isin("agent.failed", "agent.aborted", "task.completed") | _type().startswith("message.")
    rows = own.where(meaningful & F.col("thread_id").isNotNull()).select("session_id", "thread_id", "seq", "event_type", "text")
    sent = graph.where((_type() == "collab.send_input") & F.col("thread_id").isNotNull()).select("session_id", "thread_id", "seq", "event_type", F.lit(None).cast("string").alias("text"))
    return rows.unionByName(sent).groupBy("session_id", "thread_id").agg(F.max_by(F.struct("seq", "event_type", "text"), "seq").alias("e")).select(
        "session_id", "thread_id", F.col("e.seq").alias("seq"), F.col("e.event_type").alias("event_type"), X.truncate(X.trim_null(F.col("e.text")), 180).alias("preview")
    )
