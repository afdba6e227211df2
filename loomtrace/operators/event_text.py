"""One line of text for every event, from its columns and its payload.

A field is the column of that name where the rows have one, else the payload's field with the type that is asked for.
Rows without a payload have no such fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions import exprs as X
from loomtrace.functions import json as J
from loomtrace.operators.columns import TOKEN_COLUMNS, ensure_columns
from loomtrace.operators.threads import COMMAND_TOOLS, WEB_TOOLS, failed_result, is_other_message

# Words for the tools of sub-agents, the keys that say what a result was, and patch headers.
AGENT_TOOLS = {
    "spawn_agent": "subagent launch", "send_input": "subagent input", "wait_agent": "subagent wait", "wait": "subagent wait",
    "close_agent": "subagent close", "resume_agent": "subagent resume",
}
TELLING = ["stderr", "error", "message", "output", "stdout"]
PATCH_HEADER = r"(?m)^\*\*\* (?:Update|Add|Delete) File: [ \t]*(\S.*?)[ \t\r]*$"
ROOT_TOOL_EVENTS = ["web.search", "web.open", "collab.spawn_agent", "collab.send_input", "collab.wait", "collab.close_agent", "collab.resume_agent"]


def _blank() -> Column:
    return F.lit("")


def _let(value: Column, use) -> Column:
    """`use(value)` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _filled(value: Column) -> Column:
    return F.nullif(value, _blank())


def _pair(label: str, value: Column) -> Column:
    """`label=value`, null for no value."""
    return F.concat(F.lit(f"{label}="), _filled(value))


def _words(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def _headed(head: Column | str, detail: Column) -> Column:
    head = F.lit(head) if isinstance(head, str) else head
    return F.concat(head, F.coalesce(F.concat(F.lit(": "), _filled(detail)), _blank()))


def scalar(tree: Column, path: str) -> Column:
    """Text of whatever is at the path: a string plainly, else its JSON; null only where nothing is."""
    return J.as_text(J.node(tree, path))


def _says(tree: Column) -> Column:
    return tree.isNotNull() & (J.kind(tree) != "VOID") & ~F.coalesce(X.strip(F.try_variant_get(tree, "$", "string")) == "", F.lit(False))


def told(tree: Column) -> Column:
    """What a tool's result says: text, or the first telling field of an object however deep, else its JSON."""

    def step(acc: Column, _: Column) -> Column:
        fields = F.array(*[J.node(acc["v"], f"$.{name}") for name in TELLING])
        found = F.get(F.filter(fields, _says), F.lit(0))
        return F.struct(F.coalesce(F.when(J.is_object(acc["v"]), found), acc["v"]).alias("v"))

    def deepest(v: Column) -> Column:
        braces = F.length(F.regexp_replace(F.to_json(v), r"[^{]", ""))
        return F.when(J.is_object(v), F.aggregate(F.sequence(F.lit(1), braces), F.struct(v.alias("v")), step)["v"]).otherwise(v)

    return _let(_let(tree, deepest), lambda v: F.when(_says(v), X.strip(J.as_text(v))))


class _Event:
    """Fields of an event row and the details that several types share."""

    def __init__(self, events: DataFrame, full: bool):
        kinds = dict(events.dtypes)
        self.own = set(events.columns)
        self.variants = {c for c, t in kinds.items() if t == "variant"}
        self.payload = F.col("payload") if "payload" in self.variants else F.lit(None).cast("variant")
        self.full = full
        self.input, self.output = self.node("input"), self.node("output")
        self.tool = F.coalesce(self.text("tool_name"), F.lit("?"))
        self.phase, self.status = _pair("phase", self.text("phase")), _pair("status", self.text("status"))
        self.failed = failed_result()
        self.command, self.container, self.action = F.col("__command"), F.col("__container"), F.col("__action")
        self.sub = F.coalesce(F.col("actor_type") == "subagent", F.lit(False))

    def shared(self) -> list[dict[str, Column]]:
        """Columns that several details read, to be worked out before them."""
        command = F.when(J.is_object(self.input), F.coalesce(J.clean(self.input, "$.command"), J.clean(self.input, "$.cmd")))
        container = F.when(J.is_object(self.input), self.input).when(J.is_object(self.output), self.output)
        action = F.coalesce(J.clean(self.container, "$.action"), J.clean(self.container, "$.action.type"))
        return [
            {"__command": command, "__container": container, **{f"__{name}_says": told(self.node(name)) for name in ("stderr", "error", "output")}},
            {"__action": action, "__states": self.states(), "__session": self.session(), "__done": self.done()},
        ]

    def text(self, name: str) -> Column:
        return F.col(name) if name in self.own and name not in self.variants else J.text(self.payload, f"$.{name}")

    def node(self, name: str) -> Column:
        return F.col(name) if name in self.variants else J.node(self.payload, f"$.{name}")

    def items(self, tree: Column, path: str) -> Column:
        return F.try_variant_get(tree, path, "array<variant>")

    def short(self, value: Column, width: int) -> Column:
        return X.strip(value) if self.full else _let(value, lambda v: X.truncate(v, width))

    def one_line(self, value: Column, width: int) -> Column:
        return self.short(F.replace(value, F.lit("\n"), F.lit(" ")), width)

    def command_text(self) -> Column:
        if self.full:
            return self.command
        return F.array_join(F.transform(F.split(self.command, r"\r?\n"), lambda line: X.truncate(line, 120)), "\n")

    # ---- details --------------------------------------------------------------------------------

    def session(self) -> Column:
        return _words(_pair("role", self.text("agent_role")), _pair("nickname", self.text("agent_nickname")), _pair("cwd", self.short(_filled(self.text("cwd")), 60)))

    def task(self) -> Column:
        window = F.coalesce(self.text("model_context_window"), scalar(self.payload, "$.model_context_window"))
        window = F.nullif(X.trim_null(window), F.lit("null"))
        return _words(_pair("mode", X.trim_null(self.text("collaboration_mode_kind"))), _pair("turn", self.short(X.trim_null(self.text("turn_id")), 80)), _pair("window", window))

    def context(self) -> Column:
        mode = J.text(J.node(self.payload, "$.collaboration_mode"), "$.mode")
        return _words(_pair("cwd", self.short(_filled(self.text("cwd")), 80)), _pair("model", self.text("model")), _pair("mode", mode))

    def compaction(self) -> Column:
        return _words(_pair("items", J.size(self.payload, "$.replacement_history").cast("string")), _pair("message", self.short(X.trim_null(self.text("message")), 80)))

    def tokens(self) -> Column:
        def count(name: str) -> Column:
            number = F.col(name) if name in self.own else J.whole(self.payload, f"$.{name}")
            # Fixed value: a blank between groups of three digits.
            grouped = F.regexp_replace(number.cast("string"), r"(?<=\d)(?=(\d{3})+$)", " ")
            return F.coalesce(F.when(number >= 0, grouped), number.cast("string"), scalar(self.payload, f"$.{name}"))

        label = lambda name: name.removesuffix("_tokens").replace("_", " ")
        return F.concat_ws(", ", *[F.concat(F.lit(f"{label(name)}: "), count(name)) for name in TOKEN_COLUMNS])

    def states(self) -> Column:
        stated = F.filter("agents_states", lambda s: s["status"].isNotNull())
        named = F.array_join(F.transform(stated, lambda s: F.concat(s["thread_id"], F.lit(":"), s["status"])), ",")
        prompt = F.when(self.text("tool_name") == "spawn_agent", self.short(X.trim_null(self.text("prompt")), 80))
        return _words(
            self.phase, self.status, _pair("prompt", prompt),
            F.when(F.size("receiver_thread_ids") > 0, F.concat(F.lit("agents="), F.array_join("receiver_thread_ids", ","))), _pair("states", named),
        )

    def web(self) -> Column:
        box = self.container
        query, url = J.clean(box, "$.query"), J.clean(box, "$.action.url")
        action = self.action
        pending = F.when(J.is_object(self.input), "query=<pending>")
        shown = lambda name, value: _pair(name, self.short(value, 120))
        page = _words(shown("url", url), shown("query", F.when(~query.eqNullSafe(url), query)))
        search = _words(F.coalesce(shown("query", query), pending), _pair("action", self.short(action, 40)), shown("url", url))
        return F.when(action == "open_page", F.coalesce(_filled(page), pending, _blank())).otherwise(search)

    def plan(self) -> Column:
        explained = self.short(J.clean(self.container, "$.explanation"), 80)
        return _words(self.phase, _pair("explanation", explained), _pair("steps", J.size(self.container, "$.plan").cast("string")))

    def is_plan(self) -> Column:
        held = F.lit(False)
        for tree in (self.input, self.output):
            for name in ("plan", "explanation", "text"):
                held = held | (J.is_object(tree) & J.node(tree, f"$.{name}").isNotNull())
        used = F.col("operation_id").isNotNull() if "operation_id" in self.own else F.lit(False)
        return F.coalesce(self.text("tool_name") == "update_plan", F.lit(False)) | used | J.node(self.payload, "$.tool_use_id").isNotNull() | held

    def todo(self) -> Column:
        count = lambda column, name: F.coalesce(F.col(column) if column in self.own else J.whole(self.payload, f"$.{name}"), F.lit(0)).cast("string")
        done = lambda x: F.coalesce(F.when(J.kind(J.node(x, "$.completed")) == "BOOLEAN", F.try_variant_get(x, "$.completed", "boolean")), F.lit(False))
        open_ = F.filter(self.items(self.payload, "$.items"), lambda x: J.is_object(x) & ~done(x) & J.text(x, "$.text").isNotNull())
        following = self.short(J.text(F.get(open_, F.lit(0)), "$.text"), 80)
        head = F.concat(F.lit("todo "), F.coalesce(self.text("phase"), _blank()), F.lit(": "), count("todo_completed", "completed_count"), F.lit("/"), count("todo_total", "total_count"))
        return _words(head, _pair("next", following))

    def questions(self) -> Column:
        asked = self.items(self.input, "$.questions")
        first = F.get(asked, F.lit(0))
        heading = F.when(J.node(first, "$.header").isNotNull(), J.clean(first, "$.header")).otherwise(J.clean(first, "$.question"))
        given = F.map_values(F.try_variant_get(self.output, "$.answers", "map<string,variant>"))
        size = lambda v: F.coalesce(
            J.size(v, "$.answers"), J.size(v, "$"), F.when(X.strip(J.text(v, "$")) != "", F.lit(1).cast("bigint")), F.lit(0).cast("bigint")
        )
        total = F.aggregate(given, F.lit(0).cast("bigint"), lambda acc, v: acc + size(v))
        return _words(self.phase, _pair("questions", J.size(self.input, "$.questions").cast("string")), _pair("first", self.short(heading, 80)), _pair("answers", total.cast("string")))

    def stdin(self) -> Column:
        box = F.when(J.is_object(self.input), self.input)
        session = _pair("session_id", scalar(box, "$.session_id"))
        return _words(
            self.phase, self.status, session, _pair("chars", self.short(J.clean(box, "$.chars"), 80)), _pair("output", self.one_line(F.col("__output_says"), 100))
        )

    def files(self, paths: Column) -> Column:
        more = F.when(F.size(paths) > 1, F.concat(F.lit(" (+"), (F.size(paths) - 1).cast("string"), F.lit(")")))
        return F.concat(F.lit("file="), self.short(F.get(paths, F.lit(0)), 80), F.coalesce(more, _blank()))

    def patch(self) -> Column:
        changes = J.node(self.payload, "$.changes")
        changed = J.is_object(changes)
        paths = F.array_sort(F.map_keys(F.try_variant_get(changes, "$", "map<string,variant>")))
        named = F.regexp_extract_all(J.text(self.input, "$"), F.lit(PATCH_HEADER), 1)
        target = F.when(changed, F.when(F.size(paths) > 0, self.files(paths)).otherwise("files=0")).when(F.size(named) > 0, self.files(named))
        said = F.when(~changed, _pair("output", self.one_line(F.col("__output_says"), 100)))
        return _words(self.phase, self.status, target, said)

    def changed_files(self) -> Column:
        changes = self.items(self.payload, "$.changes")
        first = F.get(changes, F.lit(0))
        more = F.when(F.size(changes) > 1, F.concat(F.lit("(+"), (F.size(changes) - 1).cast("string"), F.lit(")")))
        told_ = _words(F.coalesce(J.text(first, "$.kind"), F.lit("change")), _filled(self.short(J.text(first, "$.path"), 80)), more)
        return F.when(J.is_object(first), F.concat(F.lit("files: "), told_)).otherwise("files changed")

    def links(self) -> Column:
        if "text_links" in self.own and "text_links" not in self.variants:
            get = lambda name: F.col(f"text_links.{name}").cast("string")
            status, fallback = get("status_code"), F.when(F.col("text_links.is_fallback"), get("fallback_to"))
        else:
            tree = self.node("text_links")
            get = lambda name: J.text(tree, f"$.{name}")
            flagged = F.when(J.kind(J.node(tree, "$.is_fallback")) == "BOOLEAN", F.try_variant_get(tree, "$.is_fallback", "boolean"))
            status, fallback = scalar(tree, "$.status_code"), F.when(flagged, get("fallback_to"))
        found = _words(_pair("request_id", get("request_id")), _pair("status", status), _pair("host", get("host")), _pair("cf_ray", get("cf_ray")), _pair("fallback", fallback))
        return F.coalesce(F.concat(F.lit(" ["), _filled(found), F.lit("]")), _blank())

    # ---- whole lines ----------------------------------------------------------------------------

    def mcp(self, result: bool) -> Column:
        def value(name: str) -> Column:
            tree = self.node(name)
            return _pair(name, F.when(J.kind(tree) != "VOID", self.short(J.as_text(tree), 120)))

        parts = [self.phase, self.status, value("arguments"), value("result"), value("error"), _pair("server", self.text("server")), _pair("tool", self.text("tool"))]
        return _headed("mcp result" if result else "mcp call", _words(*parts))

    def root_tool(self, result: Column) -> Column:
        names = F.create_map(*[F.lit(x) for pair in AGENT_TOOLS.items() for x in pair])
        is_web = self.tool.isin(*WEB_TOOLS)
        is_command = self.tool.isin(*COMMAND_TOOLS) | self.command.isNotNull()
        page = F.when(self.action == "open_page", "open page").otherwise("search")
        about_agents = F.col("receiver_thread_ids").isNotNull() | F.col("sender_thread_id").isNotNull() | F.col("agents_states").isNotNull()
        head = (
            F.when(F.try_element_at(names, self.tool).isNotNull(), F.try_element_at(names, self.tool))
            .when(is_web, F.concat(page, F.when(result, " result").otherwise("")))
            .when(is_command, F.when(result, F.when(self.failed, "command fail").otherwise("command ok")).otherwise("command"))
            .otherwise(F.when(result, "tool result").otherwise("tool"))
        )
        detail = F.when(about_agents, F.col("__states")).when(is_web, self.web()).otherwise(self.command_text())
        code = F.when(result, _pair("exit", F.col("exit_code").cast("string")))
        parts = _words(_filled(detail), code)
        said = F.coalesce("__stderr_says", "__error_says", "__output_says")
        diagnostic = F.when(result & self.failed, _filled(self.one_line(said, 120)))
        # an answer follows the details with an arrow, or stands in their place
        tail = _let(parts, lambda x: F.when(x == "", F.coalesce(diagnostic, _blank())).otherwise(F.concat_ws(" -> ", x, diagnostic)))
        return _headed(F.concat(head, F.lit(" ["), self.tool, F.lit("]")), tail)

    def sub_call(self) -> Column:
        detail = F.when(self.tool.isin(*WEB_TOOLS), self.web()).otherwise(self.command_text())
        return _headed(F.concat(F.lit("tool "), self.tool), F.coalesce(detail, _blank()))

    def sub_result(self) -> Column:
        return _headed(F.concat(F.lit("result "), self.tool), F.coalesce(self.one_line(F.col("__output_says"), 60), _blank()))

    def done(self) -> Column:
        return _headed("done", self.short(F.coalesce(self.text("last_agent_message"), _blank()), 80))

    def said(self, width: int = 100) -> Column:
        return self.short(F.coalesce(self.text("text"), _blank()), width)

    def meta(self) -> Column:
        kind = F.coalesce(self.text("meta_type"), F.lit("meta"))
        return (
            F.when(kind.isin("message", "user_message"), self.said())
            .when(kind == "task_started", _headed("started", self.task()))
            .when(kind == "task_complete", F.col("__done"))
            .when(kind == "turn_context", _headed("turn context", _words(_pair("cwd", self.short(_filled(self.text("cwd")), 60)))))
            .otherwise(F.concat(F.lit("meta "), kind))
        )

    def line(self) -> Column:
        kind = F.col("event_type")
        failure = F.coalesce(self.text("message"), J.text(J.node(self.payload, "$.error"), "$.message"), _blank())
        foreign = _words(_pair("thread", self.text("foreign_thread_id")), _filled(F.col("__session")))
        completed = kind.isin(*ROOT_TOOL_EVENTS) & F.coalesce(self.text("phase") == "completed", F.lit(False))
        result = kind.isin("tool.result", "shell.result") | completed
        return (
            F.when(is_other_message() | (kind == "message.user"), self.said())
            .when(kind == "agent.session", _headed("ready", F.col("__session")))
            .when(kind == "agent.session.foreign", _headed("foreign session meta", foreign))
            .when(kind == "agent.meta", self.meta())
            .when(kind == "task.started", _headed("started", self.task()))
            .when(kind == "task.completed", F.col("__done"))
            .when(kind == "runtime.context", _headed("context", self.context()))
            .when(kind == "context.compacted", _headed("context compacted", self.compaction()))
            .when(kind == "context.compacted.duplicate", _headed("context compacted duplicate", _words(_pair("source", self.text("duplicate_of")))))
            .when(kind == "info.tokens", _headed("tokens", self.tokens()))
            .when(self.sub & kind.isin("tool.call", "shell.call"), self.sub_call())
            .when(self.sub & kind.isin("tool.result", "shell.result"), self.sub_result())
            .when(kind.isin("tool.call", "shell.call", "tool.result", "shell.result", *ROOT_TOOL_EVENTS), self.root_tool(result))
            .when(kind == "mcp.call", self.mcp(False))
            .when(kind == "mcp.result", self.mcp(True))
            .when(kind == "stdin.write", _headed("stdin write", self.stdin()))
            .when(kind == "todo.update", F.when(self.is_plan(), _headed("todo update", self.plan())).otherwise(self.todo()))
            .when(kind == "user.input.request", _headed("user input request", self.questions()))
            .when(kind == "patch.apply", _headed("patch apply", self.patch()))
            .when(kind == "patch.apply.duplicate", _headed("patch apply duplicate", self.patch()))
            .when(kind == "file.change", self.changed_files())
            .when(kind == "stderr.line", F.concat(F.lit("stderr: "), self.said()))
            .when(kind == "error", F.concat(F.lit("error: "), self.short(F.coalesce(self.text("message"), _blank()), 100), self.links()))
            .when(kind == "agent.failed", F.concat(_headed("agent failed", self.short(failure, 100)), self.links()))
            .when(kind == "agent.aborted", _headed("agent aborted", _words(_pair("reason", self.text("reason")))))
            .otherwise(kind)
        )


def event_summary(events: DataFrame, full: bool = False) -> DataFrame:
    """Events with `summary`: long texts are cut with three dots, or left whole with `full`."""
    rows = ensure_columns(events)
    event = _Event(events, full)
    first, second = event.shared()
    rows = rows.withColumns(first).withColumns(second).withColumn("summary", event.line())
    return rows.drop(*first, *second)
