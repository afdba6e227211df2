"""Readers for session logs, run folders, canonical event logs, the session index and the catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.functions import exprs as X
from loomtrace.functions import json as J
from loomtrace.operators.catalog import ROLLOUT_NAME
from loomtrace.operators.columns import EVENT_COLUMNS
from loomtrace.operators.normalize import UNPARSED, normalize_session, normalize_stdout, parse_lines, subagent_threads
from loomtrace.operators.ordered import lookup, row_index, running_total
from loomtrace.session import cut_lineage, many_small_files

# The canonical event row, with what a missing or wrong field becomes.
EVENT_DEFAULTS = {
    "schema_version": ("bigint", "1"), "ts": ("string", ""), "task_id": ("string", ""), "run_id": ("string", ""), "seq": ("bigint", "0"),
    "event_type": ("string", UNPARSED), "raw_type": ("string", "unknown"), "parse_status": ("string", "parsed"),
}
STATE_FILE = r"state_(\d+)\.sqlite$"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def line_bytes() -> Column:
    """A line as the text reader gives it, less a closing carriage return; bytes that are no UTF-8 stay as they are."""
    cut_off = F.expr("cast(substring(cast(value AS binary), 1, octet_length(value) - 1) AS string)")
    return F.when(F.col("value").endswith("\r"), cut_off).otherwise(F.col("value"))


def number_lines(lines: DataFrame) -> DataFrame:
    """Number the non-empty lines of every file from 1, in file order, without one task per file.

    `lines` has path, block (start of the split), place (increasing inside a split) and value.
    Splits are counted, their sizes summed along the file, and lines counted inside their split.
    """
    kept = lines.withColumn("value", line_bytes()).where(F.col("value") != "")
    kept = cut_lineage(kept)
    sizes = kept.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first_place"))
    before = running_total(sizes, ["path"], "block", {"upto": F.col("n")}).withColumn("offset", F.col("upto") - F.col("n"))
    places = before.select("path", "block", "offset", "first_place")
    joined = kept.join(places, ["path", "block"])
    # Places grow by one per kept line of a split, since empty lines were dropped before.
    return joined.withColumn("seq", F.col("place") - F.col("first_place") + 1 + F.col("offset")).drop("block", "place", "offset", "first_place")


def read_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """Lines of all matching files below a folder, with their file, its time and their number."""
    with many_small_files(spark):
        text = (
            spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
            .select(
                F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                F.col("_metadata.file_modification_time").alias("modified"), "value",
            )
        )
        text = text.withColumn("value", line_bytes()).where(F.col("value") != "").withColumn("place", F.monotonically_increasing_id())
        return number_lines(text)


def session_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of session logs with the session id of their file; lines without a time take the file's."""
    lines = read_lines(spark, path)
    named = F.nullif(F.regexp_extract(file_name(F.col("path")), ROLLOUT_NAME, 1), F.lit(""))
    return lines.select(
        F.coalesce(named, F.regexp_replace(file_name(F.col("path")), r"\.jsonl$", "")).alias("session_id"),
        "path", "seq", "value", X.rfc3339(F.col("modified")).alias("read_at"),
    )


def files_of(lines: DataFrame) -> DataFrame:
    """One row per log file: the id its first line states, else the one in its name, else none."""
    first = lines.groupBy("path").agg(F.min_by("value", "seq").alias("first_line"), F.max("modified").alias("modified"))
    tree = J.parse(F.col("first_line"))
    stated = F.when(J.text(tree, "$.type") == "session_meta", J.clean(tree, "$.payload.id"))
    named = F.nullif(F.regexp_extract(file_name(F.col("path")), ROLLOUT_NAME, 1), F.lit(""))
    session_id = F.coalesce(stated, named)
    return first.select(
        F.col("path").alias("session_ref"), session_id.alias("session_id"), "modified",
        F.when(session_id.isNull(), "session id not found").alias("diagnostic"),
    )


def discover_session_files(spark: SparkSession, path: str) -> DataFrame:
    """files_of, from the first line of every file alone: lines are compared where they are read, none is moved.

    Files of empty lines are listed with a diagnostic unless their name tells the id; files of no bytes are not seen by
    Spark's readers.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    line = F.regexp_replace("value", r"\r$", "")
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    with many_small_files(spark):
        lines = reader.text(path).select(F.col("_metadata.file_path").alias("path"), line.alias("value"), place.alias("place"))
        listed = reader.format("binaryFile").load(path).select(F.col("path"), F.col("modificationTime").alias("modified"))
    first = lines.where(F.col("value") != "").groupBy("path").agg(F.min_by("value", "place").alias("value"))
    told = listed.select(_plain_path(F.col("path")).alias("at"), F.col("path"), "modified").join(
        first.select(_plain_path(F.col("path")).alias("at"), "value"), "at", "left"
    )
    return files_of(told.select("path", "value", "modified", F.lit(1).alias("seq")))


def _plain_path(path: Column) -> Column:
    """A file's path without its scheme and URL escapes, as different readers write it."""
    return F.url_decode(F.replace(F.regexp_replace(path, r"^[a-z0-9]+:(//[^/]*)?/*", "/"), F.lit("+"), F.lit("%2B")))


def startup_metadata(bronze: DataFrame) -> DataFrame:
    """First session_meta of each session, and whether it leads the file and names its session."""
    is_meta = (F.col("raw_type") == "session_meta") & F.col("p").isNotNull()
    at = F.when(is_meta, F.col("seq"))
    fields = F.struct(F.col("p_id").alias("first_id"), J.text(F.col("p"), "$.cwd").alias("cwd"), "seq")
    first = bronze.groupBy("session_id").agg(F.min_by(fields, at).alias("m"), F.min("seq").alias("lead"))
    leads = (F.col("m.seq") == F.col("lead")) & (F.col("m.first_id") == F.col("session_id"))
    return first.where(F.col("m").isNotNull()).select("session_id", "m.*", leads.alias("lead_line"))


def _canonical(tree: Column) -> list[Column]:
    fields = []
    for name, (kind, default) in EVENT_DEFAULTS.items():
        value = J.whole(tree, f"$.{name}") if kind == "bigint" else J.text(tree, f"$.{name}")
        fields.append(F.coalesce(value, F.lit(default).cast(kind)).alias(name))
    payload = J.node(tree, "$.payload")
    return [*fields, F.when(J.is_object(payload), payload).otherwise(F.parse_json(F.lit("{}"))).alias("payload"), F.lit("event_log").alias("source")]


def canonical_rows(lines: DataFrame) -> DataFrame:
    """Canonical events from JSON lines; blank, invalid and non-object lines are dropped."""
    tree = J.parse(F.trim("value"))
    return lines.withColumn("tree", tree).where(J.is_object(F.col("tree"))).select(*_canonical(F.col("tree")))


def scan_event_log(spark: SparkSession, path: str) -> DataFrame:
    return canonical_rows(spark.read.text(path))


# Payload fields that tell what a started task is about, the first with text wins.
TASK_TEXT = ["title", "task", "prompt", "message", "summary"]


def flat_events(canonical: DataFrame) -> DataFrame:
    """The flat rows operators read, from canonical events with their payload.

    A field is taken when it has the column's type. `artifact_path` falls back to `path` where it is absent, a started
    task's title to the other texts that describe it; the session is the payload's, else the run.
    """
    payload = F.col("payload")
    kept = {"run_id", "task_id", "seq", "ts", "event_type", "raw_type", "parse_status", "source", "agents_states"}
    get = {"string": J.text, "bigint": J.whole, "int": lambda t, p: J.whole(t, p).cast("int"), "array<string>": J.texts}
    fields = {c: get[kind](payload, f"$.{c}") for c, kind in EVENT_COLUMNS.items() if c not in kept}
    fields["session_id"] = F.coalesce(J.clean(payload, "$.session_id"), "run_id")
    fields["agents_states"] = J.agent_states(payload, "$.agents_states")
    path = F.when(J.node(payload, "$.artifact_path").isNull(), J.text(payload, "$.path"))
    fields["artifact_path"] = F.coalesce(fields["artifact_path"], path)
    about = F.coalesce(*[J.clean(payload, f"$.{name}") for name in TASK_TEXT])
    fields["title"] = F.when(F.col("event_type") == "task.started", about).otherwise(fields["title"])
    return canonical.select(*[F.col(c) for c in sorted(kept - {"agents_states"})], *[value.alias(c) for c, value in fields.items()], "payload")


def scan_event_array(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold one JSON array (a trailing comma is forgiven) or one row per line.

    A file is an array when its first character that is not blank is `[`. An array file is one JSON value, so its lines are
    put together by path; line files stay lines and are never loaded whole. The files are read once, into a table, and the
    driver learns no path. A malformed array gives one unparsed row with the file's text.
    """
    meta = F.col("_metadata")
    with many_small_files(spark):
        read = spark.read.option("lineSep", "\n").text(path)
        lines = cut_lineage(read.select(
            meta["file_path"].alias("path"), meta["file_size"].alias("bytes"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), "value",
        ))
    lead = F.substring(F.trim(F.translate("value", "\t\r", "  ")), 1, 1)
    place = F.struct("block", "at")
    leads = lines.select("path", lead.alias("lead"), place.alias("place")).where(F.col("lead") != "").groupBy("path").agg(F.min_by("lead", "place").alias("c"))
    # Fixed value: the character that tells an array from lines.
    arrays = cut_lineage(leads.where(F.col("c") == "[").select("path"))
    single = lines.join(arrays, "path", "left_anti").select(F.explode(F.split("value", "\r")).alias("value"))
    rows = canonical_rows(single)
    parts = lines.join(arrays, "path", "left_semi").groupBy("path", "bytes").agg(F.sort_array(F.collect_list(F.struct("block", "at", "value"))).alias("parts"))
    # a text that ends with a line's end has one byte more than its lines and what stands between them
    text = F.concat_ws("\n", F.col("parts.value"))
    whole = parts.select(F.concat(text, F.when(F.octet_length(text) < F.col("bytes"), "\n").otherwise("")).alias("value"))
    whole = whole.withColumn("tree", J.parse(F.regexp_replace("value", r",\s*\]\s*$", "]")))
    items = whole.select("value", F.try_variant_get("tree", "$", "array<variant>").alias("items"))
    good = items.select(F.explode("items").alias("tree")).where(J.is_object(F.col("tree"))).select(*_canonical(F.col("tree")))
    bad = items.where(F.col("items").isNull()).select(F.parse_json(F.to_json(F.struct(F.lit("unparsed").alias("parse_status"), F.struct(F.col("value").alias("raw_line")).alias("payload")))).alias("tree"))
    return rows.unionByName(good).unionByName(bad.select(*_canonical(F.col("tree"))))


RUN_PATH = r"([^/]+)/runs/[^/]*?--([^/]+)/"


def _run_ids(path: Column) -> list[Column]:
    return [F.regexp_extract(path, RUN_PATH, 2).alias("run_id"), F.regexp_extract(path, RUN_PATH, 1).alias("task_folder")]


def task_ids(spark: SparkSession, path: str) -> DataFrame:
    """Task ids of the task.json files below a folder."""
    tasks = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "task.json").text(path, wholetext=True)
    tree = J.parse(F.col("value"))
    return tasks.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/task\.json$", 1).alias("task_folder"),
        F.coalesce(J.clean(tree, "$.task_id"), J.clean(tree, "$.id")).alias("task_id"),
    )


def run_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Lines of one kind of run artefact with their run and task ids."""
    lines = read_lines(spark, path, pattern).where(F.col("path").rlike(RUN_PATH))
    lines = lines.select("*", *_run_ids(F.col("path"))).join(task_ids(spark, path), "task_folder", "left")
    return lines.withColumn("task_id", F.coalesce("task_id", "task_folder")).withColumn("read_at", X.rfc3339(F.col("modified")))


def stderr_events(lines: DataFrame, stdout_lines: DataFrame) -> DataFrame:
    """Every stderr line as one event, numbered after the run's stdout lines."""
    last = stdout_lines.groupBy("run_id").agg(F.max("seq").alias("last_seq"))
    rows = lines.join(last, "run_id", "left")
    return rows.select(
        F.lit(1).alias("schema_version"), F.col("run_id").alias("session_id"), "run_id", "task_id",
        (F.col("seq") + F.coalesce("last_seq", F.lit(0))).alias("seq"), F.col("read_at").alias("ts"),
        F.lit("stderr.line").alias("event_type"), F.lit("stderr").alias("raw_type"), F.lit("parsed").alias("parse_status"),
        F.lit("json_output").alias("source"), F.lit("system").alias("actor_type"), F.col("value").alias("text"),
    )


def replay(stdout_events: DataFrame, errors: DataFrame, agent_events: DataFrame, owners: DataFrame) -> DataFrame:
    """All events of runs; sub-agent events take the run and task of their owner."""
    children = lookup(agent_events, owners, ["session_id"], "seq", how="inner")
    children = children.withColumns({"run_id": F.col("owner_run"), "task_id": F.col("owner_task")}).drop("owner_run", "owner_task")
    return stdout_events.unionByName(errors, allowMissingColumns=True).unionByName(children, allowMissingColumns=True)


def in_replay_order(stdout_events: DataFrame, errors: DataFrame, children: DataFrame) -> DataFrame:
    """Events of runs numbered from 1: each stdout line, behind it the logs of the agents it is the first to name (by
    thread id), stderr last. Logs of agents that no line names are left out; a child without a parent takes the thread
    that stdout was in.
    """
    named = subagent_threads(stdout_events).select("run_id", F.col("thread_id").alias("session_id"), F.col("first_seq").alias("anchor"))
    spoke = stdout_events.select("run_id", F.col("seq").alias("anchor"), F.col("thread_id").alias("speaker"))
    named = named.join(spoke, ["run_id", "anchor"], "left")
    kids = lookup(children, named, ["run_id", "session_id"], "seq", how="inner")
    kids = kids.withColumn("parent_thread_id", F.coalesce("parent_thread_id", "speaker")).drop("speaker")
    last = F.lit(1 << 40)
    parts = [
        stdout_events.withColumns({"anchor": F.col("seq"), "rank": F.lit(0), "who": F.lit("")}),
        kids.withColumns({"rank": F.lit(1), "who": F.col("session_id")}),
        errors.withColumns({"anchor": last + F.col("seq"), "rank": F.lit(2), "who": F.lit("")}),
    ]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    placed = row_index(every, ["run_id"], F.floor(F.col("anchor") / 1000), [F.col(c) for c in ("anchor", "rank", "who", "seq")], "at")
    return placed.withColumn("seq", F.col("at") + 1).drop("anchor", "rank", "who", "at")


def replay_run_dir(spark: SparkSession, path: str) -> DataFrame:
    """All events of the run folders below a path, in replay order: stdout, sub-agent logs and stderr."""
    stdout = cut_lineage(run_lines(spark, path, "stdout.jsonl"))
    errors = stderr_events(run_lines(spark, path, "stderr.log"), stdout)
    agents = run_lines(spark, path, "*.jsonl").where(F.col("path").contains("/subagents/"))
    agents = agents.withColumn("session_id", F.regexp_replace(file_name(F.col("path")), r"\.jsonl$", ""))
    owners = agents.select("session_id", F.col("run_id").alias("owner_run"), F.col("task_id").alias("owner_task")).distinct()
    children = normalize_session(cut_lineage(parse_lines(agents)))
    children = lookup(children.drop("run_id", "task_id"), owners, ["session_id"], "seq", how="inner")
    children = children.withColumnsRenamed({"owner_run": "run_id", "owner_task": "task_id"})
    return in_replay_order(cut_lineage(normalize_stdout(stdout)), errors, children)


def index_rows(lines: DataFrame) -> DataFrame:
    """Newest entry per session of an index file: greatest updated_at, then the later line.

    `lines` has seq and value; a bad line gives a row with a diagnostic and no session.
    """
    tree = J.parse(F.col("value"))
    rows = lines.select(
        F.coalesce(J.clean(tree, "$.id"), J.clean(tree, "$.session_id")).alias("session_id"),
        J.clean(tree, "$.thread_name").alias("thread_name"), J.text(tree, "$.updated_at").alias("updated_at"), "seq", "value",
    )
    good = rows.where(F.col("session_id").isNotNull())
    newest = good.groupBy("session_id").agg(F.max_by(F.struct("thread_name", "updated_at", "seq"), F.struct("updated_at", "seq")).alias("r"))
    return newest.select("session_id", "r.*")


def index_diagnostics(lines: DataFrame) -> DataFrame:
    tree = J.parse(F.col("value"))
    found = F.coalesce(J.clean(tree, "$.id"), J.clean(tree, "$.session_id"))
    return lines.where(found.isNull()).select("seq", F.lit("invalid index line").alias("diagnostic"))


def newest_state(files: DataFrame) -> DataFrame:
    """The state database to read: highest generation, then newest, then last by path."""
    generation = F.regexp_extract("path", STATE_FILE, 1).try_cast("bigint")
    rows = files.withColumn("generation", generation).where(F.col("generation").isNotNull())
    return rows.agg(F.max(F.struct("generation", "modified", "path")).alias("s")).select("s.*")


def scan_thread_catalog(spark: SparkSession, path: str, **jdbc: str) -> DataFrame:
    """Rows of the state table `threads`, from a parquet export or over JDBC."""
    if jdbc:
        return spark.read.format("jdbc").options(dbtable="threads", url=path, **jdbc).load()
    return spark.read.parquet(path)


def collect_receiver_ids(rows: DataFrame, value: str = "payload_text") -> DataFrame:
    """Thread ids any `receiver_thread_ids` list names, at any depth and inside strings that are JSON, sorted.

    Values are opened level by level. Every level takes an opening bracket or a quote, so their number bounds the walk; rows
    that nowhere hold the key are not opened.
    """
    text = F.col(value)
    none = F.array().cast("array<variant>")

    def opened(x: Column) -> Column:
        inside = J.parse(F.try_variant_get(x, "$", "string"))
        return (
            F.when(J.is_object(x), F.map_values(F.try_variant_get(x, "$", "map<string,variant>")))
            .when(J.kind(x).startswith("ARRAY"), F.try_variant_get(x, "$", "array<variant>"))
            .when((J.kind(x) == "STRING") & inside.isNotNull(), F.array(inside))
            .otherwise(none)
        )

    def step(acc: Column, _: Column) -> Column:
        named = F.flatten(F.transform(acc["open"], lambda x: F.coalesce(F.when(J.is_object(x), J.texts(x, "$.receiver_thread_ids")), F.array().cast("array<string>"))))
        return F.struct(F.flatten(F.transform(acc["open"], opened)).alias("open"), F.concat(acc["ids"], named).alias("ids"))

    start = F.struct(F.array_compact(F.array(J.parse(text))).alias("open"), F.array().cast("array<string>").alias("ids"))
    levels = F.sequence(F.lit(0), F.length(text) - F.length(F.translate(text, '[{"', "")))
    found = F.when(text.contains("receiver_thread_ids"), F.aggregate(levels, start, step)["ids"])
    ids = F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda n: X.strip(n)), lambda n: n != "")))
    return rows.withColumn("receivers", F.coalesce(ids, F.array().cast("array<string>")))
