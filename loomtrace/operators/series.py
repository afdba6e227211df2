"""Series statistics of a project: fences, smoothing, robust trend, normalisation, anomalies.

Points are long: (project, idx, session_id, started_at, series, value, coverage), idx being the
session's position in its project. Every step is keyed by (project, series) and none needs a whole
series in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions import covered as C
from loomtrace.operators.ordered import carry, exact_percentiles, lookup, row_index
from loomtrace.operators.projects import failure_preference, session_time
from loomtrace.operators.slopes import median_slopes
from loomtrace.session import cut_lineage

KEYS = ["project", "series"]
SERIES = [
    "duration", "tokens", "allTokens", "tokenInput", "tokenOutput", "tokenCachedInput", "tokenReasoningOutput", "tokenTask",
    "tokenSpawnAgent", "failures", "toolCalls", "startContext", "skillsCount", "usedSkillsCount", "mcpServerCount", "taskCount",
    "spawnAgentCalls", "tokensPerSuccess", "reviewFindingsPer1k",
]
FENCE_FACTOR, FENCE_MIN_POINTS = 1.5, 4
HALO = 4
CHUNK = 100_000
FLAT = 1e-6
JUMP, BIG_JUMP = 0.45, 0.7


def series_metrics(include_spawn: bool = True) -> dict[str, Column]:
    """The nineteen series as covered columns of the session metrics."""
    total, duration = F.col("tokens_total"), F.col("duration_ms")
    if not include_spawn:
        total = C.covered_subtract_view(total, F.col("tokens_spawn_agent"))
        duration = C.covered_subtract_view(duration, F.col("spawn_agent_ms"))
    columns = [
        duration, C.covered_subtract_view(total, F.col("tokens_cached_input")), total, "tokens_input", "tokens_output",
        "tokens_cached_input", "tokens_reasoning_output", "tokens_task", "tokens_spawn_agent", failure_preference(), "tool_calls",
        "start_context_size", "skills_count", "used_skills", "mcp_server_count", "task_count", "spawn_agent_calls",
        "tokens_per_successful_session", "review_findings_per_1k_tokens",
    ]
    return {n: F.col(c) if isinstance(c, str) else c for n, c in zip(SERIES, columns, strict=True)}


def metric_series(metrics: DataFrame, by: str = "project_key", include_spawn: bool = True) -> DataFrame:
    """One row per session and series, numbered by session order within the project."""
    point = lambda n, m: F.struct(
        F.lit(n).alias("series"), m["value"].cast("double").alias("value"), m["coverage"].alias("coverage")
    )
    wide = metrics.select(
        F.col(by).alias("project"), "session_id", "started_at", "ended_at",
        F.array(*[point(n, m) for n, m in series_metrics(include_spawn).items()]).alias("points"),
    )
    numbered = row_index(wide, ["project"], F.substring(session_time(), 1, 13), [session_time(), F.col("session_id")])
    return numbered.select("project", "idx", "session_id", "started_at", F.explode("points").alias("p")).select(
        "project", "idx", "session_id", "started_at", "p.*"
    )


def series_coverage(points: DataFrame) -> DataFrame:
    """Available, partial and unknown points; partial ones with a value are available too."""
    return points.groupBy(*KEYS).agg(
        F.count_if((F.col("coverage") != C.UNKNOWN) & F.col("value").isNotNull()).alias("available_points"),
        F.count_if(F.col("coverage") == C.PARTIAL).alias("partial_points"),
        F.count_if(F.col("coverage") == C.UNKNOWN).alias("unknown_points"),
    )


def outlier_fences(points: DataFrame) -> DataFrame:
    """Quartile fences; none below four points or when the quartiles meet."""
    quartiles = exact_percentiles(points, KEYS, "value", {"q1": 0.25, "q3": 0.75})
    sizes = points.groupBy(*KEYS).agg(F.count("value").alias("available"))
    spread = F.col("q3") - F.col("q1")
    usable = (F.col("available") >= FENCE_MIN_POINTS) & (spread != 0)
    return sizes.join(quartiles, KEYS, "left").select(
        *KEYS, "available",
        F.when(usable, F.col("q1") - spread * FENCE_FACTOR).alias("lower_fence"),
        F.when(usable, F.col("q3") + spread * FENCE_FACTOR).alias("upper_fence"),
    )


def outlier_flags(points: DataFrame, fences: DataFrame) -> DataFrame:
    """Points with their series' fences and whether they lie outside."""
    outside = (F.col("value") < F.col("lower_fence")) | (F.col("value") > F.col("upper_fence"))
    return lookup(points, fences, KEYS, "idx", weight="available").withColumn("is_outlier", F.coalesce(outside, F.lit(False)))


def outlier_mode(flagged: DataFrame, mode: str) -> DataFrame:
    """Processed value: outliers kept, clamped to the fence, or excluded."""
    value = F.col("value")
    if mode == "clamp":
        value = F.when(F.col("is_outlier"), F.least(F.greatest(value, "lower_fence"), "upper_fence")).otherwise(value)
    elif mode == "exclude":
        value = F.when(~F.col("is_outlier"), value)
    elif mode != "keep":
        raise ValueError(mode)
    return flagged.withColumn("processed", value)


def smoothing_size(n: Column) -> Column:
    """Odd window size for n known points."""
    quarter = F.greatest(F.lit(3), F.least(F.lit(9), F.floor(n / 4 + 0.5)))
    size = F.when(n <= 1, 1).when(n <= 4, n).otherwise(quarter)
    return F.greatest(F.lit(1), size - F.when(size % 2 == 0, 1).otherwise(0)).cast("int")


def smoothing_window(processed: DataFrame) -> DataFrame:
    sizes = processed.groupBy(*KEYS).agg(F.count("processed").alias("processed_count"))
    return sizes.withColumn("window_size", smoothing_size(F.col("processed_count")))


def _mid(values: Column) -> Column:
    """Middle of a short sorted array, between the two middle values when even."""
    n = F.size(values)
    low, high = F.get(values, F.floor((n - 1) / 2).cast("int")), F.get(values, F.floor(n / 2).cast("int"))
    return low + (high - low) * 0.5


def moving_values(processed: DataFrame, windows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Centred moving average and median of ±⌊size/2⌋ rows; nulls are skipped, null stays null.

    Rows are cut into chunks of consecutive positions; the few rows next to a chunk's border are
    given to both neighbours.
    """
    home = F.floor(F.col("idx") / chunk)
    reach = F.array_distinct(F.array(F.floor((F.col("idx") - HALO) / chunk), home, F.floor((F.col("idx") + HALO) / chunk)))
    rows = lookup(processed, windows, KEYS, "idx", weight="processed_count").withColumn("chunk", F.explode(reach))
    frame = Window.partitionBy(*KEYS, "chunk").orderBy("idx").rowsBetween(-HALO, HALO)
    near = F.collect_list(F.when(F.col("processed").isNotNull(), F.struct("idx", "processed"))).over(frame)
    rows = rows.withColumn("near", near).where(F.col("chunk") == home)
    half = F.floor(F.col("window_size") / 2)
    inside = F.transform(
        F.filter("near", lambda p: F.abs(p["idx"] - F.col("idx")) <= half), lambda p: p["processed"]
    )
    rows = rows.withColumn("inside", inside)
    average = F.aggregate("inside", F.lit(0.0), lambda a, v: a + v) / F.size("inside")
    smooth = F.col("processed").isNotNull()
    return rows.withColumn("moving_average", F.when(smooth, average)).withColumn(
        "moving_median", F.when(smooth, _mid(F.array_sort("inside")))
    ).drop("near", "inside", "chunk")


def theil_sen_slopes(processed: DataFrame) -> DataFrame:
    """Median of the slopes between all known points of each series."""
    return median_slopes(processed.select(*KEYS, "idx", F.col("processed").alias("y")))


def theil_sen_trend(processed: DataFrame) -> DataFrame:
    """Trend value at every known point; a lone point is its own trend."""
    slopes = cut_lineage(theil_sen_slopes(processed))
    sloped = lookup(processed, slopes, KEYS, "idx")
    slope = F.coalesce("slope", F.lit(0.0))
    rest = sloped.select(*KEYS, (F.col("processed") - slope * F.col("idx")).alias("rest"))
    intercepts = exact_percentiles(rest, KEYS, "rest", {"intercept": 0.5})
    found = lookup(sloped, intercepts, KEYS, "idx")
    value = F.col("intercept") + slope * F.col("idx")
    return found.withColumn("trend", F.when(F.col("processed").isNotNull(), value))


VALUE_SETS = ["processed", "trend", "moving_average", "moving_median"]


def against_baseline(value: Column, baseline: Column) -> Column:
    """asinh of the relative distance from the baseline; of the value itself when that is about zero."""
    return F.asinh(F.when(F.abs(baseline) < FLAT, value).otherwise((value - baseline) / F.abs(baseline)))


def series_normalize(rows: DataFrame) -> DataFrame:
    """All value sets on one 0..1 scale per project, and the scale with each row."""
    first = F.min_by("processed", F.when(F.col("processed").isNotNull(), F.col("idx")))
    bases = rows.groupBy(*KEYS).agg(F.coalesce(first, F.lit(0.0)).alias("baseline"))
    based = lookup(rows, bases, KEYS, "idx")
    raw = {v: against_baseline(F.col(v), F.col("baseline")) for v in VALUE_SETS}
    based = based.withColumns({f"raw_{v}": c for v, c in raw.items()})
    low = F.least(*[F.min(f"raw_{v}") for v in VALUE_SETS])
    high = F.greatest(*[F.max(f"raw_{v}") for v in VALUE_SETS])
    scale = based.groupBy("project").agg(low.alias("scale_min"), high.alias("scale_max"))
    scaled = lookup(based, scale, ["project"], "idx")
    width = F.col("scale_max") - F.col("scale_min")

    def norm(raw_value: Column) -> Column:
        return F.when(raw_value.isNotNull(), F.when(F.abs(width) < FLAT, 0.5).otherwise((raw_value - F.col("scale_min")) / width))

    return scaled.withColumns({f"norm_{v}": norm(F.col(f"raw_{v}")) for v in VALUE_SETS}).drop(*[f"raw_{v}" for v in VALUE_SETS])


def chart_rows(points: DataFrame, mode: str = "keep") -> DataFrame:
    """The whole chain per point: fences, processed value, trend, smoothing, normalised values."""
    points = cut_lineage(points)
    processed = cut_lineage(outlier_mode(outlier_flags(points, outlier_fences(points)), mode))
    moved = moving_values(processed, smoothing_window(processed))
    trend = theil_sen_trend(processed).select(*KEYS, "idx", "trend")
    return series_normalize(cut_lineage(moved.join(trend, [*KEYS, "idx"])))


def chart_analysis(rows: DataFrame) -> DataFrame:
    """One statistics row per series of the charted points."""
    medians = exact_percentiles(rows, KEYS, "processed", {"project_median": 0.5})
    stats = rows.groupBy(*KEYS).agg(
        F.count("value").alias("available_count"),
        F.count("processed").alias("processed_count"),
        F.count_if("is_outlier").alias("outlier_count"),
        *[F.max(c).alias(c) for c in ("lower_fence", "upper_fence", "window_size", "baseline", "scale_min", "scale_max")],
    )
    width = F.col("scale_max") - F.col("scale_min")
    raw = against_baseline(F.col("project_median"), F.col("baseline"))
    normalized = F.when(raw.isNotNull(), F.when(F.abs(width) < FLAT, 0.5).otherwise((raw - F.col("scale_min")) / width))
    return stats.join(medians, KEYS, "left").withColumn("normalized_median", normalized).drop("baseline")


def row_window(rows: DataFrame, totals: DataFrame, start: int, end: int) -> DataFrame:
    """Sessions at positions start..end of each project, clamped to what exists."""
    upper = F.col("rows") - 1
    first = F.greatest(F.lit(0), F.least(F.lit(start), upper))
    last = F.greatest(first, F.least(F.lit(end), upper))
    return lookup(rows, totals, ["project"], "idx").where((F.col("idx") >= first) & (F.col("idx") <= last)).drop("rows")


def focus_window(total: int, size: int, focus: int) -> tuple[int, int]:
    """Window of `size` positions around `focus` that stays inside 0..total-1."""
    if total <= 0:
        return 0, 0
    size = max(1, min(size, total))
    start = min(max(0, max(0, min(focus, total - 1)) - (size - 1) // 2), total - size)
    return start, start + size - 1


def dominant_coverage(points: DataFrame) -> DataFrame:
    """Per session: any partial series makes it partial, all unknown makes it unknown, else known."""
    coverage = F.col("coverage")
    return points.groupBy("project", "idx", "session_id").agg(
        F.when(F.bool_or(coverage == C.PARTIAL), C.PARTIAL)
        .when(F.bool_and(coverage == C.UNKNOWN), C.UNKNOWN)
        .otherwise(C.KNOWN)
        .alias("coverage")
    )


def anomalies_metric(flagged: DataFrame) -> DataFrame:
    """Sessions with outlying series; severity grows with their number, up to three."""
    hits = flagged.where("is_outlier").groupBy("project", "session_id", "started_at").agg(
        F.array_join(F.array_sort(F.collect_set("series")), ", ").alias("reasons"), F.count(F.lit(1)).alias("n")
    )
    return _item(hits, "Metric", F.least(F.lit(3), F.col("n") + 1), "reasons", F.concat(F.lit("metric:"), "session_id"))


def _item(rows: DataFrame, name: str, severity: Column, detail: Column | str, item_id: Column, *extra: Column) -> DataFrame:
    detail = F.col(detail) if isinstance(detail, str) else detail
    return rows.select(
        "project", F.lit(name).alias("class"), item_id.alias("item_id"), "session_id", "started_at",
        severity.cast("int").alias("severity"), detail.alias("detail"), *extra,
    )


def anomalies_session(metrics: DataFrame, by: str = "project_key") -> DataFrame:
    """Sessions with failures or another end than completion."""
    failures = F.coalesce(failure_preference()["value"], F.lit(0))
    rows = metrics.select(F.col(by).alias("project"), "session_id", "started_at", "outcome", failures.alias("failures"))
    bad = rows.where((F.col("failures") > 0) | (F.col("outcome") != "completed"))
    detail = F.concat(F.col("outcome"), F.lit(" · failures "), F.col("failures").cast("string"))
    return _item(bad, "Session", F.when(F.col("failures") > 0, 3).otherwise(2), detail, F.concat(F.lit("session:"), "session_id"))


def anomalies_data(metrics: DataFrame, coverage: DataFrame, by: str = "project_key") -> DataFrame:
    """Sessions with partial or unknown data, a degraded project or an unknown scope."""
    rows = metrics.select(F.col(by).alias("project"), "session_id", "started_at", "degraded", "session_scope").join(
        coverage.select("project", "session_id", "coverage"), ["project", "session_id"]
    )
    tests = {
        "partial metric coverage": F.col("coverage") == C.PARTIAL,
        "unknown chart values": F.col("coverage") == C.UNKNOWN,
        "degraded project identity": F.col("degraded"),
        "unknown scope": F.col("session_scope") == C.UNKNOWN,
    }
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(text)) for text, test in tests.items()]))
    rows = rows.withColumn("reasons", reasons).where(F.size("reasons") > 0)
    severity = F.when(F.size("reasons") >= 2, 3).otherwise(2)
    return _item(rows, "Data issue", severity, F.array_join("reasons", " · "), F.concat(F.lit("data:"), "session_id"))


def anomalies_baseline(rows: DataFrame, totals: DataFrame, series: str = "tokens", value: str = "norm_trend") -> DataFrame:
    """Jumps of the primary series between neighbouring sessions, with the range to look at."""
    primary = cut_lineage(rows.where(F.col("series") == series).select("project", "idx", "session_id", "started_at", F.col(value).alias("v")))
    before = carry(primary, ["project"], "idx", {"before": F.struct("idx", "v")}, inclusive=False)
    jump = F.abs(F.col("v") - F.col("before.v"))
    jumps = lookup(before.withColumn("jump", jump).where(F.col("jump") >= JUMP), totals, ["project"], "idx")
    return _item(
        jumps, "Baseline", F.when(F.col("jump") >= BIG_JUMP, 3).otherwise(2), F.round("jump", 4).cast("string"),
        F.concat(F.lit("baseline:"), F.col("session_id"), F.lit(":"), F.col("idx").cast("string")),
        F.greatest(F.lit(0), F.col("idx") - 2).alias("start_index"),
        F.least(F.col("rows") - 1, F.col("idx") + 1).alias("end_index"),
    )


def anomaly_groups(items: DataFrame) -> DataFrame:
    """All items in review order with their class's highest severity; empty classes do not appear."""
    top = items.groupBy("project", "class").agg(F.max("severity").alias("class_severity"), F.count(F.lit(1)).alias("class_items"))
    return lookup(items, top, ["project", "class"], "item_id").orderBy(
        "project", "class", F.col("severity").desc(), F.coalesce("started_at", F.lit("")).desc(), "item_id"
    )


def session_flags(coverage: DataFrame, metrics: DataFrame, flagged: DataFrame, jumps: DataFrame, by: str = "project_key") -> DataFrame:
    """Flags per session: anomaly, baseline, partial, unknown, degraded."""
    outlying = flagged.where("is_outlier").select("project", "session_id").distinct().withColumn("anomaly", F.lit(True))
    # A jump's range holds at most four positions, so it is listed instead of range-joined.
    touched = jumps.select("project", F.explode(F.sequence("start_index", "end_index")).alias("idx")).distinct().withColumn("baseline", F.lit(True))
    facts = metrics.select(F.col(by).alias("project"), "session_id", "degraded", "session_scope")
    rows = (
        coverage.join(facts, ["project", "session_id"])
        .join(outlying, ["project", "session_id"], "left")
        .join(touched, ["project", "idx"], "left")
    )
    unknown = (F.col("coverage") == C.UNKNOWN) | (F.col("session_scope") == C.UNKNOWN)
    return rows.select(
        "project", "idx", "session_id", F.coalesce("anomaly", F.lit(False)).alias("anomaly"), F.coalesce("baseline", F.lit(False)).alias("baseline"),
        (F.col("coverage") == C.PARTIAL).alias("partial"), F.coalesce(unknown, F.lit(False)).alias("unknown"), "degraded",
    )


def window_pulse(points: DataFrame, metrics: DataFrame, skills: DataFrame, items: DataFrame, by: str = "project_key") -> DataFrame:
    """Summary of the visible sessions of each project."""
    value, idx = F.col("value"), F.col("idx")
    is_tokens, is_duration = F.col("series") == "tokens", F.col("series") == "duration"
    has = F.when(is_tokens & value.isNotNull(), idx)
    numbers = points.groupBy("project").agg(
        F.count_if(is_tokens).alias("sessions"),
        F.coalesce(F.sum(F.when(is_tokens, value)), F.lit(0.0)).alias("tokens"),
        F.round(F.avg(F.when(is_duration, value))).alias("average_duration_ms"),
        (F.max_by("value", has) - F.min_by("value", has)).alias("token_drift"),
    )
    known = dominant_coverage(points).groupBy("project").agg(F.count_if(F.col("coverage") == C.KNOWN).alias("known_sessions"))
    done = metrics.groupBy(F.col(by).alias("project")).agg(F.count_if(F.col("outcome") == "completed").alias("completed_sessions"))
    used = skills.groupBy(F.col(by).alias("project")).agg(F.count(F.lit(1)).alias("used_skills"))
    found = items.groupBy("project").agg(F.count(F.lit(1)).alias("anomalies"))
    percent = F.round(F.col("completed_sessions") / F.col("sessions") * 100).cast("bigint")
    return (
        numbers.join(known, "project").join(done, "project").join(used, "project", "left").join(found, "project", "left")
        .withColumn("completion_percent", percent)
        .withColumn("anomalies", F.coalesce("anomalies", F.lit(0)))
    )
