"""Coverage algebra: every metric is struct<value, coverage, source>; unknown is never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KNOWN, PARTIAL, UNKNOWN = "known", "partial", "unknown"

# Labels of where a metric came from.
FROM_EVENTS = "normalized_events"
FROM_OPERATIONS = "operation_projection"
FROM_TREE = "event_tree"
FROM_CATALOG = "indexed_session_metadata"
DERIVED = "derived"
UNAVAILABLE = "unavailable"


def _metric(value: Column, coverage: Column, source: Column) -> Column:
    return F.struct(value.alias("value"), coverage.alias("coverage"), source.alias("source"))


def covered(value: Column, coverage: Column, source: str) -> Column:
    """Metric with the given coverage; an unknown coverage or a null value drops the value."""
    usable = value.isNotNull() & (coverage != UNKNOWN)
    return _metric(
        F.when(usable, value),
        F.when(usable, coverage).otherwise(UNKNOWN),
        F.when(usable, F.lit(source)).otherwise(UNAVAILABLE),
    )


def known(value: Column, source: str = FROM_EVENTS) -> Column:
    return covered(value, F.lit(KNOWN), source)


def partial(value: Column, source: str = FROM_EVENTS) -> Column:
    return covered(value, F.lit(PARTIAL), source)


def unknown(kind: str = "bigint") -> Column:
    return _metric(F.lit(None).cast(kind), F.lit(UNKNOWN), F.lit(UNAVAILABLE))


def covered_sum(metric: Column | str) -> Column:
    """Aggregate: known only when every input is known; no value at all is unknown."""
    metric = F.col(metric) if isinstance(metric, str) else metric
    total = F.sum(metric["value"])
    complete = F.coalesce(F.bool_and(metric["coverage"] == KNOWN), F.lit(False))
    return covered(total, F.when(complete, KNOWN).otherwise(PARTIAL), DERIVED)


def snapshot_sum(value: Column, force_partial: Column, source: str) -> Column:
    """Aggregate over snapshots: known when each one carries the value and nothing forces partial."""
    missing = F.count(F.when(value.isNull(), 1)) > 0
    return covered(F.sum(value), F.when(missing | force_partial, PARTIAL).otherwise(KNOWN), source)


def child_sum(value: Column, is_child: Column, force_partial: Column) -> Column:
    """Snapshot sum over the children; no child at all counts as zero."""
    children = F.count(F.when(is_child, 1))
    missing = F.count(F.when(is_child & value.isNull(), 1)) > 0
    total = F.when(children == 0, F.lit(0).cast("bigint")).otherwise(F.sum(F.when(is_child, value)))
    return covered(total, F.when(missing | force_partial, PARTIAL).otherwise(KNOWN), DERIVED)


def covered_subtract(total: Column, part: Column, source: str = DERIVED) -> Column:
    """Unknown when either side is missing; floors at zero; known only when both are."""
    both = (total["coverage"] == KNOWN) & (part["coverage"] == KNOWN)
    floor = F.greatest(total["value"] - part["value"], F.lit(0).cast("bigint"))
    value = F.when(total["value"].isNotNull() & part["value"].isNotNull(), floor)
    return covered(value, F.when(both, KNOWN).otherwise(PARTIAL), source)


def covered_subtract_view(total: Column, part: Column) -> Column:
    """View rule: a missing side leaves the total as it is; the total's source is kept."""
    usable = total["value"].isNotNull() & part["value"].isNotNull()
    both = (total["coverage"] == KNOWN) & (part["coverage"] == KNOWN)
    floor = F.greatest(total["value"] - part["value"], F.lit(0).cast("bigint"))
    reduced = _metric(floor, F.when(both, F.lit(KNOWN)).otherwise(PARTIAL), total["source"])
    return F.when(usable, reduced).otherwise(total)


def is_covered(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and kind.fieldNames() == ["value", "coverage", "source"]


def flatten_covered(df: DataFrame, sources: bool = False) -> DataFrame:
    """Each metric column `m` becomes `m`, `m_coverage` (and `m_source`)."""
    out = []
    for field in df.schema.fields:
        if not is_covered(field.dataType):
            out.append(F.col(field.name))
            continue
        out += [F.col(f"{field.name}.value").alias(field.name), F.col(f"{field.name}.coverage").alias(f"{field.name}_coverage")]
        if sources:
            out.append(F.col(f"{field.name}.source").alias(f"{field.name}_source"))
    return df.select(*out)
