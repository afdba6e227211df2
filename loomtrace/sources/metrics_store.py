"""Stored session metrics: a parquet table in hash buckets, one current row per session.

An upsert rewrites only the buckets its sessions fall in; a lookup reads only the buckets of its
ids. Rows older than the current versions count as stale and are computed anew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.operators import operations as O
from loomtrace.operators import session_metrics as M
from loomtrace.operators.columns import METRICS_PROJECTION_VERSION, METRICS_SCHEMA_VERSION
from loomtrace.operators.ordered import lookup
from loomtrace.session import cut_lineage

BUCKETS = 64
KEY = "session_id"


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def load_by_id(spark: SparkSession, path: str, ids: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Rows of the given sessions; both conditions reach the scan, one as a partition filter."""
    rows = spark.read.parquet(path)
    places = [_bucket(F.lit(i), buckets) for i in ids]
    return rows.where(F.col("bucket").isin(*places) & F.col(KEY).isin(*ids)).drop("bucket")


def upsert(spark: SparkSession, path: str, rows: DataFrame, buckets: int = BUCKETS) -> None:
    """Insert or replace the row of every session in `rows` (one row per session)."""
    fresh = cut_lineage(rows.withColumn("bucket", _bucket(F.col(KEY), buckets)))
    if exists(spark, path):
        old = spark.read.parquet(path).join(fresh.select("bucket").distinct(), "bucket", "left_semi")
        kept = old.join(fresh.select(KEY), KEY, "left_anti")
        # The buckets to rewrite are read in full before they are replaced.
        fresh = cut_lineage(kept.unionByName(fresh, allowMissingColumns=True))
    (
        # Rebalancing splits a large bucket over several files and tasks.
        fresh.hint("rebalance", "bucket").sortWithinPartitions("bucket", KEY)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    )


def needs_rebuild(sessions: DataFrame, stored: DataFrame) -> DataFrame:
    """Sessions without a stored row, or with one of another version."""
    known = stored.select(KEY, "metrics_schema_version", "source_projection_version")
    same = (F.col("metrics_schema_version") == METRICS_SCHEMA_VERSION) & (F.col("source_projection_version") == METRICS_PROJECTION_VERSION)
    joined = sessions.select(KEY).join(known, KEY, "left")
    return joined.select(KEY, (~F.coalesce(same, F.lit(False))).alias("needs_rebuild"))


def _of_sessions(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Events of the listed sessions; a long session is spread over many tasks."""
    return lookup(events, sessions.select(KEY).distinct(), [KEY], "seq", how="inner")


def materialize(spark: SparkSession, path: str, events: DataFrame, sessions: DataFrame, keys: DataFrame, buckets: int = BUCKETS) -> None:
    """Compute and store the metrics of the sessions in `keys`."""
    chosen = cut_lineage(_of_sessions(events, keys))
    wanted = sessions.join(keys.select(KEY), KEY, "left_semi")
    made = M.session_metrics(chosen, O.project_operations(chosen), wanted)
    upsert(spark, path, made, buckets)


def materialize_stale(spark: SparkSession, path: str, events: DataFrame, sessions: DataFrame, force: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """Bring the table up to date: only stale sessions are computed, or all of them with `force`."""
    stale = sessions.select(KEY)
    if not force and exists(spark, path):
        stale = needs_rebuild(sessions, load(spark, path)).where("needs_rebuild").select(KEY)
    stale = cut_lineage(stale)
    if not stale.isEmpty():
        materialize(spark, path, events, sessions, stale, buckets)
    return stale
