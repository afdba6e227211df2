"""Session settings the library relies on, and lineage cuts that survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings a session should carry. Partition counts stay with the cluster's own defaults:
# adaptive execution coalesces small shuffles and splits skewed ones.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A repeated key in a log line keeps its last value instead of spoiling the line.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(app: str = "loomtrace", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def many_small_files(spark: SparkSession):
    """Settings for folders of many small files, put back afterwards: listings take eight tasks a core, not one a folder, and
    opening a file counts as half a megabyte, so a task reads a few hundred files.

    Files are listed when a reader is made and dealt when its rows are asked for; only what is done inside is touched.
    """
    wanted = {
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": 8 * spark.sparkContext.defaultParallelism,
        "spark.sql.files.openCostInBytes": 512 * 1024,
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the cluster; pick a local one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif re.match(r"local(\[|$)", context.master):  # one machine; local-cluster has executors of its own
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared checkpoint folder and read that from here on.

    The table survives the loss of any executor, keeps column pruning and filter push-down, and
    has a known size, so the planner can judge whether a broadcast is safe.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
