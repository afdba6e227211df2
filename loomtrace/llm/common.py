"""Small helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write a table in the shared checkpoint folder and read it back; the shuffles behind it are freed at once."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return cut_lineage(df)
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)


def release(*tables: DataFrame) -> None:
    """Delete tables that `cut` wrote, once what was made of them is a table itself."""
    for df in tables:
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles() if "/table-" in file}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def whole_text(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def fold(doc_id: str | Column, folds: int, number: int) -> Column:
    """Whether crc32 of the id as text leaves `number` modulo `folds`; false for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(folds)) == number, F.lit(False))


def keep_documents(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of docs whose (doc_id, text) occurs in kept(doc_id, text_sha256), each such pair once.

    Nulls match nulls. All columns of docs stay, whatever their names.
    """
    left = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.sha2(whole_text(), 256).alias("sha")
    )
    right = kept.select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")).distinct()
    found = left.join(right, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")), "left_semi")
    return found.dropDuplicates(["id", "sha"]).select("row.*")
