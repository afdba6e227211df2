"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import fold, whole_text


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: dict[int, int]) -> DataFrame:
    """(doc_id, label, text) of labelled documents outside the held-out fold, at most most[label] labels of each kind.

    Labels are taken in the order of a hash of the id, so the choice does not depend on partitions. The ids are broadcast;
    their number is what `most` allows. Null ids and labels are left out.
    """
    clean = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label")).dropna().filter(~fold("id", folds, held_out))
    chosen = [clean.filter(F.col("label") == kind).orderBy(F.xxhash64("id"), "id").limit(n) for kind, n in most.items()]
    ids = chosen[0]
    for more in chosen[1:]:
        ids = ids.unionByName(more)
    text = docs.select("doc_id", whole_text().alias("text"))
    return text.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("doc_id", "label", "text")
