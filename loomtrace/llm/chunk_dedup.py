"""Exact deduplication by content-defined chunk recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.llm.common import cut, keep_documents, whole_text

LEAST, MOST = 1024, 8192  # characters of a chunk


def chunk_pattern(least: int = LEAST, most: int = MOST) -> str:
    """A chunk ends at the first place after `least` characters where a word that ends in s, e or n (with or without one
    mark) meets a word that begins with a to d, at the end of the text, or after `most` characters. Places depend on the
    text around them only, so equal passages are cut alike wherever they stand."""
    return rf"(?s).{{{least},{most}}}?(?:(?<=[sen\W]\s)(?=[a-dA-D])|\z)|.{{1,{most}}}"


def recipes(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """One row per document without its text: row number, digest of the text, and its chunks in order as
    (64-bit key, SHA-256, length)."""
    text = whole_text()
    chunks = F.transform(
        F.regexp_extract_all(text, F.lit(chunk_pattern(least, most)), F.lit(0)),
        lambda c: F.struct(F.xxhash64(c).alias("key"), F.unhex(F.sha2(c, 256)).alias("digest"), F.length(c).alias("n")),
    )
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2(text, 256).alias("text_sha256"), chunks.alias("chunks"))


def exact_dedup(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Groups of documents with identical texts.

    Every text is read once, cut into chunks and reduced to their digests; no text is moved. Chunk keys are verified by
    SHA-256 and length: chunks that share a key but differ get different identifiers (key, place among them). Documents
    are equal when their ordered lists of identifiers are.

    Returns one row per row of docs: doc_id, keep_id (largest doc_id of the group), group_size, kept, text_sha256. A null
    text is an empty one, an empty text has an empty list. Of repeated rows with the same doc_id one is kept; null ids
    come last in the choice. An empty table gives an empty result; other columns are ignored.
    """
    base = cut(recipes(docs, least, most))  # a table, so row numbers stay what they are
    uses = base.select("row", F.posexplode("chunks").alias("place", "chunk")).select("row", "place", "chunk.*")
    same_key = Window.partitionBy("key").orderBy("digest", "n")
    ids = uses.select("key", "digest", "n").distinct().withColumn("variant", F.row_number().over(same_key))
    named = uses.join(ids, ["key", "digest", "n"])
    lists = named.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "key", "variant"))).alias("list"))
    lists = lists.select("row", F.transform("list", lambda c: F.struct(c["key"], c["variant"])).alias("recipe"))
    known = base.select("row", "doc_id", "text_sha256").join(lists, "row", "left")
    known = cut(known.withColumn("recipe", F.coalesce("recipe", F.expr("array()").cast(lists.schema["recipe"].dataType))))
    # a table too, so that the join can split the partition of a large group
    groups = cut(known.groupBy(F.col("recipe").alias("same")).agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep")
    ))
    return known.join(groups, F.col("recipe") == F.col("same")).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, all columns kept."""
    return keep_documents(docs, exact_dedup(docs).filter("kept"))
