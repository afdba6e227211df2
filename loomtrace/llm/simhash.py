"""SimHash fingerprints of word shingles, linked through shared pigeonhole blocks."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import cut, keep_documents, whole_text
from loomtrace.llm.components import components

SHINGLE, SEED, DISTANCE, BLOCKS = 3, 42, 2, 4
PIECE = 1 << 15  # shingles whose bits are counted at once


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits: a bit is set when it is set in over half of the shingles' XXH64 values; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z only, and blanks are 0x20, 0x09-0x0D
    if not words:
        return 0
    digest, counts, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    for low in range(0, total, PIECE):
        part = words[low : min(low + PIECE, total) + shingle - 1] if len(words) >= shingle else words
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        values = np.fromiter((digest(g, seed) for g in grams), np.uint64)
        counts += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(x.as_buffer().to_pybytes()) for x in batch["text"]), np.uint64, len(batch))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["sha"], pa.array(values.view(np.int64))], ["doc_id", "text_sha256", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, print) of every row; a null text is an empty one."""
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2(whole_text(), 256).alias("sha"), whole_text().cast("binary").alias("text"))
    return text.mapInArrow(_fingerprints, "doc_id bigint, text_sha256 string, print bigint")


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Edges (a, b) that join all pairs of prints(print) with at most two differing bits, and no others.

    Fingerprints are split into `blocks` equal parts. A pair within `distance` bits agrees on blocks - distance parts at
    least, so it meets in the table of one such choice. Only fingerprints that meet another go on. They are verified
    without writing out the pairs of a block: two fingerprints differ in two bits or fewer exactly if some value lies
    within one bit of both, and at most 65 fingerprints lie within one bit of a value, all of them linked to each other;
    so each links to the smallest fingerprint around each of its 65 values.
    """
    if distance != 2:
        raise ValueError("links are verified at their midpoint, which needs a distance of two")
    width = 64 // blocks
    masks = [sum(((1 << width) - 1) << (width * i) for i in chosen) for chosen in itertools.combinations(range(blocks), blocks - distance)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    parts = F.array(*[F.struct(F.lit(i).alias("table"), F.col("print").bitwiseAND(F.lit(m).cast("bigint")).alias("part")) for i, m in enumerate(signed)])
    keyed = prints.select("print", F.explode(parts).alias("block")).select("print", "block.*")
    shared = keyed.groupBy("table", "part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("table", "part")
    met = cut(keyed.join(shared, ["table", "part"]).select("print").distinct())
    near = F.array(F.lit(0).cast("bigint"), *[F.shiftleft(F.lit(1).cast("bigint"), i) for i in range(64)])
    around = met.select("print", F.explode(near).alias("flip")).select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("middle"))
    least = around.groupBy("middle").agg(F.min("print").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return around.join(least, "middle").filter("print != low").select(F.col("print").alias("a"), F.col("low").alias("b")).distinct()


def _grouped(docs: DataFrame, distance: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their fingerprints, fingerprints with their component's root)."""
    prints = cut(fingerprints(docs))
    nodes = cut(prints.groupBy("print").agg(F.min("doc_id").alias("first")))
    groups = components(links(nodes.select("print"), distance, blocks))
    rooted = nodes.join(groups.select(F.col("node").alias("print"), "component"), "print", "left")
    return prints, rooted.select("print", "first", F.coalesce("component", "print").alias("component"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of docs.

    component_id is the smallest doc_id reachable through links. Documents with one fingerprint are gathered before
    anything else, so a group of copies is one node. Rows without words have fingerprint zero and link like others; a
    null doc_id has no part in the minimum unless it is alone. Repeated rows share a component; other columns are ignored.
    """
    prints, rooted = _grouped(docs, distance, blocks)
    roots = rooted.groupBy("component").agg(F.min("first").alias("component_id"))
    named = rooted.join(roots, "component").select("print", "component_id")
    return prints.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """docs with one document of each component: that with the smallest doc_id, and of several such the one whose text
    has the smallest digest. Null ids stay only where nothing else does."""
    prints, rooted = _grouped(docs, distance, blocks)
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_sha256")
    least = prints.groupBy("print").agg(F.min(rank).alias("least"))
    kept = rooted.join(least, "print").groupBy("component").agg(F.min("least").alias("kept"))
    return keep_documents(docs, kept.select("kept.doc_id", "kept.text_sha256"))
