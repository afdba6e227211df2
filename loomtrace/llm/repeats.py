"""Repeated windows of whole texts, found through content-chosen anchors and Spark joins.

A text is a sequence of units (words or bytes). Two equal windows meet at equal anchors (see anchors.py); the context of an
anchor is all windows over it. Steps:

1. Count anchors. One that occurs once cannot lie in a repeated window.
2. A repeated anchor whose occurrences all have one context does not branch: all its windows are repeated. Neighbouring
   ones merge into one span of the document; no window is written out.
3. At branching anchors contexts that occur several times are repeated as a whole. Contexts that occur once are compared
   with the distinct contexts of the same anchor, window by window, at their source coordinates. How is up to the caller
   (`payload` and `resolve`); anchors with more than `most` distinct contexts are compared as counted window hashes, so no
   group is gathered in one task.

Equality is that of two independent 64-bit hashes, of the anchor and of the context or window. Documents are told apart
by (doc_id, hash of the text); repeated rows are documents of their own and repeat each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm import anchors as A
from loomtrace.llm.common import cut, whole_text

MOST = 20_000  # distinct contexts of an anchor that one task compares
COVERED, SAMPLE, SINGLE = 0, 1, 2  # a mark's windows are repeated; the same, and it stands for its context; to be compared
ROWS = 8000  # contexts compared at once


@dataclass(frozen=True)
class Method:
    """What differs between the operators."""

    values: Callable[[np.ndarray], np.ndarray]  # hash per unit of UTF-8 bytes
    length: int  # units of a window
    k: int  # units of an anchor
    payload: Callable  # (bytes, values, positions) -> list of binary, what a context is compared by
    resolve: Callable  # (anchor ids, weights, payloads) -> (row, first, last) of repeated window offsets
    windows: Callable  # payload -> (offsets, hashes) of the windows an anchor owns

    @property
    def side(self) -> int:
        return self.length - self.k


def units_around(positions: np.ndarray, n: int, reach: int) -> Iterator[tuple[slice, int, int]]:
    """Slices of sorted positions, each with the range of units within reach, of bounded size."""
    at = 0
    while at < len(positions):
        upto = int(np.searchsorted(positions, positions[at] + A.STEP))
        yield slice(at, upto), max(0, int(positions[at]) - reach), min(n, int(positions[upto - 1]) + reach)
        at = upto


def owned_windows(values: np.ndarray, positions: np.ndarray, length: int, k: int) -> list[tuple[int, np.ndarray]]:
    """Of each anchor (largest offset, hashes by falling offset) of the windows in which its hash is the smallest."""
    side, out = length - k, []
    for part, low, high in units_around(positions, len(values), 2 * length):
        sums = A.prefix_sums(values[low:high])
        up = np.arange(high - low - k + 1)
        grams = A.span_hash(sums, up, up + k)
        least = A.slide(np.minimum, grams, side + 1)
        starts = np.arange(len(least))
        hashes = A.mix(A.span_hash(sums, starts, starts + length) ^ A.INVERSE)
        for p in positions[part] - low:
            begin, end = max(0, p - side), min(p + 1, len(least))
            own = np.flatnonzero(least[begin:end] == grams[p]) + begin  # neighbours, since p is in all of them
            out.append((int(p - own[0]), hashes[own[0] : own[-1] + 1]) if len(own) else (0, hashes[:0]))
    return out


def _source(docs: DataFrame) -> DataFrame:
    text = whole_text()
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("text"))


def _packed(docs: DataFrame) -> DataFrame:
    """Documents with their texts compressed, to be moved."""

    def run(batches):
        for batch in batches:
            packer = zstandard.ZstdCompressor(level=3)
            texts = pa.array([packer.compress(x.as_buffer().to_pybytes()) for x in batch["text"]], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], texts], ["doc_id", "text_key", "text"])

    return _source(docs).mapInArrow(run, "doc_id bigint, text_key bigint, text binary")


def unpack(text: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(text.as_buffer().to_pybytes())


def _anchor_rows(docs: DataFrame, how: Method) -> DataFrame:
    def run(batches):
        for batch in batches:
            found, counts = [], []
            for text in batch["text"]:
                data = np.frombuffer(text.as_buffer(), np.uint8) if len(text.as_buffer()) else np.empty(0, np.uint8)
                found.append(A.anchors(how.values(data), how.length, how.k))
                counts.append(len(found[-1][0]))
            at, gram, context = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
            rows = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(rows), batch["text_key"].take(rows), pa.array(at), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64))],
                ["doc_id", "text_key", "at", "gram", "context"],
            )

    return _source(docs).mapInArrow(run, "doc_id bigint, text_key bigint, at bigint, gram bigint, context bigint")


def _marks(docs: DataFrame, how: Method, most: int) -> DataFrame:
    """(doc_id, text_key, at, gram, role, hot) of repeated anchors."""
    rows = cut(_anchor_rows(docs, how))
    degree = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("low"), F.max("context").alias("high")).filter("n > 1")
    # a table, so that both sides of the join are dealt for it alone and a hot anchor's partition can be split
    degree = cut(degree.select("gram", (F.col("low") != F.col("high")).alias("branches")))
    repeated = cut(rows.join(degree, "gram"))
    place = F.struct("doc_id", "text_key", "at")
    branching = repeated.filter("branches")
    contexts = cut(branching.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("weight"), F.min(place).alias("sample")))
    wide = cut(contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("gram", F.lit(True).alias("wide")))
    role = F.when(F.col("weight") == 1, SINGLE).when(place.eqNullSafe(F.col("sample")), SAMPLE).otherwise(COVERED)
    hot = F.coalesce("wide", F.lit(False)).alias("hot")
    roles = branching.join(contexts, ["gram", "context"]).join(wide, "gram", "left").select("doc_id", "text_key", "at", "gram", role.alias("role"), hot)
    plain = repeated.filter("NOT branches").select("doc_id", "text_key", "at", "gram", F.lit(COVERED).alias("role"), F.lit(False).alias("hot"))
    return cut(plain.unionByName(roles))


def _same(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
    """Join on the document, null ids included."""
    other = right.withColumnsRenamed({"doc_id": "its_id", "text_key": "its_key"})
    met = (F.col("text_key") == F.col("its_key")) & F.col("doc_id").eqNullSafe(F.col("its_id"))
    return left.join(other, met, kind).drop("its_id", "its_key")


def _contexts(docs: DataFrame, marks: DataFrame, how: Method) -> DataFrame:
    """What is to be compared: a row for each context that occurs once, and one for each other distinct one."""
    asked = marks.filter(F.col("role") != COVERED).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("at", "gram", "role", "hot"))).alias("asked"))

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                asked = batch["asked"][i].values.flatten()
                at, gram, role, hot = (asked[j] for j in range(4))
                data = np.frombuffer(unpack(batch["text"][i]), np.uint8)
                payloads = how.payload(data, how.values(data), at.to_numpy())
                same = pa.array(np.full(len(at), i))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(same), batch["text_key"].take(same), at, gram,
                     pa.array(np.where(role.to_numpy() == SINGLE, 1, 2)), hot, pa.array(payloads, pa.binary())],
                    ["doc_id", "text_key", "at", "gram", "weight", "hot", "payload"],
                )

    schema = "doc_id bigint, text_key bigint, at bigint, gram bigint, weight bigint, hot boolean, payload binary"
    return cut(_same(_packed(docs), asked, "inner").mapInArrow(run, schema))


RUNS = "doc_id bigint, text_key bigint, first bigint, last bigint"


def _compared(contexts: DataFrame, how: Method) -> DataFrame:
    """(doc_id, text_key, first, last): runs of starts of repeated windows of contexts that occur once."""

    def groups(batches) -> Iterator[pa.Table]:
        kept, n = [], 0
        for batch in batches:
            kept.append(batch)
            n += len(batch)
            if n < ROWS:
                continue
            whole = pa.Table.from_batches(kept).combine_chunks()
            gram = whole["gram"].to_numpy()
            upto = int(np.searchsorted(gram, gram[-1]))  # the last anchor may go on
            if upto:
                yield whole.slice(0, upto)
                kept, n = whole.slice(upto).to_batches(), len(whole) - upto
        if n:
            yield pa.Table.from_batches(kept).combine_chunks()

    def resolve(batches):
        for part in groups(batches):
            weight, at = part["weight"].to_numpy(), part["at"].to_numpy()
            row, first, last = how.resolve(part["gram"].to_numpy(), weight, part["payload"].to_pylist())
            single = weight[row] == 1
            row, first, last = row[single], first[single], last[single]
            ids = part.select(["doc_id", "text_key"]).take(pa.array(row)).combine_chunks()
            for got in ids.append_column("first", pa.array(at[row] - last)).append_column("last", pa.array(at[row] - first)).to_batches():
                yield got

    def expand(batches):
        for batch in batches:
            for i in range(len(batch)):
                offsets, hashes = how.windows(batch["payload"][i].as_py())
                n = pa.array(np.full(len(offsets), i))
                starts = pa.array(batch["at"][i].as_py() - offsets.astype(np.int64))
                keys = pa.array(A.mix(hashes + offsets.astype(np.uint64) * A.BASE).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(n), batch["text_key"].take(n), starts, batch["gram"].take(n), keys, batch["weight"].take(n)],
                    ["doc_id", "text_key", "start", "gram", "key", "weight"],
                )

    few = contexts.filter("NOT hot").drop("hot").repartition("gram").sortWithinPartitions("gram").mapInArrow(resolve, RUNS)
    many = cut(contexts.filter("hot").mapInArrow(expand, "doc_id bigint, text_key bigint, start bigint, gram bigint, key bigint, weight bigint"))
    often = many.groupBy("gram", "key").agg(F.sum("weight").alias("n")).filter("n > 1")
    found = many.filter("weight = 1").join(often, ["gram", "key"]).select("doc_id", "text_key", F.col("start").alias("first"), F.col("start").alias("last"))
    return few.unionByName(found)


def repeated_spans(docs: DataFrame, how: Method, most: int = MOST) -> DataFrame:
    """(doc_id, text_key, spans): unit ranges [start, end) of each document that repeated windows cover, not merged;
    they may reach over the ends of the text."""
    marks = _marks(docs, how, most)
    covered = marks.filter(F.col("role") != SINGLE).select("doc_id", "text_key", (F.col("at") - how.side).alias("start"), (F.col("at") + how.length).alias("end"))
    runs = _compared(_contexts(docs, marks, how), how)
    runs = runs.select("doc_id", "text_key", F.col("first").alias("start"), (F.col("last") + how.length).alias("end"))
    return covered.unionByName(runs).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def spans_mask(n: int, spans: pa.ListScalar | None) -> np.ndarray:
    """Which of n units the spans cover."""
    if spans is None or not spans.is_valid or not n:
        return np.zeros(n, bool)
    start, end = (x.to_numpy() for x in spans.values.flatten())
    edges = np.bincount(np.clip(start, 0, n), minlength=n + 1) - np.bincount(np.clip(end, 0, n), minlength=n + 1)
    return np.cumsum(edges[:n]) > 0


def with_spans(docs: DataFrame, how: Method, summary: Callable, schema: str, most: int = MOST) -> DataFrame:
    """One row per row of docs: doc_id and what summary(bytes, spans) says of the whole text."""
    spans = cut(repeated_spans(docs, how, most))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [(i.as_py(), *summary(unpack(t), s)) for i, t, s in zip(batch["doc_id"], batch["text"], batch["spans"])]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=arrow)

    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    return _same(_packed(docs), spans, "left").drop("text_key").mapInArrow(run, schema)
