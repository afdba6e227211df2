"""Near copies by the exact Jaccard similarity of word shingles.

Documents whose SimHash fingerprints meet in a table of blocks and lie within its distance are candidates first. Similar sets
may lie further apart than any distance such tables serve (3 to 11 bits on the given tables), so the exact way for the rest
follows: documents not linked yet are candidates if they share a shingle of their prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.llm import simhash
from loomtrace.llm.common import cut, keep_documents, release, whole_text
from loomtrace.llm.components import components

SHINGLE, SIMILARITY, SEED = 5, "0.8", 42
PIVOTS = 2  # rounds that compare with one document of each shingle only, before all open pairs are written out
LEAST_BITS = 1024  # of a parity sketch; longer sets have as many bits as values, up to the next power of two
SAMPLED, COMMON, OFTEN = 20_000, 100_000, 8  # documents in which common shingles are counted, how many of them, and their least count
OFTEN_BITS = 1 << 25  # of the filter of shingles that are often shared, 4 MB


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 values of `size` words in a row (of all words, if fewer); A-Z in lower case, blanks as one."""
    words = text.lower().split()  # of bytes: blanks are 0x20, 0x09-0x0D
    if not words:
        return np.empty(0, np.int64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64).view(np.int64))


def prefix(values: np.ndarray, similarity: Fraction, common: np.ndarray, rank: np.ndarray, often: np.ndarray | None = None, more: int = 0) -> np.ndarray:
    """The first of the values in an order that all documents share: those of the filter `often` late, common shingles
    last. Two sets that are similar enough have a value in both prefixes, whatever the order. So many `more` may follow."""
    if not len(values):
        return values
    late = np.zeros(len(values), np.int64)
    if often is not None:
        late = often[(values & (64 * len(often) - 1)) >> 6] >> (values & 63) & 1
    if len(common):
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        late = np.where(common[at] == values, rank[at] + 2, late)
    values = values[np.argsort(late, kind="stable")]
    return values[: len(values) + 1 + (-len(values) * similarity.numerator // similarity.denominator) + more]


def _enough(shared: Column | str, n: Column | str, m: Column | str, similarity: Fraction) -> Column:
    """Whether two sets of n and m values with so many shared ones are similar enough."""
    p, q = similarity.numerator, similarity.denominator
    return (F.lit(p + q) * shared) >= F.lit(p) * (F.col(n) + F.col(m))


def parities(values: np.ndarray) -> np.ndarray:
    """Of every class of values, by their low bits, whether it has an odd number of them, as 64-bit words; as many classes
    as values or more. Where the bits of two sets differ, a value lies in one of them only, so the differing bits never
    outnumber such values."""
    bits = max(LEAST_BITS, 1 << (len(values) - 1).bit_length())
    odd = np.bincount((values & (bits - 1)).astype(np.intp), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _folded(words: Column, count: Column) -> Column:
    """The sketch with so many words of the same set; both counts are powers of two."""
    parts = F.sequence(F.lit(0), F.try_divide(F.size(words), count).cast("int") - 1)
    word = lambda i: F.aggregate(parts, F.lit(0).cast("bigint"), lambda x, j: x.bitwiseXOR(F.get(words, i + j * count)))
    return F.when(F.size(words) == count, words).otherwise(F.transform(F.sequence(F.lit(0), count - 1), word))


def _may_do(similarity: Fraction) -> Column:
    """Whether two sets of n and m values may be similar enough, as far as sizes and sketches a_odd and b_odd tell."""
    count = F.least(F.size("a_odd"), F.size("b_odd"))
    words = F.zip_with(_folded(F.col("a_odd"), count), _folded(F.col("b_odd"), count), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(words, F.lit(0), lambda total, x: total + x)
    size = F.col("n").cast("bigint") + F.col("m")
    return _enough(F.least("n", "m"), "n", "m", similarity) & _enough(F.floor((size - differ) / 2), "n", "m", similarity)


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2(whole_text(), 256).alias("sha"), whole_text().cast("binary").alias("text"))


def _common(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles of a sample of documents, sorted, and their ranks, the rarest first. They only set the order of
    prefixes, and so the work, not the result."""
    share = max(1, docs.count() // SAMPLED)

    def run(batches):
        for batch in batches:
            yield from (pa.RecordBatch.from_arrays([pa.array(shingles(x.as_buffer().to_pybytes(), size))], ["gram"]) for x in batch["text"])

    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select(whole_text().cast("binary").alias("text"))
    counts = some.mapInArrow(run, "gram bigint").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OFTEN)
    found = [r["gram"] for r in counts.orderBy(F.desc("n"), "gram").limit(COMMON).collect()][::-1]
    values = np.array(found, np.int64)
    order = np.argsort(values)
    return values[order], order


def _often(docs: DataFrame, size: int, similarity: Fraction, bits: int = OFTEN_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What `_common` tells, and a filter of the shingles that stand in the prefixes, or soon after, of OFTEN documents or
    more, counted in all of them. A false hit is one for every document; this too sets the work, not the result."""
    known = _common(docs, size)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        common, rank = shared.value
        for batch in batches:
            first = [np.empty(0, np.int64)]
            for text in batch["text"]:
                values = shingles(text.as_buffer().to_pybytes(), size)
                first.append(prefix(values, similarity, common, rank, more=8 + len(values) // 20))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first))], ["gram"])

    grams = docs.select(whole_text().cast("binary").alias("text")).mapInArrow(run, "gram bigint")
    place = F.col("gram").bitwiseAND(F.lit(bits - 1))
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OFTEN)
    often = often.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(gram & 63 as int))").alias("bit"))
    words = often.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # so many words at most as the filter has
    told = np.zeros(bits // 64, np.int64)
    told[words["word"].to_numpy()] = words["bits"].to_numpy()
    return *known, told


def _sets(docs: DataFrame, size: int, similarity: Fraction) -> DataFrame:
    """(doc_id, text_sha256, node, n, prefix, odd, print) of every row: a digest of its set of shingles, their number, its
    prefix, its parity sketch and its fingerprint."""
    shared = docs.sparkSession.sparkContext.broadcast(_often(docs, size, similarity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank, often = shared.value
        for batch in batches:
            node, n, first, odd, prints = [], [], [], [], []
            for text in batch["text"]:
                raw = text.as_buffer().to_pybytes()
                values = shingles(raw, size)
                prints.append(simhash.fingerprint(raw, size, SEED))
                node.append(xxhash.xxh64_intdigest(values.tobytes(), SEED))
                n.append(len(values))
                first.append(prefix(values, similarity, common, rank, often))
                odd.append(parities(values))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["sha"], pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int32()),
                 pa.array(first, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64())), pa.array(np.array(prints, np.uint64).view(np.int64))],
                ["doc_id", "text_sha256", "node", "n", "prefix", "odd", "print"],
            )

    columns = "doc_id bigint, text_sha256 string, node bigint, n int, prefix array<bigint>, odd array<bigint>, print bigint"
    return cut(_text(docs).mapInArrow(run, columns))


def _ordered(pairs: DataFrame) -> DataFrame:
    """(a, b, n, m) of pairs of (node, n) and (its_node, its_n): the smaller node and the larger one, with their sizes."""
    low = F.col("node") < F.col("its_node")
    first, second = F.struct("node", "n"), F.struct(F.col("its_node").alias("node"), F.col("its_n").alias("n"))
    pairs = pairs.select(F.when(low, first).otherwise(second).alias("x"), F.when(low, second).otherwise(first).alias("y"))
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("n"), F.col("y.n").alias("m"))


def print_pairs(nodes: DataFrame) -> DataFrame:
    """Candidates (a, b, n, m) among nodes(node, n, print): every node with the first one of its fingerprint, and with the
    first one of each fingerprint that its own is linked to."""
    first = cut(nodes.groupBy("print").agg(F.min(F.struct(F.col("node").alias("its_node"), F.col("n").alias("its_n"))).alias("its")))
    first = first.select(F.col("print").alias("its_print"), "its.*")
    linked = simhash.links(first.select(F.col("its_print").alias("print")))
    near = first.select(F.col("its_print").alias("a"), F.col("its_print").alias("b")).unionByName(linked)
    met = nodes.select("node", "n", F.col("print").alias("a")).join(cut(near), "a").join(first, F.col("b") == F.col("its_print"))
    return _ordered(met.filter("node != its_node"))


def _links(pairs: DataFrame, docs: DataFrame, least: DataFrame, sketches: DataFrame, size: int, similarity: Fraction) -> DataFrame:
    """Those of pairs(a, b, n, m) whose sets of shingles are similar enough, as a table of edges (a, b). Sketches rule out
    most others, so whole sets travel for few pairs only."""

    def run(batches):
        for batch in batches:
            sets = pa.array([shingles(x.as_buffer().to_pybytes(), size) for x in batch["text"]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["node"], sets], ["node", "values"])

    left, right = (sketches.select(F.col("node").alias(x), F.col("odd").alias(f"{x}_odd")) for x in "ab")
    pairs = cut(pairs.distinct().join(left, "a").join(right, "b").filter(_may_do(similarity)).select("a", "b", "n", "m"))
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    asked = asked.join(least, "node").select("node", F.col("least.doc_id").alias("its_id"), F.col("least.text_sha256").alias("its_sha"))
    met = F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("sha") == F.col("its_sha"))
    sets = cut(_text(docs).join(asked, met).select("node", "text").mapInArrow(run, "node bigint, values array<bigint>").dropDuplicates(["node"]))
    left, right = (sets.select(F.col("node").alias(x), F.col("values").alias(f"{x}_values")) for x in "ab")
    shared = F.size(F.array_intersect("a_values", "b_values"))
    found = cut(pairs.join(left, "a").join(right, "b").filter(_enough(shared, "n", "m", similarity)).select("a", "b"))
    release(pairs, sets)
    return found


def _told(found: DataFrame, named: DataFrame | None) -> DataFrame:
    """(node, component) by the edges found and what is linked already, which is told by one edge to its component; both
    tables are replaced."""
    told = components(found if named is None else found.unionByName(named.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    now = cut(told)
    release(found, told, *([named] if named is not None else []))
    return now


def _components(
    rows: DataFrame, named: DataFrame, docs: DataFrame, least: DataFrame, sketches: DataFrame, size: int, similarity: Fraction, pivots: int
) -> DataFrame:
    """(node, component) of all nodes that are similar enough to another. rows: (gram, node, n, at, own) of shared prefix
    shingles, own being how many of its prefix a node shares with none; named: (node, component) of those linked already.

    Documents that share a shingle of their prefixes are compared unless they are linked already. The first rounds compare
    with one document of each shingle, so a group of n near copies costs n comparisons, not n²; the first time
    with the one that has least of its own, which the others were made of most likely. Then all pairs that are still apart
    are compared. At its first shared shingle a similar pair has as many values left as it must share, which spares most
    pairs that share a common passage only.
    """
    for turn in range(pivots + 1):
        now = rows.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
        apart = now.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("gram")
        apart, before = cut(apart), rows
        now = rows = cut(now.join(apart, "gram"))
        release(apart, before)
        rows = rows.drop("component")
        if now.isEmpty():
            break
        other = now.select("gram", *[F.col(x).alias(f"its_{x}") for x in ("node", "n", "at", "own", "component")])
        if turn < pivots:
            key = [F.col("its_own"), F.xxhash64(F.col("its_node"), F.lit(turn)).alias("key")][turn % 2 :]
            place = F.struct(*key, "its_node", "its_n", "its_at", "its_component")
            other = cut(other.groupBy("gram").agg(F.min(place).alias("pivot")).select("gram", "pivot.*").drop("key", "its_own"))
        left = F.least(F.col("n") - F.col("at"), F.col("its_n") - F.col("its_at"))
        likely = (F.col("component") != F.col("its_component")) & _enough(left, "n", "its_n", similarity)
        likely = likely if turn < pivots else likely & (F.col("node") < F.col("its_node"))
        met = now.join(other, (now["gram"] == other["gram"]) & likely)
        pairs = _ordered(met)
        found = _links(pairs, docs, least, sketches, size, similarity)
        if turn < pivots:
            release(other)
        named = _told(found, named)
    return named


def drop_near_copies(docs: DataFrame, size: int = SHINGLE, similarity: str = SIMILARITY, pivots: int = PIVOTS) -> DataFrame:
    """docs with one document of each component of texts whose sets of `size`-word shingles have a Jaccard similarity of
    `similarity` or more: that with the smallest doc_id, and of several such the one whose text has the smallest digest.

    Texts with one set of shingles are gathered first and are one node; those without words are one such group. Null ids
    stay only where nothing else does. Shingles are compared by their 64-bit hashes; all pairs are found.
    """
    share = Fraction(similarity)
    sets = _sets(docs, size, share)
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_sha256")
    least = cut(sets.groupBy("node").agg(F.min(rank).alias("least")))
    nodes = cut(sets.groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("prefix").alias("prefix"), F.any_value("odd").alias("odd"), F.min("print").alias("print")))
    sketches = nodes.select("node", "odd")
    near = _told(_links(print_pairs(nodes), docs, least, sketches, size, share), None)
    shared = nodes.select(F.explode("prefix").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("gram")
    rows = nodes.select("node", "n", F.size("prefix").alias("length"), F.posexplode("prefix").alias("at", "gram"))
    rows = cut(rows.join(cut(shared), "gram"))
    own = rows.groupBy("node").agg((F.any_value("length") - F.count(F.lit(1))).alias("own"))
    named = _components(cut(rows.drop("length").join(own, "node")), near, docs, least, sketches, size, share, pivots)
    rooted = least.join(named, "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("least").alias("kept"))
    return keep_documents(docs, rooted.select("kept.doc_id", "kept.text_sha256"))
