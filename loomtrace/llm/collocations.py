"""Phrases whose words occur together more often than apart, by the SON scheme: mine shards, then count candidates.

1. Every document belongs to one of SHARDS shards. A phrase with `support` occurrences in a language has, in one shard at
   least, its share of them: support times the shard's part of the language's words. Each shard is mined completely at
   that lowered support. Phrases are 64-bit values here, which can only add candidates.
2. The union of what some shard finds frequent becomes a filter of bounded size; whole texts are read again and phrases
   that pass are counted exactly, by their words.
3. Parts, cuts, scores and longer phrases are joins of the frequent phrases.

A shard is no task: values are counted inside a task, then spread by value over as many groups as the words need, so no
phrase, language or shard is gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.llm.anchors import BASE, INVERSE, mix
from loomtrace.llm.common import cut, whole_text

SUPPORT, LONGEST, BEST, SHARE = 10, 3, 2000, 50
SHARDS = 4  # below the support, so that the lowered support stays above one
GROUP = 2_000_000  # phrase occurrences whose values one group counts, about
FILTER_BITS = 1 << 28  # the filter's largest size (32 MB); beyond, more passes it and is counted, nothing is lost
CHUNK = 1 << 20  # words handled at once

SEPARATORS, MARK = b".,;:!?\n\x0b\x0c\r", b"\xff"  # 0xFF occurs in no UTF-8 text
_TO_MARK = bytes.maketrans(SEPARATORS + b"\t", MARK * len(SEPARATORS) + b" ")


def tokens_of(text: bytes) -> list[bytes]:
    """Lower-case (A-Z) words of a text, with MARK between pieces."""
    return text.lower().translate(_TO_MARK).replace(MARK, b" \xff ").split(b" ")


class Chunk:
    """Words of many texts as numbers; `kind` numbers what phrases are counted apart by, `lang` the language."""

    def __init__(self, texts: list[tuple[str, int, bytes]]):
        known: dict[bytes, int] = {MARK: 0}
        langs: dict[str, int] = {}
        lang_of, kinds, parts = [], [], []
        for lang, kind, text in texts:
            tokens = [t for t in tokens_of(text) if t]
            tokens.append(MARK)
            parts.append(np.fromiter((known.setdefault(t, len(known)) for t in tokens), np.int64, len(tokens)))
            lang_of.append(langs.setdefault(lang, len(langs)))
            kinds.append(kind)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.ids = np.concatenate(parts)
        self.lang = np.repeat(np.array(lang_of, np.int64), sizes)
        self.kind = np.repeat(np.array(kinds, np.int64), sizes)
        self.words, self.langs = list(known), list(langs)
        self.word_values = np.array([xxhash.xxh64_intdigest(w, 7) for w in known], np.uint64)
        self.lang_values = np.array([xxhash.xxh64_intdigest(x.encode(), 7) for x in langs], np.uint64)

    def phrases(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, places, 64-bit values) of all phrases inside pieces; the language is part of the value."""
        at = np.flatnonzero(self.ids != 0)
        value = mix(self.lang_values[self.lang[at]] * INVERSE + self.word_values[self.ids[at]])
        for size in range(1, longest + 1):
            if size > 1:
                goes_on = self.ids[at + size - 1] != 0  # a text ends with a mark
                at = at[goes_on]
                value = mix(value[goes_on] * BASE + self.word_values[self.ids[at + size - 1]] + np.uint64(size))
            yield size, at, value


def _numbers(values: np.ndarray, groups: int) -> np.ndarray:
    """Group and 32 bits more of each value, as one number: what is counted instead of the phrase."""
    low = values & np.uint64(0xFFFFFFFF)
    return ((values >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32) << np.uint64(32) | low).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[tuple]]:
    """Texts with the named columns in front, in lists of about CHUNK words."""
    held, size = [], 0
    for batch in batches:
        others = [batch[c].to_pylist() for c in columns]
        for i, text in enumerate(batch["text"]):
            data = text.as_buffer().to_pybytes()
            held.append((*(o[i] for o in others), data))
            size += len(data) // 4 + 1
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _source(docs: DataFrame) -> DataFrame:
    text = whole_text()
    shard = F.pmod(F.xxhash64(F.col("doc_id"), text), F.lit(SHARDS)).cast("int")
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), shard.alias("shard"), text.cast("binary").alias("text"))


def _sizes(docs: DataFrame) -> DataFrame:
    """(lang, shard, n): words of each language in each shard."""
    words = F.size(F.regexp_extract_all(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D.,;:!?]+"), F.lit(0)))
    return docs.select("lang", "shard", words.cast("bigint").alias("n")).groupBy("lang", "shard").agg(F.sum("n").alias("n"))


def _local_numbers(docs: DataFrame, kinds: dict[tuple[str, int], int], longest: int, groups: int) -> DataFrame:
    """(group, packed): the distinct numbers of a task's chunk with their counts, by kind (language and shard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _chunks(batches, ("lang", "shard")):
            texts = [(lang, kinds[lang, shard], text) for lang, shard, text in held if (lang, shard) in kinds]
            if not texts:  # nothing but empty ones
                continue
            chunk = Chunk(texts)
            numbers, kind = (np.concatenate(x) for x in zip(*[(_numbers(v, groups), chunk.kind[at]) for _, at, v in chunk.phrases(longest)]))
            packed: dict[int, list[bytes]] = {}
            for k in np.unique(kind):
                mine, counts = np.unique(numbers[kind == k], return_counts=True)
                edges = np.searchsorted(mine, np.arange(groups + 1) << 32)
                rest, counts = mine.astype("<u4"), counts.astype("<u4")
                for g in np.flatnonzero(np.diff(edges)):
                    low, high = edges[g], edges[g + 1]
                    packed.setdefault(int(g), []).append(np.array([k, high - low], "<u4").tobytes() + rest[low:high].tobytes() + counts[low:high].tobytes())
            rows = [pa.array(packed, pa.int32()), pa.array([b"".join(x) for x in packed.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(rows, ["group", "packed"])

    return docs.mapInArrow(run, "group int, packed binary")


def _unpack(packed: memoryview) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    at = 0
    while at < len(packed):
        kind, n = (int(x) for x in np.frombuffer(packed, "<u4", 2, at))
        yield kind, np.frombuffer(packed, "<u4", n, at + 8), np.frombuffer(packed, "<u4", n, at + 8 + 4 * n)
        at += 8 + 8 * n


def _frequent_numbers(local: DataFrame, least: list[int]) -> DataFrame:
    """(number): what is frequent in some shard, at the shard's share of the support."""

    def mine(part: pa.Table) -> pa.Table:
        found: dict[int, list] = {}
        for packed in part["packed"]:
            for kind, numbers, counts in _unpack(packed.as_buffer()):
                found.setdefault(kind, []).append((numbers, counts))
        often = [np.empty(0, np.uint32)]
        for kind, pieces in found.items():
            numbers, counts = (np.concatenate(x) for x in zip(*pieces))
            order = np.argsort(numbers)
            numbers, counts = numbers[order], counts[order].astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], numbers[1:] != numbers[:-1])))
            often.append(numbers[first[np.add.reduceat(counts, first) >= least[kind]]])
        whole = np.unique(np.concatenate(often)).astype(np.int64) | part["group"][0].as_py() << 32
        return pa.table({"number": whole})

    return local.groupBy("group").applyInArrow(mine, "number bigint")


def _places(numbers: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    spread = mix(numbers.view(np.uint64) + BASE)
    return (spread & np.uint64(bits - 1)).astype(np.int64), (mix(spread) & np.uint64(bits - 1)).astype(np.int64)


def _filter(numbers: DataFrame, n: int) -> tuple[bytes, int]:
    """A Bloom filter of the candidates, at most FILTER_BITS long; tasks send the bytes they set, not the candidates."""
    bits = min(FILTER_BITS, 1 << max(16, (16 * n - 1).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.unique(np.concatenate(_places(batch["number"].to_numpy(), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(both >> 20), pa.array(both & ((1 << 20) - 1))], ["slice", "place"])

    def fill(part: pa.Table) -> pa.Table:
        field = np.zeros(min(bits, 1 << 20), bool)
        field[part["place"].to_numpy()] = True
        return pa.table({"slice": part["slice"][:1], "bits": pa.array([np.packbits(field, bitorder="little").tobytes()], pa.binary())})

    spread = numbers.mapInArrow(places, "slice bigint, place bigint").distinct()  # a slice has no more rows than bits
    field = bytearray(bits // 8)
    for row in spread.groupBy("slice").applyInArrow(fill, "slice bigint, bits binary").toLocalIterator():
        field[row["slice"] << 17 : (row["slice"] << 17) + len(row["bits"])] = row["bits"]
    return bytes(field), bits


def _counted(docs: DataFrame, field: bytes, bits: int, longest: int, groups: int) -> DataFrame:
    """(lang, words, phrase, n): exact counts, inside one chunk, of the phrases that pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.frombuffer(shared.value, np.uint8)
        for held in _chunks(batches, ("lang",)):
            chunk = Chunk([(lang, 0, text) for lang, text in held])
            for size, at, value in chunk.phrases(longest):
                good = np.ones(len(at), bool)
                for place in _places(_numbers(value, groups), bits):
                    good &= (have[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
                at = at[good]
                _, first, n = np.unique(_key(chunk, at, size), return_index=True, return_counts=True)
                heads, table = at[first], chunk.words
                phrases = [b" ".join([table[i] for i in ids]) for ids in np.stack([chunk.ids[heads + j] for j in range(size)], axis=1).tolist()]
                langs = pa.array(chunk.langs, pa.string()).take(pa.array(chunk.lang[heads]))
                yield pa.RecordBatch.from_arrays(
                    [langs, pa.array(np.full(len(n), size, np.int32)), pa.array(phrases, pa.binary()), pa.array(n)], ["lang", "words", "phrase", "n"]
                )

    return docs.mapInArrow(run, "lang string, words int, phrase binary, n bigint")


def _key(chunk: Chunk, at: np.ndarray, size: int) -> np.ndarray:
    """One number per distinct phrase of a language; a prefix is numbered anew where the numbers would pass 62 bits."""
    key, top, words = chunk.lang[at], len(chunk.langs), len(chunk.words)
    for j in range(size):
        if top * words >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            top = len(key) + 1
        key, top = key * words + chunk.ids[at + j], top * words
    return key


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, group: int = GROUP) -> DataFrame:
    """(lang, words, phrase, f) of every phrase of 1 to `longest` words with f >= support occurrences in its language."""
    source = _source(docs)
    sizes = [tuple(r) for r in _sizes(source).filter("n > 0").collect()]  # languages times shards
    total: dict[str, int] = {}
    for lang, _, n in sizes:
        total[lang] = total.get(lang, 0) + n
    least = [-(-support * n // total[lang]) for lang, _, n in sizes]
    kinds = {(lang, shard): i for i, (lang, shard, _) in enumerate(sizes)}
    groups = max(1, -(-sum(total.values()) * longest // group))
    numbers = cut(_frequent_numbers(_local_numbers(source, kinds, longest, groups), least))
    field, bits = _filter(numbers, numbers.count())
    counted = _counted(source.select("lang", "text"), field, bits, longest, groups)
    whole = counted.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= support)
    return cut(whole.select("lang", "words", F.col("phrase").cast("string").alias("phrase"), "f"))


def _scored(frequent: DataFrame, longest: int) -> DataFrame:
    """Candidates with l, r and score of their lowest cut; a part of a frequent phrase is frequent itself."""
    part = lambda name: frequent.select(F.col("lang").alias(f"{name}_lang"), F.col("phrase").alias(name), F.col("f").alias(name[0]))
    words = F.split("phrase", " ", -1)
    cuts = frequent.filter("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "words", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"),
    )
    left, right = part("left").withColumnRenamed("left", "left_part"), part("right").withColumnRenamed("right", "right_part")
    met = cuts.join(left, (F.col("lang") == F.col("left_lang")) & (F.col("left") == F.col("left_part")))
    met = met.join(right, (F.col("lang") == F.col("right_lang")) & (F.col("right") == F.col("right_part")))
    exact = met.select("lang", "words", "phrase", "a", "k", "l", "r", *(F.col(c).cast("decimal(15,0)").alias(f"d{c}") for c in "alr"))
    score = F.expr("cast(1000000 as decimal(7,0)) * (da * da) div (dl * dr)")
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return exact.withColumn("score", score).groupBy("lang", "words", "phrase", "a").agg(best).select("lang", "words", "phrase", "a", "best.l", "best.r", "best.score")


def _inside(frequent: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, longer): the largest count of a longer candidate around each phrase of two words or more."""
    longer = frequent.filter("words > 2").select("lang", "words", F.col("f").alias("longer"), F.split("phrase", " ", -1).alias("w"))
    spans = longer.select("lang", "longer", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    spans = spans.select("lang", "longer", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    return spans.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase")).agg(F.max("longer").alias("longer"))


def collocations(
    docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, best: int = BEST, share: int = SHARE, group: int = GROUP
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `best` phrases of 2 to `longest` words.

    Texts are lower-cased (A-Z), cut at . , ; : ! ? and 0x0A-0x0D, and the pieces into words at blanks and tabs. a, l and r
    are the occurrences of the phrase and of the two parts of its lowest-scoring cut (ties: first cut), n all words of the
    language; score is floor(1000000 a a / (l r)). A phrase inside a longer frequent one goes when the longer one has
    `share` percent of its occurrences. Ranked by score and a, falling, and phrase. A null language is `und`, null and
    empty texts have no words, repeated rows count as often as they stand; other columns are ignored; no rows give no rows.
    """
    frequent = frequent_phrases(docs, support, longest, group)
    inside = _inside(frequent, longest).withColumnsRenamed({"lang": "in_lang", "phrase": "in_phrase"})
    scored = _scored(frequent, longest)
    met = scored.join(inside, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("in_phrase")), "left")
    kept = cut(met.filter(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))).select("lang", "phrase", "a", "l", "r", "score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = max(1, int((kept.count() / max(1, best)) ** 0.5))
    ranked = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    some = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    some = some.withColumn("place", ranked("lang", "part")).filter(F.col("place") <= best)
    top = some.withColumn("rank", ranked("lang")).filter(F.col("rank") <= best)
    n = _sizes(_source(docs)).groupBy("lang").agg(F.sum("n").alias("n")).withColumnRenamed("lang", "n_lang")
    return top.join(n, F.col("lang") == F.col("n_lang")).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
