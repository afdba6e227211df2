"""Periodic runs of words: frequency splitting leaves the stretches that can hold a run, and a scan over lags finds them.

A run is a stretch of words with smallest period q, at least `times` periods and `least` words long, that no neighbour
extends. Every word of a run occurs at least `times` times in it. A word that occurs more rarely inside its segment can
therefore lie in no run and splits the segment; shorter segments make further words rare, so this is repeated until
nothing changes. Only what is left is scanned.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import WORD, whole_text

LEAST, TIMES = 6, 4  # words and periods of a run
STEP = 1 << 20  # places compared at once


def word_ids(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def segments(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """[start, end) of the stretches left by splitting at words that occur fewer than `times` times in their stretch."""
    done = []
    at = np.arange(len(ids))
    if len(ids) < least or np.bincount(ids).max() < times:
        return []
    while len(at):
        breaks = np.flatnonzero(np.diff(at) != 1) + 1
        segment = np.zeros(len(at), np.int64)
        segment[breaks] = 1
        segment = np.cumsum(segment)
        _, group, counts = np.unique(segment * (ids.max() + 1) + ids[at], return_inverse=True, return_counts=True)
        stays = counts[group] >= times
        kept = np.bincount(segment, stays)
        size = np.bincount(segment)
        for s in np.flatnonzero((kept == size) & (size >= least)):
            begin = at[np.searchsorted(segment, s)]
            done.append((int(begin), int(begin + size[s])))
        at = at[stays & (kept < size)[segment] & (size >= least)[segment]]
    return sorted(done)


def _agreement(ids: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """[start, end) of the places i around `at` with ids[i] == ids[i + lag]; parts of doubling size are compared."""
    start, size = at, 64
    while start > 0:
        low = max(0, start - size)
        other = np.flatnonzero(ids[low:start] != ids[low + lag : start + lag])
        if len(other):
            start = low + int(other[-1]) + 1
            break
        start, size = low, 2 * size
    end, size, top = at, 64, len(ids) - lag
    while end < top:
        high = min(top, end + size)
        other = np.flatnonzero(ids[end:high] != ids[end + lag : high + lag])
        if len(other):
            end += int(other[0])
            break
        end, size = high, 2 * size
    return start, end


def _candidates(ids: np.ndarray, times: int, reach: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(lag, places) where `times` words a lag apart agree, lags rising; places are multiples of the lag.

    A stretch of `times` periods holds that many such places in a row. Small lags are taken one by one, large ones
    together by the number of the place, so Python takes 2 sqrt(n) steps and numpy n log n. Places inside a run found
    so far need no look: by Fine and Wilf its period divides the lag.
    """
    n = len(ids)
    most = n // times
    few = min(most, int(n**0.5))
    for lag in range(1, few + 1):
        marks = ids[::lag]
        count = (n - 1) // lag + 1 - (times - 1)
        same = marks[1:] == marks[:-1]
        hit = same[:count].copy()
        for t in range(1, times - 1):
            hit &= same[t : t + count]
        places = np.flatnonzero(hit) * lag
        yield lag, places
    lags, found = np.arange(few + 1, most + 1), []
    k = 0
    while len(lags := lags[(k + times - 1) * lags < n]):
        for low in range(0, len(lags), STEP):
            part = lags[low : low + STEP]
            first = ids[k * part]
            good = part[np.logical_and.reduce([ids[(k + t) * part] == first for t in range(1, times)])]
            for t in range(1, 8):  # more places of the same stretch, so that chance agreements go at once
                step = good * t // 4
                inside = k * good + step + good < n
                good = good[inside & (ids[np.where(inside, k * good + step, 0)] == ids[np.where(inside, k * good + step + good, 0)])]
            good = good[reach[k * good] < (k + times - 1) * good + 1]
            if len(good):
                found.append(np.stack([good, k * good]))
        k += 1
    if found:
        both = np.concatenate(found, axis=1)
        both = both[:, np.lexsort((both[1], both[0]))]
        for part in np.split(both, np.flatnonzero(np.diff(both[0])) + 1, axis=1):
            yield int(part[0, 0]), part[1]


def segment_runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs inside one segment."""
    out, reach = [], np.zeros(len(ids) + 1, np.int64)  # reach: the furthest end of a run that starts at or before a place
    for lag, places in _candidates(ids, times, reach):
        new, seen = [], -1
        for at in places[reach[places] < places + (times - 1) * lag + 1].tolist():
            if at < seen:
                continue
            start, end = _agreement(ids, at, lag)
            seen = max(seen, end)
            if end - start + lag >= max(least, times * lag):
                new.append((start, end - start + lag, lag))
        # a stretch that a shorter period explains was found with that period
        new = [r for r in new if reach[r[0]] < r[0] + r[1]]
        for start, length, _ in new:
            reach[start] = max(reach[start], start + length)
        if new:
            np.maximum.accumulate(reach, out=reach)
            out += new
    return out


def runs_of(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, by start, then period."""
    found = [(low + s, n, q) for low, high in segments(ids, least, times) for s, n, q in segment_runs(ids[low:high], least, times)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words a run holds after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) > 0


def _rows(docs: DataFrame, summary, schema: str, arrow: list[tuple[str, pa.DataType]], least: int, times: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                words = text.as_buffer().to_pybytes().split()
                runs = runs_of(word_ids(words), least, times)
                gone = dropped(len(words), runs) if runs else None
                rows.append(summary(runs, b" ".join(itertools.compress(words, (~gone).tolist()) if runs else words)))
            columns = list(zip(*rows)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, kind) for c, (_, kind) in zip(columns, arrow))], ["doc_id", *(n for n, _ in arrow)])

    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().cast("binary").alias("text"))
    return text.mapInArrow(run, "doc_id bigint, " + schema)


def collapse_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start, then period) and collapsed: the text without repeats.

    Words are runs of bytes other than 0x20 and 0x09-0x0D. A word is left out when a run holds it after the run's first
    period; the others are joined by one blank. Rows are independent, so repeated rows give repeated results. Null and
    empty texts have no runs and an empty collapsed text; other columns are ignored; no rows give no rows. A text is
    handled whole: about n log n steps, memory in proportion to its words.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def summary(runs, kept):
        return [dict(zip(("start", "length", "period"), r)) for r in runs], kept.decode()

    schema = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return _rows(docs, summary, schema, [("runs", kind), ("collapsed", pa.string())], least, times)


def run_digests(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """What collapse_runs finds, as numbers and digests.

    doc_id, n_runs; start, length, period and exponent_milli of the longest run (ties: smallest start, then period; no
    run: nulls); runs_sha256 over `start,length,period` lines of all runs; collapsed_sha256 over the text without repeats.
    """

    def summary(runs, kept):
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        exponent = 1000 * best[1] // best[2] if runs else None
        return len(runs), *best, exponent, sha256(listed.encode()).hexdigest(), sha256(kept).hexdigest()

    numbers = ["n_runs", "start", "length", "period", "exponent_milli"]
    digests = ["runs_sha256", "collapsed_sha256"]
    schema = ", ".join([f"{c} bigint" for c in numbers] + [f"{c} string" for c in digests])
    return _rows(docs, summary, schema, [(c, pa.int64()) for c in numbers] + [(c, pa.string()) for c in digests], least, times)


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """Documents in which a tenth, chosen by a digest of doc_id, end in a repetition of their own words.

    With h = crc32 of the id as text and g = floor(h / 10): where h is a multiple of 10, word i >= a becomes word
    a + (i - a) % p, with a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Other texts, those without words and those
    without an id stay; changed ones have single blanks. Returns doc_id and text.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(whole_text(), F.lit(WORD), F.lit(0))
    n = F.size("words").cast("bigint")
    g = F.floor(F.col("h") / 10)
    a = F.pmod(g, F.col("n"))

    def place(i: Column) -> Column:
        return F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p")))

    marked = docs.select("doc_id", "text", h.alias("h"))
    marked = marked.select("*", F.when(F.col("h") % 10 == 0, words).alias("words"))
    sized = marked.select("*", F.when(n > 0, n).alias("n"))
    placed = sized.select("*", a.alias("a")).select("*", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.pmod(g, F.lit(8))))).alias("p"))
    changed = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), lambda i: F.get("words", place(i).cast("int"))), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))
