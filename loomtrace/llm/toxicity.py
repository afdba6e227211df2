"""Toxicity score: a support vector machine on a gapped subsequence kernel, with Nystroem landmarks."""

from __future__ import annotations

import bisect
import functools
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import cut, fold, whole_text
from loomtrace.llm.labelled import training_rows

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
SAMPLE = {1: 4000, 0: 8000}  # labelled documents that are learned from, by label
TOXIC, CLEAN = 96, 32  # landmarks: strings of toxic documents, and clean strings that look like them
DECAY = 0.6  # for each character a subsequence leaves out
STEPS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))  # three characters within five
FLOOR = 0.5  # smaller similarities count as none
STRANGE, SHORTEST = 2, 4  # characters put into a landmark, or marks and digits in place of its own; of landmarks of four characters or more
KEPT = 0.8  # of a landmark's kernel, for each strange character
SHARPNESS = 5.0  # the machine's kernel is exp(SHARPNESS * (similarity - 1))
START = "\x02"  # put before every string, so that subsequences know where it begins
ALTERED = 0.2  # weight of the altered forms of toxic landmarks; either label has 0.5
STIFFNESS = 1e-4  # of the machine's norm against its losses
ODDS = 4.0  # least log odds of a toxic landmark
APART = 0.4  # the largest kernel between two landmarks
ALPHABET = 63
TOKEN = re.compile(r"[^\W_]+")
ENDS = re.compile(r"[.!?]")
CACHED = 300_000
PIECE = 20_000
TOGETHER = 500_000  # characters whose strings are looked up at once


def tokens_of(text: str) -> list[str]:
    """What blanks separate, in lower case; a line's end is a token that ends a sentence."""
    return text.lower().replace("\n", " . ").split()


def strings(token: str) -> list[str]:
    """The words of a token, and what they are together when marks break it."""
    found = TOKEN.findall(token)
    return found if len(found) < 2 else [*found, "".join(found)]


@functools.cache
def _kinds() -> np.ndarray:
    """Of each code point: 1 for a letter or digit, 2 for a blank, 0 for others."""
    chars = list(map(chr, range(0x110000)))
    return np.fromiter(map(str.isalnum, chars), np.uint8, len(chars)) + 2 * np.fromiter(map(str.isspace, chars), np.uint8, len(chars))


def spelled(text: str) -> list[str]:
    """Words that three or more single characters spell out, with one to three others between neighbours.

    Marks and line ends count as characters between, blanks in a row as one; text is in lower case.
    """
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.concatenate((np.full(1, 2, np.uint8), _kinds()[chars], np.full(1, 2, np.uint8)))
    alone = np.flatnonzero((kind[1:-1] == 1) & (kind[:-2] != 1) & (kind[2:] != 1))
    if len(alone) < 3:
        return []
    place = np.cumsum((kind[1:-1] != 2) | (kind[:-2] != 2))[alone]  # blanks in a row take one place
    runs = np.split(alone, np.flatnonzero(np.diff(place) > 4) + 1)
    return ["".join(map(text.__getitem__, run)) for run in runs if len(run) > 2]


def family(words: list[str]) -> int:
    """The smallest hash of three words in a row: near copies of a text mostly share it, other texts do not."""
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))), default=0)


def altered(word: str) -> list[str]:
    """The word with a strange character put in, or in place of one of its own, at a few places."""
    places = range(1, len(word), max(1, len(word) // 4))
    put_in = [word[:i] + x + word[i:] for x in ("0", "00") for i in places]
    return put_in + [word[:i] + "0" + word[i + 1 :] for i in places if len(word) >= SHORTEST and i + 1 < len(word)]


def strange(word: str, text: str, most: int = STRANGE) -> int:
    """Least number of characters put into the word, or other than letters in place of its own, that give the text; over most if more."""
    i = 0
    while i < min(len(word), len(text)) and word[i] == text[i]:
        i += 1
    if i == len(word):
        return len(text) - i
    if i == len(text) or not most:
        return most + 1
    found = strange(word[i:], text[i + 1 :], most - 1)
    return 1 + (found if text[i].isalpha() else min(found, strange(word[i + 1 :], text[i + 1 :], most - 1)))


class Landmarks:
    """Subsequence kernel against a fixed set of strings.

    A string's features are its triples of characters within five places, each weighted by DECAY per character left out;
    a similarity is the product of two strings' features, divided by both norms, and the kernel a sharper function of it.
    Only triples that landmarks have are looked up, so the cost is linear in the text.

    Short landmarks lose most triples by one strange character. So a string that holds a whole landmark, but for at most
    STRANGE characters put in or marks and digits in place of its own, has a kernel of KEPT for each of them at least, as
    one gapped subsequence. Letters are put in between its first and its last character only.
    """

    def __init__(self, words: list[str]):
        self.words = words
        tally: dict[str, int] = {}
        for w in words:
            for c in START + w:
                tally[c] = tally.get(c, 0) + 1
        letters = sorted(tally, key=lambda c: (-tally[c], c))[:ALPHABET]
        self.codes = np.array(sorted(map(ord, letters)), np.uint32) if letters else np.array([0], np.uint32)
        size = len(self.codes) + 1
        self.size, self.place = size, np.full(size**3, -1, np.int32)
        owner, triple, weight, norm = self._triples(words)
        known, at = np.unique(triple, return_inverse=True)
        self.place[known] = np.arange(len(known))
        self.table = np.zeros((max(1, len(known)), len(words)), np.float32)
        np.add.at(self.table, (at, owner), weight / np.maximum(norm[owner], 1e-9))
        self.ends: dict[tuple[str, str, int], list[int]] = {}  # landmarks by their ends ("" for any) and the length of altered forms
        for i, w in enumerate(words):
            if len(w) >= SHORTEST:
                for first, last, more in itertools.product((w[0], ""), (w[-1], ""), range(STRANGE + 1)):
                    self.ends.setdefault((first, last, len(w) + more), []).append(i)

    def _triples(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(string, triple, weight) of all triples of known characters, and the norm of each string."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        chars = np.frombuffer("".join([START + w for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.codes, chars), len(self.codes) - 1)
        ids = np.where(self.codes[at] == chars, at + 1, 0) if len(chars) else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(words)), lengths)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(chars))  # characters to the end of the string
        found, square = [], np.zeros(len(words))
        for j, k in STEPS:
            w = DECAY ** (k - 2)
            square += w * w * np.maximum(lengths - k, 0)
            i = np.flatnonzero(left > k)
            a, b, c = ids[i], ids[i + j], ids[i + k]
            full = (a > 0) & (b > 0) & (c > 0)
            found.append((owner[i[full]], (a[full] * self.size + b[full]) * self.size + c[full], np.full(int(full.sum()), w, np.float32)))
        o, t, w = (np.concatenate(x) for x in zip(*found))
        return o, t, w, np.sqrt(square)

    def similar(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(indexes, kernels): the strings with a similarity of FLOOR or more, or that hold a landmark with strange characters,
        and their row of kernels; 0 for others."""
        at, rows = self._alike(words)
        place = dict(zip(at.tolist(), range(len(at))))
        held = []
        for i, w in enumerate(words):
            if w:
                key = (w[0] if w[0].isalpha() else "", w[-1] if w[-1].isalpha() else "", len(w))
                held += [(i, j, n) for j in self.ends.get(key, ()) if (n := strange(self.words[j], w)) <= STRANGE]
        if not held:
            return at, rows
        new = [i for i in dict.fromkeys(i for i, _, _ in held) if i not in place]
        place.update(zip(new, range(len(at), len(at) + len(new))))
        rows = np.concatenate((rows, np.zeros((len(new), len(self.words)), rows.dtype)))
        for i, j, n in held:
            rows[place[i], j] = max(rows[place[i], j], KEPT**n)
        return np.concatenate((at, np.array(new, np.int64))), rows

    def _alike(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Strings with a similarity of FLOOR or more, by their triples."""
        keep, rows = [], []
        for low in range(0, len(words), PIECE):
            owner, triple, weight, norm = self._triples(words[low : low + PIECE])
            feature = self.place[triple]
            hit = feature >= 0
            owner, feature, weight = owner[hit], feature[hit], weight[hit]
            # a kernel is at most the norm of the shared features over the string's own
            some = np.flatnonzero(np.bincount(owner, weight, len(norm)) >= FLOOR * norm * 0.999)
            some = some[norm[some] > 0]
            if not len(some):
                continue
            number = np.full(len(norm), -1)
            number[some] = np.arange(len(some))
            mine = number[owner] >= 0
            owner, feature, weight = number[owner[mine]], feature[mine], weight[mine]
            by = np.argsort(owner, kind="stable")
            owner, feature, weight = owner[by], feature[by], weight[by]
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            kernel = np.add.reduceat(self.table[feature] * weight[:, None], first, axis=0) / norm[some[owner[first]]][:, None]
            close = (kernel >= FLOOR).any(axis=1)
            kernel = kernel[close]
            keep.append(some[owner[first]][close] + low)
            rows.append(np.where(kernel >= FLOOR, np.exp(SHARPNESS * (np.minimum(kernel, 1) - 1)), 0))
        if not keep:
            return np.empty(0, np.int64), np.empty((0, len(self.words)), np.float32)
        return np.concatenate(keep), np.concatenate(rows)


class Model:
    """Landmarks, the machine's weights over their kernels, and its calibration."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks, self.weights, self.bias, self.slope, self.shift = landmarks, np.zeros(len(landmarks.words)), 0.0, 0.0, 0.0
        self.forget()

    def forget(self) -> None:
        """Empty what was looked up: kernels of strings and of tokens, and the tokens that end a sentence."""
        self.known: dict[str, np.ndarray | None] = {}
        self.rows: dict[str, np.ndarray | None] = {}
        self.ends: set[str] = set()

    def learn(self, words: list[str]) -> None:
        """Kernels of strings that were not seen before."""
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        self.known.update(dict.fromkeys(new))
        at, rows = self.landmarks.similar(new)
        self.known.update((new[i], row) for i, row in zip(at.tolist(), rows))

    def largest(self, words: list[str]) -> np.ndarray | None:
        near = [r for r in map(self.known.get, words) if r is not None]
        return None if not near else near[0] if len(near) == 1 else np.max(near, axis=0)

    def kernels(self, texts: Iterator[str]) -> Iterator[np.ndarray]:
        """Per text a row for each sentence with a string near a landmark: the largest kernel of its strings with each.

        A word that is spelled out in single characters is a sentence of its own.
        """
        for part in self._parts(texts):
            if len(self.known) > CACHED or len(self.rows) > CACHED:
                self.forget()
            part, apart = [tokens for tokens, _ in part], [words for _, words in part]
            sets = [set(tokens) for tokens in part]
            new = {t: strings(t) for t in set().union(*sets) if t not in self.rows}
            self.learn([w for words in [*new.values(), *apart] for w in words])
            self.rows.update((t, self.largest(words)) for t, words in new.items())
            self.ends.update(t for t in new if ENDS.search(t))
            for tokens, known, words in zip(part, sets, apart):
                out = [r for r in map(self.known.get, words) if r is not None]
                near = {t for t in known if self.rows[t] is not None}
                if near:
                    at = [i for i, t in enumerate(tokens) if t in near]
                    ends = [i for i, t in enumerate(tokens) if t in self.ends]
                    for _, group in itertools.groupby(at, lambda i: bisect.bisect_left(ends, i)):
                        found = [self.rows[t] for t in dict.fromkeys(tokens[i] for i in group)]
                        out.append(np.max(found, axis=0) if len(found) > 1 else found[0])
                yield np.array(out, np.float32).reshape(len(out), len(self.weights))

    @staticmethod
    def _parts(texts: Iterator[str]) -> Iterator[list[tuple[list[str], list[str]]]]:
        """Tokens of texts and words spelled out, some at a time, so that their new strings are looked up together."""
        part, size = [], 0
        for text in texts:
            part.append((tokens_of(text), spelled(text.lower())))
            size += len(text)
            if size > TOGETHER:
                yield part
                part, size = [], 0
        yield part

    def scores(self, texts: Iterator[str]) -> list[float]:
        best = [max(float((rows @ self.weights).max()) if len(rows) else 0.0, 0.0) for rows in self.kernels(texts)]
        return (1 / (1 + np.exp(-np.clip(self.slope * (np.array(best) + self.bias) + self.shift, -30, 30)))).tolist()


def _machine(model: Model, rows: np.ndarray, labels: np.ndarray, share: float, toxic: int) -> None:
    """Support vector machine (squared hinge) among the functions that landmarks span, then a logistic fit of its margins.

    A function is a weight per landmark, its norm taken from the landmarks' own kernels (the Nystroem space). Toxic
    landmarks, the first ones, speak for label 1 and clean ones against it.
    """
    words = model.landmarks.words
    gram = np.zeros((len(words), len(words)))
    at, kernels = model.landmarks.similar(words)
    gram[at] = kernels
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    gram = vector * np.maximum(value, 1e-3) @ vector.T  # small similarities were cut off, which may leave it indefinite
    sign = np.where(np.arange(len(words)) < toxic, 1, -1)
    # toxic landmarks teach in altered forms too
    _, forms = model.landmarks.similar([v for w in words[:toxic] for v in altered(w)])
    x, y = np.concatenate((rows, forms)), np.concatenate((2 * labels - 1, np.ones(len(forms))))
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    weight = np.concatenate((weight, np.full(len(forms), ALTERED / max(1, len(forms)))))
    step = 1 / (2 * (weight * ((x**2).sum(axis=1) + 1)).sum() + 2 * STIFFNESS * np.linalg.norm(gram, 2))
    w, b = np.zeros(len(words)), 0.0
    v, c, t = w, b, 1.0
    for _ in range(3000):
        slack = np.maximum(0, 1 - y * (x @ v + c)) * y * weight
        new_w = np.maximum(sign * (v - step * (2 * STIFFNESS * gram @ v - 2 * slack @ x)), 0) * sign
        new_b, t_next = c + step * 2 * slack.sum(), (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new_w + (t - 1) / t_next * (new_w - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new_w, new_b, t_next
    model.weights, model.bias = w, float(b)
    # calibration with the share of toxic documents among all labelled ones
    margin = np.maximum(rows @ model.weights, 0) + model.bias
    share = min(max(share, 1e-3), 1 - 1e-3)
    weight = np.where(labels == 1, share / max(1, labels.sum()), (1 - share) / max(1, (1 - labels).sum()))
    fit = np.zeros(2)
    z = np.stack((margin, np.ones(len(margin))), axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ fit, -30, 30)))
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2)
        fit = fit + np.linalg.solve(curve, (z * (weight * (labels - p))[:, None]).sum(axis=0) - 1e-4 * fit)
    model.slope, model.shift = max(float(fit[0]), 0.0), float(fit[1])


def _apart(words: list[str], most: int) -> list[str]:
    """The first words of the list that are not close to one before them."""
    chosen: list[str] = []
    landmarks = Landmarks(words) if words else None
    if landmarks:
        at, kernels = landmarks.similar(words)
        row = dict(zip(at.tolist(), kernels))
        taken: list[int] = []
        for i, w in enumerate(words):
            if len(taken) < most and (i not in row or not taken or row[i][taken].max() < APART):
                taken.append(i)
                chosen.append(w)
    return chosen


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> Model:
    """Learn from at most the sampled number of labelled documents.

    Landmarks are the strings that set toxic documents apart, and the clean strings most like them. A document teaches by
    the sentence that is nearest to the toxic landmarks. Strings are counted on Spark; the driver sees the best of them and
    one row of kernels per sampled document.
    """
    rows = cut(training_rows(docs, labels, "toxic", FOLDS, HELD_OUT, sample))

    def words(batches):
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                told = tokens_of(text.as_py())
                own = sorted({w for t in set(told) for w in strings(t)} | set(spelled(text.as_py().lower())))
                same = [pa.array(np.full(len(own), x), t) for x, t in ((label.as_py(), pa.int32()), (family(told), pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), *same], ["word", "label", "family"])

    # a word counts once for near copies of a document
    counts = rows.mapInArrow(words, "word string, label int, family bigint").distinct()
    counts = cut(counts.groupBy("word").agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n")))
    totals = rows.agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = totals["toxic"] or 0, totals["n"] - (totals["toxic"] or 0)
    if not toxic or not clean:
        model = Model(Landmarks([]))
        model.shift = 30.0 if toxic else -30.0 if clean else 0.0
        return model
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("toxic") + 0.5) / (clean + 1))
    told = counts.filter(F.col("toxic") >= max(3, toxic // 250)).select("word", (odds * F.sqrt("toxic")).alias("told"), odds.alias("odds")).filter(odds > ODDS)
    bad = _apart([r["word"] for r in told.filter(F.length("word") > 2).orderBy(F.desc("told"), "word").limit(4 * TOXIC).collect()], TOXIC)
    first = Landmarks(bad)

    def alike(batches):
        for batch in batches:
            own = batch["word"].to_pylist()
            at, kernels = first.similar(own)
            yield pa.RecordBatch.from_arrays([batch["word"].take(pa.array(at)), batch["n"].take(pa.array(at)), pa.array(kernels.max(axis=1).astype(float) if len(at) else [], pa.float64())], ["word", "n", "near"])

    usual = counts.filter(F.col("toxic") * clean <= (F.col("n") - F.col("toxic")) * toxic).select("word", "n").mapInArrow(alike, "word string, n bigint, near double")
    good = [r["word"] for r in usual.orderBy(F.desc(F.col("near") * F.sqrt("n")), "word").limit(CLEAN).collect()] if bad else []
    model = Model(Landmarks(bad + good))

    def witness(batches):
        for batch in batches:
            out = []
            for found in model.kernels(x.as_py() for x in batch["text"]):
                out.append(found[found[:, : len(bad)].max(axis=1).argmax()].tolist() if len(found) and bad else [0.0] * len(model.weights))
            kin = [family(tokens_of(x.as_py())) for x in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(kin, pa.int64()), pa.array(out, pa.list_(pa.float64()))], ["label", "family", "row"])

    seen = rows.select("label", "text").mapInArrow(witness, "label int, family bigint, row array<double>")
    seen = seen.groupBy("label", "family").agg(F.max("row").alias("row")).collect()
    x, y = np.array([r["row"] for r in seen]).reshape(len(seen), len(model.weights)), np.array([r["label"] for r in seen], float)
    order = np.lexsort((*x.T, y)) if len(model.weights) else np.arange(len(y))
    share = labels.filter(~fold("doc_id", FOLDS, HELD_OUT)).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if len(model.weights):
        _machine(model, x[order], y[order], share or 0.0, len(bad))
    else:
        model.shift = float(np.log(min(max(share, 1e-3), 1 - 1e-3) / (1 - min(max(share, 1e-3), 1 - 1e-3))))
    model.forget()
    return model


def score_documents(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.3) of every row of docs.

    A document's margin is that of its worst sentence, whole texts read. Null texts are empty ones and score like a text
    without any string near a landmark; without labels every score is 0.5. Repeated rows are scored alike, labels of
    unknown documents and null labels are ignored, as are other columns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = pa.array(model.scores(x.as_py() for x in batch["text"]), pa.float64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], scores], ["doc_id", "score"])

    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    scored = text.mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", fold("doc_id", FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> DataFrame:
    """docs without the rows that score_documents predicts as toxic; rows pass through whole, nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = model.scores(x.as_py() or "" for x in batch["text"])
            yield batch.filter(pa.array(np.array(scores) < THRESHOLD, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
