"""Quality score: histogram gradient-boosted trees over statistics of whole documents."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import fold, whole_text
from loomtrace.llm.labelled import training_rows

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
SAMPLE = {0: 10_000, 1: 10_000}  # labelled documents that are learned from, by label
BINS, DEPTH, TREES, RATE, LEAST_ROWS, RIDGE = 64, 4, 120, 0.1, 10, 1.0
MARKS = b"#$%&*|!?.,;:@<>{}[]()=+-_/\\\"'"


def statistics(text: bytes) -> list[float]:
    """Numbers about one text; none depends on its language or source."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if n else np.zeros(256, np.int64)
    share = counts / max(1, n)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    tally = Counter(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    often = [c for _, c in tally.most_common(5)]
    some = max(1, len(words))
    line_words = np.fromiter((len(x) for x in lines), np.int64, len(lines))
    seen = share[share > 0]
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), len(words) / max(1, len(lines)),
        float(sizes.mean()) if len(sizes) else 0.0, float(sizes.std()) if len(sizes) else 0.0, float(sizes.max()) if len(sizes) else 0.0,
        len(tally) / some, (often[0] if often else 0) / some, sum(often) / some, len(set(lines)) / max(1, len(lines)),
        float(line_words.std()) if len(lines) else 0.0, float(share[48:58].sum()), float(share[65:91].sum()), float(share[97:123].sum()),
        float(share[128:].sum()), float(share[[32, *range(9, 14)]].sum()), float(share[10]), float(share[:9].sum()),
        -float((seen * np.log2(seen)).sum()), len(zlib.compress(text, 1)) / max(1, n),
        sum(w[:1].isupper() for w in words) / some, sum(w.isupper() for w in words) / some, sum(w.isalpha() for w in words) / some,
        float((sizes == 1).mean()) if len(sizes) else 0.0,
        *(float(share[c]) for c in MARKS),
    ]


class Trees:
    """Boosted trees of one depth, flattened: node i of a tree has children 2i+1 and 2i+2; leaves hold values."""

    def __init__(self, base: float, cuts: list[np.ndarray]):
        self.base, self.cuts = base, cuts
        self.feature, self.bin, self.value = np.empty((0, (1 << DEPTH) - 1), np.int64), np.empty((0, (1 << DEPTH) - 1), np.int64), np.empty((0, 1 << DEPTH))

    def bins(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, rows[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1) if len(rows) else np.empty((0, len(self.cuts)), np.int64)

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """All rows through all trees at once, a level at a time."""
        binned = self.bins(rows)
        if not len(self.feature) or not len(rows):
            return np.full(len(rows), self.base)
        tree, node, row = np.arange(len(self.feature)), np.zeros((len(rows), len(self.feature)), np.int64), np.arange(len(rows))[:, None]
        for _ in range(DEPTH):
            node = 2 * node + 1 + (binned[row, self.feature[tree, node]] > self.bin[tree, node])
        return self.base + self.value[tree, node - ((1 << DEPTH) - 1)].sum(axis=1)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows), -30, 30)))


def train(rows: np.ndarray, labels: np.ndarray, prior: float) -> Trees:
    """Logistic boosting on histograms of quantile bins; rows are weighted so that label 1 has the share `prior`."""
    prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
    cuts = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(rows) else np.empty(0) for j in range(rows.shape[1])]
    model = Trees(float(np.log(prior / (1 - prior))), cuts)
    ones = int(labels.sum())
    if not ones or ones == len(labels):
        return model
    weight = np.where(labels == 1, prior * len(labels) / ones, (1 - prior) * len(labels) / (len(labels) - ones))
    binned, width = model.bins(rows), rows.shape[1]
    cell = binned + np.arange(width) * BINS
    margin, features, bins, values = np.full(len(rows), model.base), [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        gradient, curve = weight * (labels - p), weight * p * (1 - p)
        node = np.zeros(len(rows), np.int64)
        feature, split = np.zeros((1 << DEPTH) - 1, np.int64), np.full((1 << DEPTH) - 1, BINS)
        for level in range(DEPTH):
            first, n = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (width * BINS) + cell).ravel()
            sums = [np.bincount(at, np.repeat(v, width), n * width * BINS).reshape(n, width, BINS).cumsum(axis=2) for v in (gradient, curve, np.ones(len(rows)))]
            (g, h, c), (g_all, h_all, c_all) = sums, (s[:, :, -1:] for s in sums)
            gain = g**2 / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all**2 / (h_all + RIDGE)
            gain[(c < LEAST_ROWS) | (c_all - c < LEAST_ROWS)] = 0
            flat = gain.reshape(n, -1)
            found = flat.argmax(axis=1)
            worth = flat[np.arange(n), found] > 1e-6
            feature[first : first + n] = np.where(worth, found // BINS, 0)
            split[first : first + n] = np.where(worth, found % BINS, BINS)
            node = 2 * node + 1 + (binned[np.arange(len(rows)), feature[node]] > split[node])
        leaf = node - ((1 << DEPTH) - 1)
        value = RATE * np.bincount(leaf, gradient, 1 << DEPTH) / (np.bincount(leaf, curve, 1 << DEPTH) + RIDGE)
        margin = margin + value[leaf]
        features.append(feature), bins.append(split), values.append(value)
    model.feature, model.bin, model.value = np.array(features), np.array(bins), np.array(values)
    return model


WIDTH = len(statistics(b""))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(x.as_buffer().to_pybytes()) for x in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["label"], pa.array(rows, pa.list_(pa.float64()))], ["label", "row"])


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> Trees:
    """Trees from at most the sampled number of labelled documents; their statistics are all the driver sees."""
    rows = training_rows(docs, labels, "quality", FOLDS, HELD_OUT, sample)
    measured = rows.select("label", F.col("text").cast("binary").alias("text")).mapInArrow(_measure, "label int, row array<double>").collect()
    x = np.array([r["row"] for r in measured], float).reshape(len(measured), WIDTH)
    y = np.array([r["label"] for r in measured], float)
    order = np.lexsort((*x.T, y))  # the same trees whatever order the rows come in
    share = labels.filter(~fold("doc_id", FOLDS, HELD_OUT)).agg(F.avg(F.col("quality").cast("double"))).first()[0]
    return train(x[order], y[order], 0.5 if share is None else share)


def score_documents(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.3) of every row of docs.

    Null texts are empty ones and get the score of an empty text; without labels every score is that of the prior, 0.5.
    Repeated rows are scored alike, labels of unknown documents and null labels are ignored, as are other columns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(x.as_buffer().to_pybytes()) for x in batch["text"]], float).reshape(len(batch), WIDTH)
            parts = [shared.value.scores(rows[i : i + 1000]) for i in range(0, len(rows), 1000)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.concatenate(parts) if parts else [], pa.float64())], ["doc_id", "score"])

    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().cast("binary").alias("text"))
    scored = text.mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", fold("doc_id", FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
