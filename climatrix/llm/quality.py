"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled rows (``TRAIN_ROWS``,
those with the smallest hash of their id), so the fit is a small numpy job on
the driver at any input size; statistics and scores cover every text and are
computed by Spark tasks. Trees are complete and flattened into arrays, and a
batch of documents walks all trees at once, one level per step.

Defined results: a null or empty text has statistics of zero and gets the
score of those; rows of ``labels`` with a null id or label are left out,
repeated labels of one id vote (mean of at least 0.5 counts as 1); without
labels of both classes every score is the share of label 1 (0.5 without any).
Repeated documents rows each get their score. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climatrix.llm import statistics
from climatrix.llm import text as T
from climatrix.llm.tables import fold, stored

#: Most labelled rows that the trees are fitted on.
TRAIN_ROWS = 20_000
FOLDS = 5
THRESHOLD = 0.3


@dataclass
class Forest:
    """Complete trees as arrays: node i has children 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # right if the value is above
    leaf: np.ndarray  # trees x leaves

    def scores(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(trees):  # per tree the temporaries are one number a document
            node = np.zeros(len(x), dtype=np.int64)
            while inner and node[0:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, self.feature[t][node]] > self.cut[t][node])
            z += self.leaf[t][node - inner]
        return 1.0 / (1.0 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0) -> Forest:
    """Newton boosting of the logistic loss on binned columns; deterministic."""
    share = float(y.mean()) if len(y) else 0.5
    inner = 2**depth - 1
    if share in (0.0, 1.0) or not len(y):
        p = min(max(share, 1e-3), 1 - 1e-3)
        return Forest(float(np.log(p / (1 - p))), np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    code = np.column_stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(k)])
    base = float(np.log(share / (1 - share)))
    z = np.full(n, base)
    feature, cut, leaf = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            width, low = 2**level, 2**level - 1
            gain = np.full(width, 1e-6)
            for j in range(k):
                m = len(edges[j]) + 1
                at = (node - low) * m + code[:, j]
                gs = np.bincount(at, g, width * m).reshape(width, m).cumsum(1)
                hs = np.bincount(at, h, width * m).reshape(width, m).cumsum(1)
                g_all, h_all = gs[:, -1:], hs[:, -1:]
                gl, hl = gs[:, :-1], hs[:, :-1]
                better = gl**2 / (hl + ridge) + (g_all - gl) ** 2 / (h_all - hl + ridge) - g_all**2 / (h_all + ridge)
                better = np.where((hl < 1) | (h_all - hl < 1), -1, better)
                if m > 1:
                    best = better.argmax(1)
                    value = better[np.arange(width), best]
                    won = np.flatnonzero(value > gain)
                    gain[won] = value[won]
                    feature[t, low + won] = j
                    cut[t, low + won] = edges[j][best[won]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t][node]] > cut[t][node])
        at = node - inner
        leaf[t] = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        z += leaf[t][at]
    return Forest(base, feature, cut, leaf)


def with_features(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics (array of double) of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1)
        for b in batches:
            col = T.texts(b.column("text"))
            for i, j in T.slices(col):
                x = statistics.features(col[i:j], compress)
                flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], flat], ["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(T.releasing(run), f"doc_id {kind}, x array<double>")


def training_rows(labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """At most ``limit`` labelled ids outside the held-out fold, the same ones at every run."""
    votes = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(fold("doc_id", FOLDS) != 0)
    one = votes.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def train(features: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Forest:
    """Trees fitted on the statistics of the sampled labelled rows."""
    chosen = training_rows(labels, limit)  # bounded by ``limit``, so it can be broadcast
    rows = features.join(F.broadcast(chosen), "doc_id").select("doc_id", "x", "y").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: str(r["doc_id"]))
    x = np.array([r["x"] for r in rows], dtype=float).reshape(len(rows), len(statistics.FEATURES))
    return fit(x, np.array([r["y"] for r in rows], dtype=float))


def scored(features: DataFrame, forest: Forest) -> DataFrame:
    """``features`` rows with a ``score`` of 0 to 1 in place of the statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column("x").flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(b.num_rows, len(statistics.FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(forest.scores(x))], ["doc_id", "score"])

    kind = features.schema["doc_id"].dataType.simpleString()
    return features.mapInArrow(T.releasing(run), f"doc_id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    features = stored(with_features(docs), "quality-features")
    out = scored(features, train(features, labels, limit))
    return out.select(
        "doc_id",
        (fold("doc_id", FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all their columns unchanged.

    Scores are computed a second time beside the rows themselves, so no join
    on ids is needed and repeated ids can't multiply rows.
    """
    labelled = with_features(docs.join(F.broadcast(training_rows(labels, limit).select("doc_id")), "doc_id", "left_semi"))
    forest = train(labelled, labels, limit)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1)
        for b in batches:
            col = T.texts(b.column("text"))
            for i, j in T.slices(col):
                good = forest.scores(statistics.features(col[i:j], compress)) >= THRESHOLD
                yield b.slice(i, j - i).filter(pa.array(good))

    return docs.mapInArrow(T.releasing(run), schema)
