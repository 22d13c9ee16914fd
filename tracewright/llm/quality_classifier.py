"""Quality scores by histogram gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled rows and flattened into arrays; every document is then scored where
it is read, by walking all trees at once in numpy. Scoring needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.docstats import FEATURES, features
from tracewright.llm.textkernels import chunks, texts_of

#: Labelled rows that the trees are fitted on at most, by the order of a hash of their ids.
TRAINING_ROWS = 20_000
FOLDS = 5
ACCEPTED = 0.3


@dataclass
class Forest:
    """Trees as arrays by (tree, node): a row goes to 2i + 1 if its feature is at most the threshold, else to 2i + 2."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: int = 10) -> Forest:
    """Boosting on the logistic loss; splits are searched in histograms of at most `bins` bins for each feature."""
    share = (y.sum() + 1) / (len(y) + 2)
    inner, leaves = 2**depth - 1, 2**depth
    forest = Forest(float(np.log(share / (1 - share))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), depth)
    if len(y) == 0 or y.min() == y.max():
        return forest
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    total = np.full(len(y), forest.start)
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            base, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            cut = np.full(width, bins)
            for j in range(x.shape[1]):
                at = (node - base) * bins + binned[:, j]
                g, h, c = (np.bincount(at, v, width * bins).reshape(width, bins).cumsum(1) for v in (gradient, weight, np.ones(len(y))))
                gain = g**2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain[(c < least) | (c[:, -1:] - c < least)] = 0
                gain[:, len(edges[j]) :] = 0
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                best[better] = gain[np.arange(width), top][better]
                cut[better] = top[better]
                feature[base : base + width][better] = j
            split = cut < bins
            threshold[base : base + width] = [edges[feature[base + i]][cut[i]] if split[i] else np.inf for i in range(width)]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node - base])
        at = node - inner
        leaf = -rate * np.bincount(at, gradient, leaves) / (np.bincount(at, weight, leaves) + ridge)
        total += leaf[at]
        kept.append((feature, threshold, leaf))
    forest.feature, forest.threshold, forest.leaf = (np.array(k) for k in zip(*kept, strict=True))
    return forest


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch.column(2))
        for i, j in chunks(texts):
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(2)), pa.array(list(features(texts[i:j])), pa.list_(pa.float64()))], ["doc_id", "label", "features"])


def fold(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def sample_of(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(label, features) of at most `rows` labelled documents outside fold 0, the first ones by the hash of their ids.

    Rows without an id or a quality are left out; a document with several labels has their mean, rounded up. Of several texts with one id
    the one with the least features stands for all.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(fold() != 0)
    known = known.groupBy("doc_id").agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("long").alias("label"))
    sample = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    # The sample has `rows` pairs of numbers at most, so it may be broadcast.
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    found = chosen.select("doc_id", "label", "text").mapInArrow(_features, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label long, features array<double>")
    return found.groupBy("doc_id", "label").agg(F.min("features").alias("features")).select("label", "features")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Forest:
    """Fit on sample_of(docs, labels, rows): what the driver gathers is `rows` rows of numbers at most.

    Without labelled documents, or with labels of one class, the forest has no trees.
    """
    found = sample_of(docs, labels, rows).toPandas()
    x = np.array(found["features"].tolist(), np.float64).reshape(len(found), len(FEATURES))
    order = np.lexsort((*x.T[::-1], found["label"].to_numpy()))
    return fit(x[order], found["label"].to_numpy(np.float64)[order])


def _scores(forest: Forest, threshold: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for i, j in chunks(texts):
                score = forest.score(features(texts[i:j]))
                part = batch.slice(i, j - i)
                if threshold is None:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])
                else:
                    yield part.filter(pa.array(score >= threshold))

    return run


def score_quality(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, held_out (fold 0: never trained on), score in 0 to 1 and predicted (1 from ACCEPTED on).

    docs needs doc_id and text; other columns are ignored. Null texts score as empty ones. Repeated rows get equal scores.
    A null doc_id is never held out. With no labels, or labels of one class, the score is one smoothed share for all. An empty
    table gives an empty result.
    """
    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_scores(forest, None), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPTED).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, forest: Forest, threshold: float = ACCEPTED) -> DataFrame:
    """The rows of docs that score `threshold` or more, with all their columns.

    Null texts score as empty ones; repeated rows stay or go together; an empty table gives an empty result.
    """
    return docs.mapInArrow(_scores(forest, threshold), docs.schema)
