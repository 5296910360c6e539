"""Linear classifiers on indicators scaled by naive Bayes log-count ratios.

A document is a set of hashed features. Each feature's value is the log of the
ratio of its smoothed shares among the documents of either label; a linear
hinge-loss model on these values is fitted by dual coordinate descent; a logistic
curve fitted to margins of documents left out makes the margins scores.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fold, small_batches

BITS = 20
#: Documents of each label that a model is fitted on at most, the first by hash of the id.
FIT_DOCS = 2000
#: Weight of all documents' losses against the norm of the weights.
LOSS = 4.0
#: A feature is used where its log-count ratio is so many standard errors from 0.
LEAST_ERRORS = 1.5
Featuriser = Callable[[str], "set[int]"]
#: Makes a featuriser; given a set of feature numbers, one that returns only these.
MakeFeaturiser = Callable[["set[int] | None"], Featuriser]


@dataclass
class Model:
    weight: dict[int, float]  #: of each feature that is used, log-count ratio included
    bias: float
    slope: float
    shift: float

    def score(self, features: set[int]) -> float:
        """features: those of one document that the model uses; added in order, so that a score doesn't depend on the worker."""
        z = self.slope * (sum(self.weight[f] for f in sorted(features)) + self.bias) + self.shift
        return 1 / (1 + math.exp(-min(max(z, -35.0), 35.0)))


def log_count_ratios(rows: list[np.ndarray], label: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of each feature; 0 where it is within LEAST_ERRORS standard errors of 0."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    for r, y in zip(rows, label, strict=True):
        counts[1 - y][r] += 1  # a row's features are distinct
    seen = int((counts[0] + counts[1] > 0).sum())
    p, q = ((c + smoothing) / (c.sum() + smoothing * seen) for c in counts)
    ratio, error = np.log(p / q), np.sqrt(sum(1 / (c + smoothing) for c in counts))
    return np.where(np.abs(ratio) >= LEAST_ERRORS * error, ratio, 0.0)


def dual_descent(rows: list[np.ndarray], values: np.ndarray, label: np.ndarray, loss: float, epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Hinge-loss weights of features scaled by ``values``, one dual coordinate (a document) at a time.

    ``loss`` is the weight of all documents' losses against the weights' norm; either label has half of it.
    """
    rows = [r[values[r] != 0] for r in rows]
    cost = loss / 2 / np.where(label == 1, label.sum(), (1 - label).sum())
    sign = np.where(label == 1, 1.0, -1.0)
    dual, w, bias = np.zeros(len(rows)), np.zeros(len(values)), 0.0
    square = np.array([float((values[r] ** 2).sum()) + 1.0 for r in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x = values[rows[i]]
            slope = sign[i] * (float(w[rows[i]] @ x) + bias) - 1.0
            to = min(max(dual[i] - slope / square[i], 0.0), cost[i])
            step = (to - dual[i]) * sign[i]
            if step:
                w[rows[i]] += step * x
                bias += step
                moved = max(moved, abs(step))
                dual[i] = to
        if moved < 1e-4 * cost.min():
            break
    return w, bias


def logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of the labels over the margins (Newton steps, smoothed targets)."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * margin).sum() + 1e-3 * (a - 1), d.sum()])
        m = np.array([[(h * margin**2).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        s = np.linalg.solve(m, g)
        a, b = a - s[0], b - s[1]
        if np.abs(s).max() < 1e-7:
            break
    return max(a, 1e-3), b


def fit(rows: list[np.ndarray], label: np.ndarray, loss: float = LOSS, epochs: int = 20) -> Model:
    """Fit on documents as arrays of distinct feature numbers; with one label only, every score is its smoothed share."""
    if len(set(label.tolist())) < 2:
        share = (label.sum() + 1) / (len(label) + 2)
        return Model({}, 0.0, 1.0, float(np.log(share / (1 - share))))
    part = np.arange(len(rows)) % 3
    margin = np.zeros(len(rows))
    for k in range(3):
        inside, outside = np.flatnonzero(part != k), np.flatnonzero(part == k)
        if len(set(label[inside].tolist())) < 2:
            continue
        some = [rows[i] for i in inside]
        r = log_count_ratios(some, label[inside])
        w, bias = dual_descent(some, r, label[inside], loss, epochs)
        margin[outside] = [float((w * r)[rows[i]].sum()) + bias for i in outside]
    r = log_count_ratios(rows, label)
    w, bias = dual_descent(rows, r, label, loss, epochs)
    used = np.flatnonzero(w * r)
    return Model(dict(zip(used.tolist(), (w * r)[used].tolist(), strict=True)), bias, *logistic(margin, label))


def feature_rows(docs: DataFrame, keep: list[str], featuriser: MakeFeaturiser) -> DataFrame:
    """The columns ``keep`` and the distinct feature numbers of each whole text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = featuriser(None)
        for batch in batches:
            found = [sorted(features(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.list_(pa.int32()))], names=[*keep, "features"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, F.col("text").cast("string")).mapInArrow(each, f"{schema}, features array<int>")


def fit_labelled(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, featuriser: MakeFeaturiser, fit_docs: int = FIT_DOCS, **how: float) -> Model:
    """Fit on at most ``fit_docs`` labelled documents of each label, the first by a hash of their id.

    ``held_out``: of the labels' rows, which are never learned from. Rows without
    a label, an id or a document are passed over.
    """
    small_batches(docs.sparkSession)
    able = labels.where(~held_out & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("_y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = able.where("_y = 1").distinct().orderBy(*order).limit(fit_docs).union(able.where("_y = 0").distinct().orderBy(*order).limit(fit_docs))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")  # at most 2 * fit_docs ids
    got = feature_rows(sample, ["doc_id", "_y"], featuriser).orderBy(F.xxhash64("doc_id"), "doc_id", "_y").toArrow()
    rows = [x.values.to_numpy() for x in got["features"]]  # 32-bit numbers, as they came: at most 2 * fit_docs rows of 2**BITS
    return fit(rows, got["_y"].to_numpy().astype(np.int64), **how)


def scored(docs: DataFrame, model: Model, featuriser: MakeFeaturiser, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of each whole text."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**BITS features, in practice some thousands

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, features = sent.value, featuriser(set(sent.value.weight))
        for batch in batches:
            found = [own.score(features(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(each, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def classified(docs: DataFrame, model: Model, featuriser: MakeFeaturiser, folds: int, out: int, at_least: float) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scored(rows, model, featuriser).select(
        "doc_id", (fold(F.col("doc_id"), folds) == out).alias("held_out"), "score", (F.col("score") >= at_least).cast("int").alias("predicted")
    )
