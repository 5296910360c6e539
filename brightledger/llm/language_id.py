"""Language identification by a bidirectional gated recurrent network over bytes.

Two recurrent passes read a text's bytes, one in either direction; from both states
every position gets a probability of each language, and a document's probabilities
are the mean over its positions. Texts are cut into windows, all of which are read
and each of which begins and ends some bytes beyond those it labels, so that thousands
of positions advance with each matrix product and every byte is seen among its neighbours. Gates are piecewise
linear, which spares an exponential for each unit and byte. The network is trained
in numpy by backpropagation through time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fold, small_batches, table

FOLDS, HELD_OUT = 4, 2
UNITS = 12
#: Bytes labelled in a window when a text is read, bytes read before and after them, and windows that advance together.
READ, CONTEXT, TOGETHER = 128, 16, 2048
#: Fitted sample: documents of each language, the first by hash of the id; whole texts, in windows of so many bytes.
FIT_DOCS, FIT_WINDOW = 150, 60
#: Steps of training, each on a batch of windows, and windows in a batch.
STEPS, BATCH, RATE, SEED = 450, 128, 0.01, 5


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Network:
    """Of either direction (axis 0: forward, backward) the inputs, the recurrence and its bias; and the output layer."""

    languages: list[str]
    inputs: np.ndarray  #: (2, 3 * UNITS, 256): update gate, reset gate, candidate
    recur: np.ndarray  #: (2, 3 * UNITS, UNITS)
    out: np.ndarray  #: (languages, 2 * UNITS)
    bias: np.ndarray  #: (languages, 1)

    def parameters(self) -> list[np.ndarray]:
        return [self.inputs, self.recur, self.out, self.bias]


def untrained(languages: list[str]) -> Network:
    rng = np.random.default_rng(SEED)
    inputs = rng.normal(0, 0.1, (2, 3 * UNITS, 256)).astype(np.float32)
    inputs[:, : 2 * UNITS] += 0.5
    recur = rng.normal(0, 0.3 / np.sqrt(UNITS), (2, 3 * UNITS, UNITS)).astype(np.float32)
    out = rng.normal(0, 0.3, (len(languages), 2 * UNITS)).astype(np.float32)
    return Network(languages, inputs, recur, out, np.zeros((len(languages), 1), np.float32))


def run(net: Network, codes: np.ndarray, real: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (steps, 2 * UNITS, windows) of windows of bytes (steps, windows). keep: gets what the backward pass needs."""
    steps, many, u = *codes.shape, UNITS
    states = np.empty((steps, 2 * u, many), np.float32)
    padded = not real.all()
    for side in (0, 1):
        h, inputs, recur = np.zeros((u, many), np.float32), net.inputs[side], net.recur[side]
        for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
            x, a = np.take(inputs, codes[t], axis=1), recur @ h
            gates = x[: 2 * u]
            gates += a[: 2 * u]
            np.maximum(gates, 0, out=gates)
            np.minimum(gates, 1, out=gates)
            n = gates[u:] * a[2 * u :]
            n += x[2 * u :]
            np.maximum(n, -1, out=n)
            np.minimum(n, 1, out=n)
            before, h = h, h - n
            h *= gates[:u]
            h += n
            if padded:
                h *= real[t]
            states[t, side * u : (side + 1) * u] = h
            if keep is not None:
                keep.append((side, t, before, gates, a[2 * u :], n))
    return states


def probabilities(net: Network, states: np.ndarray) -> np.ndarray:
    """Of each language at each position: (steps, languages, windows)."""
    z = np.matmul(net.out, states)
    z += net.bias
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def gradients(net: Network, codes: np.ndarray, real: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over real positions, and its gradient by backpropagation through time."""
    keep: list = []
    states = run(net, codes, real, keep)
    p = probabilities(net, states)
    many, u, at = real.sum(), UNITS, np.arange(codes.shape[1])
    loss = -float((np.log(p[:, label, at] + 1e-9) * real).sum() / many)
    p[:, label, at] -= 1
    p *= real[:, None, :] / many
    d_out, d_bias = np.einsum("tcb,tsb->cs", p, states), p.sum(axis=(0, 2))[:, None]
    d_states = np.matmul(net.out.T, p)
    d_inputs, d_recur = np.zeros_like(net.inputs), np.zeros_like(net.recur)
    carried = np.zeros((2, u, codes.shape[1]), np.float32)
    for side, t, before, gates, a, n in reversed(keep):
        d = (d_states[t, side * u : (side + 1) * u] + carried[side]) * real[t]
        z, r = gates[:u], gates[u:]
        d_n = d * (1 - z) * (np.abs(n) < 1)
        d_gates = np.concatenate([d * (before - n), d_n * a]) * ((gates > 0) & (gates < 1))
        into = np.concatenate([d_gates, d_n])
        back = np.concatenate([d_gates, d_n * r])
        d_recur[side] += back @ before.T
        for k in range(3 * u):
            d_inputs[side, k] += np.bincount(codes[t], into[k], 256)
        carried[side] = d * z + net.recur[side].T @ back
    return loss, [d_inputs, d_recur, d_out, d_bias]


def windows_of(texts: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of FIT_WINDOW bytes of (label, whole text) pairs: labels, bytes and which of these are real; the last one of a text may be short."""
    cut = [(y, raw[i : i + FIT_WINDOW]) for y, raw in texts for i in range(0, len(raw), FIT_WINDOW)]
    codes, real = np.zeros((FIT_WINDOW, len(cut)), np.uint8), np.zeros((FIT_WINDOW, len(cut)), np.float32)
    for i, (_, raw) in enumerate(cut):
        codes[: len(raw), i], real[: len(raw), i] = np.frombuffer(raw, np.uint8), 1
    return np.array([y for y, _ in cut], np.int64), codes, real


def train(texts: list[tuple[str, bytes]]) -> Network:
    """A network for the languages of (language, bytes) pairs, by Adam on windows of the whole texts.

    Each step draws a language and then a window evenly, so that neither a language
    nor a long text outweighs the others.
    """
    net = untrained(sorted({lang for lang, _ in texts}))
    label, codes, real = windows_of([(net.languages.index(lang), raw) for lang, raw in texts])
    own = [np.flatnonzero(label == y) for y in range(len(net.languages))]
    if len(net.languages) < 2 or not all(map(len, own)):
        return net
    rng = np.random.default_rng(SEED)
    mean, square = ([np.zeros_like(p) for p in net.parameters()] for _ in range(2))
    for step in range(1, STEPS + 1):
        at = np.array([own[y][int(u * len(own[y]))] for y, u in zip(rng.integers(0, len(own), BATCH), rng.random(BATCH), strict=True)])
        _, found = gradients(net, codes[:, at], real[:, at], label[at])
        size = np.sqrt(sum(float((g**2).sum()) for g in found))
        rate = RATE * (1 - (step - 1) / STEPS)
        for p, g, m, s in zip(net.parameters(), found, mean, square, strict=True):
            g = g * min(1.0, 1.0 / (size + 1e-9))
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def document_probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean over all positions of each text: (texts, languages); zeros for an empty one."""
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    windows = -(-sizes // READ)
    owner = np.repeat(np.arange(len(texts)), windows)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    begin = np.repeat(np.cumsum(sizes) - sizes, windows)
    size, offset = np.repeat(sizes, windows), number * READ
    total = np.zeros((len(texts), len(net.languages)))
    steps = np.arange(-CONTEXT, READ + CONTEXT)[:, None]
    for i in range(0, len(owner), TOGETHER):
        s = slice(i, i + TOGETHER)
        place = offset[s] + steps
        real = ((place >= 0) & (place < size[s])).astype(np.float32)
        codes = raw[np.clip(begin[s] + place, 0, len(raw) - 1)]
        p = probabilities(net, run(net, codes, real)[CONTEXT : CONTEXT + READ])
        p *= real[CONTEXT : CONTEXT + READ, None, :]
        np.add.at(total, owner[s], p.sum(axis=0).T)
    return total / np.maximum(sizes, 1)[:, None]


def fit_languages(docs: DataFrame) -> Network:
    """Train on a bounded sample of documents with a language that aren't held out.

    For each language FIT_DOCS documents at most, the first by a hash of their id,
    and of these the whole texts.
    """
    hashed = F.xxhash64("doc_id")
    able = docs.where((fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0))
    ids = able.select("doc_id", F.col("lang").cast("string").alias("lang")).distinct()
    ids = ids.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy(hashed, "doc_id"))).where(F.col("n") <= FIT_DOCS)
    texts = able.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), ["doc_id", "lang"])  # FIT_DOCS ids a language
    rows = texts.groupBy("lang", "n").agg(F.min("text").alias("text")).orderBy("lang", "n").toArrow()
    return train([(lang, text.encode("utf-8")) for lang, text in zip(rows["lang"].to_pylist(), rows["text"].to_pylist(), strict=True)])


def language_id(docs: DataFrame) -> DataFrame:
    """Predict the language of every whole text.

    Returns doc_id, held_out, lang_pred and score (the document's probability of
    that language), a row for each row of ``docs``. Learns only from text and
    non-null lang of documents that aren't held out; a null id is never held out and
    never learned from. A text that is null or has no letter is ``und`` with score
    0, and so is every text where nothing could be learned. Ties go to the language
    that is first in alphabetical order. Texts of any length are read whole, a
    window at a time; repeated rows get equal values, other columns are ignored, and
    an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fit_languages(docs))  # some 50 kB, more by 17 numbers a language

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            able = [bool(net.languages) and t is not None and has_letter(t) for t in texts]
            p = document_probabilities(net, [t.encode("utf-8") if a else b"" for t, a in zip(texts, able, strict=True)])
            best = p.argmax(axis=1) if net.languages else np.zeros(len(texts), int)
            lang = [net.languages[b] if a else "und" for a, b in zip(able, best, strict=True)]
            score = [min(float(row[b]), 1.0) if a else 0.0 for a, b, row in zip(able, best, p, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(each, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
