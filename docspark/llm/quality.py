"""Quality classifier: gated attention over a document's passages, learnt from document labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import table
from docspark.llm.labelled import held_out, training_sample

#: Bounds of the training sample: documents of each class, and bytes of their texts.
PER_CLASS, TRAIN_BYTES = 1500, 8 << 20
PASSAGE_WORDS = 48
#: Classes of bytes: other, space, newline, digit, capital, vowel, other letter, usual punctuation, other signs, inner and leading bytes of longer characters.
CLASSES = 11
HIDDEN, GATE = 24, 12


def byte_classes() -> np.ndarray:
    out = np.zeros(256, np.int64)
    for c, chars in ((1, b" \t"), (2, b"\n\r"), (3, b"0123456789"), (4, bytes(range(65, 91))), (6, bytes(range(97, 123))), (5, b"aeiou"), (7, b".,;:!?'\"-()")):
        out[list(chars)] = c
    out[[b for b in range(33, 127) if out[b] == 0]] = 8
    out[128:192], out[192:] = 9, 10
    return out


TABLE = byte_classes()
WIDTH = CLASSES * CLASSES + 4


def encode(text: bytes, words: int = PASSAGE_WORDS) -> np.ndarray:
    """A row per passage of so many words: shares of its pairs of byte classes, how much its words repeat, their length.

    A text without words is one passage of zeros.
    """
    split = text.split()
    n = max(1, -(-len(split) // words))
    out = np.zeros((n, WIDTH))
    if not split:
        return out
    raw = np.frombuffer(text, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    starts = ~space & np.concatenate([[True], space[:-1]])
    at = np.maximum(np.cumsum(starts) - 1, 0) // words
    kinds = TABLE[raw]
    pairs = at[1:] * CLASSES * CLASSES + kinds[:-1] * CLASSES + kinds[1:]
    tally = np.bincount(pairs, minlength=n * CLASSES * CLASSES).reshape(n, -1)
    out[:, : CLASSES * CLASSES] = np.sqrt(tally / np.maximum(tally.sum(1, keepdims=True), 1))
    for i in range(n):
        own = split[i * words : (i + 1) * words]
        distinct = set(own)
        out[i, -4] = len(distinct) / len(own)
        out[i, -3] = sum(a == b for a, b in zip(own, own[1:], strict=False)) / len(own)
        out[i, -2] = min(sum(map(len, distinct)) / len(distinct), 40.0) / 10
        out[i, -1] = len(own) / words
    return out


@dataclass
class AttentionModel:
    """h = tanh(xW + b); attention a = softmax(w . (tanh(hV) * sigmoid(hU))); score = sigmoid(c . sum(a h) + d)."""

    mean: np.ndarray
    scale: np.ndarray
    w: list[np.ndarray]

    def score(self, passages: np.ndarray) -> float:
        return float(forward(self.w, (passages - self.mean) / self.scale, np.array([0]), np.zeros(len(passages), int))[0][0])


def forward(w: list[np.ndarray], x: np.ndarray, first: np.ndarray, doc: np.ndarray) -> tuple:
    w1, b1, v, u, g, c, d = w
    h = np.tanh(x @ w1 + b1)
    t, s = np.tanh(h @ v), 1 / (1 + np.exp(-np.clip(h @ u, -30, 30)))
    e = (t * s) @ g
    e = np.exp(e - np.maximum.reduceat(e, first)[doc])
    a = e / np.add.reduceat(e, first)[doc]
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    p = 1 / (1 + np.exp(-np.clip(z @ c + d[0], -30, 30)))
    return p, h, t, s, a, z


def gradients(w: list[np.ndarray], x: np.ndarray, first: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the mean weighted log loss, by each of w."""
    p, h, t, s, a, z = forward(w, x, first, doc)
    dl = weight * (p - y) / len(y)
    dz = dl[:, None] * w[5]
    da = (dz[doc] * h).sum(1)
    de = a * (da - np.add.reduceat(a * da, first)[doc])
    dt, ds = (de[:, None] * w[4]) * s * (1 - t * t), (de[:, None] * w[4]) * t * s * (1 - s)
    dh = (a[:, None] * dz[doc] + dt @ w[2].T + ds @ w[3].T) * (1 - h * h)
    return [x.T @ dh, dh.sum(0), h.T @ dt, h.T @ ds, (t * s).T @ de, z.T @ dl, np.array([dl.sum()])]


def fit(bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 3e-3, decay: float = 1e-3) -> AttentionModel:
    """Adam on the weighted log loss; the same model for the same bags in any order of rows with equal order of bags."""
    rng = np.random.default_rng(7)
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 0.02
    bags = [(b - mean) / scale for b in bags]
    w = [rng.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), rng.normal(0, GATE**-0.5, GATE), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, q, step = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            sizes = np.array([len(bags[j]) for j in own])
            first, doc, x = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(own)), sizes), np.concatenate([bags[j] for j in own])
            step += 1
            for k, grad in enumerate(gradients(w, x, first, doc, y[own], weight[own])):
                m[k] = 0.9 * m[k] + 0.1 * grad
                q[k] = 0.999 * q[k] + 0.001 * grad * grad
                w[k] -= rate * (m[k] / (1 - 0.9**step) / (np.sqrt(q[k] / (1 - 0.999**step)) + 1e-8) + decay * w[k])
    return AttentionModel(mean, scale, w)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> AttentionModel | None:
    """All passages of the sampled documents are encoded on the executors; their vectors, of 500 bytes for 48 words of
    at most 2 * TRAIN_BYTES, reach the driver. None if a class has no labelled document."""
    sample, (n0, n1) = training_sample(docs, labels, label, per_class, TRAIN_BYTES)

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [encode(text.encode()).astype("<f4").tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2)], names=["doc_id", "x", "label"])

    rows = sorted(sample.mapInArrow(passages, f"doc_id {dict(sample.dtypes)['doc_id']}, x binary, label int").collect(), key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in rows])
    if not (y == 0).any() or not (y == 1).any():
        return None
    weight = np.where(y == 1, n1 / (y == 1).sum(), n0 / (y == 0).sum())
    return fit([np.frombuffer(r["x"], "<f4").reshape(-1, WIDTH).astype(float) for r in rows], y, weight / weight.mean())


def score_documents(docs: DataFrame, model: AttentionModel | None, text: str = "text", score: str = "score") -> DataFrame:
    """The input's columns and ``score`` (0 to 1), from all passages of each whole text.

    A null or empty text is one passage without words. Equal texts have equal scores. A column named as ``score`` is
    replaced. Without a model every score is 1, so that nothing is rejected on no grounds. An empty table gives an
    empty result.
    """
    own = docs.drop(score)
    if model is None:
        return own.withColumn(score, F.lit(1.0))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index(text))
            texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
            scores = [model.score(encode(t.as_py() or b"")) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, score])

    names = own.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in own.dtypes)
    return own.mapInArrow(rate, f"{schema}, `{score}` double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score_documents(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
