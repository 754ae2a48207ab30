"""Compression-distance classification: zstandard dictionaries of toxic and of ordinary text, compared window by window."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import LOWER, UPPER, stored, table
from docspark.llm.labelled import held_out, training_sample

#: Bounds of the training sample: documents of each class, and bytes of their texts.
PER_CLASS, TRAIN_BYTES = 2500, 16 << 20
#: Of the sampled documents one in so many calibrates what the others have built.
CALIBRATES = 2
#: Word starts of these lengths (with the space before) are weighed by class.
LENGTHS = range(5, 11)
#: Log odds from which a word start counts as one class's own, less two standard errors; documents that it needs.
ODDS, SUPPORT = 1.3, 5
#: Bytes of the dictionaries: the zstandard dictionary trained on ordinary text that both open with, and what each
#: class's own word starts may fill besides. Those beyond that, the lightest, do not raise a score.
SHARED_BYTES, CLASS_BYTES = 16384, 4096
#: Words of a long window; short ones are single words.
PHRASE = 4
LONGEST = 64
#: Distances are counted from LOW (or less) to HIGH (or more).
LOW, HIGH = -4, 8
#: Stands after every window and in both dictionaries, so that short windows are compressed at all and alike.
TAIL = b"\x02 .:=|=:. ..:=|=:. \x02"
CACHE = 600_000
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def windows(text: bytes) -> list[bytes]:
    """The words of the whole text, A-Z lower-cased; a longer one goes in steps of LONGEST bytes."""
    words = text.translate(TO_LOWER).split()
    if any(len(w) > LONGEST for w in words):
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def phrases(words: list[bytes], n: int = PHRASE) -> list[bytes]:
    """Runs of n words, end to end; the last may be shorter."""
    return [b" ".join(words[i : i + n]) for i in range(0, len(words), n)]


def trained(samples: list[bytes], size: int) -> bytes:
    """The content of a zstandard dictionary trained on the samples; of too few for that, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"\x01".join(sorted(set(samples)))[-size:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(window_log=17, chain_log=16, hash_log=16, search_log=6, min_match=5, target_length=64, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    own.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=own, compression_params=how)


@dataclass
class Distance:
    """How many bytes shorter the toxic dictionary makes a window than the ordinary one does."""

    toxic: bytes
    ordinary: bytes
    known: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.a, self.b = compressor(self.toxic), compressor(self.ordinary)

    @classmethod
    def of(cls, toxic: bytes, ordinary: bytes) -> Distance:
        """A worker keeps the last from task to task."""
        global _last
        if _last is None or (_last.toxic, _last.ordinary) != (toxic, ordinary):
            _last = cls(toxic, ordinary)
        return _last

    def of_window(self, window: bytes) -> int:
        whole = b" " + window + b" " + TAIL
        return len(self.b.compress(whole)) - len(self.a.compress(whole))

    def __call__(self, word: bytes) -> int:
        if (d := self.known.get(word)) is None:
            if len(self.known) > CACHE:
                self.known.clear()
            d = self.known[word] = self.of_window(word)
        return d

    def counts(self, text: bytes) -> np.ndarray:
        """Number of windows at each distance from LOW to HIGH: of words, then of phrases."""
        words = windows(text)
        both = np.fromiter(map(self, words), np.int64), np.fromiter(map(self.of_window, phrases(words)), np.int64)
        return np.concatenate([np.bincount(np.clip(x, LOW, HIGH) - LOW, minlength=BINS) for x in both])


_last: Distance | None = None
BINS = HIGH - LOW + 1


def features(counts: np.ndarray) -> np.ndarray:
    """Per document, for words and for phrases: the greatest distance; for each threshold above 0 how many windows reach
    it, outright and among all; for each below 0 how many among all fall to it."""
    out = []
    for c in (counts[:, :BINS], counts[:, BINS:]):
        every = np.maximum(c.sum(1, keepdims=True), 10)
        over, under = np.cumsum(c[:, ::-1], axis=1)[:, ::-1][:, 1 - LOW :], np.cumsum(c, axis=1)[:, :-LOW]
        most = np.where(c > 0, np.arange(LOW, HIGH + 1), np.where(c.sum(1, keepdims=True) > 0, LOW, 0)).max(1)
        out += [most / 4.0, np.log1p(over), np.sqrt(over / every), np.sqrt(under / every)]
    return np.column_stack(out)


@dataclass
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    bias: float

    def scores(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(counts) @ self.weights + self.bias, -30, 30)))


def _word_starts(sample: DataFrame) -> DataFrame:
    """start, toxic, ordinary: in how many sampled documents of each class a word start occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {b" " + w for w in windows(text.encode())}
                seen.update({(w[:n], label) for w in words for n in LENGTHS if len(w) >= n})
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["start", "label", "n"])

    rows = sample.select("text", "label").mapInArrow(count, "start binary, label int, n long")
    return rows.groupBy("start").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("ordinary"))


def cover(found: list[tuple[bytes, int]], size: int) -> bytes:
    """Word starts of most weight (documents times length), none of which starts another, up to size bytes, the heaviest last."""
    out: list[bytes] = []
    heads: set[bytes] = set()
    used = 0
    for g, n in sorted(found, key=lambda x: (-x[1] * (len(x[0]) - 3), x[0])):
        if g not in heads and not any(g[:k] in out for k in LENGTHS) and used + len(g) < size:
            out.append(g)
            heads.update(g[:k] for k in LENGTHS)
            used += len(g) + 1
    return b"".join(g + b"\x01" for g in reversed(out))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Newton's method."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    keep = np.full(len(w), ridge * max(1.0, weight.sum()) / 10)
    keep[-1] *= 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (weight * (y - p)) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def window_counts(docs: DataFrame, toxic: bytes, ordinary: bytes, keep: tuple[str, ...], model: ToxicityModel | None = None) -> DataFrame:
    """The kept columns, counts (see Distance.counts) and the model's score, of the column text, null as empty."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance.of(toxic, ordinary)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
            counts = [distance.counts(t.as_py() or b"") for t in texts]
            scores = model.scores(np.array(counts).reshape(-1, 2 * BINS)) if model else np.zeros(len(counts))
            columns = [*[batch.column(i) for i in range(len(keep))], pa.array([c.tolist() for c in counts], pa.list_(pa.int64())), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "counts", "score"])

    types = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInArrow(measure, ", ".join(f"{c} {types[c]}" for c in keep) + ", counts array<long>, score double")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> ToxicityModel | None:
    """A dictionary of each class, then thresholds calibrated on documents that had no part in the dictionaries.

    Both open with a dictionary that zstandard trains on the ordinary sample's text, so that ordinary windows are as
    short by either; then come the word starts that set the own class's documents apart, as raw content. What reaches
    the driver is bounded by the sample.
    None if a class has no labelled document.
    """
    sample, (n0, n1) = training_sample(docs, labels, label, per_class, TRAIN_BYTES)
    sample = stored(sample.withColumn("calibrates", F.pmod(F.xxhash64(F.lit("calibrates"), "doc_id"), F.lit(CALIBRATES)) == 0), "toxicity")
    size = {(r["label"], r["calibrates"]): r["count"] for r in sample.groupBy("label", "calibrates").count().collect()}
    if not all(any((y, c) in size for c in (True, False)) for y in (0, 1)):
        return None
    if not all((y, c) in size for y in (0, 1) for c in (True, False)):  # too few for two parts: all rows do both
        builds = calibrates = sample
        n = {y: sum(size.get((y, c), 0) for c in (True, False)) for y in (0, 1)}
        held = n
    else:
        builds, calibrates = sample.where("NOT calibrates"), sample.where("calibrates")
        n, held = ({y: size[y, c] for y in (0, 1)} for c in (False, True))
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("ordinary") + 0.5) / (n[0] + 1))
    error = 2 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("ordinary") + 0.5))
    sure = _word_starts(builds).where((F.greatest("toxic", "ordinary") >= SUPPORT) & (F.abs(odds) - error >= ODDS)).select("start", (odds > 0).cast("int").alias("label"), F.abs(F.col("toxic") - F.col("ordinary") * n[1] / n[0]).alias("docs")).collect()
    text = [r["text"].encode() for r in builds.where("label = 0").select("text").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    shared = trained([b" " + p + b" " for t in text for p in phrases(windows(t), 2 * PHRASE)], SHARED_BYTES)
    own = {y: cover([(bytes(r["start"]), r["docs"]) for r in sure if r["label"] == y], CLASS_BYTES) for y in (0, 1)}
    width = max(map(len, own.values()))
    dictionaries = [shared + TAIL + own[y].rjust(width, b"\x03") + b"\x01" for y in (1, 0)]
    rows = window_counts(calibrates, *dictionaries, ("label",)).collect()
    counts, y = np.array([r["counts"] for r in rows]), np.array([r["label"] for r in rows])
    weight = np.where(y == 1, n1 / held[1], n0 / held[0]) / (n0 + n1) * len(y)
    weights, bias = fit_logistic(features(counts), y, weight)
    return ToxicityModel(*dictionaries, weights, bias)


def score_documents(docs: DataFrame, model: ToxicityModel | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts (windows at each distance) and score (0 to 1) for every whole text.

    A null or empty text has no windows and so the lowest score. Rows of one doc_id are scored apart, equal texts alike.
    Only the two columns are read. Without a model (a class without labels) every score is 0. An empty table gives an
    empty result.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if model is None:
        return own.select("doc_id", F.array().cast("array<long>").alias("counts"), F.lit(0.0).alias("score"))
    return window_counts(own, model.toxic, model.ordinary, ("doc_id",), model)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score_documents(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
