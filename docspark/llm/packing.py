"""Pattern packing: repeat counts of few-document length patterns by non-negative least squares, then best fit."""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm.common import stored, table

CAPACITY, EOS = 4096, 1
#: Lengths are fitted in steps of UNIT tokens, in patterns of up to PATTERN_DOCS documents.
UNIT, PATTERN_DOCS = 64, 4
#: Keys whose ids a worker remembers; the older half of what it knows goes when that many are new.
CACHE = 300_000
#: Bytes of text, and words new to a worker, that are worked on at a time. Longer texts go whole, by themselves.
SLICE, NEW = 4 << 20, 50_000

#: Chunks whose ids are those of a lower-case word and then those of ASCII marks: composed letters, no apostrophe.
PLAIN = "^(?P<word>[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)(?P<marks>[!-&(-/:-@[-`{-~]*)$"


class Memory:
    """What ``learn`` (a list of new keys to their values) said of each key, in two generations of bounded size."""

    def __init__(self, learn: Callable[[list[str]], Iterable[bytes]], size: int) -> None:
        self.learn, self.size = learn, size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, keys: list[str]) -> list[bytes]:
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = [k for k in keys if k not in young]
        young.update((k, old[k]) for k in missing if k in old)
        new = [k for k in missing if k not in young]
        for i in range(0, len(new), NEW):
            young.update(zip(new[i : i + NEW], self.learn(new[i : i + NEW]), strict=True))
        return list(map(young.__getitem__, keys))


class WordIds:
    """Token ids of whole texts.

    The tokenizer's pieces never reach over white space, so a text's ids are those of its white-space separated chunks
    in a row. Arrow splits a slice of texts, finds its distinct chunks and parts the plain ones into a lower-case word
    and marks. Only distinct words are looked up, and those that a worker does not know are encoded, many in one text,
    whose ids part where a token ends a word; marks and other chunks are encoded one by one. What a worker knows it
    keeps from task to task.
    """

    workers: ClassVar[dict[str, WordIds]] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words, self.others = Memory(self.of_words, CACHE), Memory(self.one_by_one, CACHE)

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in cls.workers:
            cls.workers[path] = cls(path)
        return cls.workers[path]

    def one_by_one(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of_words(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        if len(ends) != len(words):  # some word was not as plain as it looked
            return self.one_by_one(words)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's begin and the last one's end); null texts have none."""
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        coded = split.flatten().dictionary_encode()
        found = pc.extract_regex(coded.dictionary, PLAIN)
        plain = found.is_valid()
        word, marks = pc.utf8_lower(found.field("word").filter(plain)).dictionary_encode(), found.field("marks").filter(plain).dictionary_encode()
        rest = coded.dictionary.cast(pa.large_binary()).filter(pc.invert(plain)).to_pylist()
        units = [*self.words(word.dictionary.to_pylist()), *self.others(marks.dictionary.to_pylist()), *self.others([x.decode("utf-8", "replace") for x in rest]), b""]
        # a chunk is two units, the second of which is empty if it is not plain
        first = len(word.dictionary) + len(marks.dictionary)
        two = np.full((len(coded.dictionary), 2), len(units) - 1, np.int32)
        is_plain = plain.to_numpy(zero_copy_only=False)
        two[is_plain, 0], two[is_plain, 1] = word.indices.to_numpy(), marks.indices.to_numpy() + len(word.dictionary)
        two[~is_plain, 0] = np.arange(first, first + len(rest))
        at = two[coded.indices.to_numpy()].ravel()
        sizes = np.fromiter(map(len, units), np.int64, len(units)) // 4
        n = sizes[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        skip = np.cumsum(sizes) - sizes
        ids = np.frombuffer(b"".join(units), "<u4")[np.repeat(skip[at] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[2 * (split.offsets.to_numpy() - split.offsets[0].as_py())]


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[pa.Array]:
    """The texts in runs of up to so many bytes, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield texts.slice(at, to - at)
        at = to


def word_pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenized pieces: doc_id, piece, start, length, ids_crc32, and ids (binary) if asked for.

    part and k number the pieces of each length within the task that made them. Only documents over capacity are cut.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "k", *["ids"] * with_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = WordIds.of(tokenizer), EOS.to_bytes(4, "little")
        seen: dict[int, int] = defaultdict(int)
        part = TaskContext.get().partitionId()
        for batch in batches:
            row = 0
            for some in slices(batch.column(1)):
                rows: list[tuple] = []
                at: list[int] = []
                ids, bounds = encode(some)
                raw = memoryview(ids.view(np.uint8))
                for begin, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    total = stop - begin + 1
                    for piece, start in enumerate(range(0, total, capacity)):
                        n = min(capacity, total - start)
                        own, closing = raw[4 * (begin + start) : 4 * min(begin + start + n, stop)], end * (start + n == total)
                        rows.append((piece, start, n, zlib.crc32(closing, zlib.crc32(own)), part, seen[n], *[bytes(own) + closing] * with_ids))
                        seen[n] += 1
                        at.append(row)
                    row += 1
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]], names=names)

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    schema = f"doc_id {dict(own.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, part long, k long" + ", ids binary" * with_ids
    return own.mapInArrow(cut, schema)


def patterns(units: int, most: int) -> list[tuple[int, ...]]:
    """All multisets of 1 to ``most`` lengths, in units, that fill a sequence exactly."""
    found: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int) -> None:
        if head and left == 0:
            found.append(head)
        elif len(head) < most:
            for u in range(1, min(left, head[-1] if head else left) + 1):
                extend((*head, u), left - u)

    extend((), units)
    return found


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 1000) -> np.ndarray:
    """min |ax - b| with x >= 0, by active sets over the normal equations."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    target = a.T @ b
    for _ in range(steps):
        gain = np.where(free, -np.inf, target - a.T @ (a @ x))
        if (best := int(np.argmax(gain))) < 0 or gain[best] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        free[best] = True
        while True:
            own = np.flatnonzero(free)
            part = a[:, own]
            s = np.linalg.solve(part.T @ part + 1e-10 * np.eye(len(own)), target[own])
            if (s > 1e-12).all():
                x[:] = 0
                x[own] = s
                break
            down = s <= 1e-12
            ratio = np.min(x[own][down] / np.maximum(x[own][down] - s[down], 1e-300))
            x[own] += ratio * (s - x[own])
            free[own[(x[own] <= 1e-12) & down]] = False
            x[~free] = 0
            if not free.any():
                break
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY, unit: int = UNIT, most: int = PATTERN_DOCS) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths): so many sequences hold pieces of these lengths. Every piece of the histogram is placed once.

    Of several fits (fit_plan: two units, patterns whole or with their last place left to the best fit, repeated as
    fitted or half as often) the one that takes fewest sequences. All work on counts per length: time and size depend
    on the capacity, not on the number of pieces.
    """
    tried = [(u, k, share, whole) for u, k in ((unit, most), (unit // 2, 3)) if u > 0 for share in (1.0, 0.5) for whole in (True, False)]
    plans = (fit_plan(histogram, capacity, *how) for how in tried)
    return min(plans, key=lambda groups: sum(count for count, _ in groups))


def fit_plan(histogram: dict[int, int], capacity: int, unit: int, most: int, share: float = 1.0, whole: bool = True) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns of few documents that fill a sequence, in units rounded up, are fitted to the histogram by non-negative
    least squares and repeated as often as a share of the fit, rounded down, and the stock allow; unless ``whole``,
    without the pattern's shortest document. What remains goes, longest first, into the tightest gap, be it one that a
    pattern leaves or a sequence opened for it.
    """
    stock = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        stock[n] += c
    units = capacity // unit
    of_bin = lambda n: -(-n // unit)
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    if units > 1 and capacity % unit == 0:
        shapes = patterns(units, most)
        a = np.zeros((units, len(shapes)))
        for j, p in enumerate(shapes):
            for u in p:
                a[u - 1, j] += 1
        b = np.add.reduceat(stock[1:], np.arange(0, capacity, unit)).astype(float)
        x = nnls(a, b)
        for j in np.argsort(-x, kind="stable"):
            if (times := int(share * x[j] + 1e-6)) == 0:
                break
            shape = shapes[j] if whole else shapes[j][:-1] or shapes[j]
            need = np.bincount(shape, minlength=units + 1)
            for u in np.flatnonzero(need):
                times = min(times, int(stock[(u - 1) * unit + 1 : u * unit + 1].sum()) // int(need[u]))
            slots = []
            for u in shape:  # longest first within a bin
                runs, left = [], times
                for n in range(u * unit, (u - 1) * unit, -1):
                    if left and stock[n]:
                        take = min(left, int(stock[n]))
                        stock[n] -= take
                        left -= take
                        runs.append([n, take])
                slots.append(runs)
            at = [0] * len(slots)
            while times > 0:
                step = min(runs[i][1] for runs, i in zip(slots, at, strict=True))
                lengths = tuple(runs[i][0] for runs, i in zip(slots, at, strict=True))
                open_[capacity - sum(lengths)].append((step, lengths))
                times -= step
                for s, runs in enumerate(slots):
                    runs[at[s]][1] -= step
                    at[s] += runs[at[s]][1] == 0
    room = np.zeros(capacity + 1, bool)
    for r in open_:
        room[r] = True
    for n in range(capacity, 0, -1):
        while stock[n]:
            fits = np.flatnonzero(room[n:])
            if not fits.size:
                per = capacity // n
                times, rest = divmod(int(stock[n]), per)
                for t, k in ((times, per), (int(rest > 0), rest)):
                    if t:
                        open_[capacity - k * n].append((t, (n,) * k))
                        room[capacity - k * n] = True
                stock[n] = 0
                break
            r = n + int(fits[0])
            count, lengths = open_[r].pop()
            take = min(count, int(stock[n]))
            if count > take:
                open_[r].append((count - take, lengths))
            room[r] = bool(open_[r])
            open_[r - n].append((take, (*lengths, n)))
            room[r - n] = True
            stock[n] -= take
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for groups in open_.values():
        for count, lengths in groups:
            merged[lengths] += count
    return [(count, lengths) for lengths, count in merged.items()]


def places(groups: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset) in order: the pieces of a length, by rank, in runs over sequences."""
    rows, used, sequence = [], defaultdict(int), 0
    for count, lengths in groups:
        offset = 0
        for n in lengths:
            rows.append((n, used[n], sequence, offset))
            used[n] += count
            offset += n
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, capacity: int = CAPACITY, unit: int = UNIT, most: int = PATTERN_DOCS) -> DataFrame:
    """word_pieces (stored: read three times) with sequence_id and offset; columns part and k go.

    The histogram of lengths (at most ``capacity`` rows) is all that reaches the driver, and the plan made from it, as
    bounded, is all that is sent out. A piece's rank among those of its length is its rank within its task plus the
    counts of earlier tasks, so no length is gathered, however many pieces share it.
    """
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    runs = places(plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity, unit, most))
    width = np.int64(1) << np.int64(48)
    keys = runs[:, 0] * width + runs[:, 1]
    sent = pieces.sparkSession.sparkContext.broadcast((keys, runs))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    names = [c for c in pieces.columns if c not in ("part", "k")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, runs = sent.value
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, batch.column("length").to_numpy() * width + rank, side="right") - 1
            own = runs[at] if len(runs) else np.zeros((0, 4), np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(own[:, 2] + rank - own[:, 1]), pa.array(own[:, 3])], names=[*names, "sequence_id", "offset"])

    ranked = pieces.join(offsets, ["part", "length"]).select(*names, (F.col("k") + F.col("before")).alias("rank"))
    types = dict(pieces.dtypes)
    return ranked.mapInArrow(place, ", ".join(f"{c} {types[c]}" for c in names) + ", sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pack whole documents into as few sequences of ``capacity`` tokens as the plan finds.

    A document is its text's ids and then EOS; only one over capacity is cut, at multiples of capacity. Returns per
    piece doc_id, piece, start, length, ids_crc32, (ids), sequence_id, offset. A null or empty text is the single id
    EOS. Rows of one doc_id, null included, are separate documents. Other columns are not read. An empty table gives an
    empty result. The tokenizer's file must be at the same path on every worker.
    """
    pieces = stored(word_pieces(docs, tokenizer or default_tokenizer(), doc_id, text, capacity, with_ids), "pieces")
    return pack(pieces, capacity)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
