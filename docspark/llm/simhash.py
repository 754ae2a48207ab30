"""SimHash near-dedup: an inverted index over byte positions with count filtering, then the Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import LOWER, UPPER, stored, table
from docspark.llm.components import connected_components

WORDS, DISTANCE, SEED = 3, 3, 42
#: Postings that meet in one list at the first level; longer lists are split by two further byte positions.
LIST = 2048
#: Fingerprints that differ in up to DISTANCE bits share at least 8 - DISTANCE of 8 positional bytes.
MATCHES = 8 - DISTANCE
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Of 5 shared positions at least 3 lie in one half of the 8, so these 8 triples meet every pair in question.
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64 bits: bit i is 1 if it is set in over half the XXH64 of the word shingles, repeats included."""
    w = text.translate(TO_LOWER).split()  # bytes.split() parts at [\x20\x09-\x0D]
    if not w:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(w) - words + 1)
    if len(w) < words:
        hashes: Iterator[int] = iter([digest(b" ".join(w), SEED)])
    else:
        hashes = (digest(s, SEED) for s in map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)))
    counts = np.zeros(64, np.int64)
    while (h := np.fromiter(_some(hashes, 65536), np.uint64)).size:
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _some(values: Iterator[int], n: int) -> Iterator[int]:
    for _, v in zip(range(n), values, strict=False):
        yield v


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and the columns named in keep; null text counts as empty."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary() if pa.types.is_large_string(batch.column(1).type) else pa.binary())
            fp = np.fromiter((fingerprint(t.as_py() or b"") for t in column), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(i) for i in range(2, batch.num_columns)], pa.array(fp)], names=["doc_id", *keep, "fp"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"), *keep)
    schema = ", ".join([f"doc_id {dict(own.dtypes)['doc_id']}", *[f"`{c}` {dict(own.dtypes)[c]}" for c in keep], "fp bigint"])
    return own.mapInArrow(hashed, schema)


def _mask(positions: tuple[int, ...]) -> int:
    return int(np.array([sum(0xFF << 8 * p for p in positions)], np.uint64).view(np.int64)[0])


def _lists(masks: list[int]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("m")) for i, m in enumerate(masks)]))


#: For each triple, the masks of it and two of the other five positions: at least two of those are shared as well.
REFINED = [[_mask((*t, *two)) for two in combinations([p for p in range(8) if p not in t], 2)] for t in TRIPLES]


def near(x: np.ndarray, y: np.ndarray | np.uint64) -> np.ndarray:
    """Tally the shared positional bytes, keep pairs with enough of them, then verify the distance."""
    differ = np.bitwise_xor(x, y)
    shared = np.count_nonzero(differ.view(np.uint8).reshape(-1, 8) == 0, axis=1)
    keep = shared >= MATCHES
    keep[keep] = np.bitwise_count(differ[keep]) <= DISTANCE
    return keep


def links(fps: np.ndarray, mask: int) -> list[tuple[int, int]]:
    """Links (one spanning tree per group of linked fingerprints) among distinct fingerprints of one list.

    A list up to 4 * LIST long is tallied outward from one fingerprint to those not reached yet. A longer one comes
    from the second level, where five positions agree and up to three bits in the other 24 may differ: the 2,324
    values within reach of each are looked up, so the work stays proportional to the list, and a list has at most 2^24.
    """
    out: list[tuple[int, int]] = []
    if len(fps) <= 4 * LIST:
        rest = fps
        while rest.size:
            todo, rest = [rest[0]], rest[1:]
            while todo and rest.size:
                one = todo.pop()
                if (hit := near(rest, one)).any():
                    out += [(int(one), int(x)) for x in rest[hit]]
                    todo += list(rest[hit])
                    rest = rest[~hit]
        return out
    free = [np.uint64(1) << np.uint64(b) for b in range(64) if not mask >> b & 1]
    flips = np.array([np.bitwise_or.reduce(np.array(c, np.uint64)) for k in range(1, DISTANCE + 1) for c in combinations(free, k)], np.uint64)
    fps = np.sort(fps)
    parent = np.arange(len(fps))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, one in enumerate(fps):
        reach = np.bitwise_xor(one, flips)
        at = np.searchsorted(fps, reach)
        for j in at[(at < len(fps)) & (fps[np.minimum(at, len(fps) - 1)] == reach)]:
            if (a := root(i)) != (b := root(int(j))):
                parent[b] = a
                out.append((int(one), int(fps[j])))
    return out


def similar_fingerprints(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect just the fingerprints (column fp, distinct) linked at up to DISTANCE differing bits.

    Every fingerprint is posted under triples of positional bytes (TRIPLES). Lists longer than LIST are split by two
    more positions, which keeps every link and bounds a list by 2^24 values; nothing is capped. A list yields fewer
    edges than it has members, so a large group of near copies does not become all its pairs.
    """
    first = distinct.select("fp", _lists([_mask(t) for t in TRIPLES]).alias("x")).select("fp", "x.*")
    counts = first.groupBy("c", "m").agg(F.count("*").alias("n")).where("n > 1")
    posted = first.join(counts, ["c", "m"])
    short = posted.where(F.col("n") <= LIST).select("c", "m", "fp")
    again = F.array(*[F.array(*[F.struct(F.lit(8 + 10 * c + j).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("m")) for j, m in enumerate(masks)]) for c, masks in enumerate(REFINED)])
    long = posted.where(F.col("n") > LIST).select("fp", F.explode(F.element_at(again, F.col("c") + 1)).alias("x")).select("x.*", "fp")
    masks = [_mask(t) for t in TRIPLES] + [m for ms in REFINED for m in ms]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> list[tuple[int, int]]:
            return links(np.unique(np.array(held, np.int64).view(np.uint64)), masks[key[0]] & 0xFFFFFFFFFFFFFFFF) if len(held) > 1 else []

        for batch in batches:
            found: list[tuple[int, int]] = []
            for c, m, fp in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if (c, m) != key:
                    found += done()
                    key, held = (c, m), []
                held.append(fp)
            yield _edges(found)
        yield _edges(done())

    both = short.unionByName(long)
    return both.repartition("c", "m").sortWithinPartitions("c", "m").mapInArrow(scan, "a bigint, b bigint")


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), root: bool = False) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links, itself included) and the columns named in keep.

    A row for each input row. With ``root`` also root, a fingerprint that names the component, which component_id does
    not where ids are null or repeated.

    Texts without words have fingerprint 0 and are linked like any other. A null text is empty. Rows of one doc_id are
    separate documents; a null doc_id is never a component's smallest unless it has no other (component_id is null
    then). Other columns are not read. An empty table gives an empty result.

    Texts are read once, for 16 bytes a document; all later steps work on distinct fingerprints, so any number of
    exact copies is one posting.
    """
    own = stored(fingerprints(docs, doc_id, text, keep), "fingerprints")
    smallest = stored(own.groupBy("fp").agg(F.min("doc_id").alias("d")), "distinct")
    roots = connected_components(similar_fingerprints(smallest.select("fp"))).withColumnRenamed("node", "fp")
    linked = stored(roots.join(smallest, "fp"), "linked")
    of_root = linked.groupBy("root").agg(F.min("d").alias("component_id"))
    of_fp = linked.join(of_root, "root").select("fp", "root", "component_id")
    all_fps = smallest.join(of_fp, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "d").alias("component_id"))
    return own.join(all_fps, "fp").select("doc_id", "fp", "component_id", *keep, *["root"] * root)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
