"""Exact top-k inner products: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz residual bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm.common import stored, table

K, SCALE = 20, 64
#: Vectors of a block, queries of a block; blocks of a run of vectors and of a group of queries, which meet in one task.
BLOCK, QUERIES, RUN, GROUP = 1024, 1024, 64, 16
#: Blocks of the longest vectors, which every query meets first.
HEAD = 1
#: Bounds are rounded values; they are widened by this much of the product of lengths.
SLACK = 1e-9
#: The score of a pruned pair or an empty place. Its negation is itself, so sort keys must treat it apart.
NONE = np.iinfo(np.int64).min


def usable(embedding: Column) -> Column:
    """Not null and without null, NaN or infinite components."""
    return embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def quantized(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x), x as double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def gram(vectors: DataFrame, width: int) -> np.ndarray:
    """Sum of the vectors' outer products, over all rows: ``width`` rows a task, summed before and after the shuffle."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((width, width))
        for b in batches:
            m = _matrix(b.column(0).to_pylist(), width)
            g += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(width), width)), pa.array(np.tile(np.arange(width), width)), pa.array(g.ravel())], names=["i", "j", "g"])

    rows = vectors.select("v").mapInArrow(outer, "i long, j long, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect()
    g = np.zeros((width, width))
    for r in rows:
        g[r["i"], r["j"]] = r["g"]
    return g


def blocks_of(vectors: DataFrame, size: int, width: int, by: list[Column], spread: int) -> DataFrame:
    """Packed rows: block (long), ids, m (components as little-endian 32-bit integers), longest (norm of the longest).

    Blocks are in the order of ``by``; block >> 32 is the range of that order (one of ``spread``) that a block lies in.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, ids, rows = TaskContext.get().partitionId(), 0, [], []

        def full() -> pa.RecordBatch:
            m = _matrix(rows, width)
            longest = float(np.sqrt((m * m).sum(1).max()))
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | n]), pa.array([ids], pa.list_(pa.int64())), pa.array([m.astype("<i4").tobytes()], pa.binary()), pa.array([longest])], names=["block", "ids", "m", "longest"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                rows.append(v)
                if len(ids) == size:
                    yield full()
                    n, ids, rows = n + 1, [], []
        if ids:
            yield full()

    ordered = vectors.select("vec_id", "v", "norm2").repartitionByRange(spread, *by).sortWithinPartitions(*by)
    return ordered.select("vec_id", "v").mapInArrow(packed, "block long, ids array<long>, m binary, longest double")


def _unpack(m: bytes, width: int) -> np.ndarray:
    return np.frombuffer(m, "<i4").astype(np.int64).reshape(-1, width)


def scan(query: np.ndarray, found: list[tuple[float, list, np.ndarray]], rotation: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of each query over blocks in order of descending length; (queries, k) arrays of both.

    ``least`` holds a score for each query of which k are known already; lower ones are of no use. A block whose longest
    vector cannot reach a query's k-th score is skipped for that query, and where none can, the scan ends. Within a block the
    products are summed over the leading rotated components first; |rest of q| * |rest of v| bounds what is missing,
    and only pairs whose bound reaches the k-th score are multiplied out, in integers.
    """
    n, width = query.shape
    lead = max(1, width // 4)
    q = query @ rotation
    q_norm, q_rest = np.linalg.norm(q, axis=1), np.linalg.norm(q[:, lead:], axis=1)
    scores, ids = np.full((n, 0), 0, np.int64), np.full((n, 0), 0, np.int64)
    for longest, own, m in found:
        floor = scores[:, k - 1].astype(float) if scores.shape[1] >= k else np.full(n, -np.inf)
        floor = floor if least is None else np.maximum(floor, least)
        slack = SLACK * q_norm * longest + 1e-6
        live = np.flatnonzero(q_norm * longest + slack >= floor)
        if not live.size:
            break
        v = m @ rotation
        v_norm, v_rest = np.linalg.norm(v, axis=1), np.linalg.norm(v[:, lead:], axis=1)
        bound = q[live][:, :lead] @ v[:, :lead].T + np.outer(q_rest[live], v_rest) + (SLACK * np.outer(q_norm[live], v_norm) + 1e-6)
        reach = bound >= floor[live][:, None]
        rows, cols = np.flatnonzero(reach.any(1)), np.flatnonzero(reach.any(0))
        if not rows.size:
            continue
        # whole numbers below 2^53 are exact in double precision, which multiplies much faster
        small = np.abs(query).max(initial=0) * np.abs(m).max(initial=0) * width < 2**53
        exact = (query[live[rows]].astype(float) @ m[cols].astype(float).T).astype(np.int64) if small else query[live[rows]] @ m[cols].T
        got = np.where(reach[np.ix_(rows, cols)], exact, NONE)
        ids_of = own[cols]
        at = live[rows]
        all_scores = np.concatenate([scores[at], got], axis=1)
        all_ids = np.concatenate([ids[at], np.broadcast_to(ids_of, got.shape)], axis=1)
        best = np.lexsort((all_ids, np.where(all_scores == NONE, np.iinfo(np.int64).max, -all_scores)), axis=1)[:, :k]
        wide = best.shape[1]
        if scores.shape[1] < wide:
            grow = wide - scores.shape[1]
            scores = np.concatenate([scores, np.full((n, grow), NONE)], axis=1)
            ids = np.concatenate([ids, np.full((n, grow), np.iinfo(np.int64).max)], axis=1)
        scores[at[:, None], np.arange(wide)] = np.take_along_axis(all_scores, best, 1)
        ids[at[:, None], np.arange(wide)] = np.take_along_axis(all_ids, best, 1)
    return scores, ids


#: Stands for a null id inside a task: larger than any other, so ties go to it last.
NO_ID = np.iinfo(np.int64).max


def _ids(ids: list) -> np.ndarray:
    return np.array([NO_ID if i is None or i != i else int(i) for i in ids], np.int64)


def first_scores(queries: DataFrame, head: list[tuple[float, np.ndarray, bytes]], rotation: np.ndarray, width: int, keep: int) -> DataFrame:
    """queries (vec_id, v) with key, own (squared length), found (id and score of the keep best of the head) and need.

    need is the length that a vector must have to displace one of ``keep`` that the head gave, minus infinity where it
    gave fewer. The head, a bounded number of vectors, goes to all tasks.
    """
    sent = queries.sparkSession.sparkContext.broadcast([(longest, ids, m) for longest, ids, m in head])
    out = "key long, vec_id long, v array<long>, own long, least double, need double, found array<struct<vec_id:long,score:long>>"

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        blocks = [(longest, ids, _unpack(m, width)) for longest, ids, m in sent.value]
        part, n = TaskContext.get().partitionId(), 0
        longest = max((x[0] for x in blocks), default=0.0)
        for whole in batches:
            for at in range(0, whole.num_rows, QUERIES):
                b = whole.slice(at, QUERIES)
                q = _matrix(b.column(1).to_pylist(), width).astype(np.int64)
                scores, ids = scan(q, blocks, rotation, keep)
                scores, ids = (scores[:, :keep], ids[:, :keep]) if blocks else (np.zeros((len(q), 0), np.int64),) * 2
                full = scores.shape[1] == keep
                least = scores[:, -1].astype(float) if full else np.full(len(q), -np.inf)
                least[least == float(NONE)] = -np.inf
                norm = np.linalg.norm(q.astype(float), axis=1)
                slack = SLACK * norm * longest + 1e-6
                need = np.where(norm > 0, (least - slack) / np.maximum(norm, 1e-300), -np.inf)
                found = [[{"vec_id": int(i), "score": int(s)} for i, s in zip(row_i, row_s, strict=True) if s != NONE] for row_i, row_s in zip(ids, scores, strict=True)]
                columns = [pa.array(part << 32 | n + k for k in range(len(q))), b.column(0), b.column(1), pa.array((q * q).sum(1)), pa.array(least), pa.array(need), pa.array(found, pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.int64())])))]
                n += len(q)
                yield pa.RecordBatch.from_arrays(columns, names=["key", "vec_id", "v", "own", "least", "need", "found"])

    return queries.select("vec_id", "v").mapInArrow(meet, out)


def query_blocks(queries: DataFrame, width: int, spread: int) -> DataFrame:
    """first_scores' rows packed: grp (by need, the least first), keys, ids, own, least, m (32-bit integers), need (the least)."""
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary(), pa.float64()]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for whole in batches:
            for at in range(0, whole.num_rows, QUERIES):
                b = whole.slice(at, QUERIES)
                key, ids, v, own, least, need = (b.column(i).to_pylist() for i in range(6))
                row = [part, key, ids, own, least, _matrix(v, width).astype("<i4").tobytes(), min(need)]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["grp", "keys", "ids", "own", "least", "m", "need"])

    ordered = queries.select("key", "vec_id", "v", "own", "least", "need").repartitionByRange(spread, "need", "key").sortWithinPartitions("need", "key")
    return ordered.mapInArrow(packed, "grp long, keys array<long>, ids array<long>, own array<long>, least array<double>, m binary, need double")


def tiles(rest: DataFrame, q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Query blocks and vector blocks, each once for every (run, grp) in which it can matter."""
    # which runs a group needs: those up to a place, as runs go by descending length; and which groups a run is needed by
    longest = {r["run"]: r["x"] for r in rest.groupBy("run").agg(F.max("longest").alias("x")).collect()}
    need = {r["grp"]: r["x"] for r in q.groupBy("grp").agg(F.min("need").alias("x")).collect()}
    runs, groups = sorted(longest), sorted(need)
    reach = np.maximum.accumulate(np.array([longest[r] for r in runs])[::-1])[::-1] if runs else np.zeros(0)
    wanted = [(g, runs[int(m) - 1]) for g in groups if (m := np.searchsorted(-reach, -need[g], side="right"))]
    asked = [(r, [g for g, last in wanted if last >= r]) for r in runs]
    left = q.join(F.broadcast(rest.sparkSession.createDataFrame(wanted, "grp long, last long")), "grp").select("grp", "keys", "ids", "own", "least", "m", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("run"))
    right = rest.join(F.broadcast(rest.sparkSession.createDataFrame(asked, "run long, grps array<long>")), "run").select("run", "ids", "m", "longest", F.explode("grps").alias("grp"))
    return left, right


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, run: int = RUN * BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of each query row with every other row.

    Ties go to the smaller vec_id (null last). Vectors that are null or hold null or non-finite components take no part.
    Vectors of unequal length are compared over the components that both have. Rows of one vec_id are separate rows:
    only the query's own row is left out, once; a query row may have a null id too. Other columns are not read. Empty
    tables give empty results. Vectors so long that a score might leave 64 bits (squared length 2^62 or more) are an
    error. The id 2^63 - 1 counts as null.

    First every query meets the longest vectors, which fixes the score it must beat, and so the length that a vector
    needs to count. Then runs of vectors, by descending length, meet groups of queries, by ascending need: only those
    whose longest vector is long enough, so the queries that travel, and the runs, become fewer as lengths fall. A run
    goes once to each such group of 16,384 queries, and a block of queries once to each such run. That the query set
    meets all rows is the stated work; beyond what the head gave, only what beats it is shuffled. What reaches the
    driver is the head, a Gram matrix, and one number a run and a group.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("e"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where(usable(F.col("e")))
    own = own.withColumn("v", quantized(F.col("e"), scale)).withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).drop("e")
    own = stored(own, "vectors")
    n, n_queries, width, most = own.agg(F.count("*"), F.count_if("is_query"), F.max(F.size("v")), F.max("norm2")).first()
    width = max(1, width or 0)
    if (most or 0) >= 2.0**62:
        raise ValueError("vectors are too long for 64-bit scores")
    rotation = np.linalg.svd(gram(own, width))[0] if n else np.eye(width)
    order = [F.col("norm2").desc(), F.col("vec_id").asc_nulls_last(), F.xxhash64("v")]
    spread = max(1, -(-n // run), min(2 * spark.sparkContext.defaultParallelism, n // (2 * BLOCK)))
    blocks = stored(blocks_of(own, BLOCK, width, order, spread), "blocks").withColumn("run", F.shiftright("block", 32))
    head = [(r["longest"], _ids(r["ids"]), bytes(r["m"]), r["block"]) for r in blocks.orderBy("block").limit(HEAD).collect()]
    rest = blocks.where(F.col("block") > head[-1][3]) if head else blocks
    keep = k + 1
    queries = stored(first_scores(own.where("is_query"), [x[:3] for x in head], rotation, width, keep), "queries")
    q = stored(query_blocks(queries, width, max(1, -(-n_queries // (GROUP * QUERIES)))), "groups")
    left, right = tiles(rest, q)

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"key": [], "query_id": [], "vec_id": [], "score": [], "own": []})]
        b = b.sort_values("longest", ascending=False)
        found = [(x.longest, _ids(x.ids), _unpack(x.m, width)) for x in b.itertuples()]
        for x in a.itertuples() if found else ():
            scores, ids = scan(_unpack(x.m, width), found, rotation, keep, np.array(x.least, float))
            at, place = np.nonzero(scores != NONE)
            of = lambda values: np.array(values, np.int64)[at]  # noqa: E731, B023
            out.append(pd.DataFrame({"key": of(x.keys), "query_id": _ids(x.ids)[at], "vec_id": ids[at, place], "score": scores[at, place], "own": of(x.own)}))
        return pd.concat(out) if len(out) == 1 else pd.concat(out[1:])

    met = left.groupBy("run", "grp").cogroup(right.groupBy("run", "grp")).applyInPandas(meet, "key long, query_id long, vec_id long, score long, own long")
    first = queries.select("key", F.coalesce("vec_id", F.lit(int(NO_ID))).alias("query_id"), "own", F.explode("found").alias("x")).select("key", "query_id", "x.vec_id", "x.score", "own")
    both = met.unionByName(first)
    best = Window.partitionBy("key").orderBy(F.col("score").desc(), "vec_id")
    both = both.withColumn("r", F.row_number().over(best)).where(F.col("r") <= keep)
    # the query's own row has its id and its squared length; rows alike in both stand for one another
    self_row = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    both = both.withColumn("mine", F.min(F.when(self_row, F.col("r"))).over(Window.partitionBy("key"))).where(F.col("mine").isNull() | (F.col("r") != F.col("mine")))
    rank = F.col("r") - F.when(F.col("mine") < F.col("r"), 1).otherwise(0)
    named = lambda c: F.nullif(c, F.lit(int(NO_ID))).alias(c)
    return both.select(named("query_id"), rank.cast("int").alias("rank"), named("vec_id"), "score").where(F.col("rank") <= k)


def op2_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))


SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, e AS f FROM v WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(e, f), lambda z: z[1] * z[2]))::BIGINT AS score FROM q, v WHERE query_id <> vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20"""
