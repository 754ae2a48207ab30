"""Vector search: exact cosine top-k per document."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_PREFIX, QUERY_CHARS = "", 8000


def query_text(query: Column, prefix: str = QUERY_PREFIX, most: int = QUERY_CHARS) -> Column:
    """Prefixed and cut to so many characters."""
    return F.substring(F.concat(F.lit(prefix), query), 1, most)


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null or has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def search(chunks: DataFrame, queries: DataFrame, k: int, doc: str = "doc_id", chunk_id: str = "id", vector: str = "embedding") -> DataFrame:
    """(query_id, doc, id, relevance, rank): the k chunks nearest to each query within its document; k at least 1.

    queries hold query_id, the document and a vector ``q``. An equi-join on the document, so a partitioned store reads
    only documents asked for; the rank's limit is pushed below its shuffle. Ties go to the smaller id.
    """
    k = max(k, 1)
    met = chunks.select(doc, chunk_id, vector).join(queries.select("query_id", doc, "q"), doc).withColumn("relevance", cosine(F.col(vector), F.col("q")))
    rank = F.row_number().over(Window.partitionBy("query_id", doc).orderBy(F.col("relevance").desc_nulls_last(), chunk_id))
    return met.select("query_id", doc, chunk_id, "relevance", rank.alias("rank")).where(F.col("rank") <= k)


def search_all(chunks: DataFrame, queries: DataFrame, k: int, chunk_id: str = "id", vector: str = "embedding", block: int = 8192) -> DataFrame:
    """(query_id, id, relevance, rank): the k chunks nearest to each query (query_id, ``q``) of all; k at least 1.

    Exact, so all pairs are looked at: both sides go to blocks, every pair of blocks is one group, and of a group each
    query keeps k rows. Matrix products pick who may be among them; those alone are summed in order as ``cosine`` does.
    A group's memory depends on the block's rows only. Relevance and ties as in ``search``, null ids last.
    """
    k = max(k, 1)
    n_chunks, n_queries = chunks.count() // block + 1, queries.count() // block + 1
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = chunks.select(F.col(chunk_id).alias("id"), F.col(vector).alias("x")).select("id", "x", dealt(n_chunks, "id", "x").alias("b"), each(n_queries).alias("c"))
    right = queries.select("query_id", "q").select("query_id", "q", each(n_chunks).alias("b"), dealt(n_queries, "query_id", "q").alias("c"))
    types = dict(left.dtypes)["id"], dict(right.dtypes)["query_id"]

    def nearest(own: pa.Table, asked: pa.Table) -> pa.Table:
        at, to, relevance = nearest_rows(own.column("x"), own.column("id"), asked.column("q"), k)
        return pa.table({"query_id": asked.column("query_id").take(pa.array(at)), "id": own.column("id").take(pa.array(to)), "relevance": relevance})

    met = left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInArrow(nearest, f"query_id {types[1]}, id {types[0]}, relevance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("relevance").desc_nulls_last(), F.col("id").asc_nulls_last()))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("id").alias(chunk_id), "relevance", "rank")


def _by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Length to (row numbers, rows as doubles, norms) of the vectors that are not null or empty and have no null in them."""
    rows = column.combine_chunks()
    n = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype("i8")
    flat = pc.list_flatten(rows)
    values, whole = flat.to_numpy(zero_copy_only=False).astype("f8"), n > 0
    if flat.null_count:
        whole[np.repeat(np.arange(len(n)), n)[flat.is_null().to_numpy(zero_copy_only=False)]] = False
    starts, out = np.cumsum(n) - n, {}
    for m in np.unique(n[whole]):
        at = np.flatnonzero(whole & (n == m))
        x = values[starts[at][:, None] + np.arange(m)]
        out[int(m)] = at, x, np.sqrt(_dots(x, x))
    return out


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first place on as ``dot`` sums."""
    s = np.zeros(len(x))
    for j in range(x.shape[1]):
        s += x[:, j] * y[:, j]
    return s


def nearest_rows(vectors: pa.ChunkedArray, ids: pa.ChunkedArray, queries: pa.ChunkedArray, k: int, step: int = 512, margin: float = 1e-9) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row numbers of queries, of their k nearest vectors, and cosines; ties by id, pairs without a cosine last.

    Products by matrix may be off in the last places, by far less than ``margin``, so all within it of the k-th are summed in order.
    """
    order = pc.rank(ids.combine_chunks(), sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy(zero_copy_only=False).astype("i8")
    by_id, own, found = np.argsort(order, kind="stable"), _by_length(vectors), np.zeros(len(queries), "i8")
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for m, (q_at, q, q_norm) in _by_length(queries).items():
        at, x, norm = own.get(m, (np.zeros(0, "i8"), np.zeros((0, m)), np.zeros(0)))
        if not len(at):
            continue
        for a in range(0, len(q), step):
            own_norms = q_norm[a : a + step, None]
            with np.errstate(all="ignore"):
                near = (q[a : a + step] / own_norms) @ (x / norm[:, None]).T
            near[np.isnan(near)] = np.inf  # no number ranks first, as in Spark
            if not (norm.all() and own_norms.all()):
                near[own_norms * norm == 0] = -np.inf
            least = np.partition(near, -k, axis=1)[:, -k] - margin if len(at) > k else np.full(len(near), -np.inf)
            i, j = np.nonzero((near >= least[:, None]) & (near > -np.inf))
            r = np.empty(len(i))
            for p in range(0, len(i), 65536):
                s = slice(p, p + 65536)
                r[s] = _dots(x[j[s]], q[a + i[s]]) / (norm[j[s]] * q_norm[a + i[s]])
            best = np.lexsort((order[at[j]], -r, ~np.isnan(r), i))
            i, j, r = i[best], j[best], r[best]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append((q_at[a + i[keep]], at[j[keep]], r[keep]))
            found += np.bincount(out[-1][0], minlength=len(found))
    # queries with fewer cosines than k: all they have is in ``out``
    rest: list[tuple[int, list[int]]] = []
    for i in map(int, np.flatnonzero(found < min(k, len(order)))):
        has = {int(v) for q_at, at, _ in out for v in at[q_at == i]}
        rest.append((i, [int(v) for v in by_id[: k + len(has)] if v not in has][: k - len(has)]))
    at, to, r = (np.concatenate([np.zeros(0, t), *c]) for t, c in zip(("i8", "i8", "f8"), zip(*out, strict=True) if out else ((), (), ()), strict=True))
    empty = sum(len(v) for _, v in rest)
    at = np.concatenate([at, np.array([i for i, v in rest for _ in v], "i8")])
    to = np.concatenate([to, np.array([x for _, v in rest for x in v], "i8")])
    return at, to, pa.array(np.concatenate([r, np.zeros(empty)]), mask=np.arange(len(at)) >= len(r))


def search_one(chunks: DataFrame, query: list[float], k: int, chunk_id: str = "id", vector: str = "embedding") -> DataFrame:
    """The k chunks nearest to one query: a top-k without a full sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return chunks.withColumn("relevance", cosine(F.col(vector), q)).orderBy(F.col("relevance").desc_nulls_last(), chunk_id).limit(max(k, 1))


def results(hits: DataFrame, nodes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """hits (path, pos, len) with what a reader is shown: crumbs, text, page, position and relevance."""
    met = hits.join(nodes.select(doc, "path", "crumbs", "header", F.col("text").alias("node_text"), "page", "x", "y"), [doc, "path"])
    body = F.concat("header", F.lit("\n"), "node_text")
    return met.select("query_id", doc, "rank", "crumbs", F.substring(body, F.col("pos") + 1, F.col("len")).alias("text"), "page", F.struct("x", "y").alias("position"), "relevance")


def embed(texts: DataFrame, embedder: Callable[[list[str]], list[list[float]]], text: str = "text", out: str = "embedding", batch: int = 64) -> DataFrame:
    """texts with vectors of a pluggable embedder, called on batches; it is built or connected once per task.

    ``embedder`` may be a function of a list of texts, or a factory (with attribute ``factory`` true) returning one.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in texts.dtypes if n != out) + f", `{out}` array<float>"
    names = [n for n in texts.columns if n != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = embedder() if getattr(embedder, "factory", False) else embedder
        for b in batches:
            values = b.column(names.index(text)).to_pylist()
            vectors: list = []
            for i in range(0, len(values), batch):
                vectors += call(values[i : i + batch])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float32()))], names=[*names, out])

    return texts.select(*names).mapInArrow(run, schema)


class HttpEmbedder:
    """An embedder behind HTTP: posts ``{"input": texts, ...}`` to ``url`` and reads ``data[i].embedding`` by index."""

    factory = True

    def __init__(self, url: str, model: str = "", timeout: float = 600, headers: dict[str, str] | None = None) -> None:
        self.url, self.model, self.timeout = url, model, timeout
        self.headers = {"Accept": "application/json", "Content-Type": "application/json", **(headers or {})}

    def __call__(self) -> Callable[[list[str]], list[list[float]]]:
        from urllib.request import Request, urlopen

        def call(texts: list[str]) -> list[list[float]]:
            body = json.dumps({"input": texts, "model": self.model, "encoding_format": "float"}).encode()
            with urlopen(Request(self.url, body, self.headers), timeout=self.timeout) as answer:
                data = sorted(json.load(answer)["data"], key=lambda d: d["index"])
            if len(data) != len(texts):
                raise ValueError(f"{len(data)} vectors for {len(texts)} texts")
            return [d["embedding"] for d in data]

        return call


def hashing_embedder(dims: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A stand-in without a model: signed counts of hashed words, of unit length."""
    from zlib import crc32

    def call(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dims)
            for w in (t or "").lower().split():
                h = crc32(w.encode())
                v[h % dims] += 1 if h >> 16 & 1 else -1
            out.append((v / (np.linalg.norm(v) or 1)).tolist())
        return out

    return call
