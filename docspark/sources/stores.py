"""Stores that outlive a session: vectors by document, header trees, pseudonym maps."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators.grouped import fold_groups
from docspark.operators.pseudonyms import PMAP
from docspark.sources.files import append_results
from docspark.sources.plugins import per_row
from docspark.storage import exists, stored

VECTORS = "id string, pos int, len int, embedding array<float>"
BUCKETS = 256


def _bucket(doc_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")


def collections(spark: SparkSession, path: str, doc_type: str = "string") -> DataFrame:
    """(doc_id, batch, chunks): the documents that a vector store holds; none if there is no store yet.

    Where two writers stored one document at a time, the smaller batch is the one that counts.
    """
    schema = f"doc_id {doc_type}, batch string, chunks long"
    if not exists(spark, f"{path}/collections"):
        return spark.createDataFrame([], schema)
    own = spark.read.schema(schema).parquet(f"{path}/collections")
    return own.groupBy("doc_id").agg(F.min_by(F.struct("batch", "chunks"), "batch").alias("x")).select("doc_id", "x.*")


def missing(docs: DataFrame, path: str) -> DataFrame:
    """Rows of docs (doc_id) whose document the store does not hold: only these need chunks and vectors. A null id is an id."""
    held = collections(docs.sparkSession, path, dict(docs.dtypes)["doc_id"]).select(F.col("doc_id").alias("__held"))
    return docs.join(held, F.col("doc_id").eqNullSafe(F.col("__held")), "left_anti")


def add_vectors(vectors: DataFrame, path: str, docs: DataFrame | None = None) -> DataFrame:
    """Append the vectors (doc_id, and columns VECTORS) of documents not held yet; returns (doc_id, batch, chunks) added.

    ``docs`` (doc_id) names the documents, so that one without chunks is held too. Vectors are written first, by hash
    buckets of the document, the documents' rows last: what a broken run leaves belongs to no listed batch and is never
    read. Nothing is added twice. An empty table adds nothing.
    """
    names = [x.split()[0] for x in VECTORS.split(", ")]
    spark, batch = vectors.sparkSession, uuid.uuid4().hex
    new = stored(missing(vectors, path).select("doc_id", *names), "vectors")
    counts = new.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    if docs is not None:
        own = missing(docs, path).select(F.col("doc_id").alias("__own")).distinct()
        counts = own.join(counts, F.col("__own").eqNullSafe(F.col("doc_id")), "full").select(F.coalesce("__own", "doc_id").alias("doc_id"), F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"))
    counts = stored(counts.select("doc_id", F.lit(batch).alias("batch"), "chunks"), "collections")
    placed = new.withColumn("batch", F.lit(batch)).withColumn("bucket", _bucket(F.col("doc_id")))
    placed.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "doc_id", "id").write.mode("append").partitionBy("bucket").parquet(f"{path}/vectors")
    counts.write.mode("append").parquet(f"{path}/collections")
    return counts


def read_vectors(spark: SparkSession, path: str, docs: list | None = None, doc_type: str = "string") -> DataFrame:
    """(doc_id, and columns VECTORS) of the store; with ``docs`` only theirs, which prunes buckets."""
    held = collections(spark, path, doc_type).select(F.col("doc_id").alias("__held"), F.col("batch").alias("__batch"))
    schema = f"doc_id {doc_type}, {VECTORS}, batch string, bucket int"
    if not exists(spark, f"{path}/vectors"):
        return spark.createDataFrame([], schema).drop("batch", "bucket")
    own = spark.read.schema(schema).parquet(f"{path}/vectors")
    if docs is not None:
        asked = spark.createDataFrame([(d,) for d in docs], f"doc_id {doc_type}")
        buckets = [r[0] for r in asked.select(_bucket(F.col("doc_id"))).distinct().collect()]  # as many as were asked for
        own = own.where(F.col("bucket").isin(buckets) & F.col("doc_id").isin(docs))
    on = F.col("doc_id").eqNullSafe(F.col("__held")) & (F.col("batch") == F.col("__batch"))
    return own.join(held, on, "left_semi").drop("batch", "bucket")


# --- trees -----------------------------------------------------------------------------------------------------------

NODES = "node_id int, parent_id int, level int, header string, text string, page int, x double, y double, ordinal int"


def tree_to_json(nodes: DataFrame, doc: list[str]) -> DataFrame:
    """(doc, json): each document's tree_nodes as one nested object with name, level, header, text, page, position, children.

    A fold per document over its nodes in id order; children keep their ordinals' order. A node whose parent is not
    there is an error. Repeated rows are repeated nodes.
    """
    keys = ", ".join(f"`{c}` {dict(nodes.dtypes)[c]}" for c in doc)

    def fold(key: tuple, rows: list[dict]) -> list[tuple]:
        made = {r["node_id"]: {"name": str(r["node_id"]), "level": r["level"], "header": r["header"], "text": r["text"], "page": r["page"], "position": {"x": r["x"], "y": r["y"]}} for r in rows}
        roots = []
        for r in sorted(rows, key=lambda r: (r["ordinal"] or 0, r["node_id"])):
            if r["parent_id"] is None:
                roots.append(made[r["node_id"]])
            elif r["parent_id"] not in made:
                raise ValueError(f"node {r['node_id']} of {key} has no parent {r['parent_id']}")
            else:
                made[r["parent_id"]].setdefault("children", []).append(made[r["node_id"]])
        return [(*key, json.dumps(t, ensure_ascii=False)) for t in roots]

    return fold_groups(nodes, doc, ["node_id"], fold, f"{keys}, json string")


def tree_from_json(trees: DataFrame, doc: list[str], body: str = "json") -> DataFrame:
    """tree_nodes (and error) from nested objects as tree_to_json writes them; null gives no row, a broken one its error.

    Node ids are the names; where these are no numbers or repeat, places in preorder.
    """

    def call(text: str | None) -> Iterator[tuple]:
        if text is None:
            return
        order, rest = [], [(json.loads(text), None, 0)]
        while rest:
            node, parent, ordinal = rest.pop()
            order.append((node, parent, ordinal))
            rest += [(c, len(order) - 1, k) for k, c in reversed(list(enumerate(node.get("children", ()))))]
        names = [n.get("name") for n, _, _ in order]
        ids = [int(n) for n in names] if len(set(names)) == len(names) and all(str(n).isdigit() for n in names) else list(range(len(names)))
        for i, (n, parent, ordinal) in enumerate(order):
            at = n.get("position") or {}
            yield (ids[i], None if parent is None else ids[parent], n["level"], n["header"], n["text"], n["page"], float(at.get("x", 0)), float(at.get("y", 0)), ordinal)

    return per_row(trees, body, call, NODES, doc)


def save_trees(nodes: DataFrame, doc: list[str], path: str) -> DataFrame:
    """Store the trees of documents that the folder does not hold yet, as JSON lines; returns those."""
    return append_results(stored(tree_to_json(nodes, doc), "trees"), path, doc)


def load_trees(spark: SparkSession, path: str, doc: str) -> DataFrame:
    """tree_nodes of all stored trees; ``doc`` is the keys' schema, such as ``doc_id string``. No folder: no rows."""
    schema = f"{doc}, json string"
    own = spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)
    return tree_from_json(own, own.columns[:-1])


# --- pseudonym maps --------------------------------------------------------------------------------------------------

def _versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions in the folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def save_map(pmap: DataFrame, path: str | None) -> str:
    """Write the map as the folder's next version and return its path; older ones stay. Without a path: ValueError.

    A new version counts once it is complete, so a broken run leaves the one before. The map may be of any size.
    """
    if not path:
        raise ValueError("a map needs a path to be saved to")
    target = f"{path}/version={max(_versions(pmap.sparkSession, path), default=0) + 1}"
    pmap.select(*[x.split()[0] for x in PMAP.split(", ")]).write.mode("overwrite").parquet(target)
    return target


def load_map(spark: SparkSession, path: str) -> DataFrame:
    """The folder's last complete version; an empty map if there is none."""
    found = _versions(spark, path)
    return spark.read.schema(PMAP).parquet(f"{path}/version={found[-1]}") if found else spark.createDataFrame([], PMAP)
