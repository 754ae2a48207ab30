"""Bounded samples of labelled documents, and the folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


#: Bytes of text of a class in a sample.
SAMPLE_BYTES = 16 << 20


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int = SAMPLE_BYTES, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, tuple[int, int]]:
    """(doc_id, text, label) of at most per_class documents of each class, and how many labels of class 0 and 1 there are.

    Only rows outside the held-out fold whose label is 0 or 1 count; an id labelled more than once has its highest
    label. Those of smallest id hash are taken, the same in every run. The chosen ids, at most 2 * per_class, are what
    is broadcast. Of repeated rows of one id the smallest text stands. Texts are whole; in the order of the hashes those
    of a class count that hold max_bytes together, and one of over an eighth of that is passed over.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("label = 0").orderBy(*order).limit(per_class).unionByName(known.where("label = 1").orderBy(*order).limit(per_class))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sample = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    size = F.octet_length("text")
    total = F.sum(size).over(Window.partitionBy("label").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sample = sample.where(size <= max_bytes // 8).withColumn("total", total).where(F.col("total") <= max_bytes)
    return sample.select("doc_id", "text", "label"), (counts.get(0, 0), counts.get(1, 0))
