"""The corpus pipeline: quality filter, line dedup, near-duplicate removal, source mix, packing.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns a DataFrame. All but
the last return the columns of ``documents`` (doc_id, text, lang, source, n_chars).

In every stage rows are documents, also where doc_id is null or repeated or whole rows are; a null text is an empty one;
a null source is a source of its own; other columns, whatever their names, are dropped. An empty table gives an empty one.
Ties are broken by id and then by a hash of the text, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import lines, mixing, packing, quality, simhash
from docspark.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REJECT_BELOW = 0.3


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels of ``docs``' own rows, does not reject.

    Labels of held-out ids are not learnt; without labels of both kinds nothing is rejected. A null text is rejected or
    kept as an empty one, and stays null.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs.select(*COLUMNS), model, score="quality_score").where(F.col("quality_score") >= REJECT_BELOW).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share; n_chars follows the text.

    A document whose lines all go stays, with an empty text. Rows of one id count as one document, those without as one too.
    """
    out = lines.dedup_lines(docs, keep=("lang", "source"))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the group's smallest id (null only if all are null).

    Groups are told apart by their root fingerprint, so documents that share an id, or have none, stay if their texts
    are not near. Of several texts with the smallest id one is kept, of repeated rows of it one.
    """
    hashed = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    groups = simhash.near_duplicates(hashed, keep=("th",), root=True)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", F.col("doc_id").alias("id")).agg(F.min("th").alias("h"))
    met = hashed.join(first, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("h")))
    return met.dropDuplicates(["root"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix's slots reach its first word: not at all, once or more.

    Documents stay whole, and a source's words come near its target; documents without words stay as they are.
    """
    numbered = stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "mixed")  # ids may be null or repeated
    taken = mixing.taken_words(*mixing.mix_sources(numbered, keep=("row",)), keep=("row",))
    times = taken.select("row", F.when(F.col("size") == 0, 1).otherwise(F.col("opens")).cast("int").alias("times"))
    met = numbered.join(times, "row").where("times > 0")
    return met.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of at most 4096 tokens; a document that the mix repeats is packed again."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", filter_quality),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_documents),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: The classifier and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
