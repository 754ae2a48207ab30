"""The stages of the corpus pipeline in a row, and the registered queries."""

import random

import __spark_entry__
import corpus_pipeline as p
from pyspark.sql import functions as F

from docspark.llm import mixing, quality, simhash

SF = "/root/testdata/sf0.001"


def test_stages_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = p.filter_quality(spark, docs, SF).persist()
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert first.count() == quality.score_documents(docs, model, score="s").where("s >= 0.3").count() > 0.7 * docs.count()
    second = p.dedup_lines(spark, first, SF).persist()
    assert second.columns == p.COLUMNS and second.count() == first.count()
    third = p.dedup_documents(spark, second, SF).persist()
    groups = simhash.near_duplicates(second).select("component_id").distinct()
    assert third.count() == groups.count() == third.select("doc_id").distinct().count()
    fourth = p.mix_sources(spark, third, SF).persist()
    most = fourth.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert fourth.columns == p.COLUMNS and most <= 2
    words = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0]
    assert abs(words(fourth) / words(third) - 1.5) < 0.3
    last = p.pack(spark, fourth, SF)
    assert last.select("doc_id").distinct().count() == fourth.select("doc_id").distinct().count()


def words_of(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))


def test_documents_without_own_ids_stay(spark):
    texts = [(None, words_of(1, 40)), (None, words_of(2, 50)), (None, words_of(3, 60)), (7, words_of(4, 40)), (7, words_of(5, 40)), (8, words_of(6, 400)), (9, words_of(6, 400))]
    again = [(None, words_of(1, 40)), (7, words_of(4, 40)), (None, words_of(6, 400)), (5, words_of(5, 40))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts + again], "doc_id long, text string, lang string, source string, n_chars long")
    kept = p.dedup_documents(spark, docs, SF).persist()
    # unrelated texts stay, near ones go: the smallest id of each, null only if there is no other
    want = [(None, words_of(1, 40)), (None, words_of(2, 50)), (None, words_of(3, 60)), (7, words_of(4, 40)), (5, words_of(5, 40)), (8, words_of(6, 400))]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert kept.columns == p.COLUMNS


def test_mix_counts_rows_of_one_id_apart(spark):
    texts = [words_of(i, 30) for i in range(60)]
    data = [(None if i % 2 else 7, t, "en", "ab"[i % 3 == 0], len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    parts = mixing.mix_sources(docs)
    opens = mixing.taken_words(*parts).agg(F.sum("opens")).first()[0]
    got = p.mix_sources(spark, docs, SF)
    assert got.count() == opens and abs(opens - 90) <= 2  # a document more where a source ends within one
    assert got.groupBy("text").count().agg(F.max("count")).first()[0] <= 2


def test_stages_take_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert [n for n, _ in p.STAGES] and set(__spark_entry__.oracle_sql()) <= set(names)
