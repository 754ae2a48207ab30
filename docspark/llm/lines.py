"""Line dedup: lines that many documents share go, all but the copies in the largest doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import SPACE, lower_ascii, table

MIN_CHARS, MIN_DOCS = 20, 3


def line_key(line: Column) -> Column:
    """Stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def _hashes(key: Column) -> list[Column]:
    """128 bits: two XXH64 of different seeds, as 64 bits would collide among the lines of a large corpus."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("\x01"), key).alias("h2")]


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Drop lines whose key (line_key) has min_chars code points and is found in min_docs documents, save in the largest doc_id.

    Returns doc_id, text (the lines kept, joined by newlines), n_lines, n_dropped and the columns named in ``keep``,
    one row per input row; other input columns are not read, so their names cannot clash.

    Null or empty text: one empty line, never dropped unless min_chars is 0. Rows of one doc_id count as one document;
    rows whose doc_id is null count together as one document that is smaller than any. Every copy of a line within the
    largest doc_id stays. A document whose lines all go keeps its row with an empty text. An empty table gives an empty
    result.

    Only hashes are exploded and shuffled, never lines; the counts combine before their shuffle; the join that finds
    the lines to drop is a plain equi-join, which adaptive execution splits where a line is hot. Texts move once, to
    meet their own list of dropped positions; no group larger than one document is ever gathered.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct(*[F.col(c) for c in keep] or [F.lit(None)]).alias("row"))
    base = base.withColumn("th", F.xxhash64("text"))
    numbered = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("pos"), line_key(line).alias("key")))
    long_lines = F.filter(numbered, lambda x: F.length(x["key"]) >= min_chars)
    lines = base.select("doc_id", "th", F.explode(F.transform(long_lines, lambda x: F.struct(x["pos"].alias("pos"), *_hashes(x["key"])))).alias("x")).select("doc_id", "th", "x.*")
    shared = (
        lines.groupBy("h1", "h2")
        .agg((F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    drops = lines.join(shared, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy("doc_id", "th").agg(F.collect_set("pos").alias("drop"))
    left, right = base.alias("a"), drops.alias("b")
    out = left.join(right, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th")), "left").select("a.doc_id", "a.text", "a.row", "b.drop")
    out = out.withColumn("lines", F.split("text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop")
    kept = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return out.select("doc_id", kept.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), *[F.col(f"row.{c}") for c in keep])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


LINES_SQL = r"""
d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {docs}),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos, len(ls) AS n FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM k LEFT JOIN s ON k.key = s.key)
"""

SQL = f"""WITH {LINES_SQL.format(docs="documents")}
SELECT doc_id, max(n)::BIGINT AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
