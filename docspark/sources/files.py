"""Files in and out: whole texts, CSV, JSON, images and PDF bytes, manifests, resumable results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.functions.text import stem, suffix
from docspark.storage import exists, stored

MANIFEST = "file_name string, id string, title string, icon string, page_from int, page_to int, detect_columns boolean, color_headers boolean, header double, footer double"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), one row per file; bytes that are no UTF-8 become replacement characters."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.make_valid_utf8(F.col("content").cast("string"))).alias("text"))


def write_texts(docs: DataFrame, path: str, text: str = "text", by: list[str] | None = None) -> None:
    """One line-oriented text per row, in folders by the columns of ``by``."""
    w = docs.select(*(by or []), F.col(text).alias("value")).write.mode("overwrite")
    (w.partitionBy(*by) if by else w).text(path)


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """All columns as strings, quoted fields over lines allowed, ragged rows padded with nulls; unknown columns are an error."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE")
    df = (r.schema(schema) if schema else r).csv(path)
    if unknown := [c for c in columns or [] if c not in df.columns]:
        raise ValueError(f"no such columns: {unknown}; there are {df.columns}")
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quote", '"').option("lineSep", "\n").csv(path)


def parse_cells(df: DataFrame, line: str, n: int) -> DataFrame:
    """array<string> of n cells parsed from a CSV line column."""
    fields = ", ".join(f"c{i} string" for i in range(n))
    return df.withColumn("cells", F.array(*[F.from_csv(line, fields)[f"c{i}"] for i in range(n)]))


def read_binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length, content): images or PDFs, for a page renderer or OCR plug-in."""
    r = spark.read.format("binaryFile")
    return (r.option("pathGlobFilter", glob) if glob else r).load(path).select("path", "length", "content")


def number_files(files: DataFrame) -> DataFrame:
    """Files (path) with ids d01, d02, ... by name without regard to case; wider ids for more than 99. One window over the listing."""
    name = F.lower(F.regexp_replace("path", "^.*/", ""))
    n = F.row_number().over(Window.orderBy(name, "path"))
    return files.withColumn("id", F.concat(F.lit("d"), F.lpad(n.cast("string"), F.greatest(F.lit(2), F.length(n.cast("string"))), F.lit("0"))))


def page_name(doc_id, page):
    """d01.p1.png"""
    return F.format_string("%s.p%d.png", doc_id, page)


def map_path(path):
    """The path of a document's own pseudonym map."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(".pii_map.json"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Document manifest as JSON lines or arrays, of a fixed schema."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def list_documents(manifest: DataFrame) -> DataFrame:
    return manifest.select("id", "file_name", "title").orderBy("title", "id")


def with_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files joined with their manifest rows by file name."""
    return files.withColumn("file_name", F.regexp_replace("path", "^.*/", "")).join(manifest, "file_name")


def is_fixed_column(path):
    """Pages of such documents are set in columns of fixed width."""
    return (suffix(path) == ".csv") | F.startswith(stem(path), F.lit("legacy"))


def append_results(results: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append rows whose keys are not stored yet, as JSON lines; returns those rows."""
    spark = results.sparkSession
    new = results
    if exists(spark, path):
        done = spark.read.schema(results.schema).json(path).select(*keys).distinct()
        new = stored(results.join(done, keys, "left_anti"), "results")
    new.write.mode("append").json(path)
    return new


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Corpus truth ({seed, docs: [{file, kind, entities}]}) as rows (seed, file, kind, entity columns)."""
    entity = "type string, value string, strip_expected boolean, evidence string, critical boolean, start int, end int, `row` int, col int"
    schema = f"seed long, docs array<struct<file:string,kind:string,entities:array<struct<{entity.replace(' ', ':').replace(',:', ',')}>>>>"
    docs = spark.read.schema(schema).option("multiLine", True).json(path).select("seed", F.explode("docs").alias("d"))
    return docs.select("seed", "d.file", "d.kind", F.explode("d.entities").alias("e")).select("seed", "file", "kind", "e.*")
