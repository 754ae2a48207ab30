"""Helpers shared by the training-data operators: tables and prefix sums; stored comes from docspark.storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.storage import stored

__all__ = ["LOWER", "SPACE", "UPPER", "lower_ascii", "running_total", "stored", "table"]

#: The characters of ``[\x20\x09-\x0D]``.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def running_total(df: DataFrame, group: list[str], chunk: str, order: list[str], weight: str, total: str, rank: str) -> DataFrame:
    """Exclusive running sum of ``weight`` within ``group``, ordered by (chunk, order), without one task per group.

    ``chunk`` cuts each group into ordered ranges of bounded size; sums per chunk are added up in a window over
    one row per chunk, and rows are ordered only within their chunk. ``rank`` numbers the rows of a chunk from 1.
    group and chunk must not be null. Adds the columns ``total`` and ``rank``.
    """
    keys = [*group, chunk]
    before = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*keys).agg(F.sum(weight).alias("__sum")).select(*keys, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.join(offsets, keys)
        .withColumn(total, F.col("__offset") + F.coalesce(F.sum(weight).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn(rank, F.row_number().over(within))
        .drop("__offset")
    )
