"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session has none and runs on one machine (tests) a temporary folder is set; on a cluster, whose
    executors would each write to their own disk, its absence is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = set_before.get() if set_before.isDefined() else None
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="docspark-")
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return where.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, on whatever file system the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


_cleaned: set[str] = set()


def own_dir(spark: SparkSession) -> str:
    """The application's own folder in the shared one, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/docspark/{spark.sparkContext.applicationId}"
    if path not in _cleaned:
        _cleaned.add(path)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())

        def clean() -> None:
            with contextlib.suppress(Exception):  # the JVM may have ended first
                files.delete(place, True)

        atexit.register(clean)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, computes once.

    The committed files outlive any executor, so a retry of later work reads them again. They stay as long as the
    application, since what is returned may be read at any time.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
