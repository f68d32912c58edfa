"""The folder that driver and executors share, and small files in it by Hadoop's own client."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; without one, a temporary folder, for a local master only."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new folder below the shared one; it goes at the end of the program."""
    path = f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    atexit.register(_quiet_remove, spark, path)
    return path


def _quiet_remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        remove(spark, path)


def _at(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return bool(fs.exists(where))


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if it does not exist."""
    fs, where = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with one line if there is none of its name: True for the one caller that made it. (A name node decides this in one step; a local disk nearly so.)"""
    fs, where = _at(spark, path)
    if fs.exists(where):
        return False
    try:
        out = fs.create(where, False)
    except PySparkException:  # another was faster; what is not that shows when the name is still free
        if fs.exists(where):
            return False
        raise
    try:
        out.write(bytearray(f"{text}\n".encode()))
    finally:
        out.close()
    return True


def line(spark: SparkSession, path: str) -> str | None:
    """The line of a file; None if its writer has not ended it."""
    fs, where = _at(spark, path)
    source = fs.open(where)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()
    return text[:-1] if text.endswith("\n") else None


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder as Parquet and read back: it is made once, and a lost executor costs nothing before it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
