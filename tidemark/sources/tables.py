"""CSV reports and logs, Parquet tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.schemas import PROBE_REPORT, SCRAPE_LOG

_CSV = {"header": True, "escape": '"', "multiLine": True}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Quotes are doubled, values may span lines, a byte-order mark is skipped."""
    reader = spark.read.options(**_CSV)
    return (reader.schema(schema) if schema else reader).csv(path)


def _at(spark: SparkSession, path: str):
    """A path and its filesystem: the one that Spark reads it with."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """One small file, written aside and renamed, so that a reader never sees a part of it."""
    at, fs = _at(spark, path)
    if fs.exists(at) and not overwrite:
        raise FileExistsError(path)
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    if fs.exists(at):
        fs.delete(at, False)
    fs.rename(part, at)


def read_text(spark: SparkSession, path: str) -> str:
    """One small file, whole."""
    return spark.read.text(path, wholetext=True).first()[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; in local mode one is made if none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        found = spark.sparkContext.getCheckpointDir()
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_probe_report(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, PROBE_REPORT)


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """The header, in order."""
    return read_csv(spark, path).columns


def check_columns(spark: SparkSession, path: str, expected: list[str] | None = None) -> None:
    """The header must equal the expected names in order."""
    want, got = expected or SCRAPE_LOG.names, csv_columns(spark, path)
    if got != want:
        raise ValueError(f"columns {got} of {path} are not {want}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The audit log; empty where there is none."""
    return read_csv(spark, path, SCRAPE_LOG) if exists(spark, path) else spark.createDataFrame([], SCRAPE_LOG)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
