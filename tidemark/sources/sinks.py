"""Writers: corpus, funnel, reports, log, manifest, classified rows, raw job results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import preview
from tidemark.schemas import BANNED_COLUMNS, CLASSIFIED_COLUMNS, CORPUS_COLUMNS, MANIFEST, SCRAPE_LOG
from tidemark.sources.tables import check_columns, exists

#: Blanks at the ends of a value are part of it; the writer would drop them.
_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def assert_deidentified(df: DataFrame) -> DataFrame:
    leaks = [c for c in BANNED_COLUMNS if c in df.columns]
    if leaks:
        raise ValueError(f"columns that identify authors: {', '.join(leaks)}")
    return df


def corpus_columns(df: DataFrame) -> DataFrame:
    """Those of the corpus's columns that there are, in order."""
    return assert_deidentified(df.select([c for c in CORPUS_COLUMNS if c in df.columns]))


def write_corpus(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet by year, so that a span of years reads its own folders only."""
    corpus_columns(df).write.mode(mode).partitionBy("year").parquet(path)


def write_corpus_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    corpus_columns(df).write.mode(mode).options(**_CSV, quoteAll=True).csv(path)


def write_funnel(funnel: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A row a stage: few enough for one file."""
    funnel.orderBy("stage_no").select("stage", "items").coalesce(1).write.mode(mode).options(**_CSV).csv(path)


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A row a query, sorted, in one file."""
    report.orderBy("tier", "subreddit", "term").coalesce(1).write.mode(mode).options(**_CSV).csv(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Rows after those there are; a log with other columns is refused."""
    if exists(rows.sparkSession, path):
        check_columns(rows.sparkSession, path)
    rows.select(SCRAPE_LOG.names).write.mode("append").options(**_CSV).csv(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.select(MANIFEST.names).coalesce(1).write.mode("overwrite").options(**_CSV).csv(path)


def write_classified(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows = df.withColumn("body_preview", preview(F.col("clean_body"))).select(CLASSIFIED_COLUMNS)
    assert_deidentified(rows).write.mode(mode).options(**_CSV).csv(path)


def write_items(items: DataFrame, path: str) -> None:
    """The items of jobs, by job; what is there already is never overwritten."""
    items.write.mode("errorifexists").partitionBy("job_key").parquet(path)
