"""Folders of JSON lists of posts and comments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schemas import RAW


def _files(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: its name and text. A glob or folder is read without descending."""
    glob = path if path.endswith(".json") or "*" in path else f"{path.rstrip('/')}/*.json"
    found = spark.read.text(glob, wholetext=True)
    return found.select(F.col("_metadata.file_name").alias("file_name"), F.col("value"))


def _parsed(schema: T.StructType) -> Column:
    """The list, or null for a text that isn't a JSON list."""
    is_list = F.ltrim(F.regexp_replace("value", "^﻿?[\t-\r ]+", "")).startswith("[")
    return F.when(is_list & F.try_parse_json("value").isNotNull(), F.from_json("value", T.ArrayType(schema)))


def read_json_lists(spark: SparkSession, path: str, schema: T.StructType = RAW, exclude_suffix: str | None = None) -> DataFrame:
    """All items with file_name and pos, whose order is the order of reading. Unreadable files and non-lists are left out."""
    files = _files(spark, path)
    if exclude_suffix:
        files = files.where(~F.col("file_name").endswith(exclude_suffix))
    items = files.select("file_name", F.posexplode(_parsed(schema)).alias("pos", "item"))
    return items.where("item IS NOT NULL").select("file_name", "pos", "item.*")


def read_json_lists_strict(spark: SparkSession, path: str, schema: T.StructType = RAW) -> DataFrame:
    """The same, but a file that can't be read as a list is an error; a path without files is one too."""
    bad = _files(spark, path).where(_parsed(schema).isNull()).select("file_name").limit(5).collect()
    if bad:
        raise ValueError(f"not a JSON list: {', '.join(r[0] for r in bad)}")
    return read_json_lists(spark, path, schema)


def posts(items: DataFrame, any_case: bool = False) -> DataFrame:
    kind = F.lower("dataType") if any_case else F.col("dataType")
    return items.where(kind == "post")


def comments(items: DataFrame, any_case: bool = False) -> DataFrame:
    kind = F.lower("dataType") if any_case else F.col("dataType")
    return items.where(kind == "comment")


def read_jobs(spark: SparkSession, folder: str, jobs: DataFrame, file_col: str = "file", schema: T.StructType = RAW) -> DataFrame:
    """The items of the jobs' own files, each with its job's columns; jobs without a readable file have none."""
    items = read_json_lists(spark, folder, schema)
    return jobs.join(items, jobs[file_col] == items["file_name"]).drop("file_name")


def count_comments(items: DataFrame, by: list[str] | None = None, any_case: bool = False) -> DataFrame:
    """By group (or over all) the number of items and of comments among them, as a log row has them."""
    kind = F.lower("dataType") if any_case else F.col("dataType")
    return items.groupBy(*by or []).agg(F.count(F.lit(1)).alias("items"), F.count_if(kind == "comment").alias("comments"))


def baseline_ids(spark: SparkSession, globs: dict[str, str], schema: T.StructType = RAW) -> DataFrame:
    """(arm, parsedId): the distinct ids of posts in the files that an arm's pattern names; an arm without one has none."""
    held = [posts(read_json_lists(spark, glob, schema)).select(F.lit(arm).alias("arm"), "parsedId") for arm, glob in globs.items() if glob]
    rows = reduce(DataFrame.unionByName, held, spark.createDataFrame([], "arm string, parsedId string"))
    return rows.where(F.coalesce(F.col("parsedId"), F.lit("")) != "").distinct()


def post_ids(items: DataFrame, id_col: str = "id") -> DataFrame:
    """Distinct ids of posts; null and empty ids left out."""
    return posts(items, any_case=True).where(F.coalesce(F.col(id_col), F.lit("")) != "").select(F.col(id_col).alias("id")).distinct()
