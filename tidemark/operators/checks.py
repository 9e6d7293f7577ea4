"""Data-quality checks as rows: (check, ok, detail). Those that must hold stop the run through require()."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def check(df: DataFrame, name: str, ok: Column, detail: Column | str = "") -> DataFrame:
    """One row out of an aggregate that is true or false."""
    return df.agg(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"), (F.lit(detail) if isinstance(detail, str) else detail).cast("string").alias("detail"))


def row_count(df: DataFrame, name: str, expected: int) -> DataFrame:
    return check(df, name, F.count(F.lit(1)) == expected, F.count(F.lit(1)))


def unique(df: DataFrame, name: str, col: str) -> DataFrame:
    return check(df, name, F.count(col) == F.countDistinct(col), F.count(col) - F.countDistinct(col))


def no_nulls(df: DataFrame, name: str, col: str) -> DataFrame:
    return check(df, name, F.count_if(F.col(col).isNull()) == 0, F.count_if(F.col(col).isNull()))


def holds(df: DataFrame, name: str, condition: Column) -> DataFrame:
    """For every row; a null counts as a breach. An empty table holds."""
    breaches = F.count_if(~F.coalesce(condition, F.lit(False)))
    return check(df, name, breaches == 0, breaches)


def has_columns(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    lacking = [c for c in columns if c not in df.columns]
    return df.sparkSession.createDataFrame([(name, not lacking, ", ".join(lacking))], "check string, ok boolean, detail string")


def referenced(df: DataFrame, name: str, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Every key is among the other table's."""
    lost = df.join(other.select(F.col(other_key).alias("__k")).distinct(), df[key] == F.col("__k"), "left_anti")
    return check(lost, name, F.count(F.lit(1)) == 0, F.count(F.lit(1)))


def matches(rows: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """By wanted key the number of rows that have it, and whether it is just one."""
    found = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    out = wanted.select(*key).distinct().join(found, key, "left").withColumn("n", F.coalesce("__n", F.lit(0)))
    return out.select(*key, "n", (F.col("n") == 1).alias("ok"))


def exactly_one(rows: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """The row of each wanted key; stops where a key has none or several."""
    bad = matches(rows, wanted, key).where("NOT ok").limit(10).collect()
    if bad:
        raise ValueError("; ".join(f"{', '.join(str(r[c]) for c in key)}: {r['n']} rows, not 1" for r in bad))
    return rows.join(wanted.select(*key).distinct(), key, "left_semi")


def agreeing(stated: DataFrame, counted: DataFrame, name: str, key: list[str], stated_col: str, counted_col: str) -> DataFrame:
    """What a report states of each key must be what its file holds; a key without a file holds nothing."""
    both = stated.select(*key, F.col(stated_col).alias("__a")).join(counted.select(*key, F.col(counted_col).alias("__b")), key, "left")
    differ = F.count_if(~F.coalesce("__b", F.lit(0)).eqNullSafe(F.col("__a")))
    return check(both, name, differ == 0, differ)


def apart(one: DataFrame, other: DataFrame, name: str, col: str) -> DataFrame:
    """No value is in both tables, as paths to be written and paths that are read."""
    both = one.select(col).distinct().join(other.select(col).distinct(), col, "left_semi")
    return check(both, name, F.count(F.lit(1)) == 0, F.count(F.lit(1)))


def at_least(spark: SparkSession, name: str, value: float, least: float) -> DataFrame:
    """An invariant of settings, as that a collection cap isn't below the probe's."""
    return spark.createDataFrame([(name, value >= least, f"{value} of {least}")], "check string, ok boolean, detail string")


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def require(checks: DataFrame) -> None:
    """Stop on the first breaches. A report has a row a check."""
    bad = checks.where("NOT ok").limit(10).collect()
    if bad:
        raise ValueError("; ".join(f"{r['check']}: {r['detail']}" for r in bad))
