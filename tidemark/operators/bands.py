"""Truncation bands of a probe report: which queries a collection cap would cut, and what the remedies cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import cost
from tidemark.plans.frame import COMMENTS_A_POST, POSTS_PER_BLOCK


def in_band(report: DataFrame, lo: int, hi: int) -> DataFrame:
    """Queries with lo <= posts_found < hi, most posts first, with what the cap drops."""
    return report.where(F.col("posts_found").between(lo, hi - 1)).withColumn("dropped", F.col("posts_found") - lo).orderBy(F.desc("posts_found"))


def with_band(report: DataFrame, lo: int, hi: int) -> DataFrame:
    n = F.col("posts_found")
    return report.withColumn("band", F.when(n < lo, "under").when(n < hi, "truncated").otherwise("saturated"))


def crosstab(report: DataFrame, lo: int, hi: int) -> DataFrame:
    """Queries by tier and band."""
    return with_band(report, lo, hi).groupBy("tier").pivot("band", ["under", "truncated", "saturated"]).count().na.fill(0)


def collected(band: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Whether a query of the band has been collected already."""
    marks = done.select(*key).distinct().withColumn("already_collected", F.lit(True))
    return band.join(marks, key, "left").na.fill(False, ["already_collected"])


def remedies(band: DataFrame, lo: int, hi: int, n_blocks: int) -> DataFrame:
    """One row: posts and cost now, with the higher cap, and with blocks."""
    n = F.col("posts_found")
    of = lambda cap: F.sum(cost(F.least(n, F.lit(cap)) * (1 + COMMENTS_A_POST)))
    each = POSTS_PER_BLOCK * n_blocks
    return band.agg(
        F.sum(F.least(n, F.lit(lo))).alias("posts_now"),
        of(lo).alias("usd_now"),
        F.sum(F.least(n, F.lit(hi))).alias("posts_census"),
        of(hi).alias("usd_census"),
        (F.count(F.lit(1)) * each).alias("posts_blocked"),
        (F.count(F.lit(1)) * cost(F.lit(each * (1 + COMMENTS_A_POST)), n_blocks)).alias("usd_blocked"),
    )
