"""The volume probe: a row a query, with what collecting it would cost, and the reports on those rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import cost, date_text, to_aud
from tidemark.plans.frame import BUDGET_USD, COLLECT_POSTS, COMMENTS_PER_POST, POSTS_PER_BLOCK, PROBE_POSTS


def summarise(jobs: DataFrame, posts: DataFrame, key: list[str], n_blocks: int, blocking: bool = True) -> DataFrame:
    """jobs, each with the sums of its posts (key, createdAt, commentsCount). A job without posts keeps its row."""
    count = F.coalesce(F.col("commentsCount"), F.lit(0))
    made = F.expr("nullif(createdAt, '')")
    sums = posts.groupBy(*key).agg(
        F.count(F.lit(1)).alias("posts_found"),
        F.min(made).alias("first_made"),
        F.max(made).alias("last_made"),
        F.sum(count).alias("comments_available"),
        F.avg(F.least(count, F.lit(COMMENTS_PER_POST))).alias("stored_per_post"),
    )
    rows = jobs.join(sums, key, "left")
    zero = {"posts_found": 0, "comments_available": 0, "stored_per_post": 0.0}
    rows = rows.na.fill(zero)
    saturated = F.col("posts_found") >= PROBE_POSTS
    blocked = saturated & F.lit(blocking)
    rows = rows.select(
        *[c for c in jobs.columns],
        "posts_found",
        saturated.alias("saturated"),
        blocked.alias("will_block"),
        F.coalesce(date_text(F.col("first_made")), F.lit("")).alias("earliest_post"),
        F.coalesce(date_text(F.col("last_made")), F.lit("")).alias("latest_post"),
        "comments_available",
        "stored_per_post",
        F.when(blocked, n_blocks).otherwise(1).alias("est_runs"),
        F.when(blocked, POSTS_PER_BLOCK * n_blocks).otherwise(F.least("posts_found", F.lit(COLLECT_POSTS))).alias("est_collect_posts"),
    )
    rows = rows.withColumn("est_collect_comments", F.bround(F.col("est_collect_posts") * F.col("stored_per_post"), 0).cast("long"))
    rows = rows.withColumn("est_collect_items", F.col("est_collect_posts") + F.col("est_collect_comments"))
    return rows.withColumn("est_collect_usd", cost(F.col("est_collect_items"), F.col("est_runs")))


def tier_totals(report: DataFrame) -> DataFrame:
    return report.groupBy("tier").agg(F.sum("posts_found").alias("posts_found"), F.sum("est_collect_usd").alias("est_collect_usd"))


def grand_total(report: DataFrame, cap: float = BUDGET_USD) -> DataFrame:
    """One row: runs, posts, comments, cost in both currencies, and the cost as a multiple of the cap."""
    total = report.agg(F.sum("est_runs").alias("runs"), F.sum("est_collect_posts").alias("posts"), F.sum("est_collect_comments").alias("comments"), F.sum("est_collect_usd").alias("usd"))
    return total.withColumn("aud", to_aud(F.col("usd"))).withColumn("over_cap", F.col("usd") > cap).withColumn("times_cap", F.col("usd") / cap)


def earliest_by_community(report: DataFrame) -> DataFrame:
    return report.where("earliest_post <> ''").groupBy("subreddit").agg(F.min("earliest_post").alias("earliest_post"))


def empty_queries(report: DataFrame) -> DataFrame:
    """Queries that found nothing stay in the report: absence is a result."""
    return report.where("posts_found = 0")


def block_split(report: DataFrame) -> DataFrame:
    return report.agg(F.count_if("will_block").alias("blocked"), F.count_if(~F.col("will_block")).alias("single"))


def earliest_held(posts: DataFrame, key: list[str]) -> DataFrame:
    """By key the earliest date held, and the number of dates that can't be read (a caller stops on any)."""
    made = F.when(F.col("createdAt").rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp("createdAt"))
    return posts.groupBy(*key).agg(F.date_format(F.min(made), "yyyy-MM-dd").alias("earliest"), F.count_if(made.isNull()).alias("unreadable"))


def thread_check(comments: DataFrame, most: int = COMMENTS_PER_POST, post_col: str = "parsedPostId") -> DataFrame:
    """One row: the largest number of comments stored of a post, and whether the cap holds."""
    per = comments.groupBy(post_col).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.max("n").alias("most"), F.count_if(F.col("n") > most).alias("over"))
