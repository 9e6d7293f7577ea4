"""From raw items to a corpus: the stages of cleaning, with a count at each.

The stages are one lazy plan. Counts are observed as rows pass, in the one action that uses the corpus; without a
funnel the observations are left out, and the optimizer may move the filters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import clean_body, strip, with_once, word_count
from tidemark.functions.values import utc_timestamp

WORD_FLOOR = 20
WINDOW_START, WINDOW_END = "2016-01-01", "2025-05-01"

# Texts of deleted bodies, names of utility accounts, tiers of communities.
DELETED = ["[deleted]", "[removed]", ""]
BOTS = ["automoderator", "autotldr", "sneakpeekbot", "remindmebot", "b0trank", "wikitextbot", "gifv-bot", "totesmessenger"]
TIER_OF = {
    "selfdrivingcars": "Tier 1",
    "teslamotors": "Tier 1",
    "realtesla": "Tier 1",
    "waymo": "Tier 1",
    "electricvehicles": "Tier 2",
    "cars": "Tier 2",
    "technology": "Tier 2",
    "futurology": "Tier 2",
    "privacy": "Tier 3",
    "cybersecurity": "Tier 3",
}


def keep_first(df: DataFrame, key: str = "id", order: tuple[str, ...] = ("file_name", "pos")) -> DataFrame:
    """The first row of each key in the order of reading. Null keys are one key.

    Each task sends its own first row of a key at most (the plan's WindowGroupLimit), so a key that a third of the rows
    share is no burden. Long keys, as texts, are best given as a hash."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def body_present(col: Column) -> Column:
    """False for a body that is gone; a deleted author's text stays."""
    return ~strip(F.coalesce(col, F.lit(""))).isin(DELETED)


def not_a_bot(name: Column, bots: list[str] | None = None) -> Column:
    """By name alone; a null name is nobody known."""
    return ~F.lower(F.coalesce(name, F.lit(""))).isin(bots or BOTS)


def in_window(ts: Column, start: str = WINDOW_START, end: str = WINDOW_END, kind: str = "timestamp") -> Column:
    """Start included, end excluded. kind is the type of ts, so that the bounds and not the column are cast."""
    return (ts >= F.lit(start).cast(kind)) & (ts < F.lit(end).cast(kind))


def tier_of(community: Column, tiers: dict[str, str] | None = None) -> Column:
    pairs = [F.lit(x) for kv in (tiers or TIER_OF).items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(F.coalesce(community, F.lit("")))), F.lit("untiered"))


class Funnel:
    """Counts of rows by stage, filled by the action that runs the plan."""

    def __init__(self) -> None:
        self.stages: list[tuple[str, Observation]] = []

    def watch(self, df: DataFrame, stage: str) -> DataFrame:
        seen = Observation(f"stage-{len(self.stages)}-{id(self)}")
        self.stages.append((stage, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("items"))

    def table(self, spark: SparkSession) -> DataFrame:
        """(stage_no, stage, items); waits for the action."""
        rows = [(i, stage, int(seen.get["items"])) for i, (stage, seen) in enumerate(self.stages)]
        return spark.createDataFrame(rows, "stage_no int, stage string, items long")


def _step(funnel: Funnel | None) -> Callable[[DataFrame, str], DataFrame]:
    return funnel.watch if funnel else lambda df, stage: df


def corpus(items: DataFrame, is_english: Callable[[Column], Column], funnel: Funnel | None = None, window: bool = True, floor: int = WORD_FLOOR) -> DataFrame:
    """Raw items (with file_name and pos) to the corpus: dedup, deletions, bots, times, window, cleaning, floor, language.

    The cheap filters stand before the language detector, as filters, so that it sees what they leave."""
    see = _step(funnel)
    df = see(items, "raw items")
    df = see(df.where("dataType = 'comment'"), "comments")
    df = see(keep_first(df), "after dedup")
    df = see(df.where(body_present(F.col("body"))), "after body-deleted removed")
    df = see(df.where(not_a_bot(F.col("authorName"))), "after bot filter")
    df = df.withColumn("created", utc_timestamp(F.col("commentCreatedAt"))).where("created IS NOT NULL")
    df = see(df, "after timestamp parse")
    if window:
        df = see(df.where(in_window(F.col("created"))), "after study window")
    df = with_once(df, clean_body=clean_body(F.col("body")))
    df = df.withColumn("clean_wordcount", word_count(F.col("clean_body"))).where(F.col("clean_wordcount") >= floor)
    df = see(df, f"after >= {floor}-word floor")
    df = see(df.where(is_english(F.col("clean_body"))), "after English filter")
    return df.withColumnRenamed("subredditName", "subreddit").withColumn("tier", tier_of(F.col("subreddit"))).withColumn("year", F.year("created"))


def skeleton_corpus(items: DataFrame, is_english: Callable[[Column], Column], funnel: Funnel | None = None, floor: int = WORD_FLOOR) -> DataFrame:
    """The other order: deletions before dedup, language before the floor. A later copy of a deleted first one stays."""
    see = _step(funnel)
    df = see(items, "raw items")
    df = see(df.where("dataType = 'comment'"), "comments")
    df = see(df.where(body_present(F.col("body"))), "after body-deleted removed")
    df = see(df.where(not_a_bot(F.col("authorName"))), "after bot filter")
    df = with_once(df, clean_body=clean_body(F.col("body")))
    df = see(df.where(is_english(F.col("clean_body"))), "after English filter")
    df = df.withColumn("clean_wordcount", word_count(F.col("clean_body"))).where(F.col("clean_wordcount") >= floor)
    df = see(df, f"after >= {floor}-word floor")
    df = see(keep_first(df), "after dedup")
    return df.withColumn("created", utc_timestamp(F.col("commentCreatedAt"))).where("created IS NOT NULL")


def value_counts(df: DataFrame, col: str, by_value: bool = False) -> DataFrame:
    """Rows by value: most first, or by value."""
    counted = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(col) if by_value else counted.orderBy(F.desc("n"), col)
