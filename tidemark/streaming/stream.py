"""The corpus as a stream: new files of items, dedup within a watermark, counts by window.

Which copy of an id arrives first depends on arrival, so the batch pipeline remains the measure of keep-first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.values import utc_timestamp
from tidemark.operators.funnel import body_present, not_a_bot, tier_of
from tidemark.schemas import RAW


def stream_items(spark: SparkSession, folder: str, schema: T.StructType = RAW, files_at_once: int = 100) -> DataFrame:
    """Items as they land: JSON lists (or one item a line) in new files."""
    return spark.readStream.schema(schema).option("multiLine", True).option("maxFilesPerTrigger", files_at_once).json(folder)


def first_seen(items: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Comments with a time and a body, each id once within the watermark. A bare time or year is no date: it would come
    out as today, and carry the watermark past good rows."""
    rows = items.where("dataType = 'comment'").withColumn("created", utc_timestamp(F.col("commentCreatedAt"))).where("created IS NOT NULL")
    rows = rows.where(body_present(F.col("body")) & not_a_bot(F.col("authorName")))
    return rows.withWatermark("created", lateness).dropDuplicatesWithinWatermark(["id"])


def window_counts(rows: DataFrame, width: str = "1 day") -> DataFrame:
    """Comments by window and tier; a window is final once the watermark has passed it."""
    grouped = rows.groupBy(F.window("created", width), tier_of(F.col("subredditName")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "tier", "n")


def write(rows: DataFrame, path: str, checkpoint: str, trigger_once: bool = False) -> StreamingQuery:
    """Exactly-once Parquet: restarts go on from the checkpoint."""
    writer = rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if trigger_once else writer).start()
