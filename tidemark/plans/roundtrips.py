"""Sources and sinks as queries: what is written in the shared folder and read back, against the tables it came from."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans import frame
from tidemark.plans.queries import _BY_CUSTOMER, _REPORT_SQL, _probe_report, _queries_by_customer, query
from tidemark.schemas import CLASSIFIED_COLUMNS, MANIFEST, PROBE_REPORT, SCRAPE_LOG, table
from tidemark.sources import json_lists, sinks, tables
from tidemark.sources.fetch import ReplayFetcher, read_or_fetch

_LISTS = table(dataType="string", id="string", body="string", depth="long")


def _lists(spark: SparkSession, sf_dir: str) -> str:
    """A JSON list for each conversation, in a file of its own, and files that are no lists: a glob of them all."""
    rows = tables.read_table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "post").otherwise("comment")
    item = F.struct(F.col("turn").alias("depth"), kind.alias("dataType"), F.concat_ws("_", "conv_id", "turn").alias("id"), F.col("text").alias("body"))
    value = F.to_json(F.sort_array(F.collect_list(item)))
    path, last = tables.scratch(spark, "lists"), F.col("conv_id") % 10
    broken = F.when(last == 0, F.substring("value", 1, 20)).when(last == 1, F.concat(F.lit('{"items": '), "value", F.lit("}"))).otherwise(F.col("value"))
    rows.groupBy("conv_id").agg(value.alias("value")).withColumn("value", broken).write.partitionBy("conv_id").text(path)
    return f"{path}/*/*"


_GOOD = "conv_id % 10 > 1"


@query(f"SELECT conv_id || '_' || turn AS id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS pos, md5(text) AS md5 FROM conversations WHERE {_GOOD}")
def tolerant_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be read of a folder in which a file in five is cut off or no list."""
    return json_lists.read_json_lists(spark, _lists(spark, sf_dir), _LISTS).select("id", "pos", F.md5("body").alias("md5"))


@query(f"SELECT conv_id || '_' || turn AS id FROM conversations WHERE {_GOOD} AND role = 'user'")
def posts_of_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_lists.post_ids(json_lists.read_json_lists(spark, _lists(spark, sf_dir), _LISTS))


@query(f"SELECT 'answers' AS arm, conv_id || '_' || turn AS \"parsedId\" FROM conversations WHERE {_GOOD} AND role = 'user'")
def baseline_of_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By arm; one arm has no pattern."""
    rows = json_lists.read_json_lists(spark, _lists(spark, sf_dir), _LISTS)
    path = tables.scratch(spark, "baseline")
    rows.groupBy("file_name").agg(F.to_json(F.collect_list(F.struct("dataType", F.col("id").alias("parsedId")))).alias("value")).select("value", F.monotonically_increasing_id().alias("n")).write.partitionBy("n").text(path)
    return json_lists.baseline_ids(spark, {"answers": f"{path}/*/*", "none": ""}, table(dataType="string", parsedId="string"))


@query("SELECT false AS read, 'not a JSON list' AS reason")
def strict_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same folder read strictly: an error."""
    try:
        json_lists.read_json_lists_strict(spark, _lists(spark, sf_dir), _LISTS)
    except ValueError as e:
        return spark.createDataFrame([(False, str(e).split(":")[0])], "read boolean, reason string")
    return spark.createDataFrame([(True, "")], "read boolean, reason string")


@query(f"""
WITH {_REPORT_SQL}
SELECT tier, subreddit, posts_found::BIGINT AS posts_found, saturated, est_collect_comments, (est_collect_posts + est_collect_comments)::BIGINT AS est_collect_items FROM report""")
def report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probe's report as CSV, with quoted terms, and back by its schema."""
    path = tables.scratch(spark, "report")
    rows = _probe_report(spark, sf_dir).withColumn("term", F.concat(F.lit('"'), "subreddit", F.lit('", a')))
    sinks.write_report(rows.select(PROBE_REPORT.names), path)
    back = tables.read_probe_report(spark, path).where(F.col("term") == F.concat(F.lit('"'), "subreddit", F.lit('", a')))
    return back.select("tier", "subreddit", "posts_found", (F.lower("saturated") == "true").alias("saturated"), "est_collect_comments", "est_collect_items")


@query("SELECT 'T' || n_regionkey AS tier, (2 * count(*))::BIGINT AS rows, round(2 * sum(n_nationkey * 0.01), 4)::DOUBLE AS spent FROM nation GROUP BY 1")
def log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended twice to a log, whose header is checked the second time."""
    path = tables.scratch(spark, "log")
    rows = tables.read_table(spark, sf_dir, "nation").select(
        F.lit("t").alias("timestamp"),
        F.concat(F.lit("T"), "n_regionkey").alias("tier"),
        F.col("n_name").alias("subreddit"),
        F.lit('"a b"').alias("term"),
        F.lit("2016-01-01").alias("start"),
        F.lit("2016-12-31").alias("end"),
        F.lit(False).alias("blocked"),
        F.col("n_nationkey").cast("long").alias("items"),
        F.lit(0).cast("long").alias("comments"),
        (F.col("n_nationkey") * 0.01).cast("double").alias("est_usd"),
    )
    for _ in range(2):
        sinks.append_log(rows, path)
    assert tables.csv_columns(spark, path) == SCRAPE_LOG.names
    return tables.read_log(spark, path).groupBy("tier").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("est_usd"), 4).alias("spent"))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return tables.read_table(spark, sf_dir, "documents").select(
        d.cast("string").alias("id"),
        F.timestamp_seconds(d * 86400).alias("created"),
        F.year(F.timestamp_seconds(d * 86400)).alias("year"),
        F.col("source").alias("subreddit"),
        F.col("text").alias("body"),
        F.upper("text").alias("clean_body"),
        F.lit("unused").alias("extra"),
    )


@query("SELECT doc_id::VARCHAR AS id, year(to_timestamp(doc_id * 86400) AT TIME ZONE 'UTC')::INT AS year, md5(text) AS body FROM documents")
def corpus_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as Parquet by year, and back; a second writing is refused."""
    path, rows = tables.scratch(spark, "corpus"), _corpus(spark, sf_dir)
    sinks.write_corpus(rows, path)
    back = spark.read.parquet(path)
    assert "extra" not in back.columns
    return back.select("id", "year", F.md5("body").alias("body"))


@query("SELECT doc_id::VARCHAR AS id, md5(text) AS body FROM documents")
def corpus_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of many lines as CSV, and back; the columns in the corpus's order."""
    path = tables.scratch(spark, "corpus-csv")
    sinks.write_corpus_csv(_corpus(spark, sf_dir), path)
    assert tables.csv_columns(spark, path) == ["id", "created", "year", "subreddit", "body", "clean_body"]
    text = T.StringType()
    schema = T.StructType([T.StructField(c, text) for c in ("id", "created", "year", "subreddit", "body", "clean_body")])
    return tables.read_csv(spark, path, schema).select("id", F.md5("body").alias("body"))


@query("SELECT 'raw items' AS stage, count(*)::BIGINT AS items FROM documents UNION ALL SELECT 'English', count(*) FILTER (lang = 'en') FROM documents")
def funnel_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.scratch(spark, "funnel")
    docs = tables.read_table(spark, sf_dir, "documents")
    one = docs.agg(F.lit(0).alias("stage_no"), F.lit("raw items").alias("stage"), F.count(F.lit(1)).alias("items"))
    two = docs.agg(F.lit(1).alias("stage_no"), F.lit("English").alias("stage"), F.count_if(F.col("lang") == "en").alias("items"))
    sinks.write_funnel(two.unionByName(one), path)
    return tables.read_csv(spark, path, table(stage="string", items="long"))


@query("SELECT conv_id || '_' || turn AS id, replace(replace(substring(text, 1, 80), chr(13), ''), chr(10), '|') AS body_preview FROM conversations")
def classified_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.scratch(spark, "classified")
    rows = tables.read_table(spark, sf_dir, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("id"), F.col("text").alias("clean_body"), F.col("role").alias("predicted_class"))
    blank = {c: F.lit("") for c in CLASSIFIED_COLUMNS if c not in ("id", "predicted_class", "body_preview")}
    sinks.write_classified(rows.withColumns(blank), path)
    back = tables.read_csv(spark, path)
    return back.select("id", F.translate(F.replace("body_preview", F.lit("\n"), F.lit("|")), "\r", "").alias("body_preview"))


@query(f"WITH {_BY_CUSTOMER} SELECT c_custkey::VARCHAR AS post_id, posts_found >= 8 AS recovery_required, CASE WHEN posts_found >= 8 THEN 'pending' ELSE 'already_present_elsewhere' END AS status FROM q")
def manifest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.scratch(spark, "manifest")
    large = F.col("posts_found") >= 8
    rows = _queries_by_customer(spark, sf_dir).select("tier", F.col("c_custkey").cast("string").alias("post_id"), large.alias("recovery_required"), (~large).alias("baseline_present_elsewhere"), F.when(large, "pending").otherwise("already_present_elsewhere").alias("status"))
    rest = {f.name: F.lit(None).cast(f.dataType) for f in MANIFEST.fields if f.name not in rows.columns}
    sinks.write_manifest(rows.withColumns(rest), path)
    return tables.read_csv(spark, path, MANIFEST).select("post_id", "recovery_required", "status")


@query("SELECT role AS job_key, count(*)::BIGINT AS items, true AS refused FROM conversations GROUP BY role")
def items_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by job, and the refusal to write them again."""
    path = tables.scratch(spark, "items")
    rows = tables.read_table(spark, sf_dir, "conversations").select(F.col("role").alias("job_key"), "conv_id", "turn")
    sinks.write_items(rows, path)
    refused = False
    try:
        sinks.write_items(rows, path)
    except Exception as e:
        refused = "already exists" in str(e).lower() or "PATH_ALREADY_EXISTS" in str(e)
    return spark.read.parquet(path).groupBy("job_key").agg(F.count(F.lit(1)).alias("items")).withColumn("refused", F.lit(refused))


@query("SELECT n_name AS subreddit, n_nationkey::BIGINT AS items FROM nation WHERE n_nationkey < 5")
def job_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with their own files, fetched by replay into a cache; other jobs have none."""
    folder, cache = tables.scratch(spark, "replay"), tables.scratch(spark, "cache")
    jobs = tables.read_table(spark, sf_dir, "nation").select(F.lit("T").alias("tier"), F.col("n_name").alias("subreddit"), F.lit("t").alias("term"), F.lit("a").alias("start"), F.lit("b").alias("end"), "n_nationkey")
    jobs = jobs.withColumn("file", frame.job_file())
    for r in jobs.where("n_nationkey < 5").collect():
        tables.write_text(spark, f"{folder}/{r['file']}", json.dumps([{"dataType": "post", "id": str(i)} for i in range(r["n_nationkey"])]))
        read_or_fetch(spark, f"{cache}/{r['file']}", ReplayFetcher(spark, folder), {"file": r["file"]})
    held = json_lists.read_jobs(spark, cache, jobs).groupBy("subreddit").agg(F.count(F.lit(1)).alias("items"))
    return jobs.where("n_nationkey < 5").select("subreddit").join(held, "subreddit", "left").na.fill(0)
