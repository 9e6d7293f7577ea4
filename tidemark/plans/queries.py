"""The engine's queries on the driver's tables, and the same in SQL.

The tables stand in for the engine's own: documents for comments (source for community, lang for language), labels
for concern, events for timed items, conversations for threads, orders for jobs and posts, customer and nation for
the frame. Each query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import WS, clean_body, html_unescape, norm, preview, slug, with_once, word_count
from tidemark.functions.values import month_of
from tidemark.operators import bands, checks, classify, coverage, phrases, series
from tidemark.operators.funnel import Funnel, body_present, in_window, keep_first, not_a_bot, tier_of, value_counts
from tidemark.plans import frame, probe
from tidemark.sources.json_lists import count_comments, post_ids
from tidemark.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_CLEAN = f"""trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?m)^[{WS}]*>.*$', ' ', 'g'), 'https?://[^{WS}]+', ' ', 'g'),
  '\\\\([\\\\`*_{{}}\\[\\]()#+\\-.!>])', '\\1', 'g'), '*', ''), '#', ''), '[{WS}]+', ' ', 'g'))""".replace(r"\x85\xa0", r"\x{85}\x{a0}")
_STRIP = f"regexp_replace(coalesce(text, ''), '^[{WS}]+|[{WS}]+$', '', 'g')".replace(r"\x85\xa0", r"\x{85}\x{a0}")
_COUNT = "CASE WHEN {0} = '' THEN 0 ELSE len(string_split({0}, ' ')) END"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


@query(f"""
WITH first AS (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1),
present AS (SELECT *, {_CLEAN} AS c FROM first WHERE {_STRIP} NOT IN ('[deleted]', '[removed]', '')),
floored AS (SELECT * FROM present WHERE {_COUNT.format("c")} >= 20)
SELECT 0 AS stage_no, 'raw items' AS stage, count(*)::BIGINT AS items FROM documents
UNION ALL SELECT 1, 'after dedup', count(*) FROM first
UNION ALL SELECT 2, 'after body-deleted removed', count(*) FROM present
UNION ALL SELECT 3, 'after >= 20-word floor', count(*) FROM floored
UNION ALL SELECT 4, 'after English filter', count(*) FROM floored WHERE lang = 'en'""")
def funnel_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of all stages, observed in one action."""
    funnel = Funnel()
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang", F.sha2("text", 256).alias("h"))
    df = funnel.watch(docs, "raw items")
    df = funnel.watch(keep_first(df, "h", ("doc_id",)), "after dedup")
    df = funnel.watch(df.where(body_present(F.col("text"))), "after body-deleted removed")
    df = with_once(df, clean_body=clean_body(F.col("text"), entities=False)).where(word_count(F.col("clean_body")) >= 20)
    df = funnel.watch(df, "after >= 20-word floor")
    df = funnel.watch(df.where("lang = 'en'"), "after English filter")
    df.select("doc_id").write.format("noop").mode("overwrite").save()
    return funnel.table(spark)


@query(f"SELECT doc_id, {_CLEAN} AS clean_body FROM documents")
def clean_body_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", clean_body(F.col("text"), entities=False).alias("clean_body"))


@query("""
SELECT page_id, md5(regexp_replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g')) AS md5 FROM pages""")
def html_unescape_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", F.md5(html_unescape(F.col("html"))).alias("md5"))


@query(f"SELECT doc_id, n::BIGINT AS clean_wordcount FROM (SELECT doc_id, {_COUNT.format('c')} AS n FROM (SELECT doc_id, {_CLEAN} AS c FROM documents)) WHERE n >= 20")
def word_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_once(_documents(spark, sf_dir).select("doc_id", "text"), clean_wordcount=word_count(clean_body(F.col("text"), entities=False)).cast("long"))
    return docs.where("clean_wordcount >= 20").select("doc_id", "clean_wordcount")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedup_first_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a hash of the text, which is what is shuffled and sorted."""
    docs = _documents(spark, sf_dir).select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return keep_first(docs, "h", ("doc_id",)).select("doc_id", "source")


@query("SELECT source, count(*)::BIGINT AS n FROM documents WHERE lang = 'en' GROUP BY source")
def lang_en_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).where("lang = 'en'").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*)::BIGINT AS n FROM events WHERE lower(coalesce(event_type, '')) NOT IN ('click', 'signup') GROUP BY event_type")
def bots_excluded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = read_table(spark, sf_dir, "events").where(not_a_bot(F.col("event_type"), ["click", "signup"]))
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*)::BIGINT AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22'")
def study_window_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").where(in_window(F.col("ts"), "2024-01-08", "2024-01-22", "timestamp_ntz"))
    return ev.agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


_TIERS = {"src0": "Tier 1", "src1": "Tier 1", "src2": "Tier 2", "src3": "Tier 3"}


@query("""
SELECT doc_id, coalesce(tier, 'untiered') AS tier FROM documents
LEFT JOIN (VALUES ('src0', 'Tier 1'), ('src1', 'Tier 1'), ('src2', 'Tier 2'), ('src3', 'Tier 3')) m(s, tier) ON lower(coalesce(source, '')) = s""")
def tier_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", tier_of(F.col("source"), _TIERS).alias("tier"))


@query("SELECT year(o_orderdate)::BIGINT AS year, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def year_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_counts(read_table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("year")), "year", by_value=True)


@query("SELECT o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def value_counts_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_counts(read_table(spark, sf_dir, "orders"), "o_orderpriority")


@query("""
SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, count(*)::BIGINT AS n,
  avg((o_orderstatus = 'F')::INT)::DOUBLE AS concern_share, avg(CASE o_orderstatus WHEN 'F' THEN -1 WHEN 'O' THEN 1 ELSE 0 END)::DOUBLE AS mean_polarity
FROM orders GROUP BY 1""")
def monthly_concern(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    rows = read_table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("created"), (s == "F").cast("int").alias("concern_flag"), F.when(s == "F", -1).when(s == "O", 1).otherwise(0).alias("polarity"))
    return series.monthly(rows).withColumn("month", F.date_format("month", "yyyy-MM-dd"))


@query("SELECT lang, count(*)::BIGINT AS n, avg(toxic)::DOUBLE AS concern_share FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def doc_concern_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "lang").join(read_table(spark, sf_dir, "labels"), "doc_id")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("toxic").alias("concern_share"))


@query("""
WITH s AS (SELECT doc_id, (doc_id % 7) / 10.0 AS n, (doc_id % 5) / 10.0 AS u, (doc_id % 3) / 10.0 AS p FROM documents)
SELECT doc_id, CASE WHEN n >= u AND n >= p THEN 'negative' WHEN u >= p THEN 'neutral' ELSE 'positive' END AS predicted_class,
  (n >= 0.5)::INT AS concern_flag, round((p - n)::DOUBLE, 6) AS polarity FROM s""")
def argmax_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    s = _documents(spark, sf_dir).select("doc_id", (d % 7 / 10.0).alias("p_neg"), (d % 5 / 10.0).alias("p_neu"), (d % 3 / 10.0).alias("p_pos"))
    return s.select("doc_id", classify.predicted_class().alias("predicted_class"), classify.concern_flag().alias("concern_flag"), F.round(classify.polarity(), 6).alias("polarity"))


_FRAME_SQL = """
subs AS (SELECT 'T' || n_regionkey AS tier, n_name AS subreddit FROM nation),
terms AS (SELECT DISTINCT 'T' || (p_size % 5) AS tier, p_brand AS term FROM part),
sat AS (SELECT 'T' || n_regionkey AS tier, n_name AS subreddit FROM nation WHERE n_nationkey % 3 = 0)"""


@query(f"""
WITH {_FRAME_SQL},
blocks AS (SELECT greatest(make_date(y, 1, 1), DATE '2016-01-01')::VARCHAR AS start, least(make_date(y, 12, 31), DATE '2025-04-30')::VARCHAR AS "end" FROM generate_series(2016, 2025) g(y)),
j AS (SELECT s.tier, s.subreddit, term, s.subreddit IN (SELECT subreddit FROM sat) AS blocked FROM subs s JOIN terms USING (tier)),
w AS (SELECT j.*, b.start, b."end" FROM j JOIN blocks b ON blocked UNION ALL SELECT j.*, '2016-01-01', '2025-04-30' FROM j WHERE NOT blocked)
SELECT tier, subreddit, term, start, "end", blocked,
  lower(trim(regexp_replace(subreddit, '[^A-Za-z0-9]+', '-', 'g'), '-')) || '__' || lower(trim(regexp_replace(term, '[^A-Za-z0-9]+', '-', 'g'), '-')) || '__' || start || '_' || "end" || '.json' AS file FROM w""")
def frame_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation")
    subs = nation.select(F.concat(F.lit("T"), "n_regionkey").alias("tier"), F.col("n_name").alias("subreddit"))
    terms = read_table(spark, sf_dir, "part").select(F.concat(F.lit("T"), F.col("p_size") % 5).alias("tier"), F.col("p_brand").alias("term")).distinct()
    marked = nation.where("n_nationkey % 3 = 0").select(F.concat(F.lit("T"), "n_regionkey").alias("tier"), F.col("n_name").alias("subreddit"))
    saturated = marked.join(terms, "tier").select("subreddit", "term")
    jobs = frame.plan_jobs(subs, terms, saturated, frame.windows(spark, "annual"), frame.windows(spark, "none"))
    return jobs.withColumn("file", frame.job_file())


@query("SELECT greatest(make_date(y, 1, 1), DATE '2016-01-01')::VARCHAR AS start, least(make_date(y, 12, 31), DATE '2025-04-30')::VARCHAR AS \"end\" FROM generate_series(2016, 2025) g(y)")
def windows_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.windows(spark, "annual")


@query("""
SELECT b::DATE::VARCHAR AS start, least((b + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE, DATE '2025-04-30')::VARCHAR AS "end"
FROM generate_series(TIMESTAMP '2016-01-01', TIMESTAMP '2025-04-30', INTERVAL 3 MONTH) g(b)""")
def windows_quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.windows(spark, "quarterly")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def todo_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for jobs, their urgent orders for outputs."""
    done = read_table(spark, sf_dir, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("c_custkey"))
    return frame.todo(read_table(spark, sf_dir, "customer").select("c_custkey"), done, ["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE EXISTS (FROM orders WHERE o_custkey = c_custkey)")
def done_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return frame.finished(read_table(spark, sf_dir, "customer").select("c_custkey"), done, ["c_custkey"])


def _probe_report(spark: SparkSession, sf_dir: str, more: DataFrame | None = None) -> DataFrame:
    """Nations as queries, their customers' orders as posts. 7 and 40 stand in for posts and comments."""
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("q"))
    made = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    posts = read_table(spark, sf_dir, "orders").select("o_custkey", made.alias("createdAt"), (F.col("o_orderkey") % 40).alias("commentsCount"))
    posts = posts.join(cust, F.col("o_custkey") == F.col("c_custkey")).select("q", "createdAt", "commentsCount")
    jobs = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("q"), F.concat(F.lit("T"), "n_regionkey").alias("tier"), F.col("n_name").alias("subreddit"))
    return probe.summarise(jobs if more is None else jobs.unionByName(more), posts, ["q"], n_blocks=10)


_REPORT_SQL = """
posts AS (SELECT c_nationkey AS q, strftime(o_orderdate, '%Y-%m-%d') AS made, o_orderkey % 40 AS c FROM orders JOIN customer ON o_custkey = c_custkey),
sums AS (SELECT q, count(*) AS posts_found, min(made) AS lo, max(made) AS hi, sum(c) AS comments_available, avg(least(c, 15)) AS stored_per_post FROM posts GROUP BY q),
base AS (SELECT n_nationkey AS q, 'T' || n_regionkey AS tier, n_name AS subreddit, coalesce(posts_found, 0) AS posts_found, lo, hi, coalesce(comments_available, 0) AS comments_available, coalesce(stored_per_post, 0) AS stored_per_post
  FROM nation LEFT JOIN sums ON q = n_nationkey),
est AS (SELECT *, posts_found >= 100 AS saturated, CASE WHEN posts_found >= 100 THEN 10 ELSE 1 END AS est_runs, CASE WHEN posts_found >= 100 THEN 30 ELSE least(posts_found, 100) END AS est_collect_posts FROM base),
report AS (SELECT *, round_even(est_collect_posts * stored_per_post, 0)::BIGINT AS est_collect_comments FROM est)"""


@query(f"""
WITH {_REPORT_SQL}
SELECT q, tier, subreddit, posts_found::BIGINT AS posts_found, saturated, saturated AS will_block, coalesce(lo, '') AS earliest_post, coalesce(hi, '') AS latest_post,
  comments_available::BIGINT AS comments_available, round(stored_per_post, 6) AS stored_per_post, est_runs::BIGINT AS est_runs, est_collect_posts::BIGINT AS est_collect_posts, est_collect_comments,
  (est_collect_posts + est_collect_comments)::BIGINT AS est_collect_items, round(est_runs * 0.02 + (est_collect_posts + est_collect_comments) * 0.002, 6)::DOUBLE AS est_collect_usd FROM report""")
def probe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _probe_report(spark, sf_dir)
    for c in ("posts_found", "est_runs", "est_collect_posts", "est_collect_items"):
        out = out.withColumn(c, F.col(c).cast("long"))
    return out.withColumn("stored_per_post", F.round("stored_per_post", 6)).withColumn("est_collect_usd", F.round("est_collect_usd", 6))


@query(f"""
WITH {_REPORT_SQL}
SELECT tier, sum(posts_found)::BIGINT AS posts_found, round(sum(est_runs * 0.02 + (est_collect_posts + est_collect_comments) * 0.002), 4)::DOUBLE AS est_collect_usd FROM report GROUP BY tier""")
def tier_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.tier_totals(_probe_report(spark, sf_dir)).withColumn("est_collect_usd", F.round("est_collect_usd", 4))


@query(f"""
WITH {_REPORT_SQL}, t AS (SELECT sum(est_runs)::BIGINT AS runs, sum(est_collect_posts)::BIGINT AS posts, sum(est_collect_comments)::BIGINT AS comments, sum(est_runs * 0.02 + (est_collect_posts + est_collect_comments) * 0.002)::DOUBLE AS usd FROM report)
SELECT runs, posts, comments, round(usd, 4) AS usd, round(usd / 0.7, 4) AS aud, usd > 110 AS over_cap, round(usd / 110, 4) AS times_cap FROM t""")
def grand_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = probe.grand_total(_probe_report(spark, sf_dir))
    return out.select("runs", "posts", "comments", *[F.round(c, 4).alias(c) for c in ("usd", "aud", "times_cap")], "over_cap")


@query("SELECT c_mktsegment AS subreddit, min(strftime(o_orderdate, '%Y-%m-%d')) AS earliest_post FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def earliest_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("subreddit"))
    rows = read_table(spark, sf_dir, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("earliest_post"))
    return probe.earliest_by_community(rows.join(cust, F.col("o_custkey") == F.col("c_custkey")))


@query(f"WITH {_REPORT_SQL} SELECT q, tier, subreddit FROM report WHERE posts_found = 0 UNION ALL SELECT 100 + r_regionkey, 'R' || r_regionkey, r_name FROM region")
def empty_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the regions as queries that nobody posts to: they keep their rows in the report."""
    regions = read_table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("q"), F.concat(F.lit("R"), "r_regionkey").alias("tier"), F.col("r_name").alias("subreddit"))
    return probe.empty_queries(_probe_report(spark, sf_dir, regions)).select("q", "tier", "subreddit")


@query(f"WITH {_REPORT_SQL} SELECT count(*) FILTER (saturated)::BIGINT AS blocked, count(*) FILTER (NOT saturated)::BIGINT AS single FROM report")
def block_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.block_split(_probe_report(spark, sf_dir))


@query("SELECT o_orderstatus = 'O' AS blocked, count(DISTINCT (o_custkey, o_orderpriority))::BIGINT AS queries FROM orders GROUP BY 1")
def distinct_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subreddit"), F.col("o_orderpriority").alias("term"), (F.col("o_orderstatus") == "O").alias("blocked"))
    return frame.distinct_queries(rows)


def _queries_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("tier"))
    n = read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("posts_found"))
    return cust.join(n, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "tier", "posts_found")


_BY_CUSTOMER = "q AS (SELECT c_custkey, c_mktsegment AS tier, count(*) AS posts_found FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


@query(f"WITH {_BY_CUSTOMER} SELECT tier, count(*) FILTER (posts_found < 8)::BIGINT AS under, count(*) FILTER (posts_found BETWEEN 8 AND 13)::BIGINT AS truncated, count(*) FILTER (posts_found >= 14)::BIGINT AS saturated FROM q GROUP BY tier")
def band_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.crosstab(_queries_by_customer(spark, sf_dir), 8, 14)


@query(f"WITH {_BY_CUSTOMER} SELECT c_custkey, tier, posts_found::BIGINT AS posts_found, (posts_found - 8)::BIGINT AS dropped FROM q WHERE posts_found BETWEEN 8 AND 13")
def truncation_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.in_band(_queries_by_customer(spark, sf_dir), 8, 14)


@query(f"""
WITH {_BY_CUSTOMER}, b AS (SELECT * FROM q WHERE posts_found BETWEEN 8 AND 13)
SELECT sum(least(posts_found, 8))::BIGINT AS posts_now, round(sum(0.02 + 0.002 * least(posts_found, 8) * 10.4), 4)::DOUBLE AS usd_now,
  sum(least(posts_found, 14))::BIGINT AS posts_census, round(sum(0.02 + 0.002 * least(posts_found, 14) * 10.4), 4)::DOUBLE AS usd_census,
  (count(*) * 30)::BIGINT AS posts_blocked, round(count(*) * (10 * 0.02 + 0.002 * 30 * 10.4), 4)::DOUBLE AS usd_blocked FROM b""")
def remedy_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bands.remedies(bands.in_band(_queries_by_customer(spark, sf_dir), 8, 14), 8, 14, 10)
    return out.select(*[F.round(c, 4).alias(c) if c.startswith("usd") else F.col(c).cast("long").alias(c) for c in out.columns])


def _order_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a job table."""
    return read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("cost"))


@query("""
WITH j AS (SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS c FROM orders),
s AS (SELECT o_orderkey, 1000 + coalesce(sum(c) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM j)
SELECT o_orderkey, before::DOUBLE AS spent_before FROM s WHERE before < 100000000""")
def budget_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frame.affordable(_order_jobs(spark, sf_dir), ["o_orderkey"], "cost", 1000, 100_000_000)
    return out.select("o_orderkey", F.col("spent_before").cast("double").alias("spent_before"))


@query("""
WITH j AS (SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS c FROM orders),
s AS (SELECT o_orderkey, 1000 + sum(c) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) > 100000000 AS over_ FROM j)
SELECT o_orderkey FROM (SELECT o_orderkey, max(over_::INT) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS stopped FROM s) WHERE stopped = 0""")
def budget_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.affordable_ahead(_order_jobs(spark, sf_dir), ["o_orderkey"], "cost", 1000, 100_000_000).select("o_orderkey")


def _id_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three overlapping sets of document ids, by source, for the set algebra."""
    docs = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "source", "n_chars", "lang")
    return docs.where("lang <> 'es'"), docs.where("n_chars >= 1500"), docs.where("n_chars < 800 OR lang = 'es'")


_SETS = "p AS (SELECT doc_id AS id, source FROM documents WHERE lang <> 'es'), o AS (SELECT doc_id AS id, source FROM documents WHERE n_chars >= 1500), b AS (SELECT doc_id AS id, source FROM documents WHERE n_chars < 800 OR lang = 'es')"


@query(f"""
WITH {_SETS}, f AS (SELECT id, source, bool_or(k = 'p') AS p, bool_or(k = 'o') AS o, bool_or(k = 'b') AS b FROM (SELECT *, 'p' AS k FROM p UNION ALL SELECT *, 'o' FROM o UNION ALL SELECT *, 'b' FROM b) GROUP BY ALL)
SELECT source, count(*) FILTER (p)::BIGINT AS n_probe, count(*) FILTER (o)::BIGINT AS n_original, count(*) FILTER (b)::BIGINT AS n_backfill, count(*) FILTER (p AND o)::BIGINT AS n_overlap,
  count(*) FILTER (p AND NOT o AND b)::BIGINT AS n_recovered, count(*) FILTER (p AND (o OR b))::BIGINT AS n_represented, count(*) FILTER (p AND NOT o AND NOT b)::BIGINT AS n_unaccounted, count(*) FILTER (b AND NOT o)::BIGINT AS n_new
FROM f GROUP BY source""")
def coverage_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.coverage(*_id_sets(spark, sf_dir), by=["source"])


@query(f"WITH {_SETS} SELECT source, id FROM p EXCEPT SELECT source, id FROM o")
def missing_probe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, o, _ = _id_sets(spark, sf_dir)
    return coverage.missing(p, o, ["source", "id"]).select("source", "id")


def _targets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p, o, b = _id_sets(spark, sf_dir)
    rows = coverage.missing(p, o, ["source", "id"]).select(F.col("source").alias("subreddit"), F.col("id").alias("post_id"), F.col("lang").alias("term"))
    return coverage.present_elsewhere(rows, b.select(F.col("id").alias("post_id"))), b


@query(f"WITH {_SETS}, t AS (SELECT * FROM p WHERE id NOT IN (SELECT id FROM o)) SELECT id AS post_id, id IN (SELECT id FROM b) AS baseline_present_elsewhere, id NOT IN (SELECT id FROM b) AS recovery_required FROM t")
def present_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _targets(spark, sf_dir)[0].select("post_id", "baseline_present_elsewhere", "recovery_required")


@query("""
SELECT conv_id, count(*)::BIGINT AS n_targets, (count(*) * 15)::BIGINT AS max_comments, count(*) > 100 AS too_large, md5(string_agg(text, '|' ORDER BY turn, role, text)) AS listed, arg_min(text, (turn, role, text)) AS first_text, arg_max(text, (turn, role, text)) AS last_text
FROM conversations GROUP BY conv_id""")
def recovery_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as queries, turns as targets."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", F.lpad(F.col("turn").cast("string"), 9, "0").alias("probe_created_at"), F.col("role").alias("post_id"), F.col("text").alias("post_url"))
    out = coverage.batches(rows, ["conv_id"])
    return out.select("conv_id", "n_targets", "max_comments", "too_large", F.md5(F.array_join("urls", "|")).alias("listed"), F.col("first_url").alias("first_text"), F.col("last_url").alias("last_text"))


@query("""
WITH t AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'F'), r AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%'),
f AS (SELECT o_custkey, o_orderkey, bool_or(k) AS w, bool_or(NOT k) AS r FROM (SELECT *, true AS k FROM t UNION ALL SELECT *, false FROM r) GROUP BY 1, 2),
c AS (SELECT o_custkey, count(*) FILTER (w)::BIGINT AS n_targets, count(*) FILTER (w AND r)::BIGINT AS n_recovered, count(*) FILTER (w AND NOT r)::BIGINT AS n_missing, count(*) FILTER (r AND NOT w)::BIGINT AS n_extra, count(*) FILTER (r)::BIGINT AS n_returned FROM f GROUP BY 1)
SELECT *, CASE WHEN n_returned = 0 THEN 'PENDING' WHEN n_missing = 0 THEN 'DONE' ELSE 'PARTIAL' END AS state FROM c WHERE n_targets > 0""")
def batch_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "orders")
    return coverage.batch_states(rows.where("o_orderstatus <> 'F'"), rows.where("o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%'"), ["o_custkey"], "o_orderkey")


@query(f"""
WITH {_SETS}, t AS (SELECT id, source, lang FROM documents WHERE lang <> 'es' AND doc_id NOT IN (SELECT id FROM o)), t2 AS (SELECT t.id, t.source FROM t),
s AS (SELECT source, id, id IN (SELECT id FROM b) AS here, source <> 'src7' AS done, id % 2 = 0 AS got FROM t2)
SELECT source AS subreddit, id AS post_id, CASE WHEN here THEN 'already_present_elsewhere' WHEN NOT done THEN 'pending' WHEN got THEN 'recovered' ELSE 'unaccounted_in_recovery_file' END AS status,
  (NOT here AND done AND got) AS recovered_by_direct FROM s""".replace("SELECT id, source, lang FROM documents", "SELECT doc_id AS id, source, lang FROM documents"))
def manifest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, _ = _targets(spark, sf_dir)
    outputs = targets.where("subreddit <> 'src7'").select("subreddit")
    returned = targets.where("post_id % 2 = 0").select("subreddit", "post_id")
    return coverage.manifest(targets, outputs, returned, ["subreddit"]).select("subreddit", "post_id", "status", "recovered_by_direct")


_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""
WITH a AS (SELECT lang AS arm, CASE lang WHEN 'en' THEN 'The and' WHEN 'de' THEN 'Der-die' WHEN 'fr' THEN 'est' ELSE 'de la' END AS phrase FROM documents GROUP BY lang),
p AS (SELECT lang AS arm, doc_id, {_NORM.format("coalesce(source, '') || ' ' || coalesce(text, '')")} AS hay, {_NORM.format("phrase")} AS phrase FROM documents JOIN a ON arm = lang),
b AS (SELECT lang AS arm, doc_id FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT lang, doc_id + 1000000 FROM documents WHERE doc_id % 7 = 0)
SELECT arm, count(*)::BIGINT AS posts, round(100.0 * count(*) FILTER (contains(hay, phrase)) / count(*), 6)::DOUBLE AS phrase_pct,
  round(100.0 * count(*) FILTER (len(list_filter(string_split(phrase, ' '), lambda t: NOT contains(hay, t))) = 0) / count(*), 6)::DOUBLE AS alltok_pct,
  any_value((SELECT count(DISTINCT b.doc_id) FROM b WHERE b.arm = p.arm))::BIGINT AS baseline_posts, count(*) FILTER (doc_id % 4 <> 0)::BIGINT AS overlap,
  round(100.0 * count(*) FILTER (doc_id % 4 <> 0) / count(*), 6)::DOUBLE AS overlap_pct FROM p GROUP BY arm""")
def phrase_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as arms; three documents in four, and some that the arm hasn't, as its baseline."""
    docs = _documents(spark, sf_dir)
    posts = docs.select(F.col("lang").alias("arm"), F.col("doc_id").cast("string").alias("parsedId"), F.col("source").alias("title"), F.col("text").alias("body"))
    arm, i = F.col("arm"), F.col("doc_id")
    arms = posts.select("arm").distinct().withColumn("phrase", F.when(arm == "en", "The and").when(arm == "de", "Der-die").when(arm == "fr", "est").otherwise("de la"))
    held = docs.select(F.col("lang").alias("arm"), F.explode(F.array(F.when(i % 4 != 0, i).cast("string"), F.when(i % 7 == 0, i + 1000000).cast("string"))).alias("parsedId")).where("parsedId IS NOT NULL")
    out = phrases.precision(arms, posts, held)
    return out.select("arm", "posts", F.round("phrase_pct", 6).alias("phrase_pct"), F.round("alltok_pct", 6).alias("alltok_pct"), "baseline_posts", "overlap", F.round("overlap_pct", 6).alias("overlap_pct"))


@query(f"""
WITH i AS (SELECT item_id, {_NORM.format("text")} AS phrase FROM benchmark), d AS (SELECT {_NORM.format("coalesce(text, '')")} AS hay FROM documents)
SELECT item_id, count(*)::BIGINT AS docs FROM i JOIN d ON phrase <> '' AND contains(' ' || hay || ' ', ' ' || phrase || ' ') GROUP BY item_id""")
def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item as a phrase, whole."""
    items = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("phrase_id"), norm(F.col("text")).alias("phrase"))
    texts = with_once(_documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), hay=norm(F.col("text"))).select("id", "hay")
    return phrases.holding(texts, items).groupBy(F.col("phrase_id").alias("item_id")).agg(F.count(F.lit(1)).alias("docs"))


@query("SELECT max(n)::BIGINT AS most, count(*) FILTER (n > 15)::BIGINT AS over FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)")
def comments_cap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.thread_check(read_table(spark, sf_dir, "conversations"), post_col="conv_id")


@query("SELECT p_partkey, lower(trim(regexp_replace(p_name || ' / ' || p_brand, '[^A-Za-z0-9]+', '-', 'g'), '-')) AS slug FROM part")
def slug_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select("p_partkey", slug(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"))


@query("""
SELECT 'document ids unique' AS "check", count(doc_id) = count(DISTINCT doc_id) AS ok, (count(doc_id) - count(DISTINCT doc_id))::VARCHAR AS detail FROM documents
UNION ALL SELECT 'texts present', count(*) FILTER (text IS NULL) = 0, count(*) FILTER (text IS NULL)::VARCHAR FROM documents
UNION ALL SELECT 'labels refer to documents', count(*) = 0, count(*)::VARCHAR FROM labels ANTI JOIN documents USING (doc_id)
UNION ALL SELECT 'prices positive', count(*) FILTER (NOT coalesce(o_totalprice > 0, false)) = 0, count(*) FILTER (NOT coalesce(o_totalprice > 0, false))::VARCHAR FROM orders
UNION ALL SELECT 'nations', count(*) = 25, count(*)::VARCHAR FROM nation""")
def checks_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return checks.report(
        checks.unique(docs, "document ids unique", "doc_id"),
        checks.no_nulls(docs, "texts present", "text"),
        checks.referenced(read_table(spark, sf_dir, "labels"), "labels refer to documents", "doc_id", docs, "doc_id"),
        checks.holds(read_table(spark, sf_dir, "orders"), "prices positive", F.col("o_totalprice") > 0),
        checks.row_count(read_table(spark, sf_dir, "nation"), "nations", 25),
    )


def _monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "orders").groupBy(month_of(F.col("o_orderdate")).alias("month"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("flagged"))


_MONTHS = "m AS (SELECT row_number() OVER (ORDER BY month) AS i, n FROM (SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n FROM orders GROUP BY 1))"


@query(f"""
WITH {_MONTHS}, s AS (SELECT sum(sign(b.n - a.n))::BIGINT AS s FROM m a JOIN m b ON a.i < b.i), c AS (SELECT count(*)::BIGINT AS n FROM m),
t AS (SELECT sum(t * (t - 1) * (2 * t + 5)) AS ties FROM (SELECT count(*) AS t FROM m GROUP BY n)), v AS (SELECT n, s, (n * (n - 1) * (2 * n + 5) - ties) / 18.0 AS var_s FROM s, c, t)
SELECT n, s, round(var_s, 6)::DOUBLE AS var_s, round(CASE WHEN s > 0 THEN (s - 1) / sqrt(var_s) WHEN s < 0 THEN (s + 1) / sqrt(var_s) ELSE 0 END, 6)::DOUBLE AS z FROM v""")
def mann_kendall_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.mann_kendall(_monthly_orders(spark, sf_dir), "month", "n")
    return out.select("n", "s", F.round(F.col("var_s").cast("double"), 6).alias("var_s"), F.round(F.col("z").cast("double"), 6).alias("z"))


#: The complement of the error function by its series, which DuckDB lacks.
_ERFC = "1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 80), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * pow({0}, 2 * k + 1) / (gamma(k + 1.0) * (2 * k + 1))))"


@query(f"""
WITH {_MONTHS}, s AS (SELECT sum(sign(b.n - a.n))::BIGINT AS s FROM m a JOIN m b ON a.i < b.i), c AS (SELECT count(*)::BIGINT AS n FROM m),
t AS (SELECT sum(t * (t - 1) * (2 * t + 5)) AS ties FROM (SELECT count(*) AS t FROM m GROUP BY n)),
z AS (SELECT (CASE WHEN s > 0 THEN s - 1 WHEN s < 0 THEN -1 - s ELSE 0 END / sqrt((n * (n - 1) * (2 * n + 5) - ties) / 18.0) / sqrt(2))::DOUBLE AS x FROM s, c, t)
SELECT round({_ERFC.format("x")}, 7)::DOUBLE AS p FROM z""")
def mann_kendall_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.mann_kendall(_monthly_orders(spark, sf_dir), "month", "n").select(F.round("p", 7).alias("p"))


@query(f"WITH {_MONTHS} SELECT round(median((b.n - a.n) / (b.i - a.i)), 6)::DOUBLE AS slope FROM m a JOIN m b ON a.i < b.i")
def sen_slope_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.sen_slope(_monthly_orders(spark, sf_dir), "month", "n").select(F.round("slope", 6).alias("slope"))


@query()
def changepoints_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.changepoints(_monthly_orders(spark, sf_dir).withColumn("of", F.lit("orders")), "of", "month", "n")


@query()
def sentiment_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("clean_body"))
    return classify.classify(rows).drop("clean_body")


_STOP_SQL = ", ".join("len(list_filter(w, lambda x: list_contains([{}], x))) AS {}".format(", ".join(f"'{x}'" for x in sorted(words)), lang) for lang, words in classify.STOP_WORDS.items())


@query(f"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+') AS w FROM documents), n AS (SELECT doc_id, {_STOP_SQL} FROM t)
SELECT doc_id, CASE WHEN en > greatest(de, fr, es) THEN 'en' WHEN de > greatest(en, fr, es) THEN 'de' WHEN fr > greatest(en, de, es) THEN 'fr' WHEN es > greatest(en, de, fr) THEN 'es' END AS lang FROM n""")
def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", classify.language_of(F.col("text")).alias("lang"))


@query(f"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+') AS w FROM documents), n AS (SELECT doc_id, {_STOP_SQL} FROM t), s AS (SELECT *, 4 + en + de + fr + es AS total FROM n)
SELECT doc_id, CASE WHEN en >= greatest(de, fr, es) THEN 'en' WHEN de >= greatest(fr, es) THEN 'de' WHEN fr >= es THEN 'fr' ELSE 'es' END AS label, round((1 + greatest(en, de, fr, es)) / total, 6)::DOUBLE AS best,
  coalesce(CASE WHEN 2 * (1 + en) >= total THEN 'en' WHEN 2 * (1 + de) >= total THEN 'de' WHEN 2 * (1 + fr) >= total THEN 'fr' WHEN 2 * (1 + es) >= total THEN 'es' END, '') AS labels FROM s""")
def zero_shot_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any labels by the scorer's own probabilities: here of words that speak for each. Two labels at 0.5 share no text."""
    rows = _documents(spark, sf_dir).select("doc_id", F.col("text").alias("clean_body"))
    out = classify.with_labels(rows, classify.KeywordScorer(classify.STOP_WORDS))
    return out.select("doc_id", "label", F.round(F.array_max(F.map_values("label_scores")), 6).alias("best"), F.coalesce(F.try_element_at("labels", F.lit(1)), F.lit("")).alias("labels"))


@query(f"""
WITH {_REPORT_SQL}, b AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT 'collection' AS kind, count(*)::BIGINT AS n, round(sum(0.02 + 0.002 * (100 + 1500)), 4)::DOUBLE AS usd FROM report
UNION ALL SELECT 'probe', count(*), round(count(*) * (0.02 + 0.002 * 100), 4) FROM report
UNION ALL SELECT 'phrase arms', count(*), round(count(*) * (0.02 + 0.002 * 60), 4) FROM region
UNION ALL SELECT 'recovery', count(*), round(count(*) * 0.02 + 0.002 * sum(n) * 16, 4) FROM b
UNION ALL SELECT 'recovery, modelled', count(*), round(count(*) * 0.02 + 0.002 * sum(n) * 10.4, 4) FROM b""")
def ceiling_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most that each kind of run can cost: nations as jobs, regions as arms, conversations as recovery batches."""
    jobs = _probe_report(spark, sf_dir).select("q")
    batches = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_targets"))
    recovery = frame.recovery_ceiling(batches)
    row = lambda df, kind, n, usd: df.select(F.lit(kind).alias("kind"), F.col(n).alias("n"), F.round(usd, 4).alias("usd"))
    collection = frame.ceiling(jobs).agg(F.count(F.lit(1)).alias("jobs"), F.sum("ceiling_usd").alias("ceiling_usd"))
    out = row(collection, "collection", "jobs", "ceiling_usd").unionByName(row(frame.posts_ceiling(jobs), "probe", "jobs", "ceiling_usd"))
    out = out.unionByName(row(frame.posts_ceiling(read_table(spark, sf_dir, "region"), 60), "phrase arms", "jobs", "ceiling_usd"))
    return out.unionByName(row(recovery, "recovery", "batches", "ceiling_usd")).unionByName(row(recovery, "recovery, modelled", "batches", "modelled_usd"))


@query("""
WITH s AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
SELECT CASE WHEN n >= 20 THEN 'complete' WHEN n >= 10 THEN 'partial' ELSE 'pending' END AS state, count(*)::BIGINT AS jobs FROM s GROUP BY 1""")
def completion_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return frame.completion(n.withColumn("state", F.when(F.col("n") >= 20, "complete").when(F.col("n") >= 10, "partial").otherwise("pending")))


@query("SELECT conv_id, count(role)::BIGINT AS n, count(DISTINCT role)::BIGINT AS n_distinct, count(role) > count(DISTINCT role) AS repeated FROM conversations GROUP BY conv_id")
def duplicate_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.duplicates(read_table(spark, sf_dir, "conversations"), "role", ["conv_id"])


@query("SELECT round(sum(o_totalprice::DECIMAL(18,2)), 2)::DOUBLE AS spent FROM orders")
def spent_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read_table(spark, sf_dir, "orders").select(F.col("o_totalprice").cast("decimal(18,2)").alias("est_usd"))
    return frame.spent(log).select(F.col("spent").cast("double").alias("spent"))


@query("""
WITH e AS (SELECT sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS estimate FROM orders)
SELECT round(estimate, 2) AS estimate, round(estimate / 99999000, 6) AS ratio, estimate > 99999000 AS over FROM e""")
def remaining_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frame.remaining_budget(_order_jobs(spark, sf_dir), "cost", 1000, 100_000_000)
    estimate = F.col("estimate").cast("double")
    return out.select(F.round(estimate, 2).alias("estimate"), F.round("ratio", 6).alias("ratio"), "over")


@query("""
WITH p AS (SELECT c_custkey FROM customer WHERE NOT EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%'))
SELECT count(DISTINCT c_custkey)::BIGINT AS pending, coalesce(sum(o_orderkey % 100), 0)::BIGINT AS total FROM p LEFT JOIN orders ON o_custkey = c_custkey""")
def pending_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs that todo_anti finds are pending."""
    pending = todo_anti(spark, sf_dir)
    values = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 100).alias("v"))
    return coverage.pending_total(pending, values, ["c_custkey"], "v")


@query("""
SELECT CASE WHEN a = 0 THEN 'quotes break the query' WHEN b >= 80 THEN 'quotes work' ELSE 'mixed' END AS quoting, CASE WHEN c >= 60 THEN 'loose fallback' ELSE 'limit of multi-word matching' END AS mechanism
FROM (SELECT count(*) FILTER (lang = 'en') AS a, 100.0 * count(*) FILTER (lang = 'de' AND contains(text, 'der')) / count(*) FILTER (lang = 'de') AS b, 100.0 * count(*) FILTER (lang = 'fr' AND contains(text, 'est')) / count(*) FILTER (lang = 'fr') AS c FROM documents)""")
def phrase_interpretation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang, text = F.col("lang"), F.col("text")
    docs = _documents(spark, sf_dir).where(lang.isin("en", "de", "fr"))
    hit = F.when(lang == "de", F.contains(text, F.lit("der"))).when(lang == "fr", F.contains(text, F.lit("est"))).otherwise(False)
    arm = F.when(lang == "en", "A").when(lang == "de", "B").otherwise("C").alias("arm")
    result = docs.groupBy(arm).agg(F.count(F.lit(1)).alias("posts"), (100.0 * F.count_if(hit) / F.count(F.lit(1))).alias("phrase_pct")).withColumn("overlap_pct", F.lit(0.0))
    return phrases.interpretation(result)


@query("SELECT conv_id, turn, substring(text, 1, 80) AS body_preview FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) <= 3")
def thread_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three comments of a thread, as a collector with that cap would store."""
    rows = coverage.capped_threads(read_table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"], 3)
    return rows.select("conv_id", "turn", preview(F.col("text")).alias("body_preview"))


@query("""
SELECT r_regionkey AS "case", CASE WHEN r_regionkey = 4 THEN 'incomplete' WHEN r_regionkey = 0 THEN 'quotes break the query' WHEN r_regionkey = 1 THEN 'quotes are ignored' WHEN r_regionkey = 2 THEN 'quotes work' ELSE 'mixed' END AS quoting,
  CASE WHEN r_regionkey >= 3 THEN NULL WHEN r_regionkey = 2 THEN 'loose fallback' ELSE 'limit of multi-word matching' END AS mechanism FROM region""")
def interpretation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every branch of the interpretation: a region is a test, with made-up results of its arms."""
    r = F.col("case")
    regions = read_table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("case"))
    arms = regions.select("case", F.explode(F.array(*[F.lit(a) for a in "ABC"])).alias("arm")).where(~((F.col("arm") == "B") & (r == 4)) & ~((F.col("arm") == "C") & (r >= 3)))
    found = F.when((F.col("arm") == "A") & (r == 0), 0).otherwise(30).cast("long")
    phrase = F.when(F.col("arm") == "C", F.when(r == 2, 60.0).otherwise(59.9)).when(r == 1, 19.9).when(r == 2, 80.0).otherwise(50.0)
    rows = arms.select("case", "arm", found.alias("posts"), phrase.alias("phrase_pct"), F.when(r == 1, 90.0).otherwise(89.9).alias("overlap_pct"))
    return phrases.interpretation(rows, by=["case"])


@query(f"""
WITH {_SETS}, f AS (SELECT id, bool_or(k = 'p') AS p, bool_or(k = 'o') AS o, bool_or(k = 'b') AS b FROM (SELECT *, 'p' AS k FROM p UNION ALL SELECT *, 'o' FROM o UNION ALL SELECT *, 'b' FROM b) GROUP BY id),
c AS (SELECT count(*) FILTER (p) AS c0, count(*) FILTER (o) AS c1, count(*) FILTER (b) AS c2, count(*) FILTER (p AND o) AS c3, count(*) FILTER (p AND NOT o AND b) AS c4, count(*) FILTER (p AND (o OR b)) AS c5, count(*) FILTER (p AND NOT o AND NOT b) AS c6, count(*) FILTER (b AND NOT o) AS c7 FROM f),
l AS (SELECT unnest([c0, c1, c2, c3, c4, c5, c6, c7])::BIGINT AS n, unnest(range(0, 8))::INT AS line FROM c)
SELECT line, [{", ".join(f"'{x}'" for x in coverage.COVERAGE_LINES.values())}][line + 1] AS label, n FROM l""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.coverage_report(coverage.coverage(*_id_sets(spark, sf_dir)), [])


@query("SELECT count(DISTINCT date_trunc('month', o_orderdate))::BIGINT AS months FROM orders")
def month_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.n_months(_monthly_orders(spark, sf_dir))


@query("""
SELECT o_orderpriority AS term, min(strftime(o_orderdate, '%Y-%m-%d')) FILTER (o_orderkey % 50 <> 0) AS earliest, count(*) FILTER (o_orderkey % 50 = 0)::BIGINT AS unreadable FROM orders GROUP BY 1""")
def earliest_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as posts; some have a time that is no date."""
    made = F.when(F.col("o_orderkey") % 50 == 0, "12:30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return probe.earliest_held(read_table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("term"), made.alias("createdAt")), ["term"])


@query("SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 7 <> 0 AS ok FROM documents")
def address_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses made of ids, in another case; of some the id goes on, of others it is another's."""
    i = F.col("doc_id")
    rows = _documents(spark, sf_dir).select("doc_id", F.concat(F.lit("t3_a"), i).alias("post_id"), F.concat(F.lit("https://x.example/r/c/COMMENTS/A"), F.when(i % 3 == 0, i + 1).otherwise(i), F.when(i % 7 == 0, "9/").otherwise("/title")).alias("post_url"))
    return rows.select("doc_id", coverage.address_matches_id().alias("ok"))


@query(f"WITH {_BY_CUSTOMER} SELECT c_custkey, posts_found::BIGINT AS posts_found, EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%') AS already_collected FROM q WHERE posts_found BETWEEN 8 AND 13")
def band_collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = read_table(spark, sf_dir, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("c_custkey"))
    return bands.collected(bands.in_band(_queries_by_customer(spark, sf_dir), 8, 14), done, ["c_custkey"]).select("c_custkey", "posts_found", "already_collected")


@query("SELECT lang AS arm, (row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) - 1)::INT AS place, substring(coalesce(text, ''), 1, 88) AS title FROM documents QUALIFY place < 8")
def first_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.first_titles(_documents(spark, sf_dir).select(F.col("lang").alias("arm"), F.col("source").alias("file_name"), F.col("doc_id").alias("pos"), F.col("text").alias("title")))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1")
def live_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.first_live(read_table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"]).select("o_orderkey")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as raw items: what users say as posts, what is answered as comments."""
    kind = F.when(F.col("role") == "user", "Post").otherwise("comment")
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("dataType"), F.concat_ws("_", F.lit("t3"), "conv_id", F.col("turn") % 4).alias("id"), F.col("text").alias("body"))


@query("SELECT conv_id, count(*)::BIGINT AS items, count(*) FILTER (role <> 'user')::BIGINT AS comments FROM conversations GROUP BY conv_id")
def comments_in_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_comments(_items(spark, sf_dir), ["conv_id"])


@query("SELECT DISTINCT 't3_' || conv_id || '_' || turn % 4 AS id FROM conversations WHERE role = 'user'")
def union_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return post_ids(_items(spark, sf_dir))


@query("""
WITH w AS (SELECT n_nationkey AS k FROM nation UNION SELECT 100 + r_regionkey FROM region), f AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_suppkey <= 40 GROUP BY 1)
SELECT k, coalesce(n, 0)::BIGINT AS n, coalesce(n, 0) = 1 AS ok FROM w LEFT JOIN f USING (k)""")
def exactly_one_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows by wanted key: none, one or several."""
    wanted = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).unionByName(read_table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("k")))
    rows = read_table(spark, sf_dir, "supplier").where("s_suppkey <= 40").select(F.col("s_nationkey").alias("k"))
    return checks.matches(rows, wanted, ["k"])


@query("""
WITH h AS (SELECT o_orderpriority AS term, min(strftime(o_orderdate, '%Y-%m-%d')) AS earliest FROM orders GROUP BY 1)
SELECT 'T' AS tier, 'orders' AS subreddit, term, '1990-01-01' AS start, earliest AS "end", false AS blocked FROM h""")
def backfill_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.date_format("o_orderdate", "yyyy-MM-dd").alias("createdAt")
    held = probe.earliest_held(read_table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("term"), made), ["term"])
    return frame.backfill_jobs(held.select(F.lit("T").alias("tier"), F.lit("orders").alias("subreddit"), "term", "earliest"), "1990-01-01", 5)


@query("SELECT 'T' AS tier, c_mktsegment AS subreddit, c_custkey::VARCHAR AS term, min(strftime(o_orderdate, '%Y-%m-%d')) AS earliest, earliest > '1996-01-01' AS ok FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def tail_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("subreddit"))
    rows = read_table(spark, sf_dir, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey"))
    held = rows.groupBy("subreddit", F.col("c_custkey").cast("string").alias("term")).agg(F.min(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("earliest"))
    return frame.tail_checks(held.withColumn("tier", F.lit("T")), "1996-01-01")


@query("""
WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 100 <> 0 GROUP BY 1),
d AS (SELECT count(*) AS n FROM a LEFT JOIN b USING (k) WHERE coalesce(b.n, 0) <> a.n), x AS (SELECT count(*) AS n FROM (SELECT n_name AS v FROM nation INTERSECT SELECT r_name FROM region))
SELECT 'report and files' AS "check", n = 0 AS ok, n::VARCHAR AS detail FROM d
UNION ALL SELECT 'outputs and sources', n = 0, n::VARCHAR FROM x
UNION ALL SELECT 'collection cap', true, '100 of 100'""")
def guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report that states more than its files hold, outputs against sources, the caps' invariant."""
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    count = lambda df: df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return checks.report(
        checks.agreeing(count(orders), count(orders.where("o_orderkey % 100 <> 0")), "report and files", ["k"], "n", "n"),
        checks.apart(read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("v")), read_table(spark, sf_dir, "region").select(F.col("r_name").alias("v")), "outputs and sources", "v"),
        checks.at_least(spark, "collection cap", frame.COLLECT_POSTS, frame.PROBE_POSTS),
    )
