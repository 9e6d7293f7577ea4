"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, html_extract, language_id, license_scan, line_dedup, mixing, quality_knn, quality_rules, simhash_dedup, substring_dedup
from tidemark.llm.common import table

NO_ID = -(2**63)


def _id(doc: str = "doc") -> Column:
    return F.when(F.col(doc) != NO_ID, F.col(doc))


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op2_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(_id().alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select(F.col("row.doc_id").alias("doc_id"), *quality_rules.COUNTS[:5], "base_failed", "kept")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.withColumn("weight", F.round("weight", 6)).withColumn("copies", F.col("copies").cast("long"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.cluster(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(_id().alias("doc_id"), simhash_dedup.hex_of(F.col("f0")).alias("fingerprint"), _id("component").alias("component_id"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    families = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"])))
    return out.select(
        "doc_id",
        "n_paragraphs",
        F.size("found").cast("long").alias("n_license"),
        F.array_join(families, ",").alias("families"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["probability"])), F.lit(0.0)).alias("score"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hits").cast("long")
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OPERATORS = (
    op1_html_extract,
    op2_quality_knn,
    op3_language_id,
    op4_substring_dedup,
    op5_quality_rules,
    op6_mixing,
    op7_line_dedup,
    op8_simhash_dedup,
    op9_license_scan,
    op10_decontaminate,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = """
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words)),
placed AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM placed WHERE nth > 1),
lost AS (SELECT doc_id, list(pos) AS ats FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ats), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda k: ats IS NULL OR NOT list_contains(ats, k)), lambda k: w[k]), ' '), '')) AS kept_sha256
FROM words LEFT JOIN lost USING (doc_id)
"""

OP7_SQL = f"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_WS})")} AS k FROM lines),
often AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT doc_id, n, line, (o.k IS NOT NULL AND o.keeper <> doc_id) AS gone FROM keyed LEFT JOIN often o USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP10_SQL = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM wins),
dwin AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes)),
occ AS (SELECT doc_id, i, size, item_id FROM dwin JOIN wins USING (win, size)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS pos FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))::BIGINT AS n_tokens, md5('17:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
p AS (SELECT source, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens)::DOUBLE / (SELECT sum(n_tokens) FROM d) AS p FROM d GROUP BY source HAVING sum(n_tokens) > 0),
bisect(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
  FROM (SELECT i, any_value(lo) AS lo, any_value(hi) AS hi, any_value(mid) AS mid,
          ln(sum(pow(p, mid))) - any_value(mid) * sum(pow(p, mid) * ln(p)) / sum(pow(p, mid)) >= 0.98 * ln(count(*)) AS ok
        FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid FROM bisect WHERE i < 45), p GROUP BY i)),
t AS (SELECT round(greatest((SELECT lo FROM bisect WHERE i = 45), (SELECT CASE WHEN max(p) / min(p) > 4 THEN 1 - ln(4) / ln(max(p) / min(p)) ELSE 0 END FROM p)), 6) AS t),
w AS (SELECT source, tokens, pow(p, t) / sum(pow(p, t)) OVER () AS weight FROM p, t),
q AS (SELECT source, tokens, weight, weight * (SELECT max(tokens / weight) FROM w) AS quota FROM w),
plan AS (SELECT source, weight, floor(quota / tokens + 1e-9) AS epochs, greatest(0, floor(quota - floor(quota / tokens + 1e-9) * tokens + 1e-6)) AS rest FROM q),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY h) AS upto FROM d)
SELECT doc_id, run.source, n_tokens, round(coalesce(weight, 0), 6) AS weight, coalesce(epochs + (upto <= rest)::INT, 1)::BIGINT AS copies, ('0x' || substr(h, 1, 3))::INT AS block
FROM run LEFT JOIN plan ON run.source IS NOT DISTINCT FROM plan.source
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": OP6_SQL, "op4_substring_dedup": OP4_SQL, "op7_line_dedup": OP7_SQL, "op10_decontaminate": OP10_SQL}
