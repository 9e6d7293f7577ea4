"""The sampling frame, date windows, jobs, and what is still to do within a budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import slug
from tidemark.functions.values import cost, truthy

# The study's window, caps and budget.
STUDY_START, STUDY_END = "2016-01-01", "2025-04-30"
PROBE_POSTS, COLLECT_POSTS, POSTS_PER_BLOCK = 100, 100, 3
COMMENTS_PER_POST, COMMENTS_PER_RUN = 15, 1500
BUDGET_USD = 110.00

# The frame, tier to communities and terms.
CORE_TERMS = ["self-driving", "autonomous vehicle", "robotaxi", "Autopilot", "FSD", "Waymo", "V2X", "LiDAR"]
PHRASE_TERMS = ['"self-driving car privacy"', '"autonomous vehicle data"', '"car data collection"', '"connected car security"', '"vehicle tracking"']
TIERS = {
    "Tier 1": (["SelfDrivingCars", "teslamotors", "RealTesla", "Waymo"], CORE_TERMS),
    "Tier 2": (["electricvehicles", "cars", "technology", "Futurology"], CORE_TERMS),
    "Tier 3": (["privacy", "cybersecurity"], CORE_TERMS + PHRASE_TERMS),
}


def frame_tables(spark: SparkSession, tiers: dict[str, tuple[list[str], list[str]]] | None = None) -> tuple[DataFrame, DataFrame]:
    """The communities and the terms of each tier, numbered in their order."""
    tiers = tiers or TIERS
    subs = [(t, s, i) for t, (ss, _) in tiers.items() for i, s in enumerate(ss)]
    terms = [(t, x, i) for t, (_, xs) in tiers.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(subs, "tier string, subreddit string, sub_no int"), spark.createDataFrame(terms, "tier string, term string, term_no int")


def windows(spark: SparkSession, mode: str = "annual", start: str = STUDY_START, end: str = STUDY_END) -> DataFrame:
    """(start, end), both inclusive: calendar blocks clipped to the study's window."""
    if mode == "none":
        return spark.sql(f"SELECT '{start}' AS start, '{end}' AS `end`")
    months = {"annual": 12, "quarterly": 3}.get(mode)
    if months is None:
        raise ValueError(f"mode must be annual, quarterly or none, not {mode!r}")
    return spark.sql(f"""
        SELECT string(greatest(b, date'{start}')) AS start, string(least(add_months(b, {months}) - INTERVAL 1 DAY, date'{end}')) AS `end`
        FROM (SELECT explode(sequence(date_trunc('YEAR', date'{start}')::date, date'{end}', INTERVAL {months} MONTHS)) AS b)
        WHERE add_months(b, {months}) > date'{start}' AND b <= date'{end}'""")


def saturated_pairs(report: DataFrame) -> DataFrame:
    """Distinct (subreddit, term) that the report marks as saturated; none if it lacks the column."""
    if "saturated" not in report.columns:
        return report.sparkSession.createDataFrame([], "subreddit string, term string")
    return report.where(truthy(F.col("saturated"))).select("subreddit", "term").distinct()


def plan_jobs(subs: DataFrame, terms: DataFrame, saturated: DataFrame | None, blocks: DataFrame, whole: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """A job for each query, or one for each block of a saturated query. The window tables are single small rows' arrays."""
    frame = subs.join(terms, "tier")
    if only is not None:
        frame = frame.join(only.select("subreddit", "term").distinct(), ["subreddit", "term"], "left_semi")
    if saturated is None:
        frame = frame.withColumn("blocked", F.lit(False))
    else:
        marks = saturated.select("subreddit", "term").distinct().withColumn("hit", F.lit(True))
        frame = frame.join(marks, ["subreddit", "term"], "left").withColumn("blocked", F.coalesce("hit", F.lit(False))).drop("hit")
    spans = lambda df: F.lit(None) if df is None else F.array(*[F.struct(F.lit(r["start"]).alias("start"), F.lit(r["end"]).alias("end")) for r in df.orderBy("start").collect()])
    each = frame.withColumn("w", F.explode(F.when(F.col("blocked"), spans(blocks)).otherwise(spans(whole))))
    return each.select("tier", "subreddit", "term", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "blocked")


def jobs(spark: SparkSession, report: DataFrame | None = None, mode: str = "annual", only: DataFrame | None = None) -> DataFrame:
    """The study's jobs. Without a report, as for the probe, every query has the whole window."""
    subs, terms = frame_tables(spark)
    return plan_jobs(subs, terms, None if report is None else saturated_pairs(report), windows(spark, mode), windows(spark, "none"), only)


def job_file(subreddit: str = "subreddit", term: str = "term"):
    """A job's file name. A quoted term has the name of the bare one; job_key tells them apart."""
    return F.concat(slug(F.col(subreddit)), F.lit("__"), slug(F.col(term)), F.lit("__"), F.col("start"), F.lit("_"), F.col("end"), F.lit(".json"))


def recovery_file(subreddit: str = "subreddit", term: str = "term"):
    return F.concat(slug(F.col(subreddit)), F.lit("__"), slug(F.col(term)), F.lit("__recovery.json"))


def job_key():
    return F.sha2(F.to_json(F.struct("tier", "subreddit", "term", "start", "end")), 256)


def todo(jobs: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return jobs.join(done, key, "left_anti")


def finished(jobs: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return jobs.join(done, key, "left_semi")


def spent(log: DataFrame) -> DataFrame:
    """One row: the log's sum of est_usd, 0 for an empty log."""
    return log.agg(F.coalesce(F.sum("est_usd"), F.lit(0.0)).alias("spent"))


#: Cells that a running sum is cut into, and rows that the cuts are taken from.
_CELLS, _CUT_ROWS = 64, 4096


def _cell(rows: DataFrame, order: list[str]) -> Column:
    """The number of a row's cell: cells follow the order, and hold like numbers of rows. The cuts are taken from a bounded
    sample, those rows with the smallest hash."""
    some = rows.select(*order).orderBy(F.xxhash64(*order), *order).limit(_CUT_ROWS)
    held = [tuple(r) for r in some.orderBy(*order).collect()]
    cuts = sorted({i * len(held) // _CELLS for i in range(1, _CELLS)} - {0})
    kinds = [rows.schema[c].dataType for c in order]
    at = F.struct(*order)
    bounds = [F.struct(*[F.lit(v).cast(k).alias(c) for v, k, c in zip(held[i], kinds, order, strict=True)]) for i in cuts]
    return reduce(lambda n, bound: n + (at >= bound).cast("int"), bounds, F.lit(0))


def running_sum(rows: DataFrame, order: list[str], col: str, name: str) -> DataFrame:
    """rows with the sum of col over all rows up to each one: the sums of whole cells before its own, of which there are
    few, and a sum inside its cell. No task has to see all rows."""
    celled = rows.withColumn("__cell", _cell(rows, order))
    totals = celled.groupBy(F.col("__cell").alias("__c")).agg(F.sum(col).alias("__total"))
    earlier = F.coalesce(F.sum("__total").over(Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = totals.select("__c", earlier.alias("__before"))  # a row a cell
    inside = F.sum(col).over(Window.partitionBy("__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = celled.withColumn("__inside", inside).join(F.broadcast(before), F.col("__cell") == F.col("__c"))
    return out.withColumn(name, F.col("__before") + F.col("__inside")).drop("__cell", "__c", "__before", "__inside")


def affordable(jobs: DataFrame, order: list[str], cost_col: str, already: float, cap: float) -> DataFrame:
    """Jobs in order, until what is spent before one has reached the cap. The last may overshoot. The order is total."""
    spent_before = F.lit(already) + F.col("__upto") - F.col(cost_col)
    return running_sum(jobs, order, cost_col, "__upto").withColumn("spent_before", spent_before).drop("__upto").where(F.col("spent_before") < cap)


def affordable_ahead(jobs: DataFrame, order: list[str], ceiling_col: str, already: float, cap: float) -> DataFrame:
    """Jobs in order, up to the first whose ceiling would carry the sum over the cap."""
    summed = running_sum(jobs, order, ceiling_col, "__upto")
    stop = summed.where(F.lit(already) + F.col("__upto") > cap).agg(F.min(F.struct(*order)).alias("at"))
    kept = summed.join(F.broadcast(stop), F.col("at").isNull() | (F.struct(*order) < F.col("at")))  # stop is one row
    return kept.drop("__upto", "at")


def first_live(jobs: DataFrame, order: list[str], n: int = 1) -> DataFrame:
    return jobs.orderBy(*order).limit(n)


def distinct_queries(jobs: DataFrame) -> DataFrame:
    """Number of distinct (subreddit, term) by blocked."""
    return jobs.groupBy("blocked").agg(F.countDistinct(F.struct("subreddit", "term")).alias("queries"))


def completion(jobs: DataFrame, state_col: str = "state") -> DataFrame:
    return jobs.groupBy(state_col).agg(F.count(F.lit(1)).alias("jobs"))


def remaining_budget(jobs: DataFrame, est_col: str, already: float, cap: float) -> DataFrame:
    """One row: the estimate, the ratio to what is left, whether it is over."""
    left = max(cap - already, 0.01)
    return jobs.agg(F.coalesce(F.sum(est_col), F.lit(0.0)).alias("estimate")).select("estimate", (F.col("estimate") / left).alias("ratio"), (F.col("estimate") > cap - already).alias("over"))


#: Stored comments for each collected post, as observed.
COMMENTS_A_POST = 9.4


def ceiling(jobs: DataFrame, posts: int = COLLECT_POSTS) -> DataFrame:
    """With the most that each job can cost: its posts, and comments up to the cap of a run."""
    most = min(COMMENTS_PER_RUN, posts * COMMENTS_PER_POST)
    return jobs.withColumn("ceiling_usd", cost(F.lit(posts + most)))


def posts_ceiling(jobs: DataFrame, posts: int = PROBE_POSTS) -> DataFrame:
    """One row: the jobs of a probe or of a phrase test, which store posts alone, and the most that they can cost."""
    n = F.count(F.lit(1))
    return jobs.agg(n.alias("jobs"), cost(posts * n, n).alias("ceiling_usd"))


def recovery_ceiling(batches: DataFrame, targets_col: str = "n_targets") -> DataFrame:
    """One row: batches, their targets, what they will cost as observed, and the most that they can cost."""
    n, targets = F.count(F.lit(1)), F.coalesce(F.sum(targets_col), F.lit(0))
    return batches.agg(n.alias("batches"), targets.alias("targets"), cost(targets * (1 + COMMENTS_A_POST), n).alias("modelled_usd"), cost(targets * (1 + COMMENTS_PER_POST), n).alias("ceiling_usd"))


def tail_checks(held: DataFrame, start: str = STUDY_START) -> DataFrame:
    """held (tier, subreddit, term, earliest) as rows of (key..., ok): the earliest post must come after the window's start."""
    return held.select("tier", "subreddit", "term", "earliest", F.coalesce(F.col("earliest") > F.lit(start), F.lit(False)).alias("ok"))


def backfill_jobs(held: DataFrame, start: str = STUDY_START, expected: int | None = None) -> DataFrame:
    """held (tier, subreddit, term, earliest) to jobs over the tail before the earliest post that is held.

    Stops where a query has no tail, or where there aren't as many jobs as expected: none is left out in silence."""
    bad = tail_checks(held, start).where("NOT ok").limit(10).collect()
    if bad:
        raise ValueError("; ".join(f"earliest post {r['earliest']} of {r['tier']}, {r['subreddit']}, {r['term']} is not after {start}" for r in bad))
    if expected is not None and (n := held.count()) != expected:
        raise ValueError(f"{n} jobs, not {expected}")
    return held.select("tier", "subreddit", "term", F.lit(start).alias("start"), F.col("earliest").alias("end"), F.lit(False).alias("blocked"))
