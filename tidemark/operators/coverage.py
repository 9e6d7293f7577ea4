"""What was expected against what is held: set algebra over ids, recovery batches, the manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.frame import COMMENTS_PER_POST, COMMENTS_PER_RUN


def flagged(sets: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """The union of id sets with a flag for each: one shuffle of all ids, whatever the number of sets."""
    marked = [df.select(*key, *[F.lit(n == name).alias(n) for n in sets]) for name, df in sets.items()]
    return reduce(DataFrame.unionByName, marked).groupBy(*key).agg(*[F.max(n).alias(n) for n in sets])


def coverage(probe: DataFrame, original: DataFrame, backfill: DataFrame, by: list[str] | None = None, id_col: str = "id") -> DataFrame:
    """The eight counts of a probe's ids against the original and backfilled ones, overall or by query."""
    by = by or []
    f = flagged({"probe": probe, "original": original, "backfill": backfill}, [*by, id_col])
    p, o, b = F.col("probe"), F.col("original"), F.col("backfill")
    counts = {
        "probe": p,
        "original": o,
        "backfill": b,
        "overlap": p & o,
        "recovered": p & ~o & b,
        "represented": p & (o | b),
        "unaccounted": p & ~o & ~b,
        "new": b & ~o,
    }
    return f.groupBy(*by).agg(*[F.count_if(c).alias(f"n_{k}") for k, c in counts.items()])


def missing(probe: DataFrame, held: DataFrame, key: list[str]) -> DataFrame:
    """Probe posts that the query's own collection lacks."""
    return probe.join(held.select(*key).distinct(), key, "left_anti")


def present_elsewhere(targets: DataFrame, baseline: DataFrame, id_col: str = "post_id") -> DataFrame:
    """targets with whether any file of the baseline has the post, and whether it must be recovered."""
    ids = baseline.select(F.col(id_col).alias("__id")).distinct()
    out = targets.join(ids, targets[id_col] == ids["__id"], "left")
    out = out.withColumn("baseline_present_elsewhere", F.col("__id").isNotNull()).drop("__id")
    return out.withColumn("recovery_required", ~F.col("baseline_present_elsewhere"))


def address_matches_id(url: str = "post_url", post_id: str = "post_id"):
    bare = F.lower(F.regexp_replace(F.col(post_id), "^t3_", ""))
    return F.contains(F.lower(F.col(url)), F.concat(F.lit("/comments/"), bare, F.lit("/")))


#: Targets whose comments a run may store: a batch of more is too large to be sent.
TARGETS_A_RUN = COMMENTS_PER_RUN // COMMENTS_PER_POST


def batches(targets: DataFrame, by: list[str], most: int = TARGETS_A_RUN) -> DataFrame:
    """A batch a query: its targets by time and id, with caps of its own size; smallest batches first.

    ``too_large`` and ``repeated_urls`` say if a batch isn't sound. The targets are listed of batches that a run can
    take, and so at most ``most``; a larger one has its counts, its first and its last target."""
    made = F.coalesce("probe_created_at", F.lit(""))
    one = F.struct(made.alias("made"), "post_id", "post_url")
    counts = targets.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_targets"),
        F.countDistinct("post_url").alias("__urls"),
        F.min(one).alias("__first"),
        F.max(one).alias("__last"),
    )
    place = F.row_number().over(Window.partitionBy(*by).orderBy(made, "post_id", "post_url"))
    few = targets.withColumn("__n", place).where(F.col("__n") <= most).groupBy(*by).agg(F.sort_array(F.collect_list(one)).alias("targets"))
    renamed = few.withColumnsRenamed({c: f"__{c}" for c in by})
    out = counts.join(renamed, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])).drop(*[f"__{c}" for c in by])
    large = F.col("n_targets") > most
    out = out.withColumn("targets", F.when(~large, F.col("targets"))).withColumn("urls", F.col("targets.post_url"))
    out = out.withColumn("max_posts", F.col("n_targets")).withColumn("max_comments", F.col("n_targets") * COMMENTS_PER_POST)
    out = out.withColumn("too_large", large).withColumn("repeated_urls", F.col("__urls") < F.col("n_targets"))
    out = out.withColumn("first_url", F.col("__first.post_url")).withColumn("last_url", F.col("__last.post_url")).drop("__urls", "__first", "__last")
    return out.orderBy("n_targets", *[F.lower(c) if c != "tier" else F.col(c) for c in by])


def batch_states(targets: DataFrame, returned: DataFrame, by: list[str], id_col: str = "post_id") -> DataFrame:
    """By batch: recovered, missing and extra ids, and PENDING, DONE or PARTIAL. A batch without output is pending."""
    f = flagged({"wanted": targets, "returned": returned}, [*by, id_col])
    w, r = F.col("wanted"), F.col("returned")
    counts = f.groupBy(*by).agg(F.count_if(w).alias("n_targets"), F.count_if(w & r).alias("n_recovered"), F.count_if(w & ~r).alias("n_missing"), F.count_if(r & ~w).alias("n_extra"), F.count_if(r).alias("n_returned"))
    state = F.when(F.col("n_returned") == 0, "PENDING").when(F.col("n_missing") == 0, "DONE").otherwise("PARTIAL")
    return counts.where("n_targets > 0").withColumn("state", state)


def manifest(targets: DataFrame, outputs: DataFrame, returned: DataFrame, by: list[str]) -> DataFrame:
    """targets (with baseline_present_elsewhere), each with its status.

    outputs has the queries whose recovery file exists; returned the ids in it."""
    done = outputs.select(*by).distinct().withColumn("__done", F.lit(True))
    got = returned.select(*by, "post_id").distinct().withColumn("__got", F.lit(True))
    rows = targets.join(done, by, "left").join(got, [*by, "post_id"], "left")
    here, done_, got_ = F.col("baseline_present_elsewhere"), F.coalesce("__done", F.lit(False)), F.coalesce("__got", F.lit(False))
    status = F.when(here, "already_present_elsewhere").when(~done_, "pending").when(got_, "recovered").otherwise("unaccounted_in_recovery_file")
    rows = rows.withColumn("recovery_required", ~here).withColumn("recovered_by_direct", ~here & done_ & got_).withColumn("status", status)
    return rows.drop("__done", "__got")


def duplicates(rows: DataFrame, col: str, by: list[str]) -> DataFrame:
    """By group the rows and the distinct values: equal unless some value repeats."""
    return rows.groupBy(*by).agg(F.count(col).alias("n"), F.countDistinct(col).alias("n_distinct")).withColumn("repeated", F.col("n") > F.col("n_distinct"))


def pending_total(pending: DataFrame, values: DataFrame, key: list[str], value_col: str) -> DataFrame:
    """One row: the number of pending keys and the sum of their values; a key without a value adds nothing."""
    rows = pending.select(*key).distinct().join(values.select(*key, value_col), key, "left")
    return rows.agg(F.countDistinct(F.struct(*key)).alias("pending"), F.coalesce(F.sum(value_col), F.lit(0)).alias("total"))


def capped_threads(comments: DataFrame, by: str, order: list[str], most: int = COMMENTS_PER_POST) -> DataFrame:
    """At most so many comments of a thread, the first in order, as a collector stores them. Each task sends at most so
    many rows of a thread, so a thread of any length is no burden."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return comments.withColumn("__n", place).where(F.col("__n") <= most).drop("__n")


#: The lines of a coverage report, in order, and the counts that they show.
COVERAGE_LINES = {
    "n_probe": "distinct ids of the probe",
    "n_original": "distinct ids collected first",
    "n_backfill": "distinct ids of the backfill",
    "n_overlap": "ids of the probe that were collected first",
    "n_recovered": "ids of the probe that the backfill added",
    "n_represented": "ids of the probe held in all",
    "n_unaccounted": "ids of the probe not held",
    "n_new": "ids of the backfill not collected first",
}


def coverage_report(counts: DataFrame, by: list[str]) -> DataFrame:
    """The counts of coverage() as lines: (by..., line, label, n)."""
    lines = F.array(*[F.struct(F.lit(i).alias("line"), F.lit(label).alias("label"), F.col(c).cast("long").alias("n")) for i, (c, label) in enumerate(COVERAGE_LINES.items())])
    return counts.select(*by, F.inline(lines))
