"""Does a search honour phrases? Shares of posts that hold a phrase or all its tokens, and overlap with a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import holds_all_tokens, holds_phrase, norm, preview, with_once


def _share(top, bottom):
    return F.coalesce(F.try_divide(100.0 * top, bottom), F.lit(0.0))


def precision(arms: DataFrame, posts: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """arms (arm, phrase) and posts (arm, parsedId, title, body) to a row an arm, unrounded. An arm without posts has zeros."""
    wanted = arms.select("arm", norm(F.col("phrase")).alias("phrase"))
    hay = norm(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))))
    seen = with_once(posts.join(wanted, "arm"), hay=hay)
    counted = seen.groupBy("arm").agg(
        F.count(F.lit(1)).alias("posts"),
        F.count_if(holds_phrase(F.col("hay"), F.col("phrase"))).alias("n_phrase"),
        F.count_if(holds_all_tokens(F.col("hay"), F.col("phrase"))).alias("n_tokens"),
    )
    ids = posts.where(F.coalesce("parsedId", F.lit("")) != "").select("arm", "parsedId").distinct()
    held = (baseline if baseline is not None else ids.limit(0)).select("arm", "parsedId").distinct()
    both = ids.withColumn("got", F.lit(1)).join(held.withColumn("base", F.lit(1)), ["arm", "parsedId"], "full")
    overlap = both.groupBy("arm").agg(F.count("got").alias("n_ids"), F.count("base").alias("baseline_posts"), F.count_if(F.col("got").isNotNull() & F.col("base").isNotNull()).alias("overlap"))
    out = wanted.select("arm").join(counted, "arm", "left").join(overlap, "arm", "left").na.fill(0)
    return out.select(
        "arm",
        "posts",
        _share(F.col("n_phrase"), F.col("posts")).alias("phrase_pct"),
        _share(F.col("n_tokens"), F.col("posts")).alias("alltok_pct"),
        "baseline_posts",
        "overlap",
        _share(F.col("overlap"), F.col("n_ids")).alias("overlap_pct"),
    )


def first_titles(posts: DataFrame, n: int = 8) -> DataFrame:
    """The first titles of each arm in the order of reading, cut to 88 characters. A task sends n rows of an arm at most."""
    place = F.row_number().over(Window.partitionBy("arm").orderBy("file_name", "pos")) - 1
    first = posts.withColumn("place", place).where(F.col("place") < n)
    return first.select("arm", "place", preview(F.coalesce("title", F.lit("")), 88).alias("title"))


#: Words of a run by which phrases and texts meet.
GRAM = 4


def holding(texts: DataFrame, phrases: DataFrame, gram: int = GRAM) -> DataFrame:
    """texts (id, hay) and phrases (phrase_id, phrase), both normalised, to (phrase_id, id): the texts that hold a whole
    phrase as whole words. Blank phrases are in none.

    Runs of words are joined, not texts with phrases: a phrase goes by its first words, ``gram`` or as many as it has, and
    a text by its runs of the lengths that phrases need, each once. What meets is then compared whole."""
    word = F.split("phrase", " ")
    size = F.least(F.size(word), F.lit(gram))
    wanted = phrases.where(F.coalesce("phrase", F.lit("")) != "").select("phrase_id", "phrase", size.alias("size"), F.array_join(F.slice(word, 1, size), " ").alias("run"))
    sizes = sorted(r["size"] for r in wanted.select("size").distinct().collect())  # gram values at most
    if not sizes:
        return texts.select(F.lit(None).cast(phrases.schema["phrase_id"].dataType).alias("phrase_id"), "id").limit(0)
    words = F.col("__words")

    def runs_of(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, each).otherwise(F.array().cast("array<string>"))

    split = with_once(texts.where(F.coalesce("hay", F.lit("")) != "").select("id", "hay"), __words=F.split("hay", " "))
    held = split.select("id", F.explode(F.array_distinct(F.flatten(F.array(*[runs_of(n) for n in sizes])))).alias("held"))
    near = held.join(wanted, F.col("held") == F.col("run")).select("id", "phrase_id", "phrase")
    hay = texts.select(F.col("id").alias("__id"), F.concat(F.lit(" "), "hay", F.lit(" ")).alias("__hay"))
    whole = F.contains("__hay", F.concat(F.lit(" "), "phrase", F.lit(" ")))
    return near.join(hay, F.col("id") == F.col("__id")).where(whole).select("phrase_id", "id").distinct()


def interpretation(result: DataFrame, control: str = "A", test: str = "B", mechanism: str = "C", by: list[str] | None = None) -> DataFrame:
    """One row (or one a test): what the arms say about quoting, and about the mechanism if its arm was run."""
    of = lambda arm, col: F.max(F.when(F.col("arm") == arm, F.col(col)))
    row = result.groupBy(*by or []).agg(of(control, "posts").alias("a_posts"), of(control, "overlap_pct").alias("a_overlap"), of(test, "phrase_pct").alias("b_phrase"), of(mechanism, "phrase_pct").alias("c_phrase"))
    verdict = (
        F.when(F.col("a_posts").isNull() | F.col("b_phrase").isNull(), "incomplete")
        .when(F.col("a_posts") == 0, "quotes break the query")
        .when((F.col("a_overlap") >= 90) & (F.col("b_phrase") < 20), "quotes are ignored")
        .when(F.col("b_phrase") >= 80, "quotes work")
        .otherwise("mixed")
    )
    loose = F.when(F.col("c_phrase").isNull(), None).when(F.col("c_phrase") >= 60, "loose fallback").otherwise("limit of multi-word matching")
    return row.select(*by or [], verdict.alias("quoting"), loose.alias("mechanism"))
