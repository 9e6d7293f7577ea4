"""Line dedup over levelled sorted runs of line hashes.

The index is a log-structured merge tree of bucketed tables. Each batch of documents is reduced to its distinct
line keys, merge-anti-joined with every run, and what no run knows is written as a new sorted run at level 0; a
level that holds ``fanout`` runs is compacted into one run of the next level. All tables have the same bucketing
by hash, so neither the joins nor the compaction of a bucket moves the runs over the network.

Defined results: a null text is one empty line; a null doc_id is below all others; rows that repeat a doc_id count
as one document, and none of the rows with the largest doc_id loses the line; a line that a document repeats counts
once, and all its copies go or stay together; a very long text is one piece, of whose lines only the hashes are
shuffled; an empty table gives an empty result; the columns of docs come back inside ``row``, so no name can clash.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WS, discard, lower_ascii, materialise, new_path, remove

NO_ID = -(2**63)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(WS)))


def line_hash(line: Column) -> Column:
    """128 bits of the key, so that chance collisions play no part even among 10^12 lines."""
    return F.unhex(F.md5(line_key(line)))


def hashes_of(text: Column, min_chars: int) -> Column:
    long = F.filter(lines_of(text), lambda x: F.char_length(F.btrim(x, F.lit(WS))) >= min_chars)
    return F.array_distinct(F.transform(long, line_hash))


class LineRuns:
    """Sorted runs (h, last_doc) with disjoint keys, in levels; tallies (h, docs, last_doc), one per batch."""

    def __init__(self, spark: SparkSession, fanout: int = 3) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.tallies: list[str] = []
        self.paths: dict[str, str] = {}

    def _write(self, df: DataFrame, kind: str) -> str:
        """Rows that come hash-partitioned by h into as many partitions as buckets make one file a bucket."""
        name = f"{kind}_{uuid.uuid4().hex}"
        path = self.paths[name] = new_path(self.spark, name)
        df.write.format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("path", path).saveAsTable(name)
        return name

    def runs(self) -> list[str]:
        return [x for level in self.levels for x in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Keys that no run holds: a chain of merge anti-joins."""
        return reduce(lambda left, run: left.join(self.spark.table(run).select("h").hint("merge"), "h", "left_anti"), self.runs(), keys)

    def add(self, batch: DataFrame) -> str:
        """Take a batch of distinct (doc, h): tally its keys, add those that are new as a run, return the new run's name."""
        tally = batch.groupBy("h").agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("last_doc"))
        self.tallies.append(self._write(tally, "tally"))
        fresh = self.unseen(self.spark.table(self.tallies[-1]).select("h", "last_doc"))
        run = self._write(fresh, "run")
        self.levels[0].append(run)
        self.compact()
        return run

    def compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                parts = [self.spark.table(x) for x in level]
                merged = self._write(reduce(DataFrame.unionByName, parts).repartition(self.buckets, "h"), "run")
                for x in level:
                    self._drop(x)
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k] = []
                self.levels[k + 1].append(merged)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self.paths.pop(name))

    def close(self) -> None:
        """Drop all tables, those of a step that failed too."""
        for name in list(self.paths):
            self._drop(name)

    def frequent(self, min_docs: int) -> DataFrame:
        """Keys of at least min_docs documents and the document that the runs keep for each."""
        tally = reduce(DataFrame.unionByName, [self.spark.table(x).select("h", "docs") for x in self.tallies])
        often = tally.groupBy("h").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
        runs = reduce(DataFrame.unionByName, [self.spark.table(x) for x in self.runs()])
        return runs.join(often, "h").select("h", F.col("last_doc").alias("keeper"), "docs")


def batch_of(docs: DataFrame, n: int) -> Column:
    """The number of a doc's batch, 0 to n - 1, by quantiles of the ids: the highest ids are in the highest batch."""
    cuts = sorted({int(x) for x in docs.approxQuantile("doc", [i / n for i in range(1, n)], 0.01)}) if n > 1 else []
    return reduce(lambda out, c: out + (F.col("doc") >= F.lit(c)).cast("int"), cuts, F.lit(0))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a struct of the columns of docs), n_lines, n_dropped and kept_text: the text without the frequent lines that
    other documents keep. The lines' hashes are taken and written once, by batch; batches are taken from the highest ids
    down, so that a run's holder of a line is the largest document that has it."""
    spark = docs.sparkSession
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    held = docs.select(doc.alias("doc"), F.explode(hashes_of(F.col(text_col), min_chars)).alias("h")).distinct()
    keys = materialise(held.withColumn("batch", batch_of(docs.select(doc.alias("doc")), batches)), "line-keys", ["batch"])
    index = LineRuns(spark, fanout)
    try:
        for k in reversed(range(batches)):
            index.add(keys.where(F.col("batch") == k).select("doc", "h"))
        frequent = materialise(index.frequent(min_docs).select("h", "keeper"), "frequent-lines")
    finally:
        index.close()
    losing = keys.select("doc", "h").join(frequent, "h").where(F.col("doc") != F.col("keeper"))
    lost = materialise(losing.groupBy(F.col("doc").alias("__doc")).agg(F.collect_set("h").alias("__lost")), "lost-lines")
    discard(keys, frequent)
    out = docs.select(F.struct("*").alias("row"), doc.alias("__key"), F.col(text_col).alias("__text")).join(lost.hint("merge"), F.col("__key") == F.col("__doc"), "left")
    return split_lines(out, min_chars)


def split_lines(df: DataFrame, min_chars: int) -> DataFrame:
    """(row, __text, __lost) to (row, n_lines, n_dropped, kept_text). Only texts that lose lines are hashed again."""
    lines = lines_of(F.col("__text"))
    gone = lambda x: (F.char_length(F.btrim(x, F.lit(WS))) >= min_chars) & F.array_contains(F.col("__lost"), line_hash(x))
    kept = F.when(F.col("__lost").isNull(), lines).otherwise(F.filter(lines, lambda x: ~gone(x)))
    cut = df.select("row", F.size(lines).cast("long").alias("n_lines"), kept.alias("kept"))
    return cut.select("row", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))


def stage(docs: DataFrame) -> DataFrame:
    """As a filter stage: each text loses its repeated lines; a document that loses all it has goes.

    Null and blank texts lose nothing and stay as they are; a null doc_id is below all others; repeated rows have equal
    results; n_chars, where docs has it, follows the text; no rows give no rows; the columns of docs keep their names."""
    out = dedup_lines(docs)
    cut = F.col("n_dropped") > 0
    new = {"text": F.when(cut, F.col("kept_text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    left = out.where(~(cut & (F.btrim(F.col("kept_text"), F.lit(WS)) == "")))
    return left.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])
