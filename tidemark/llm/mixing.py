"""Mixing sources to target weights by temperature, in DataFrame operations only.

A source with a share p of all tokens gets a weight in proportion to p^t. The exponent t is bisected: the largest in
[0, 1] whose weights reach a target entropy, raised as far as a limit on the repetition of any source demands. The
weights become token quotas under a budget. A quota is whole epochs of the source and a rest; the rest is filled
from a permutation of the source's documents. The permutation is by hash: blocks are the cells of a hash prefix, in
their order, each permuted by the digits that follow. So the cut needs sums over cells, at most 4,096 of a source in
a window, then cells of the one cell in which the cut falls, then the documents of one small cell.

Defined results: a null text has no tokens; documents without tokens are in every epoch and cost nothing; a null
source is a source of its own; a source without tokens has weight 0 and one epoch; rows that repeat a doc_id, or have
none, share a hash and are drawn or left together; a very long text counts like any other, in one piece; an empty
table gives an empty result; the id, the source and the text alone are read, under names of the operator's own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialise

ENTROPY, REPEATS, SEED = 0.98, 4.0, 17
#: Points in an interval per pass, passes, and the digits that the exponent is rounded to.
POINTS, PASSES, DIGITS = 63, 4, 6


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t-\r]+")).cast("long")


def sums_at(sources: DataFrame, low: float, high: float) -> list[tuple[float, float, float, float, float]]:
    """At each of POINTS exponents inside (low, high) and at its ends: (t, Z, entropy, least and greatest p^(t-1))."""
    steps = POINTS + 1
    t = F.lit(low) + F.col("i") * F.lit((high - low) / steps)
    rows = sources.select("p", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i")).withColumn("t", t)
    power = F.pow("p", F.col("t"))
    out = rows.groupBy("i", "t").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("s"), F.min(F.pow("p", F.col("t") - 1)).alias("low"), F.max(F.pow("p", F.col("t") - 1)).alias("high"))
    got = out.orderBy("i").collect()  # POINTS + 2 rows, however many sources there are
    return [(r["t"], r["z"], math.log(r["z"]) - r["t"] * r["s"] / r["z"], r["low"], r["high"]) for r in got]


def _bisect(sources: DataFrame, holds, low: float = 0.0, high: float = 1.0) -> tuple[float, float]:
    """holds(row) is true below some exponent and false above it: the last point where it is true, and the next."""
    for _ in range(PASSES):
        rows = sums_at(sources, low, high)
        true = [r[0] for r in rows if holds(r)]
        if not true:
            return rows[0][0], rows[0][0]
        low = true[-1]
        after = [r[0] for r in rows if r[0] > low]
        if not after:
            return low, low
        high = after[0]
    return low, high


def exponent(sources: DataFrame, total: int, n: int, entropy: float, repeats: float, budget: int | None) -> float:
    """The exponent, rounded: the entropy's, or the higher one that keeps to the repetition limit."""
    if n < 2:
        return 1.0
    goal = entropy * math.log(n)
    t_entropy = _bisect(sources, lambda r: r[2] >= goal)[0]
    # Without a budget the least repeated source is taken once; with one, an epoch of i repeats w_i budget / tokens_i.
    times = (lambda r: r[4] / r[3]) if budget is None else (lambda r: r[4] / r[1] * budget / total)
    t_repeats = _bisect(sources, lambda r: times(r) > repeats)[1] if times(sums_at(sources, 0.0, 1.0)[0]) > repeats else 0.0
    return round(max(t_entropy, t_repeats), DIGITS)


def placed(id_col: str, source_col: str, seed: int) -> dict[str, Column]:
    """A document's source key and its place in the permutation: a digest, whose first digits are the cells."""
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return {"key": key, "h": h, "c1": F.substring(h, 1, 3), "c2": F.substring(h, 4, 3)}


def weights(sized: DataFrame, entropy: float, repeats: float, budget: int | None) -> DataFrame:
    """sized (key, n_tokens, h, c1, c2) to a row a source: (k, weight, epochs, b1, b2, b3)."""
    totals = materialise(sized.groupBy("key").agg(F.sum("n_tokens").alias("tokens")), "sources")
    total, n = totals.where("tokens > 0").agg(F.sum("tokens"), F.count(F.lit(1))).first()
    total = total or 0
    weighed = totals.where("tokens > 0").withColumn("p", F.col("tokens") / F.lit(float(total or 1)))
    if n:
        t = exponent(weighed, total, n, entropy, repeats, budget)
        z, _ = weighed.agg(F.sum(F.pow("p", F.lit(t))), F.count(F.lit(1))).first()
        weighed = weighed.withColumn("weight", F.pow("p", F.lit(t)) / F.lit(z))
        spend = float(budget) if budget is not None else weighed.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0]
    else:
        weighed, spend = weighed.withColumn("weight", F.lit(0.0)), 0.0
    quota = F.col("weight") * F.lit(spend)
    plan = weighed.withColumn("epochs", F.floor(quota / F.col("tokens") + F.lit(1e-9)).cast("long"))
    plan = plan.withColumn("rest", F.greatest(F.lit(0), F.floor(quota - F.col("epochs") * F.col("tokens") + F.lit(1e-6)).cast("long")))
    plan = materialise(plan.select("key", "tokens", "weight", "epochs", "rest"), "plan")
    cuts = cut_points(sized, plan)
    final = materialise(plan.join(cuts, "key", "left").select(F.col("key").alias("k"), "weight", "epochs", "b1", "b2", "b3"), "weights")
    discard(totals, plan, cuts)
    return final


def copies_of(empty: Column) -> Column:
    """How often the mixture holds a document, of the columns of placed() and weights()."""
    in_cell = F.coalesce(F.col("h") <= F.col("b3"), F.lit(False))
    inside = (F.col("c1") < F.col("b1")) | ((F.col("c1") == F.col("b1")) & ((F.col("c2") < F.col("b2")) | ((F.col("c2") == F.col("b2")) & in_cell)))
    copies = F.when(F.col("weight").isNull(), F.lit(1)).otherwise(F.col("epochs") + F.coalesce(inside, F.lit(False)).cast("long"))
    return F.when(empty, F.greatest(copies, F.lit(1))).otherwise(copies).cast("long")


def sized_docs(docs: DataFrame, seed: int, id_col: str, source_col: str, text_col: str) -> DataFrame:
    at = placed(id_col, source_col, seed)
    return materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), tokens(F.col(text_col)).alias("n_tokens"), *[c.alias(k) for k, c in at.items()]), "sized")


def mix(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, n_tokens, weight, copies, block) for each row of docs.

    copies is how often the mixture holds the document; block is its place among the 4,096 blocks of a permutation.
    The budget is in tokens; None is the least with which every document is held at least once."""
    sized = sized_docs(docs, seed, id_col, source_col, text_col)
    out = sized.join(weights(sized, entropy, repeats, budget), F.col("key") == F.col("k"), "left")
    return out.select("doc_id", "source", "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), copies_of(F.col("n_tokens") == 0).alias("copies"), F.conv("c1", 16, 10).cast("int").alias("block"))


def _cut(cells: DataFrame, by: list[str], cell: str, rest: str) -> DataFrame:
    """The first cell whose running sum exceeds the rest, and what is left of the rest before it."""
    w = Window.partitionBy(*by).orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
    run = cells.withColumn("upto", F.sum("size").over(w)).where(F.col("upto") > F.col(rest))
    first = run.groupBy(*by).agg(F.min(F.struct(cell, "upto", "size", rest)).alias("x"))
    return first.select(*by, F.col(f"x.{cell}").alias(cell), (F.col(f"x.{rest}") - F.col("x.upto") + F.col("x.size")).alias(rest))


def cut_points(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(key, b1, b2, b3): a source's rest ends in cell b1, in that at b2, in that with the hash b3 (null: before all)."""
    rests = plan.select(F.col("key").alias("k"), "rest")
    cells = sized.groupBy("key", "c1").agg(F.sum("n_tokens").alias("size"))
    one = _cut(cells.join(rests, F.col("key") == F.col("k")), ["key"], "c1", "rest")
    one = materialise(one.select(F.col("key").alias("k"), F.col("c1").alias("b1"), F.col("rest").alias("rest1")), "cut-1")
    inner = sized.join(one, (F.col("key") == F.col("k")) & (F.col("c1") == F.col("b1")))
    cells = inner.groupBy("key", "b1", "c2").agg(F.sum("n_tokens").alias("size"), F.min("rest1").alias("rest1"))
    two = _cut(cells, ["key", "b1"], "c2", "rest1")
    two = materialise(two.select(F.col("key").alias("k"), "b1", F.col("c2").alias("b2"), F.col("rest1").alias("rest2")), "cut-2")
    last = sized.join(two, (F.col("key") == F.col("k")) & (F.col("c1") == F.col("b1")) & (F.col("c2") == F.col("b2")))
    # Rows of one hash (a repeated id, or none) are summed up first, so that the window has a row a hash.
    each = last.groupBy("key", "b1", "b2", "h").agg(F.sum("n_tokens").alias("n_tokens"), F.min("rest2").alias("rest2"))
    w = Window.partitionBy("key", "b1", "b2").orderBy("h")
    fits = each.withColumn("upto", F.sum("n_tokens").over(w)).where(F.col("upto") <= F.col("rest2")).groupBy("key").agg(F.max("h").alias("b3"))
    out = materialise(two.join(fits.withColumnRenamed("key", "fk"), F.col("k") == F.col("fk"), "left").select(F.col("k").alias("key"), "b1", "b2", "b3"), "cuts")
    discard(one, two)
    return out


def draws(mixed: DataFrame, seed: int = SEED) -> DataFrame:
    """A row for each copy: (doc_id, source, epoch, place); the rows by epoch and place are the training order."""
    out = mixed.where("copies > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("epoch"))
    return out.withColumn("place", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch"), F.col("doc_id"))))


def stage(docs: DataFrame) -> DataFrame:
    """As the last stage: the columns of docs with mix_weight and mix_copies; documents that the mixture doesn't hold go.

    Each row is weighed by its own source and place, so null and repeated ids need no join. Null and blank texts have one
    copy at least; no rows give no rows; where docs has a column of one of the two names, ours gets an underscore more."""
    sized = sized_docs(docs, SEED, "doc_id", "source", "text")
    final = weights(sized, ENTROPY, REPEATS, None)
    discard(sized)
    empty = ~F.coalesce(F.col("row.text").rlike(r"[^ \t-\r]"), F.lit(False))
    rows = docs.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in placed("doc_id", "source", SEED).items()])
    held = rows.join(final, F.col("key") == F.col("k"), "left").withColumn("copies", copies_of(empty)).where("copies > 0")
    weight, copies = (free_name(c, docs.columns) for c in ("mix_weight", "mix_copies"))
    return held.select("row.*", F.coalesce("weight", F.lit(0.0)).alias(weight), F.col("copies").alias(copies))


def free_name(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name
