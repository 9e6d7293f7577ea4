"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Rows stay distributed: no edge or label reaches the driver. A hub's edges meet only in a minimum, which is
combined before the shuffle, and in a join whose skewed side Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialise


def _lowest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _star(pairs: DataFrame, centres: DataFrame) -> DataFrame:
    """Link v to the lowest of u's neighbourhood, for every pair (u, v)."""
    joined = pairs.join(centres.select(F.col("u").alias("c"), "m"), F.col("u") == F.col("c"))
    kept = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    centre = centres.select("u", F.col("m").alias("v"))
    return kept.unionByName(centre).where("u != v").distinct()


def _mark(pairs: DataFrame) -> tuple:
    """Equal for equal sets of pairs: their number and two sums of hashes."""
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit("salt"), "u"))).first())


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """edges (a, b) of longs to (node, component): the smallest node that each linked node reaches, for all but those
    smallest. The result is a written table, which discard() removes. Loops and repeated edges count for nothing."""
    state = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    before = _mark(state)
    for _ in range(most if before[0] else 0):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written before the join, so that the join is of two plain shuffles and a hub's part can be split.
        lowest = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")
        large = _star(both.where("v > u"), lowest)  # every larger neighbour hangs on the lowest one
        down = materialise(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "large-stars")
        discard(state, lowest)
        lowest = materialise(_lowest(down), "lowest")
        state = materialise(_star(down, lowest).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
        discard(down, lowest)
        now = _mark(state)
        if now == before:
            out = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out._stored_at = state._stored_at
            return out
        before = now
    if before[0]:
        raise RuntimeError("components did not settle")
    out = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out._stored_at = state._stored_at
    return out
