"""Monthly series and their trends."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.values import month_of


def monthly(df: DataFrame, time_col: str = "created", flag_col: str = "concern_flag", polarity_col: str = "polarity") -> DataFrame:
    """(month, n, concern_share, mean_polarity)."""
    return df.groupBy(month_of(F.col(time_col)).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.avg(flag_col).alias("concern_share"), F.avg(polarity_col).alias("mean_polarity"))


def n_months(series: DataFrame) -> DataFrame:
    return series.agg(F.countDistinct("month").alias("months"))


def _keyed(series: DataFrame, by: list[str] | None) -> tuple[DataFrame, list[str]]:
    """With a constant key where there is one series."""
    return (series, by) if by else (series.withColumn("__all", F.lit(1)), ["__all"])


def _pairs(series: DataFrame, by: list[str], time_col: str, value_col: str) -> DataFrame:
    """Each value with all later ones of its series: a join on the series, of which there is a value a period."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(time_col))
    one = series.select(*by, F.col(value_col).cast("double").alias("y"), place.alias("i"))
    other = one.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("i").alias("j"), F.col("y").alias("z"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    return one.join(other, same & (F.col("i") < F.col("j"))).select(*by, "i", "y", "j", "z")


def mann_kendall(series: DataFrame, time_col: str, value_col: str, by: list[str] | None = None) -> DataFrame:
    """n, S, its variance with the correction for ties, Z with the continuity correction, and the two-sided p."""
    series, key = _keyed(series, by)
    s = _pairs(series, key, time_col, value_col).groupBy(*key).agg(F.sum(F.signum(F.col("z") - F.col("y"))).cast("long").alias("s"))
    times = series.groupBy(*key, F.col(value_col).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("t"))
    counts = times.groupBy(*key).agg(F.sum("t").alias("n"), F.sum(F.col("t") * (F.col("t") - 1) * (2 * F.col("t") + 5)).alias("ties"))
    out = counts.join(s, key)
    n, s_ = F.col("n"), F.col("s")
    out = out.withColumn("var_s", (n * (n - 1) * (2 * n + 5) - F.col("ties")) / 18.0).drop("ties", "__all")
    out = out.withColumn("z", F.when(s_ > 0, (s_ - 1) / F.sqrt("var_s")).when(s_ < 0, (s_ + 1) / F.sqrt("var_s")).otherwise(0.0))

    @F.pandas_udf(T.DoubleType())
    def p_value(z: pd.Series) -> pd.Series:
        return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)))

    return out.withColumn("p", p_value("z"))


def sen_slope(series: DataFrame, time_col: str, value_col: str, by: list[str] | None = None) -> DataFrame:
    """The median of the slopes of all pairs of periods."""
    series, key = _keyed(series, by)
    out = _pairs(series, key, time_col, value_col).groupBy(*key).agg(F.median((F.col("z") - F.col("y")) / (F.col("j") - F.col("i"))).alias("slope"))
    return out.drop("__all")


def segment(y: np.ndarray, penalty: float | None = None, least: int = 2) -> list[int]:
    """Starts of new segments: optimal partition by PELT (Killick et al., 2012) under squared error."""
    n = len(y)
    if n < 2 * least:
        return []
    one, two = np.concatenate([[0], np.cumsum(y)]), np.concatenate([[0], np.cumsum(y * y)])
    penalty = 2 * np.log(n) * max(float(np.median(np.abs(np.diff(y)))) ** 2 / 0.91, 1e-12) if penalty is None else penalty
    cost = lambda a, b: two[b] - two[a] - (one[b] - one[a]) ** 2 / (b - a)
    best, back, live = np.full(n + 1, np.inf), np.zeros(n + 1, int), [0]
    best[0] = -penalty
    for b in range(least, n + 1):
        ready = [a for a in live if b - a >= least]
        total = [best[a] + cost(a, b) + penalty for a in ready]
        k = int(np.argmin(total))
        best[b], back[b] = total[k], ready[k]
        dropped = {a for a, t in zip(ready, total, strict=True) if t - penalty > best[b]}
        live = [a for a in live if a not in dropped] + [b - least + 1]
    out, b = [], n
    while back[b] > 0:
        b = int(back[b])
        out.append(b)
    return out[::-1]


def changepoints(series: DataFrame, by: str, time_col: str, value_col: str, penalty: float | None = None) -> DataFrame:
    """(by, period, mean_before, mean_after): where the mean of a series shifts. A group is one series."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        y, t = pdf["y"].to_numpy(float), pdf["t"].tolist()
        at = segment(y, penalty)
        edges = [0, *at, len(y)]
        rows = [(pdf["g"].iloc[0], t[b], y[edges[i] : b].mean(), y[b : edges[i + 2]].mean()) for i, b in enumerate(at)]
        return pd.DataFrame(rows, columns=["g", "period", "mean_before", "mean_after"])

    rows = series.select(F.col(by).cast("string").alias("g"), F.col(time_col).cast("string").alias("t"), F.col(value_col).cast("double").alias("y"))
    return rows.groupBy("g").applyInPandas(f, "g string, period string, mean_before double, mean_after double").withColumnRenamed("g", by)
