"""Numbers and times: costs, rounding, guarded timestamps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

COST_PER_RUN, COST_PER_ITEM = 0.02, 0.002
AUD_USD = 0.70


def cost(items: Column, runs: Column | int = 1) -> Column:
    """USD: a charge for each run and for each stored item."""
    runs = F.lit(runs) if isinstance(runs, int) else runs
    return runs * COST_PER_RUN + items * COST_PER_ITEM


def to_aud(usd: Column) -> Column:
    return usd / AUD_USD


def round_exact(col: Column, digits: int) -> Column:
    """Half-even on the exact binary value, as Python rounds. For small reports only: it leaves the JVM."""

    @F.pandas_udf("double")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None or x != x else round(x, digits))

    return f(col.cast("double"))


def date_text(col: Column) -> Column:
    return F.substring(col, 1, 10)


def utc_timestamp(col: Column) -> Column:
    """Each value parsed by itself; null for what isn't a date in ISO order (a bare time or year would otherwise pass)."""
    return F.when(col.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(col))


def month_of(col: Column) -> Column:
    return F.date_trunc("month", col).cast("date")


def truthy(col: Column) -> Column:
    """A flag read back from text: true or 1."""
    return F.coalesce(F.lower(col.cast("string")).isin("true", "1"), F.lit(False))
