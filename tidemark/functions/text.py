"""Text functions, in the JVM save for HTML entities.

White space is what Python's str.isspace has, spelled out, as the regular expressions of the JVM and of Python differ.
"""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space, quote lines, addresses and the escapes of marks.
#: The 29 white-space code points, as the inside of a character class.
WS = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, f"^[{WS}]+|[{WS}]+$", "") if isinstance(col, Column) else strip(F.col(col))


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html.unescape(x) if x is not None and "&" in x else x)


def html_unescape(col: Column) -> Column:
    """Every HTML5 character reference, with and without its semicolon. Arrow batches."""
    return _unescape(col)


def without_quotes_and_urls(col: Column) -> Column:
    """Quoted lines go before references are decoded, so that an escaped '>' at a line's start survives."""
    quoted = F.regexp_replace(F.coalesce(col, F.lit("")), f"(?md)^[{WS}]*>.*$", " ")
    return F.regexp_replace(quoted, f"https?://[^{WS}]+", " ")


def without_marks(col: Column) -> Column:
    """Backslash escapes undone, '*' and '#' dropped, white space collapsed and stripped."""
    plain = F.regexp_replace(col, r"\\([\\`*_{}\[\]()#+\-.!>])", "$1")
    return F.trim(F.regexp_replace(F.translate(plain, "*#", ""), f"[{WS}]+", " "))


def clean_body(col: Column, entities: bool = True) -> Column:
    """The cleaned text of a comment; entities=False leaves character references alone and stays in the JVM."""
    bare = without_quotes_and_urls(col)
    return without_marks(html_unescape(bare) if entities else bare)


def word_count(clean: Column) -> Column:
    """Words of a text that is already clean. The text is named once, so that what makes it is computed once."""
    return F.regexp_count(clean, F.lit("[^ ]+"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, computed once a row whatever uses them after: filters on them aren't pushed through the
    generator that makes them, where a projection would be copied into the filter."""
    made = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select("*", F.inline(made))


def slug(col: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(col, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))


def norm(col: Column) -> Column:
    """Lower case, punctuation collapsed to single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "[^a-z0-9]+", " "))


def holds_phrase(hay: Column, phrase: Column) -> Column:
    return F.contains(hay, phrase)


def holds_all_tokens(hay: Column, phrase: Column) -> Column:
    return F.forall(F.split(phrase, " "), lambda t: F.contains(hay, t))


def preview(col: Column, n: int = 80) -> Column:
    return F.substring(col, 1, n)
