"""Three-class sentiment behind a protocol, with a gate that halts on swapped labels, and a language detector.

The lexicon scorer stands in where no model can be loaded; a model plugs in by the same protocol and is loaded once
in each worker.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import let

#: A placeholder, to be set against labelled data.
CONCERN_THRESHOLD = 0.50
# What the model's labels stand for.
LABEL_MAP = {"LABEL_0": "negative", "LABEL_1": "neutral", "LABEL_2": "positive"}
_GOOD_PROBE = "This is wonderful, I love it, absolutely fantastic."
_BAD_PROBE = "This is terrible, I hate it, absolutely awful."

_GOOD = frozenset("good great love loved lovely like liked nice best better excellent amazing awesome fantastic wonderful happy enjoy enjoyed perfect safe safer helpful useful impressive impressed reliable smooth easy brilliant beautiful win success thank thanks glad positive recommend".split())
_BAD = frozenset("bad worse worst hate hated awful terrible horrible poor sad angry fear afraid scary scared dangerous danger unsafe risk risky crash crashed kill killed die died fail failed failure broken useless stupid scam lie lies wrong problem problems terrified worry worried concern concerned privacy spying annoying disgusting moron idiot worthless pathetic".split())
_NOT = frozenset("not no never n't cannot can't don't doesn't didn't isn't wasn't won't without hardly".split())
_WORD = re.compile(r"[a-z']+")
_LETTERS = re.compile(r"[^\W\d_]+")


class Scorer(Protocol):
    def score(self, texts: list[str]) -> list[tuple[float, float, float]]:
        """P(negative), P(neutral), P(positive) of each text."""


class LexiconScorer:
    """Counts of good and bad words, turned round after a negation, as probabilities."""

    def score(self, texts: list[str]) -> list[tuple[float, float, float]]:
        out = []
        for text in texts:
            good = bad = 0
            turned = 0
            for w in _WORD.findall((text or "").lower()):
                if w in _NOT or w.endswith("n't"):
                    turned = 3
                    continue
                side = (w in _GOOD) - (w in _BAD)
                if turned:
                    side, turned = -side, turned - 1
                good += side > 0
                bad += side < 0
            z = [math.exp(min(bad, 20)), math.exp(1.0), math.exp(min(good, 20))]
            out.append(tuple(x / sum(z) for x in z))
        return out


def check_labels(scorer: Scorer) -> None:
    """Halt unless a good and a bad sentence come out the right way round."""
    good, bad = scorer.score([_GOOD_PROBE, _BAD_PROBE])
    if not (good[2] > good[0] and bad[0] > bad[2]):
        raise ValueError(f"labels are swapped: {good} for a positive sentence, {bad} for a negative one")


def with_scores(df: DataFrame, scorer: Scorer | None = None, text_col: str = "clean_body") -> DataFrame:
    """p_neg, p_neu and p_pos of each text, after the gate."""
    scorer = scorer or LexiconScorer()
    check_labels(scorer)

    @F.pandas_udf("p_neg double, p_neu double, p_pos double")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame(scorer.score(s.tolist()), columns=["p_neg", "p_neu", "p_pos"])

    return df.withColumn("__p", f(F.col(text_col))).select(*df.columns, "__p.*")


class LabelScorer(Protocol):
    labels: list[str]

    def score(self, texts: list[str]) -> list[list[float]]:
        """For each text a probability of each label, in the order of labels."""


class KeywordScorer:
    """Shares of the words that speak for each label, one more counted for each; a label scorer that needs no model."""

    def __init__(self, words: dict[str, frozenset[str]]) -> None:
        self.labels, self.words = list(words), [frozenset(w) for w in words.values()]

    def score(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            said = _LETTERS.findall((text or "").lower())
            hits = [1 + sum(w in s for w in said) for s in self.words]
            out.append([h / sum(hits) for h in hits])
        return out


def with_labels(df: DataFrame, scorer: LabelScorer, text_col: str = "clean_body", threshold: float = 0.5) -> DataFrame:
    """label_scores (label to probability), the best label, and all labels at the threshold or above. The labels are the
    scorer's own, as of a zero-shot model."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([list(map(float, x)) for x in scorer.score(s.tolist())])

    names = F.array(*[F.lit(x) for x in scorer.labels])
    out = df.withColumn("__p", f(F.col(text_col)))
    best = F.element_at(names, F.array_position("__p", F.array_max("__p")).cast("int"))
    over = F.filter(names, lambda x, i: F.element_at(F.col("__p"), i + 1) >= threshold)
    return out.withColumn("label_scores", F.map_from_arrays(names, F.col("__p"))).withColumn("label", best).withColumn("labels", over).drop("__p")


def polarity() -> Column:
    return F.col("p_pos") - F.col("p_neg")


def predicted_class() -> Column:
    """The class of the highest probability; on a tie the first of negative, neutral, positive."""
    n, u, p = F.col("p_neg"), F.col("p_neu"), F.col("p_pos")
    return F.when((n >= u) & (n >= p), "negative").when(u >= p, "neutral").otherwise("positive")


def concern_flag(threshold: float = CONCERN_THRESHOLD) -> Column:
    """NaN is no concern, though it sorts above all numbers."""
    return (~F.isnan("p_neg") & (F.col("p_neg") >= threshold)).cast("int")


def classify(df: DataFrame, scorer: Scorer | None = None, threshold: float = CONCERN_THRESHOLD) -> DataFrame:
    scored = with_scores(df, scorer)
    return scored.withColumn("polarity", polarity()).withColumn("predicted_class", predicted_class()).withColumn("concern_flag", concern_flag(threshold))


#: Common words of each language.
STOP_WORDS = {
    "en": frozenset("the and of to in is that it was for on with as be at by this are from or an not".split()),
    "de": frozenset("der die das und ist nicht ein eine mit von zu den im für auf dem des sich es auch".split()),
    "fr": frozenset("le la les de des et un une est pour dans que qui sur pas avec au du ce il".split()),
    "es": frozenset("el la los las de que y en un una es por con no se del para lo su al".split()),
}


def language_of(col: Column) -> Column:
    """The language with most stop words, by plain counts in the JVM; ties, and texts without any, go to none."""
    listed = sorted(frozenset().union(*STOP_WORDS.values()))
    known = F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(rf"(?<!\p{{L}})({'|'.join(listed)})(?!\p{{L}})"), F.lit(1))
    hits = lambda words: F.array(*[F.struct(F.size(F.filter(words, lambda w: w.isin(*sorted(own)))).alias("n"), F.lit(lang).alias("lang")) for lang, own in STOP_WORDS.items()])
    best = lambda ranked: F.when(ranked[0]["n"] > ranked[1]["n"], ranked[0]["lang"])
    return let(known, lambda words: let(F.sort_array(hits(words), asc=False), best))


def is_english(col: Column) -> Column:
    return F.coalesce(language_of(col) == "en", F.lit(False))


def column_is(lang_col: str, value: str = "en"):
    """A detector that reads a column instead of the text."""
    return lambda _text: F.coalesce(F.col(lang_col) == value, F.lit(False))
