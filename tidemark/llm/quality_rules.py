"""Quality rules: a decision list learned by sequential covering (after IREP and RIPPER; Cohen, 1995).

A pass over a whole text gives its counts. From the counts of a bounded sample of labelled documents, rules are
learned one after another: a conjunction of thresholds is grown by information gain on two thirds of the sample,
pruned on the rest, and kept if it is precise there; what it covers is set aside. The rules, in order, become one
Spark conditional expression over the counts, so applying them needs no model and no Python.

Defined results: a null text has no words (all counts are zero) and fails the base checks; a null doc_id keeps its
row; rows that repeat a doc_id are judged each for itself, and are learned from as one, the one with the least counts;
a doc_id with several labels has the least; without labels of both kinds the list is empty and only the base checks
decide; of tests with equal gain the first stands, in the order of RATIOS and of thresholds, and a ratio equal to a
threshold meets it; a very long text is one piece, and its windows of words are told apart by numbers, not copies;
an empty table gives an empty result; the columns of docs come back inside ``row``, so no name can clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import by_batch, field_of, hash_sample, parts_of

#: At most so many labelled documents are learned from: those with the smallest hash of their id.
SAMPLE = 20_000
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_POINTS = b".,;:!?"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_points", "n_adjacent")

#: Name to numerator and denominator; a denominator of None is 1.
RATIOS = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols_a_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "point_share": ("n_points", "n_words"),
    "adjacent_share": ("n_adjacent", "n_words"),
}


def repeat_words(word: np.ndarray, size: int = 5) -> int:
    """Words, given as numbers, inside a window of ``size`` words that the text has twice or more, the first included.

    Windows become numbers by ranking pairs: equal windows have equal numbers, without hashing."""
    if len(word) - size + 1 < 2:
        return 0
    rank, have = word, 1
    while have < size:
        step = min(have, size - have)
        pair = rank[:-step] * np.int64(len(word) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        have += step
    again = np.nonzero(np.bincount(rank)[rank] > 1)[0]
    return int(size + np.minimum(np.diff(again), size).sum()) if len(again) else 0


def counts_of(text: bytes | None, at_once: int = 1 << 20) -> tuple[int, ...]:
    """The COUNTS of one text. A long text's words are split up a part at a time, and only their numbers kept."""
    text = text or b""
    known: dict[bytes, int] = {}
    numbers, chars = [], 0
    for part in parts_of(text, at_once):
        words = part.split()
        chars += len(b"".join(words).decode("utf-8", "replace"))
        numbers.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
    word = numbers[0] if len(numbers) == 1 else np.concatenate(numbers)
    lines = [x for x in text.split(b"\n") if x.strip()]
    drop = lambda chars: len(text) - len(text.translate(None, chars))
    return (
        len(word),
        chars,
        drop(_SYMBOLS),
        len(lines) - len(set(lines)),
        repeat_words(word) if len(known) < len(word) else 0,
        len(lines),
        drop(_UPPER),
        drop(_DIGITS),
        drop(_POINTS),
        int(np.count_nonzero(word[1:] == word[:-1])),
    )


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """row (a struct of the columns of docs) and the COUNTS. The text crosses to Python once, inside its row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = field_of(batch.column(0), text_col)
        found = [counts_of(x.as_py()) for x in texts]
        cols = [pa.array([f[i] for f in found], pa.int64()) for i in range(len(COUNTS))]
        return pa.RecordBatch.from_arrays([batch.column(0), *cols], ["row", *COUNTS])

    ready = docs.select(F.struct("*").alias("row"))
    schema = T.StructType([ready.schema["row"], *[T.StructField(c, T.LongType()) for c in COUNTS]])
    return ready.mapInArrow(by_batch(run), schema)


def ratio(name: str) -> Column:
    top, bottom = RATIOS[name]
    return F.col(top).cast("double") / (F.greatest(F.col(bottom), F.lit(1)) if bottom else F.lit(1))


@dataclass
class Rule:
    """A conjunction of (ratio, '<=' or '>=', threshold)."""

    tests: list[tuple[str, str, float]] = field(default_factory=list)

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, op, t in self.tests:
            out &= x[name] <= t if op == "<=" else x[name] >= t
        return out

    def expression(self) -> Column:
        out = F.lit(True)
        for name, op, t in self.tests:
            out = out & (ratio(name) <= t if op == "<=" else ratio(name) >= t)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {op} {t:.6g}" for n, op, t in self.tests)


def _thresholds(x: np.ndarray, most: int = 64) -> np.ndarray:
    values = np.unique(x)
    cuts = (values[1:] + values[:-1]) / 2
    return cuts if len(cuts) <= most else np.unique(np.quantile(cuts, np.linspace(0, 1, most)))


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most_tests: int) -> Rule:
    """Add the test of the highest FOIL gain until only bad rows are covered, or no test gains."""
    rule, covered = Rule(), np.ones(len(bad), bool)
    while len(rule.tests) < most_tests:
        p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
        if not n or not p:
            break
        before, best = np.log2(p / (p + n)), (1e-9, None, None)
        for name, values in x.items():
            v, b = values[covered], bad[covered]
            order = np.argsort(v, kind="stable")
            below_bad = np.concatenate([[0], np.cumsum(b[order])])
            for t in _thresholds(v):
                k = int(np.searchsorted(v[order], t, "right"))
                for op, pos, size in (("<=", below_bad[k], k), (">=", p - below_bad[k], p + n - k)):
                    if pos:
                        gain = pos * (np.log2(pos / size) - before)
                        if gain > best[0]:
                            best = (gain, (name, op, float(t)), None)
        if best[1] is None:
            break
        rule.tests.append(best[1])
        covered &= Rule([best[1]]).covers(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Of the rule's beginnings, the one with the best (p - n) / (p + n) on rows that it wasn't grown on."""

    def worth(r: Rule) -> float:
        c = r.covers(x)
        p, n = int((c & bad).sum()), int((c & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    starts = [Rule(rule.tests[:k]) for k in range(1, len(rule.tests) + 1)]
    return max(starts, key=lambda r: (worth(r), -len(r.tests))) if starts else rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 16, most_tests: int = 3, precision: float = 0.95, least: int = 2, seed: int = 7) -> list[Rule]:
    """Rules for what to reject, in order."""
    rules: list[Rule] = []
    if not len(bad) or bad.all() or not bad.any():
        return rules
    part = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules and (left & part & bad).sum() >= least:
        take = lambda m: ({k: v[m] for k, v in x.items()}, bad[m])
        rule = _prune(_grow(*take(left & part), most_tests), *take(left & ~part))
        c = rule.covers(x) & left
        right, all_of = int((c & bad & ~part).sum()), int((c & ~part).sum())
        if not rule.tests or (c & bad).sum() < least or right < precision * max(all_of, 1) or (c & bad).sum() < precision * c.sum():
            break
        rules.append(rule)
        left &= ~c
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as an ordered conditional: the first rule that holds rejects."""
    out = F
    for r in rules:
        out = out.when(r.expression(), F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def labelled_sample(labels: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(labelled, label): at most ``most`` labelled ids, those with the smallest hash; an id that repeats has its least label."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("labelled")).agg(F.min(F.col(label_col).cast("int")).alias("label"))
    return hash_sample(one, ["labelled"], most)


def learn_from(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """Learn from the documents of a bounded labelled sample: only theirs are counted, and the broadcast is of their ids."""
    chosen = F.broadcast(labelled_sample(labels, sample))
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, F.col("id") == F.col("labelled"))
    seen = with_counts(found).groupBy("row.labelled").agg(F.min(F.struct("row.label", *COUNTS)).alias("s"))
    got = seen.select("labelled", "s.*").select("labelled", "label", *[ratio(r).alias(r) for r in RATIOS]).toPandas().sort_values("labelled")
    return learn({r: got[r].to_numpy(float) for r in RATIOS}, got["label"].to_numpy() == 0)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """row, the COUNTS, base_failed and kept. docs need doc_id and text. Nothing is written: documents are counted as
    they are read."""
    rules = learn_from(docs, labels, sample)
    return with_counts(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """As a filter stage: documents that the base checks or the rules reject go.

    A null or blank text goes; a null doc_id is judged like any other; repeated rows go or stay together; no rows give
    no rows; the columns of docs come back as they were."""
    return judge(docs, labels).where("kept").select("row.*")
