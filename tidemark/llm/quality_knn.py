"""Quality classifier: nearest-neighbour voting in a latent semantic space.

A text is a bag of hashed terms: its words, the shapes of its words and of neighbouring words, and marks of
repetition. Document frequencies come from all documents. A truncated singular value decomposition of a bounded
sample of labelled documents gives the latent axes. The sample's vectors, of a size fixed by SAMPLE and RANK, are
broadcast; every document meets all of them in exact blocked cosine products, and the labels of its K nearest
vote with weights that grow with similarity.

A text is read by Python once: its counts are written, packed, and the frequencies, the sample and the scores are made
of them.

Defined results: a null or blank text has no terms and no neighbours, and its score is the share of label 1 in the
sample; a null doc_id keeps its row (its text for the fold is empty) and is never learned from; with no label at all
the score is 0.5; labels that repeat a doc_id count once, with the least label, and rows that repeat one are learned
from as one, the one of the least counts; similarities are compared to five decimals, and of neighbours that tie at
the last place those with the smallest doc_id vote; repeated rows have equal scores; a very long text is counted in
segments; an empty table gives an empty result; the columns that are named are read, so no other can clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_batch, id_text_mod, materialise, parts_of, slices
from tidemark.llm.quality_rules import labelled_sample

#: At most so many labelled documents, those with the smallest hash of their id; SAMPLE * RANK floats are broadcast.
SAMPLE, RANK, K = 4_000, 48, 25
SHAPES, PAIRS, MARKS, WORDS = 512, 512, 16, 1024
DIMS = SHAPES + PAIRS + MARKS + WORDS
#: What the words weigh against shapes and marks (before the axes are found).
WORD_WEIGHT = 0.4

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = ord("A"), ord("a"), ord("0"), ord("a")
_CLASS = _CLASS.tobytes()
_RUN = re.compile(rb"(.)\1+", re.S)


class _Terms(dict):
    """word to (hash of its shape, hash of the word) packed in one number; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        shape = xxhash.xxh3_64_intdigest(_RUN.sub(rb"\1", word.translate(_CLASS)))
        x = self[word] = (shape & 0xFFFFFF) << 40 | xxhash.xxh3_64_intdigest(word.lower()) >> 24
        return x


_TERMS = _Terms()


def word_ids(text: bytes, at_once: int = 1 << 20) -> np.ndarray:
    """The packed hashes of a text's words; a long text's words are split up a part at a time."""
    out = []
    for part in parts_of(text, at_once):
        words = part.split()
        out.append(np.fromiter(map(_TERMS.__getitem__, words), np.uint64, len(words)))
    return out[0] if len(out) == 1 else np.concatenate(out)


def term_counts(text: bytes | None) -> np.ndarray:
    """The counts of the hashed terms of one text."""
    out = np.zeros(DIMS)
    ids = word_ids(text or b"")
    n = len(ids)
    if not n:
        return out
    shape, word = ids >> np.uint64(40), ids & np.uint64(0xFFFFFFFFFF)
    out[:SHAPES] = np.bincount((shape % SHAPES).astype(np.int64), minlength=SHAPES)
    pair = (shape[1:] * np.uint64(31) + shape[:-1]) % np.uint64(PAIRS)
    out[SHAPES : SHAPES + PAIRS] = np.bincount(pair.astype(np.int64), minlength=PAIRS)
    marks = out[SHAPES + PAIRS : SHAPES + PAIRS + MARKS]
    for lag in (1, 2, 3):
        marks[lag] = np.count_nonzero(word[lag:] == word[:-lag])
    if n >= 5:
        five = word[4:].copy()
        for i in range(4):
            five = five * np.uint64(0x9E3779B97F4A7C15) + word[i : n - 4 + i]
        marks[4] = len(five) - len(np.unique(five))
    marks[8 + min(7, int(np.log2(n)) // 2)] = n
    out[-WORDS:] = np.bincount((word % WORDS).astype(np.int64), minlength=WORDS)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of counts to rows of weights: roots of shares times idf, each group of terms of unit length."""
    x = np.sqrt(counts) * idf
    for part, weight in ((slice(0, DIMS - WORDS), 1.0), (slice(DIMS - WORDS, DIMS), WORD_WEIGHT)):
        norm = np.linalg.norm(x[:, part], axis=1, keepdims=True)
        x[:, part] *= weight / np.maximum(norm, 1e-12)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def latent_axes(x: np.ndarray, rank: int, seed: int = 11) -> np.ndarray:
    """The leading right singular vectors, by a randomised range finder with power steps."""
    rng = np.random.default_rng(seed)
    rank = max(1, min(rank, *x.shape))
    q = np.linalg.qr(x.T @ rng.standard_normal((x.shape[0], min(rank + 16, *x.shape))))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :rank]


def packed(counts: np.ndarray) -> bytes:
    """The places that aren't zero, and their counts."""
    at = np.nonzero(counts)[0]
    return at.astype("<u2").tobytes() + counts[at].astype("<u4").tobytes()


def unpacked(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), DIMS))
    for i, raw in enumerate(rows):
        n = len(raw) // 6
        out[i, np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<u4", n, 2 * n)
    return out


def counted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, terms): the packed counts of each text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for piece in slices(batch, 1, 4_000_000):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([packed(term_counts(x.as_py())) for x in piece.column(1)], pa.binary())], ["doc_id", "terms"])

    ready = docs.select("doc_id", F.col(text_col).cast("binary").alias("text"))
    return ready.mapInArrow(by_batch(run), f"doc_id {ready.schema['doc_id'].dataType.simpleString()}, terms binary")


def idf_of(counts: DataFrame) -> np.ndarray:
    """Inverse document frequencies over all documents: each batch sums its own; DIMS + 1 rows reach the driver."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = [np.frombuffer(raw, "<u2", len(raw) // 6) for raw in batch.column(0).to_pylist()]
        df = np.bincount(np.concatenate([np.empty(0, np.uint16), *at]), minlength=DIMS + 1)
        df[-1] = batch.num_rows
        held = np.nonzero(df)[0]
        return pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], ["term", "n"])

    parts = counts.select("terms").mapInArrow(by_batch(run), "term long, n long")
    total = np.zeros(DIMS + 1)
    for term, n in parts.groupBy("term").agg(F.sum("n").alias("n")).collect():
        total[term] = n
    return np.log((1 + total[-1]) / (1 + total[:-1])) + 1


def labelled_counts(counts: DataFrame, labels: DataFrame, sample: int, fold: int, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """Term counts and labels of a bounded sample outside the held-out fold, by doc_id."""
    chosen = F.broadcast(labelled_sample(labels.where(id_text_mod(F.col("doc_id"), folds) != fold), sample))
    found = counts.join(chosen, F.col("doc_id") == F.col("labelled")).groupBy("labelled").agg(F.min(F.struct("label", "terms")).alias("s"))
    got = sorted(found.select("labelled", "s.*").collect(), key=lambda r: r["labelled"])
    return unpacked([bytes(r["terms"]) for r in got]), np.array([r["label"] for r in got], float)


def vote(z: np.ndarray, base: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """For rows of unit vectors the similarity-weighted share of label 1 among the k nearest labelled vectors. Ties at the
    k-th place go to the first of them."""
    sims = np.round(z @ base.T, 5)
    k = min(k, base.shape[0])
    last = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
    above, level = sims > last, sims == last
    room = k - above.sum(axis=1, keepdims=True)
    near = above | (level & (np.cumsum(level, axis=1) <= room))
    weight = np.where(near, np.clip(sims, 0, None).astype(float) ** 8 + 1e-12, 0.0)
    return np.clip(weight @ labels / weight.sum(1), 0, 1)


def score(docs: DataFrame, labels: DataFrame, fold: int = 1, folds: int = 3, sample: int = SAMPLE, rank: int = RANK, k: int = K, block: int = 256) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    spark = docs.sparkSession
    counts = materialise(counted(docs.select("doc_id", "text")), "term-counts")
    idf = idf_of(counts)
    x, y = labelled_counts(counts, labels, sample, fold, folds)
    prior = float(y.mean()) if len(y) else 0.5
    if len(y):
        x = weighted(x, idf)
        axes = latent_axes(x, rank)
        model = spark.sparkContext.broadcast((idf, axes.astype(np.float32), unit(x @ axes), y))
    else:
        model = None

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, block):
            piece = batch.slice(at, block)
            out = np.full(piece.num_rows, prior)
            if model is not None:
                idf, axes, base, y = model.value
                x = unpacked(piece.column(1).to_pylist())
                has = x.any(axis=1)
                if has.any():
                    out[has] = vote(unit(weighted(x[has], idf).astype(np.float32) @ axes), base, y, k)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(out)], ["doc_id", "score"])

    scored = counts.mapInArrow(by_batch(run), f"doc_id {counts.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", (id_text_mod(F.col("doc_id"), folds) == fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
