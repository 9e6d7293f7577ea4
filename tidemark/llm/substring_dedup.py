"""Substring dedup: seed and extend.

1. Seeds. Each text is winnowed: of every 20-word window the anchors are its k-grams with the smallest hash, a
   choice that depends on the window's words alone, so equal windows have equal anchors at equal offsets.
2. Join. Anchors found at two places or more, and no others, are joined to the earliest place that has them.
3. Extend. A link is a diagonal: a piece of a text beside a piece of the earliest holder of most of its anchors. From
   the anchors the match is extended word by word to the left and to the right as far as both texts agree; runs of 20
   words or more are repeats. As each piece follows one diagonal, what it shares with other holders is left over.
4. The rest. Windows that a shared anchor stands for and that no extension has settled are met by a hash of their 20
   words; the earliest of equal ones stays. So the choice of diagonals decides the cost, not the result.
5. Overlapping repeats make the maximal repeats, which are cut out.

Exact copies are settled first by the hash of all their words, so that a group of copies brings its words once.
Nothing is compared pair by pair: anchors and windows meet in sums and minima, which are combined before the
shuffle, and in joins of a key's one row with its many, which Spark can split.

Defined results: a null or blank text has no words; a null doc_id is below all others; rows that repeat a doc_id and
have different texts are ordered by a hash of the text (``part``); equal rows have equal results; of equal windows in
one text the first stays; anchors that tie are all kept; a very long text is compared in pieces, and where a piece
ends changes nothing; an empty table gives an empty result; the id and the text alone are read, under names of the
operator's own, so no other column can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_batch, discard, materialise, slices

WINDOW, GRAM = 20, 7
#: Words of a text that follow one diagonal; with them go the words that windows starting there need.
PIECE = 128
NO_ID = -(2**63)
_WORDS_HELD = 1 << 18


class _Hashes(dict):
    """word to its 64-bit hash; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_HELD:
            self.clear()
        x = self[word] = xxhash.xxh3_64_intdigest(word)
        return x


_HASHES = _Hashes()


def _multipliers(seed: int, n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"{seed}:{i}".encode()) | 1 for i in range(n)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_hashes(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i, m in enumerate(_multipliers(seed, size)):
        out += _mix(words[i : i + n] ^ m) * m
    return _mix(out)


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each run of ``width`` values, by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = f(out[:-step] if step else out, out[step:])
        have += step
    return out


def anchors(grams: np.ndarray, per_window: int) -> np.ndarray:
    """The places of the grams that are the smallest of some window of ``per_window`` grams (all places, on a tie)."""
    if len(grams) < per_window:
        return np.empty(0, np.int64)
    least = _sliding(grams, per_window, np.minimum)
    pad = np.zeros(per_window - 1, np.uint64)
    most = _sliding(np.concatenate([pad, least, pad]), per_window, np.maximum)  # of the windows over each gram
    return np.nonzero(most == grams)[0]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def scanned(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc, part, n_words, whole, sha, grams, places): what one pass over the texts gives."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for piece in slices(batch, 2, 8_000_000):
            n_words, whole, sha, grams, places = [], [], [], [], []
            for text in piece.column(2):
                words = (text.as_py() or b"").split()
                joined = b" ".join(words)
                n_words.append(len(words))
                whole.append(xxhash.xxh3_128_digest(joined))
                sha.append(hashlib.sha256(joined).digest())
                g = gram_hashes(word_hashes(words), gram, 1) if len(words) >= window else np.empty(0, np.uint64)
                at = anchors(g, window - gram + 1)
                grams.append(g[at].view(np.int64))
                places.append(at.astype(np.int32))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in places])]).astype(np.int32))
            flat = lambda x, t: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(t)))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array(n_words, pa.int64()), pa.array(whole, pa.binary()), pa.array(sha, pa.binary()), flat(grams, np.int64), flat(places, np.int32)],
                ["doc", "part", "n_words", "whole", "sha", "grams", "places"],
            )

    return docs.mapInArrow(by_batch(run), "doc long, part long, n_words long, whole binary, sha binary, grams array<long>, places array<int>")


def pieces(docs: DataFrame, window: int) -> DataFrame:
    """(doc, part, text, own, other) to (d, p, no, kind, words): the numbered pieces as hashes of their words. own (kind 0)
    has PIECE words and those that its windows need, other (kind 1) as many more as a diagonal may be shifted."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for piece in slices(batch, 2, 4_000_000):
            cols: tuple[list, ...] = ([], [], [], [], [])
            for doc, part, text, own, other in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                words = word_hashes((text or b"").split())
                for kind, numbers in enumerate((own, other)):
                    for no in numbers:
                        for col, x in zip(cols, (doc, part, no, kind, words[no * PIECE : (no + 1 + kind) * PIECE + window - 1].tobytes()), strict=True):
                            col.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["d", "p", "no", "kind", "words"])

    return docs.mapInArrow(by_batch(run), "d long, p long, no int, kind int, words binary")


def runs_of(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    """[from, to) of the runs of at least so many true values."""
    edges = np.diff(np.concatenate([[0], equal.astype(np.int8), [0]]))
    return [(a, b) for a, b in zip(np.nonzero(edges == 1)[0].tolist(), np.nonzero(edges == -1)[0].tolist(), strict=True) if b - a >= least]


def along(words: np.ndarray, other: np.ndarray, shift: int, window: int) -> list[tuple[int, int]]:
    """The maximal matches of words[i] with other[i + shift], as ranges of the starts of whole windows in words."""
    lo, hi = max(0, -shift), min(len(words), len(other) - shift)
    if hi - lo < window:
        return []
    return [(lo + a, lo + b - window + 1) for a, b in runs_of(words[lo:hi] == other[lo + shift : hi + shift], window)]


def followed(links: DataFrame, window: int) -> DataFrame:
    """(doc, part, no, shift, mine, theirs) to (d, p, a, b): starts of repeats in a text, as ranges."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for piece in slices(batch, 5, 4_000_000):
            rows = []
            for doc, part, no, shift, mine, theirs in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                rows += [(doc, part, no * PIECE + a, no * PIECE + min(b, PIECE)) for a, b in along(np.frombuffer(mine, np.uint64), np.frombuffer(theirs, np.uint64), shift, window) if a < PIECE]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], [], []))], ["d", "p", "a", "b"])

    return links.mapInArrow(by_batch(run), "d long, p long, a long, b long")


_RANGES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_RANGE_TYPE = "array<struct<a:long,b:long>>"


def marked(ranges: list[dict] | None, n: int) -> np.ndarray:
    """Which of n places the ranges cover."""
    step = np.zeros(n + 1, np.int64)
    for r in ranges or ():
        step[r["a"]] += 1
        step[r["b"]] -= 1
    return np.cumsum(step)[:n] > 0


def extended(seeded: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc, part, text, seeds, settled) to (doc, place, w1, w2): the windows that a seed is an anchor of and that aren't
    settled, with 128 bits of hash. place is part and start in one number."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for piece in slices(batch, 2, 4_000_000):
            cols: tuple[list, list, list, list] = ([], [], [], [])
            for doc, part, text, seeds, settled in zip(*piece.columns, strict=True):
                words = word_hashes((text.as_py() or b"").split())
                n = len(words) - window + 1
                if n <= 0:
                    continue
                g = gram_hashes(words, gram, 1)
                per = window - gram + 1
                kept = np.full(len(g), np.iinfo(np.uint64).max, np.uint64)
                at = seeds.values.to_numpy()
                kept[at] = g[at]
                # A window is in play if its smallest gram is a seed.
                start = np.nonzero((_sliding(kept, per, np.minimum) == _sliding(g, per, np.minimum)) & ~marked(settled.as_py(), n))[0]
                w1, w2 = gram_hashes(words, window, 2)[start], gram_hashes(words, window, 3)[start]
                cols[0].append(np.full(len(start), doc.as_py(), np.int64))
                cols[1].append(start + (part.as_py() << 32))
                cols[2].append(w1.view(np.int64))
                cols[3].append(w2.view(np.int64))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["doc", "place", "w1", "w2"])

    return seeded.mapInArrow(by_batch(run), "doc long, place long, w1 long, w2 long")


def spans_of(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """The maximal repeats [from, to) that windows at these places (marked true) cover."""
    at = np.nonzero(starts)[0]
    if not len(at):
        return []
    new = np.concatenate([[True], at[1:] > at[:-1] + window])
    last = np.concatenate([new[1:], [True]])
    return list(zip(at[new].tolist(), (at[last] + window).tolist(), strict=True))


def without(text: bytes | None, spans: list[tuple[int, int]]) -> list[bytes]:
    words = (text or b"").split()
    kept, at = [], 0
    for a, b in spans:
        kept += words[at:a]
        at = b
    return kept + words[at:]


def cut_out(docs: DataFrame, window: int) -> DataFrame:
    """(doc, part, text, n_words, starts, settled) to (d, p, spans, cut_sha): the maximal repeats, and the hash of the rest."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for piece in slices(batch, 2, 4_000_000):
            doc, part, texts, sizes, starts, settled = piece.columns
            spans, kept = [], []
            for text, n, at, ranges in zip(texts, sizes.to_pylist(), starts.to_pylist(), settled.to_pylist(), strict=True):
                hit = marked(ranges, n)
                hit[at or []] = True
                spans.append(spans_of(hit, window))
                kept.append(hashlib.sha256(b" ".join(without(text.as_py(), spans[-1]))).hexdigest())
            flat = pa.array([[{"a": a, "b": b} for a, b in x] for x in spans], _RANGES)
            yield pa.RecordBatch.from_arrays([doc, part, flat, pa.array(kept, pa.string())], ["d", "p", "spans", "cut_sha"])

    return docs.mapInArrow(by_batch(run), f"d long, p long, spans {_RANGE_TYPE}, cut_sha string")


def settled_by_extension(ids: DataFrame, linked: DataFrame, window: int) -> DataFrame:
    """linked (doc, part, place, e_doc, e_at) to (d, p, settled): ranges of the starts that extension finds to be repeats.

    Of the diagonals that a piece's anchors give, the one with most is followed, if it is the earliest holder's."""
    later = linked.where((F.col("doc") != F.col("e_doc")) | (F.shiftleft("part", 32) + F.col("place") != F.col("e_at")))
    e_part, e_place = F.shiftright("e_at", 32), F.col("e_at").bitwiseAND(F.lit(2**32 - 1)).cast("int")
    at = later.select("doc", "part", F.floor(F.col("place") / PIECE).cast("int").alias("no"), "e_doc", e_part.alias("e_part"), (e_place - F.col("place")).alias("diagonal"))
    votes = at.groupBy("doc", "part", "no", "e_doc", "e_part", "diagonal").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("doc", "part", "no").agg(F.max(F.struct("n", F.col("e_doc").alias("e"), "e_part", "diagonal")).alias("x"))
    start = F.col("no") * PIECE + F.col("x.diagonal")
    e_no = F.greatest(F.floor(start / PIECE), F.lit(0)).cast("int")
    chosen = materialise(best.select("doc", "part", "no", F.col("x.e").alias("e_doc"), "x.e_part", e_no.alias("e_no"), (start - e_no * PIECE).cast("int").alias("shift")), "diagonals")
    own = chosen.select("doc", "part", F.col("no").alias("own"), F.lit(None).cast("int").alias("other"))
    theirs = chosen.select(F.col("e_doc").alias("doc"), F.col("e_part").alias("part"), F.lit(None).cast("int").alias("own"), F.col("e_no").alias("other"))
    wanted = own.unionByName(theirs).groupBy(F.col("doc").alias("d"), F.col("part").alias("p")).agg(F.collect_set("own").alias("own"), F.collect_set("other").alias("other"))
    wanted = materialise(wanted, "wanted")
    texts = ids.join(wanted, (F.col("doc") == F.col("d")) & (F.col("part") == F.col("p"))).select("doc", "part", "text", "own", "other")
    held = materialise(pieces(texts, window).dropDuplicates(["d", "p", "no", "kind"]), "pieces")
    discard(wanted)
    mine = held.where("kind = 0").select("d", "p", F.col("no").alias("own_no"), F.col("words").alias("mine"))
    other = held.where("kind = 1").select(F.col("d").alias("ed"), F.col("p").alias("ep"), F.col("no").alias("en"), F.col("words").alias("theirs"))
    links = chosen.join(mine, (F.col("doc") == F.col("d")) & (F.col("part") == F.col("p")) & (F.col("no") == F.col("own_no"))).drop("d", "p", "own_no")
    links = links.join(other, (F.col("e_doc") == F.col("ed")) & (F.col("e_part") == F.col("ep")) & (F.col("e_no") == F.col("en")))
    found = followed(links.select("doc", "part", "no", "shift", "mine", "theirs"), window)
    out = materialise(found.groupBy("d", "p").agg(F.collect_list(F.struct("a", "b")).alias("settled")), "settled")
    discard(chosen, held)
    return out


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_words, spans, n_removed, kept_sha256) for each row of docs; spans are the word ranges [a, b) of repeats."""
    text = F.col(text_col).cast("binary")
    part = F.coalesce(F.xxhash64(text), F.lit(0)).bitwiseAND(F.lit(2**31 - 1))
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), part.alias("part"), text.alias("text"))
    seen = materialise(scanned(ids, window, gram), "scanned")
    # The one row of each key is written first: only a join of two plain shuffles has its skewed parts split.
    first = materialise(seen.groupBy(F.col("whole").alias("w")).agg(F.min("doc").alias("first")), "first")
    base = materialise(seen.join(first, F.col("whole") == F.col("w")).withColumn("copy", F.col("doc") > F.col("first")).drop("w", "first", "whole"), "texts")
    discard(seen, first)

    seeds = base.where("NOT copy").select("doc", "part", F.explode(F.arrays_zip("grams", "places")).alias("x"))
    seeds = seeds.select("doc", "part", F.col("x.grams").alias("gram"), F.col("x.places").alias("place"))
    # Plain counts first: few anchors are shared, and only of those the earliest place is asked for.
    often = materialise(seeds.groupBy(F.col("gram").alias("g")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g"), "often")
    shared = materialise(seeds.join(often, F.col("gram") == F.col("g"), "left_semi"), "shared")
    at = F.struct("doc", (F.shiftleft("part", 32) + F.col("place")).alias("at"))
    holders = materialise(shared.groupBy(F.col("gram").alias("g")).agg(F.min(at).alias("e")).select("g", F.col("e.doc").alias("e_doc"), F.col("e.at").alias("e_at")), "holders")
    linked = materialise(shared.join(holders, F.col("gram") == F.col("g")).select("doc", "part", "place", "e_doc", "e_at"), "linked")
    discard(often, shared, holders)
    settled = settled_by_extension(ids, linked, window)

    shared = linked.groupBy("doc", "part").agg(F.collect_set("place").alias("seeds")).join(settled, (F.col("doc") == F.col("d")) & (F.col("part") == F.col("p")), "left")
    shared = materialise(shared.select(F.col("doc").alias("sd"), F.col("part").alias("sp"), "seeds", "settled"), "seeds")
    discard(linked)
    seeded = ids.join(shared, (F.col("doc") == F.col("sd")) & (F.col("part") == F.col("sp"))).select("doc", "part", "text", "seeds", "settled")
    windows = materialise(extended(seeded, window, gram), "windows")
    discard(shared)

    earliest = windows.groupBy(F.col("w1").alias("e1"), F.col("w2").alias("e2")).agg(F.min(F.struct("doc", "place")).alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1")
    earliest = materialise(earliest.drop("n"), "earliest")
    repeats = windows.join(earliest, (F.col("w1") == F.col("e1")) & (F.col("w2") == F.col("e2"))).where(F.struct("doc", "place") > F.col("at"))
    repeats = repeats.select(F.col("doc").alias("d"), F.shiftright("place", 32).alias("p"), F.col("place").bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("start"))
    starts = repeats.groupBy("d", "p").agg(F.collect_set("start").alias("starts")).withColumn("settled", F.lit(None).cast(_RANGE_TYPE))
    both = starts.unionByName(settled.withColumn("starts", F.lit(None).cast("array<int>"))).groupBy("d", "p").agg(F.max("starts").alias("starts"), F.max("settled").alias("settled"))
    hits = materialise(both, "repeats")
    discard(windows, earliest, settled)

    words = base.where("NOT copy").select(F.col("doc").alias("bd"), F.col("part").alias("bp"), "n_words").distinct()
    hits = hits.join(words, (F.col("d") == F.col("bd")) & (F.col("p") == F.col("bp"))).select("d", "p", "n_words", "starts", "settled")
    touched = ids.join(hits, (F.col("doc") == F.col("d")) & (F.col("part") == F.col("p"))).select("doc", "part", "text", "n_words", "starts", "settled")
    cut = materialise(cut_out(touched, window).dropDuplicates(["d", "p"]), "cut")
    whole_goes = F.col("copy") & (F.col("n_words") >= window)
    spans = F.when(whole_goes, F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n_words").alias("b")))).otherwise(F.coalesce("spans", F.array().cast(_RANGE_TYPE)))
    sha = F.when(whole_goes, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", F.lower(F.hex("sha"))))
    out = base.select("doc", "part", "n_words", "sha", "copy").join(cut, (F.col("doc") == F.col("d")) & (F.col("part") == F.col("p")), "left")
    out = out.select("doc", "n_words", spans.alias("spans"), sha.alias("kept_sha256"))
    return out.withColumn("n_removed", F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"]))
