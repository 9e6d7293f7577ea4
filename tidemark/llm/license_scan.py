"""License scans: a trained classifier of paragraphs, confirmed against templates.

A paragraph is a run of lines with words; a line of blanks or comment marks alone ends it, so a notice that is wrapped
over lines, or stands in a comment, is one paragraph. It is read in spans of SPAN words that overlap, so that any
template lies whole in some span, however long the paragraph. A span's words and runs of two and three words, hashed,
are the sparse features of a multinomial logistic regression whose classes are the licence families and ``unknown``.
It is trained here, in numpy, on variations of the templates inside other words, and, as unknowns, on a bounded sample
of the corpus's own spans, on the templates' words out of order, and on notices of families that aren't listed. A
temperature and a threshold on the probability are set on held-out variations, so that what the classifier isn't sure
of is unknown. A prediction counts only if the span holds most of a template of the predicted family, in the order of
the template, with the words that tell the family and without those that tell another.

Only spans with one of the words that templates demand are scored: others could not be confirmed.

Defined results: a null or blank text has no paragraphs; a null doc_id keeps its row; a family counts once a
paragraph, where it fits best (of equal fits, first); equal paragraphs count each; repeated rows have equal results; a
very long paragraph is read in blocks, and where a block ends changes nothing; an empty table gives an empty result;
the id and the text alone are read, so no other column can clash.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_batch, hash_sample, parts_of, slices

#: Bits of the feature space, and the bound of the documents whose spans stand for unknown text in training.
BITS, SAMPLE_DOCS = 16, 3_000
UNKNOWN = "unknown"
#: The share of a template's words, in order, that a span must hold.
CONFIRM = 0.75
#: Words of a span, words from one to the next, words of a paragraph held at a time. No template is over SPAN - STRIDE.
SPAN, STRIDE, BLOCK_WORDS = 64, 24, 19_200

# Sentences of public licences and notices, by family, each with the words that must be there.
TEMPLATES = {
    "agpl": [
        ("affero", "licensed under the gnu affero general public license version 3"),
        ("affero", "under the terms of the gnu affero general public license as published by the free software foundation"),
        ("agpl", "spdx license identifier agpl 3.0 or later"),
        ("agpl", "licensed under the agpl"),
    ],
    "apache": [
        ("apache", "licensed under the apache license version 2.0"),
        ("apache", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license"),
        ("apache", "apache license version 2.0 january 2004 http www apache org licenses"),
        ("apache", "you may obtain a copy of the license at http www apache org licenses license 2.0"),
        ("apache", "spdx license identifier apache 2.0"),
        ("apache", "released under the apache 2.0 license"),
    ],
    "bsd": [
        ("redistribution binary", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
        ("redistributions binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
        ("redistributions retain", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
        ("endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
        ("bsd", "released under the bsd 3 clause license"),
        ("bsd", "licensed under the bsd license"),
        ("bsd", "spdx license identifier bsd 3 clause"),
    ],
    "cc-by": [("cc by", "licensed under cc by 4.0"), ("commons attribution", "this work is licensed under a creative commons attribution 4.0 international license"), ("commons attribution", "licensed under a creative commons attribution license")],
    "cc-by-nc": [
        ("cc by nc", "licensed under cc by nc 4.0"),
        ("commons noncommercial", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
        ("commons non commercial", "this work is licensed under a creative commons attribution non commercial 4.0 international license"),
    ],
    "cc-by-sa": [
        ("cc by sa", "licensed under cc by sa 4.0"),
        ("commons sharealike", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
        ("commons sharealike", "text is available under the creative commons attribution sharealike license"),
    ],
    "cc0": [
        ("cc0", "released under cc0 1.0 universal public domain dedication"),
        ("cc0", "licensed under cc0 1.0"),
        ("waived", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ],
    "epl": [
        ("eclipse", "licensed under the eclipse public license version 2.0"),
        ("eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
        ("epl", "spdx license identifier epl 2.0"),
    ],
    "gpl": [
        ("gnu", "this work is licensed under the gnu general public license version 3"),
        ("gnu", "gnu general public license version 2 june 1991"),
        ("gnu", "gnu general public license version 3"),
        ("gnu redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
        ("gnu received", "you should have received a copy of the gnu general public license along with this program"),
        ("gpl", "spdx license identifier gpl 3.0 or later"),
        ("gpl", "released under the gpl license"),
    ],
    "isc": [
        ("isc", "licensed under the isc license"),
        ("isc", "released under the isc license"),
        ("isc", "spdx license identifier isc"),
        ("permission fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ],
    "lgpl": [
        ("lesser", "licensed under the gnu lesser general public license version 3"),
        ("lesser", "under the terms of the gnu lesser general public license as published by the free software foundation"),
        ("lgpl", "spdx license identifier lgpl 3.0 or later"),
    ],
    "mit": [
        ("mit", "released under the mit license"),
        ("mit", "licensed under the mit license"),
        ("mit", "distributed under the terms of the mit license"),
        ("permission obtaining", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
        ("sublicense", "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
        ("substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
        ("mit", "spdx license identifier mit"),
    ],
    "mpl": [
        ("mozilla", "this source code form is subject to the terms of the mozilla public license v 2.0"),
        ("mozilla", "licensed under the mozilla public license version 2.0"),
        ("mpl", "spdx license identifier mpl 2.0"),
    ],
    "unlicense": [("unencumbered", "this is free and unencumbered software released into the public domain"), ("unlicense", "released under the unlicense"), ("anyone compile", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary")],
}
# Words that tell another family of the same kind.
OTHER = {
    "cc-by": "nc sa nd noncommercial commercial sharealike noderivatives noderivs derivs",
    "cc-by-nc": "sa nd sharealike noderivatives noderivs derivs",
    "cc-by-sa": "nc nd noncommercial commercial noderivatives noderivs derivs",
    "gpl": "lesser library affero lgpl agpl",
    "bsd": "isc mit",
    "isc": "bsd mit",
    "mit": "isc bsd",
    "apache": "mit",
    "mpl": "eclipse",
    "epl": "mozilla",
}
# Names of families that aren't listed, for the unknown class.
UNLISTED = "artistic eupl zlib openssl php python ofl postgresql w3c wtfpl cecill osl boost microsoft intel ibm qt fair beerware sleepycat ncsa cddl ogl odbl elastic sspl busl".split()

FAMILIES = [*sorted(TEMPLATES), UNKNOWN]
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+(?:\.[0-9]+)*")


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        x = self[word] = xxhash.xxh3_64_intdigest(word)
        return x


_IDS = _Ids()


def words_of(line: bytes) -> list[bytes]:
    return _WORD.findall(line.lower())


def _templates() -> list[tuple[int, frozenset[bytes], list[bytes]]]:
    return [(i, frozenset(words_of(must.encode())), words_of(t.encode())) for i, f in enumerate(FAMILIES[:-1]) for must, t in TEMPLATES[f]]


_ALL = _templates()
_OTHER = {FAMILIES.index(f): frozenset(words_of(x.encode())) for f, x in OTHER.items()}
#: One word of each template's, as told first: a span without any of them can't be confirmed.
TRIGGERS = frozenset(must.split()[0].encode() for x in TEMPLATES.values() for must, _ in x)


def grams(spans: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed runs of one, two and three words of all spans laid end to end, and the span of each."""
    ids = np.fromiter((_IDS[w] for p in spans for w in p), np.uint64)
    owner = np.repeat(np.arange(len(spans)), [len(p) for p in spans])
    features, owners = [], []
    run = np.zeros(len(ids), np.uint64)
    for size in (1, 2, 3):
        run = run[: max(0, len(ids) - size + 1)] * np.uint64(0x9E3779B97F4A7C15) + ids[size - 1 :]
        same = owner[: len(run)] == owner[size - 1 :]
        features.append(((run[same] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(owner[: len(run)][same])
    return np.concatenate(features), np.concatenate(owners)


#: Notices of families that aren't listed, and talk of licences; {} is a name.
FORMS = ["licensed under the {} license", "licensed under the {} public license version 2.0", "released under the {} license", "spdx license identifier {}", "the license of my {} is under review version 3 is free"]


def _vocabulary() -> np.ndarray:
    """Which features count: those of templates and forms. What stands around a notice says nothing of its family."""
    out = np.zeros(1 << BITS, bool)
    out[grams([words for _, _, words in _ALL] + [words_of(f.format(x).encode()) for f in FORMS for x in UNLISTED])[0]] = True
    return out


VOCABULARY = _vocabulary()


def hashed(spans: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The features of all spans that are in the vocabulary, each once a span, and the span of each."""
    feature, owner = grams(spans)
    known = VOCABULARY[feature]
    pairs = np.unique(owner[known] << BITS | feature[known])
    return pairs & (1 << BITS) - 1, pairs >> BITS


class Model:
    """Multinomial logistic regression over hashed n-grams. A span's features are summed up, each once, not averaged, so
    that a short notice says as much inside a full span as alone."""

    def __init__(self) -> None:
        self.w = np.zeros((1 << BITS, len(FAMILIES)), np.float32)
        self.b = np.zeros(len(FAMILIES), np.float32)
        self.temperature, self.threshold = 1.0, 0.5

    def scores(self, spans: list[list[bytes]]) -> np.ndarray:
        feature, owner = hashed(spans)
        out = np.tile(self.b, (len(spans), 1))
        np.add.at(out, owner, self.w[feature])
        return out

    def probabilities(self, spans: list[list[bytes]]) -> np.ndarray:
        s = self.scores(spans) / self.temperature
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def fit(self, spans: list[list[bytes]], target: np.ndarray, steps: int = 300, rate: float = 0.2, decay: float = 1e-4, seed: int = 1) -> None:
        """AdaGrad over random batches."""
        rng = np.random.default_rng(seed)
        past_w, past_b = np.full_like(self.w, 1e-6), np.full_like(self.b, 1e-6)
        for _ in range(steps):
            chosen = rng.integers(0, len(spans), 256)
            part = [spans[i] for i in chosen]
            feature, owner = hashed(part)
            error = self.probabilities(part)
            error[np.arange(len(part)), target[chosen]] -= 1
            error /= len(part)
            at, inverse = np.unique(feature, return_inverse=True)
            g = np.zeros((len(at), len(FAMILIES)))
            np.add.at(g, inverse, error[owner])
            g += decay * self.w[at]
            past_w[at] += g * g
            self.w[at] -= (rate * g / np.sqrt(past_w[at])).astype(np.float32)
            past_b += error.sum(0) ** 2
            self.b -= (rate * error.sum(0) / np.sqrt(past_b)).astype(np.float32)

    def calibrate(self, spans: list[list[bytes]], target: np.ndarray) -> None:
        """The temperature of least loss on held-out rows; the least threshold at which what passes is right 99 times in 100."""
        raw = self.scores(spans)

        def loss(t: float) -> float:
            s = raw / t
            s = s - s.max(axis=1, keepdims=True)
            return float(-(s[np.arange(len(s)), target] - np.log(np.exp(s).sum(1))).mean())

        self.temperature = float(min(np.geomspace(0.2, 5, 41), key=loss))
        p = self.probabilities(spans)
        best, top = p[:, :-1].argmax(1), p[:, :-1].max(1)
        for t in np.linspace(0.3, 0.99, 70):
            passed = top >= t
            if not passed.any() or (best[passed] == target[passed]).mean() >= 0.99:
                break
        self.threshold = float(t)


def aligned(template: list[bytes], words: list[bytes]) -> tuple[float, int, int]:
    """The share of the template's words that the words have in the template's order, and where those start and end."""
    n = len(template)
    best = [[0] * (n + 1)]
    for w in words:
        last = best[-1]
        row = [0] * (n + 1)
        for j, t in enumerate(template, 1):
            row[j] = last[j - 1] + 1 if w == t else max(last[j], row[j - 1])
        best.append(row)
    i, j, matched = len(words), n, []
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            matched.append(i)
    return best[-1][-1] / n, min(matched, default=0), max(matched, default=-1) + 1


def confirmed(family: int, words: list[bytes]) -> tuple[float, int]:
    """The best overlap with a template of the family that has its words, and the place of its first word."""
    out = (0.0, 0)
    here = frozenset(words)
    for k, must, template in _ALL:
        if k == family and must <= here:
            share, a, b = aligned(template, words)
            near = words[a : b if words[b - 1][:1].isdigit() else b + 2]  # an '-NC' or '-SA' may follow, not after a version
            if share > out[0] and must <= frozenset(near) and not _OTHER.get(family, frozenset()) & frozenset(near) - frozenset(template):
                out = (share, a)
    return out


def unknown_sample(docs: DataFrame, most: int) -> list[list[bytes]]:
    """A span of each of a bounded number of documents, from anywhere in the text. Only spans reach the driver."""
    mark = F.xxhash64("doc_id", "text").alias("mark")
    texts = docs.where(F.col("text").isNotNull())
    chosen = hash_sample(texts.select(mark), ["mark"], most)
    found = texts.select(mark, F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "mark")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for piece in slices(batch, 1, 2_000_000):
            out = []
            for at, text in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                size = 16 * SPAN
                start = at % max(1, len(text) - size)
                out.append(b" ".join(words_of(text[start : start + size])[1 : SPAN + 1]))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(out, pa.binary())], ["mark", "span"])

    got = found.mapInArrow(by_batch(run), "mark long, span binary").groupBy("mark").agg(F.first("span").alias("span")).collect()
    return [s.split() for s in sorted({bytes(r["span"]) for r in got}) if s]


def training_set(corpus: list[list[bytes]], seed: int = 2) -> tuple[list[list[bytes]], np.ndarray]:
    """Variations of the templates inside other words, and spans of unknown text."""
    rng = np.random.default_rng(seed)
    # A span that shares three words in a row with a template may be a part of a notice: it is no example of either.
    runs = {tuple(words[i : i + 3]) for _, _, words in _ALL for i in range(len(words) - 2)}
    unknown = plain = [w for w in corpus if runs.isdisjoint(zip(w, w[1:], w[2:], strict=False))]
    filler = sorted({w for x in plain for w in x} | set(words_of(b"software work file project author the and public version terms copy")))
    names = sorted(set(filler) - {w for _, _, words in _ALL for w in words}) or [b"other"]
    scattered = lambda n: [filler[i] for i in rng.integers(0, len(filler), n)]

    def context(most: int) -> list[bytes]:
        n = int(rng.integers(0, most + 1))
        if not plain or rng.random() < 0.3:
            return scattered(n)
        return plain[rng.integers(len(plain))][:n]

    unknown = unknown + [scattered(int(rng.integers(3, SPAN))) for _ in range(400)]
    # A licence's words out of order, the words that all licences share, and other families' notices aren't a family.
    for _ in range(800):
        words = _ALL[rng.integers(len(_ALL))][2]
        unknown.append(context(12) + [words[i] for i in rng.permutation(len(words))[: max(2, len(words) // 3)]] + context(12))
    for _ in range(900):
        name = UNLISTED[rng.integers(len(UNLISTED))] if rng.random() < 0.7 else names[rng.integers(len(names))].decode("utf-8", "replace")
        unknown.append(context(12) + words_of(FORMS[rng.integers(len(FORMS))].format(name).encode()) + context(12))
    out, target = [], []
    for k, must, words in _ALL:
        for _ in range(60):
            kept = [w for w in words if w in must or rng.random() > 0.05]
            room = SPAN - len(kept)
            before = context(room)
            out.append(before + kept + context(room - len(before)))
            target.append(k)
    out += [u for u in unknown if u]
    target += [len(FAMILIES) - 1] * (len(out) - len(target))
    return out, np.array(target)


def train(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Model:
    spans, target = training_set(unknown_sample(docs.select("doc_id", "text"), sample))
    held = np.random.default_rng(4).random(len(target)) < 0.25
    model = Model()
    model.fit([p for p, h in zip(spans, held, strict=True) if not h], target[~held])
    model.calibrate([p for p, h in zip(spans, held, strict=True) if h], target[held])
    return model


def paragraphs(text: bytes) -> Iterator[tuple[int, list[bytes], list[int], list[int], int]]:
    """(number, words, first word of each line, lines, place): paragraphs, long ones in blocks that overlap by the words
    that spans share. place is the block's first word in the paragraph, a multiple of STRIDE."""
    number, words, starts, lines, place = 0, [], [], [], 0
    for at, line in enumerate(text.split(b"\n")):
        blank = True
        for part in parts_of(line):
            found = words_of(part)
            if found:
                blank = False
                starts.append(len(words))
                lines.append(at)
                words += found
            while len(words) >= BLOCK_WORDS + SPAN:
                yield number, words[: BLOCK_WORDS + SPAN - STRIDE], starts, lines, place
                words, place = words[BLOCK_WORDS:], place + BLOCK_WORDS
                from_line = bisect_right(starts, BLOCK_WORDS) - 1
                starts, lines = [max(0, s - BLOCK_WORDS) for s in starts[from_line:]], lines[from_line:]
        if blank and words:
            yield number, words, starts, lines, place
            number, words, starts, lines, place = number + 1, [], [], [], 0
    if words:
        yield number, words, starts, lines, place


def find(model: Model, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int, str, float, float]]]]:
    """Per text: its number of paragraphs, and (paragraph, line, family, probability, overlap) of those with a licence."""
    count = [0] * len(texts)
    best: dict[tuple[int, int, int], tuple] = {}
    where: list[tuple] = []
    todo: list[list[bytes]] = []

    def settle() -> None:
        if not todo:
            return
        p = model.probabilities(todo)[:, :-1]
        family = p.argmax(1)
        for j in np.nonzero(p.max(1) >= model.threshold)[0]:
            i, number, start, starts, lines, words = where[j]
            share, a = confirmed(int(family[j]), words[start : start + SPAN + 6])  # a name may go on past the span
            if share >= CONFIRM:
                key = (i, number, int(family[j]))
                found = (share, float(p[j, family[j]]), lines[bisect_right(starts, start + a) - 1])
                if key not in best or found[:2] > best[key][:2]:
                    best[key] = found
        where.clear()
        todo.clear()

    for i, text in enumerate(texts):
        for number, words, starts, lines, _ in paragraphs(text or b""):
            count[i] = number + 1
            if TRIGGERS.isdisjoint(words):
                continue
            for start in range(0, max(1, len(words) - SPAN + STRIDE), STRIDE):
                span = words[start : start + SPAN]
                if not TRIGGERS.isdisjoint(span):
                    where.append((i, number, start, starts, lines, words))
                    todo.append(span)
            if len(todo) >= 20_000:
                settle()
    settle()
    out: list[tuple[int, list]] = [(n, []) for n in count]
    for (i, number, k), (share, p, line) in sorted(best.items()):
        out[i][1].append((number, line, FAMILIES[k], p, share))
    return out


_FOUND = ("paragraph", "line", "family", "probability", "overlap")


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_paragraphs, found): found has (paragraph, line, family, probability, overlap) for each licence."""
    sent = docs.sparkSession.sparkContext.broadcast(model or train(docs.select("doc_id", "text")))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct(list(zip(_FOUND, (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()), strict=True))))
        for piece in slices(batch, 1, 4_000_000):
            got = find(sent.value, piece.column(1).to_pylist())
            rows = [[dict(zip(_FOUND, f, strict=True)) for f in g[1]] for g in got]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array(rows, kind)], ["doc_id", "n_paragraphs", "found"])

    ready = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return ready.mapInArrow(by_batch(run), f"doc_id {ready.schema['doc_id'].dataType.simpleString()}, n_paragraphs long, found array<struct<paragraph:long,line:long,family:string,probability:double,overlap:double>>")
