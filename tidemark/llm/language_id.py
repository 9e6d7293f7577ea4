"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read the bytes of a whole text, blanks and marks included, one from each end; at every byte both states give
probabilities of languages, and a document pools the log probabilities of all its letters' bytes. The network is
trained here, in numpy, by backpropagation through time over slices of a bounded sample of documents.

A text is read in slices of SLICE bytes at fixed offsets, each with CONTEXT bytes more on either side from which the
states come in; so every byte is labelled once, with what stands around it, in memory that doesn't grow with the text,
and slices of all documents of a batch are read at once. Neither the batch nor the partition changes a result.

Defined results: a null text, or one without a letter (a code point of Unicode's category L, in training and in
prediction), is ``und`` with score 0; languages are learned from rows with a doc_id, a text with a letter and a lang
outside the held-out fold, rows that repeat doc_id and text once, and without any of those every text is ``und``; a
null doc_id keeps its row (its text for the fold is empty); case is folded before the bytes are read; of languages
that tie the first in order of name stands; repeated rows have equal results; an empty table gives an empty result;
the three columns that are named are read, so no other can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_batch, hash_sample, id_text_mod, slices

#: Bounds of what is learned from: documents of each language (those with the smallest hash), slices of each document
#: (spread evenly over the whole text) and bytes of a slice.
SAMPLE_DOCS, SAMPLE_SLICES, SAMPLE_BYTES = 600, 8, 96
HIDDEN = 12
#: Bytes of a slice that is labelled, and bytes around it that are read but not labelled.
SLICE, CONTEXT = 384, 32
#: Bytes of text cut into slices at a time, and slices read at once.
PIECE_BYTES, ROWS = 2_000_000, 1024
UNKNOWN = "und"
#: Weight of a byte: those of letters count, in lower case.
LETTER = np.zeros(256, np.float32)
LETTER[97:123] = LETTER[128:] = 1


def padded(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """bytes[step, row], and the length of each row."""
    size = np.array([len(p) for p in pieces])
    width = int(size.max())
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
    return np.ascontiguousarray(raw.T), size


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


class BiGRU:
    """Weights by name. For each direction: x (byte to the input part of update, reset and candidate), u, c, b."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        h, n = hidden, len(languages)
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w |= {f"x{d}": rng.normal(0, 0.3, (256, 3 * h)), f"u{d}": rng.normal(0, h**-0.5, (h, 2 * h)), f"c{d}": rng.normal(0, h**-0.5, (h, h)), f"b{d}": np.zeros(3 * h)}
        self.w |= {"o": rng.normal(0, (2 * h) ** -0.5, (2 * h, n)), "ob": np.zeros(n)}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def steps(self, raw: np.ndarray, size: np.ndarray, d: str) -> Iterator[tuple[int, np.ndarray, tuple]]:
        """(t, state after byte t, what the backward pass needs): t goes up for "f" and down for "b".

        Past the end of a row its state is zero, so the padding plays no part."""
        h, u, c = self.hidden, self.w[f"u{d}"], self.w[f"c{d}"]
        table = self.w[f"x{d}"] + self.w[f"b{d}"]
        prev = np.zeros((raw.shape[1], h), u.dtype)
        least = int(size.min()) if len(size) else 0
        for t in range(raw.shape[0]) if d == "f" else reversed(range(raw.shape[0])):
            a = table[raw[t]]
            zr = prev @ u
            zr += a[:, : 2 * h]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            z, r = zr[:, :h], zr[:, h:]
            cand = (r * prev) @ c
            cand += a[:, 2 * h :]
            np.tanh(cand, out=cand)
            state = cand - prev
            state *= z
            state += prev
            if t >= least:
                state *= (t < size)[:, None]
            yield t, state, (z, r, cand, prev)
            prev = state

    def states(self, raw: np.ndarray, size: np.ndarray, d: str, keep: dict | None = None) -> np.ndarray:
        """The state after each byte, [step, row, hidden]; keep gets what the backward pass needs, by step."""
        out = np.empty((*raw.shape, self.hidden), self.w["o"].dtype)
        for t, state, parts in self.steps(raw, size, d):
            out[t] = state
            if keep is not None:
                keep[t] = parts
        return out

    def sums(self, raw: np.ndarray, size: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row the sums, over its bytes by weight[step, row], of log probabilities and of probabilities."""
        h, n = self.hidden, len(self.languages)
        forward = self.states(raw, size, "f")
        ahead, back = self.w["o"][:h], self.w["o"][h:]
        logp_sum, p_sum = np.zeros((raw.shape[1], n)), np.zeros((raw.shape[1], n))
        for t, state, _ in self.steps(raw, size, "b"):
            x = forward[t] @ ahead
            x += state @ back
            x += self.w["ob"]
            x -= x.max(axis=1, keepdims=True)
            e = np.exp(x)
            total = e.sum(axis=1, keepdims=True)
            x -= np.log(total)
            e /= total
            at = weight[t][:, None]
            x *= at
            e *= at
            logp_sum += x
            p_sum += e
        return logp_sum, p_sum

    def gradients(self, raw: np.ndarray, size: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of all letters' positions, weighed by row, and its gradients, by backpropagation through time."""
        h, w = self.hidden, self.w
        kept: dict[str, dict] = {"f": {}, "b": {}}
        both = np.concatenate([self.states(raw, size, d, kept[d]) for d in "fb"], axis=2)
        logp = _log_softmax(both @ w["o"] + w["ob"])
        steps, rows = raw.shape
        real = (np.arange(steps)[:, None] < size) * LETTER[raw] * weight
        real = (real / max(real.sum(), 1e-9)).astype(both.dtype)
        loss = float(-(logp[:, np.arange(rows), target] * real).sum())
        d_logits = np.exp(logp)
        d_logits[:, np.arange(rows), target] -= 1
        d_logits *= real[:, :, None]
        grad = {"o": np.tensordot(both, d_logits, ([0, 1], [0, 1])), "ob": d_logits.sum((0, 1))}
        d_both = d_logits @ w["o"].T
        one_hot = np.eye(256, dtype=both.dtype)
        for d, d_out in (("f", d_both[:, :, :h]), ("b", d_both[:, :, h:])):
            u, c = w[f"u{d}"], w[f"c{d}"]
            g = {k: np.zeros_like(w[f"{k}{d}"]) for k in "xucb"}
            later = np.zeros((rows, h), both.dtype)
            for t in reversed(range(steps)) if d == "f" else range(steps):
                z, r, cand, prev = kept[d][t]
                dh = (d_out[t] + later) * (t < size)[:, None]
                d_cand = dh * z * (1 - cand * cand)
                d_gated = d_cand @ c.T
                d_zr = np.concatenate([dh * (cand - prev) * z * (1 - z), d_gated * prev * r * (1 - r)], axis=1)
                later = dh * (1 - z) + d_gated * r + d_zr @ u.T
                g["u"] += prev.T @ d_zr
                g["c"] += (r * prev).T @ d_cand
                d_in = np.concatenate([d_zr, d_cand], axis=1)
                g["x"] += one_hot[raw[t]].T @ d_in
                g["b"] += d_in.sum(0)
            grad |= {f"{k}{d}": v for k, v in g.items()}
        return loss, grad

    def fit(self, pieces: list[bytes], target: np.ndarray, weight: np.ndarray, steps: int = 500, rows: int = 192, rate: float = 0.02, seed: int = 5) -> float:
        """Adam over random batches of slices of like length; the mean loss of the last tenth."""
        rng = np.random.default_rng(seed)
        size = np.array([len(p) for p in pieces])
        order = np.argsort(size + rng.random(len(size)), kind="stable")
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        square = {k: np.zeros_like(v) for k, v in self.w.items()}
        losses = []
        for step in range(1, steps + 1):
            near = order[rng.integers(0, max(1, len(order) - 4 * rows + 1)) :][: 4 * rows]
            chosen = rng.choice(near, min(rows, len(near)), replace=False)
            raw, length = padded([pieces[i] for i in chosen])
            loss, grad = self.gradients(raw, length, target[chosen], weight[chosen])
            losses.append(loss)
            lr = rate * (1 - step / (steps + 1))
            for k, g in grad.items():
                g = np.clip(g, -1, 1)
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                self.w[k] = (self.w[k] - lr * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return float(np.mean(losses[-max(1, steps // 10) :]))


def cut(text: bytes, own: int = SLICE, around: int = CONTEXT) -> list[tuple[bytes, int, int]]:
    """(bytes, from, to): the slices of a text with their context; from and to bound the bytes that a slice labels."""
    out = []
    for at in range(0, len(text), own):
        start = max(0, at - around)
        out.append((text[start : at + own + around], at - start, min(len(text), at + own) - start))
    return out


def label(model: BiGRU, texts: list[bytes | None]) -> list[tuple[str, float]]:
    """The language and score of each folded text; null, or without a byte of a letter, is UNKNOWN."""
    n = len(model.languages)
    parts = [(i, *p) for i, t in enumerate(texts) for p in cut(t or b"")]
    parts.sort(key=lambda p: len(p[1]))
    logp, prob, count = np.zeros((len(texts), n)), np.zeros((len(texts), n)), np.zeros(len(texts))
    for at in range(0, len(parts), ROWS):
        some = parts[at : at + ROWS]
        raw, size = padded([p[1] for p in some])
        place = np.arange(raw.shape[0])[:, None]
        weight = LETTER[raw] * ((place >= np.array([p[2] for p in some])) & (place < np.array([p[3] for p in some])))
        owner = np.array([p[0] for p in some])
        for total, x in zip((logp, prob), model.sums(raw, size, weight), strict=True):
            np.add.at(total, owner, x)
        np.add.at(count, owner, weight.sum(0))
    best = logp.argmax(1)
    return [(model.languages[b], float(min(1.0, max(0.0, prob[i, b] / count[i])))) if count[i] else (UNKNOWN, 0.0) for i, b in enumerate(best.tolist())]


def spread(text: bytes, most: int = SAMPLE_SLICES, size: int = SAMPLE_BYTES) -> list[bytes]:
    """At most so many slices of a text, evenly over all of it."""
    places = max(1, len(text) // size)
    chosen = range(places) if places <= most else sorted({i * (places - 1) // (most - 1) for i in range(most)})
    return [text[i * size : (i + 1) * size] for i in chosen]


def training_slices(docs: DataFrame, fold: int, folds: int) -> list[tuple[str, bytes]]:
    """(lang, bytes) of a bounded sample of documents of each language. Texts are cut where they are."""
    mark = F.xxhash64("doc_id", "text").alias("mark")
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (id_text_mod(F.col("doc_id"), folds) != fold))
    chosen = hash_sample(usable.select("lang", mark), ["mark"], SAMPLE_DOCS, by="lang")
    found = usable.select(mark, "lang", F.lower("text").cast("binary").alias("text")).join(F.broadcast(chosen.select("mark").distinct()), "mark")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for piece in slices(batch, 2, PIECE_BYTES):
            rows = [(m, lang, k, s) for m, lang, t in zip(*(c.to_pylist() for c in piece.columns), strict=True) for k, s in enumerate(spread(t))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.binary()), strict=True)], ["mark", "lang", "k", "slice"])

    got = found.mapInArrow(by_batch(run), "mark long, lang string, k int, slice binary").groupBy("mark", "lang", "k").agg(F.first("slice").alias("slice")).collect()
    return sorted((r["lang"], bytes(r["slice"])) for r in got)


def train(docs: DataFrame, fold: int = 2, folds: int = 4, steps: int = 500) -> BiGRU | None:
    got = [(lang, s) for lang, s in training_slices(docs, fold, folds) if LETTER[np.frombuffer(s, np.uint8)].any()]
    languages = sorted({lang for lang, _ in got})
    if not languages:
        return None
    model = BiGRU(languages)
    target = np.array([languages.index(lang) for lang, _ in got])
    weight = (len(got) / len(languages) / np.bincount(target))[target].astype(np.float32)  # languages weigh alike
    model.fit([s for _, s in got], target, weight, steps=steps)
    return model


def identify(docs: DataFrame, fold: int = 2, folds: int = 4, steps: int = 500) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs."""
    model = train(docs.select("doc_id", "text", "lang"), fold, folds, steps)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for piece in slices(batch, 1, PIECE_BYTES):
            texts = piece.column(1).to_pylist()
            found = label(sent.value, texts) if sent.value else [(UNKNOWN, 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    lettered = F.when(F.col("text").rlike(r"\p{L}"), F.lower("text").cast("binary"))
    ready = docs.select("doc_id", lettered.alias("text"))
    out = ready.mapInArrow(by_batch(run), f"doc_id {ready.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return out.select("doc_id", (id_text_mod(F.col("doc_id"), folds) == fold).alias("held_out"), "lang_pred", "score")
