"""Benchmark decontamination by Wu-Manber multi-pattern search (Wu and Manber, 1994), vectorised.

A batch of texts becomes one byte buffer: A-Z lower-cased, each run of separators one space, each document closed by
a line feed. All patterns of one length class share a table of shifts over blocks of bytes. Many cursors, one to a
span of the buffer, hop at once: where the block at the cursor has a shift, the cursor skips; where the shift is
zero, the bucket of that suffix block gives the patterns to try, a prefix word prunes them, and a direct comparison
of bytes confirms. The patterns are a stated query set: they are read in blocks of items of a fixed number, and each
block is searched for in all documents.

Defined results: a null text has no words; a null item text gives no window; items that repeat an item_id count
once; a null doc_id is kept; a null item_id is left out, as it has no name to report; a word inside several
occurrences is hit once; rows that repeat have equal results; a text over SEGMENT_BYTES is searched in segments that
overlap by a window less one word, so that no occurrence is cut; an empty table gives an empty result, and without
items nothing is hit; the columns of docs come back inside ``row``, so no name can clash.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import by_batch, discard, field_of, materialise, slices

WINDOW = 10
#: Items in one block of the query set; a block of items of 1,000 words makes some 100 MB of tables.
ITEMS_AT_ONCE = 5_000
BLOCKS_AT_ONCE = 4
#: Characters of the items of a block: their windows take some ten times as much.
BLOCK_BYTES = 4_000_000
#: Bytes of text searched at a time; the arrays of a search take some 40 times as much.
PIECE_BYTES = 3_000_000
#: Bytes of one text searched at a time.
SEGMENT_BYTES = 2_000_000
SPACE, END = 32, 10


def _classes() -> np.ndarray:
    """Each byte to its lower-cased self if it belongs to a word, else to a space."""
    out = np.full(256, SPACE, np.uint8)
    word = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
    out[word] = word
    out[0x41:0x5B] = np.arange(0x61, 0x7B)
    return out


CLASSES = _classes()
#: Zero bytes after the buffer, so that a block of 8 bytes can be read at any place.
PAD = 16


def normalised(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The buffer and, for each text, where it starts in it (with the end of the last)."""
    raw = np.frombuffer(b"".join(x or b"" for x in texts), np.uint8)
    ends = np.cumsum([len(x or b"") for x in texts]).astype(np.int64)
    kind = CLASSES[raw]
    kind = np.insert(kind, ends, END)  # one line feed after each text
    before = np.concatenate([[np.uint8(END)], kind[:-1]])
    keep = (kind != SPACE) | ((before != SPACE) & (before != END))
    buffer = kind[keep]
    stops = np.nonzero(buffer == END)[0] + 1
    return np.concatenate([buffer, np.zeros(PAD, np.uint8)]), np.concatenate([[0], stops])


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return CLASSES[np.frombuffer(raw, np.uint8)].tobytes().split()


_GAP = rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]"
_ANY_GAP = re.compile(_GAP)
_MORE_WORDS = re.compile(rb"(?:%b+[0-9A-Za-z\x80-\xff]+){0,%d}" % (_GAP, WINDOW - 1))


def segments(text: bytes, most: int = SEGMENT_BYTES) -> Iterator[tuple[bytes, int]]:
    """(bytes, own words): parts that end at a word's end, each with the words after it that a window may reach."""
    at = 0
    while at < len(text):
        gap = _ANY_GAP.search(text, at + most)
        cut = gap.start() if gap else len(text)
        end = _MORE_WORDS.match(text, cut).end()
        yield text[at:end], len(words_of(text[at:cut]))
        at = cut


def windows_of(items: list[tuple[object, str | None]], size: int = WINDOW) -> dict[bytes, list[str]]:
    """Each distinct window, as bytes, with the items that hold it."""
    out: dict[bytes, set] = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - size + 1) if words and item is not None else 0):
            out[b" ".join(words[i : i + size])].add(str(item))
    return {k: sorted(v) for k, v in out.items()}


def _load(buffer: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The size (at most 8) bytes at each place, as a number."""
    view = np.ndarray(len(buffer) - 7, "<u8", buffer, strides=(1,))
    return view[at] & np.uint64(2 ** (8 * size) - 1)


class WuManber:
    """Tables for patterns of similar length: shift and suffix buckets over blocks of ``block`` bytes."""

    def __init__(self, patterns: list[bytes]) -> None:
        self.patterns = patterns
        self.m = min(map(len, patterns))
        self.block = 8 if self.m >= 16 else 4 if self.m >= 8 else min(self.m, 2)
        self.bits = int(np.clip(4 + int(len(patterns) * self.m).bit_length(), 12, 24))
        heads = np.frombuffer(b"".join(p[: self.m] for p in patterns) + bytes(PAD), np.uint8)
        base = np.arange(len(patterns)) * self.m
        self.shift = np.full(1 << self.bits, self.m - self.block + 1, np.int32)
        for end in range(self.block, self.m + 1):
            slot = self.slot(_load(heads, base + end - self.block, self.block))
            np.minimum.at(self.shift, slot, self.m - end)
        order = np.argsort(slot, kind="stable")  # the last slots are those of the suffix blocks
        self.members = order
        self.starts = np.searchsorted(slot[order], np.arange((1 << self.bits) + 1))
        self.prefix_size = min(8, self.m)
        self.prefix = _load(heads, base, self.prefix_size)

    def slot(self, block: np.ndarray) -> np.ndarray:
        return ((block * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, buffer: np.ndarray, span: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern) of every occurrence that is whole words."""
        n = len(buffer) - PAD
        cursor = np.arange(self.m, n + 1, span)  # the end of the m bytes under test
        stop = np.minimum(cursor + span, n + 1)
        tested: list[np.ndarray] = []
        while len(cursor):
            shift = self.shift[self.slot(_load(buffer, cursor - self.block, self.block))]
            zero = shift == 0
            tested.append(cursor[zero])
            cursor = cursor + np.maximum(shift, 1)
            on = cursor < stop
            cursor, stop = cursor[on], stop[on]
        ends = np.concatenate(tested) if tested else np.empty(0, np.int64)
        starts_at = ends - self.m
        edge = (starts_at == 0) | (buffer[np.maximum(starts_at - 1, 0)] <= SPACE)
        ends, starts_at = ends[edge], starts_at[edge]
        found: tuple[list, list] = ([], [])
        raw = buffer.tobytes()
        for at in range(0, len(ends), 1 << 16):
            first = starts_at[at : at + (1 << 16)]
            slot = self.slot(_load(buffer, ends[at : at + (1 << 16)] - self.block, self.block))
            size = self.starts[slot + 1] - self.starts[slot]
            which = np.repeat(np.arange(len(first)), size)
            member = self.members[np.repeat(self.starts[slot], size) + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)]
            same = _load(buffer, first[which], self.prefix_size) == self.prefix[member]
            for a, p in zip(first[which[same]].tolist(), member[same].tolist(), strict=True):
                b = a + len(self.patterns[p])
                if raw[a:b] == self.patterns[p] and raw[b] <= SPACE:
                    found[0].append(a)
                    found[1].append(p)
        return np.array(found[0], np.int64), np.array(found[1], np.int64)


class Searcher:
    """The windows of a block of items, in length classes, so that one short window doesn't shorten all shifts."""

    def __init__(self, windows: dict[bytes, list[str]]) -> None:
        self.items = sorted({x for v in windows.values() for x in v})
        number = {x: i for i, x in enumerate(self.items)}
        classes: dict[int, list[bytes]] = defaultdict(list)
        for w in sorted(windows):
            classes[0 if len(w) < 8 else 1 if len(w) < 24 else 2].append(w)
        self.tables = [WuManber(c) for _, c in sorted(classes.items())]
        self.owners = [[np.array([number[x] for x in windows[p]]) for p in t.patterns] for t in self.tables]

    def search(self, texts: list[bytes | None], most: int = SEGMENT_BYTES) -> list[tuple[int, np.ndarray, list[str]]]:
        """Per text: number of words, places of the words hit, names of the items."""
        short = [t if t is None or len(t) <= most else None for t in texts]
        out = self.search_short(short)
        for i, t in enumerate(texts):
            if t is not None and len(t) > most:
                n, hits, names = 0, [], set()
                for part, own in segments(t, most):
                    _, at, items = self.search_short([part])[0]
                    hits.append(at + n)
                    names.update(items)
                    n += own
                out[i] = (n, np.unique(np.concatenate(hits)), sorted(names))
        return out

    def search_short(self, texts: list[bytes | None]) -> list[tuple[int, np.ndarray, list[str]]]:
        buffer, bounds = normalised(texts)
        body = buffer[:-PAD]
        word_start = (body > SPACE) & (np.concatenate([[np.uint8(END)], body[:-1]]) <= SPACE)
        place = np.cumsum(word_start)  # the number of words begun up to here
        before = np.concatenate([[0], place])[bounds]
        change = np.zeros(len(body) + 1, np.int64)
        names: dict[int, set] = defaultdict(set)
        for table, owners in zip(self.tables, self.owners, strict=True):
            start, pattern = table.find(buffer)
            size = np.array([len(p) for p in table.patterns])
            np.add.at(change, start, 1)
            np.add.at(change, start + size[pattern] if len(start) else start, -1)
            text = np.searchsorted(bounds, start, "right") - 1
            for t, p in set(zip(text.tolist(), pattern.tolist(), strict=True)):
                names[t].update(owners[p].tolist())
        at = np.nonzero((np.cumsum(change[:-1]) > 0) & word_start)[0]
        hits = np.split(place[at] - 1, np.searchsorted(at, bounds[1:-1])) if len(texts) else []
        return [(int(before[i + 1] - before[i]), hits[i] - before[i], [self.items[x] for x in sorted(names.get(i, ()))]) for i in range(len(texts))]


def item_blocks(items: DataFrame, id_col: str, text_col: str, at_once: int):
    """The windows of the query set, a bounded number of items and of bytes (or one item) at a time."""
    held: list[tuple] = []
    size = 0
    for row in items.select(id_col, text_col).toLocalIterator():
        n = len(row[1] or "")
        if held and (len(held) == at_once or size + n > BLOCK_BYTES):
            yield windows_of(held)
            held, size = [], 0
        held.append(tuple(row))
        size += n
    if held:
        yield windows_of(held)


def _joined(a: list, b: list) -> list:
    return sorted({*a, *b})


def searched(rows: DataFrame, text_col: str, windows: list[dict[bytes, list[str]]]) -> DataFrame:
    """rows (row, and n_words, hits, items from before or not at all) with what these windows add. The text crosses to
    Python once, inside its row."""
    spark = rows.sparkSession
    blocks = [spark.sparkContext.broadcast(w) for w in windows]
    again = "hits" in rows.columns

    def run(batch: pa.RecordBatch):
        searchers = _searchers(blocks)
        for piece in slices(batch, field_of(batch.column(0), text_col), PIECE_BYTES):
            texts = field_of(piece.column(0), text_col).to_pylist()
            hits, names = (piece.column(i).to_pylist() for i in (2, 3)) if again else ([[]] * len(texts), [[]] * len(texts))
            for s in searchers:
                found = s.search(texts)
                n_words = [f[0] for f in found]
                hits = [_joined(h, f[1].tolist()) for h, f in zip(hits, found, strict=True)]
                names = [_joined(n, f[2]) for n, f in zip(names, found, strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))], schema.names)

    schema = T.StructType([rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])
    return rows.mapInArrow(by_batch(run), schema)


def find_hits(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """row (a struct of the columns of docs), n_words, hits (places of the words in an occurrence), items (sorted names).

    A pass over the texts searches for up to BLOCKS_AT_ONCE blocks of items, which bounds what driver and workers
    hold; a larger query set takes more passes, each written before the next."""
    rows, written = docs.select(F.struct("*").alias("row")), None
    held: list[dict] = []
    for windows in item_blocks(items, item_col, item_text, at_once):
        if len(held) == BLOCKS_AT_ONCE:
            before, written = written, materialise(searched(rows, text_col, held), "hits")
            rows, held = written, []
            if before is not None:
                discard(before)
        held.append(windows)
    return searched(rows, text_col, held or [{}])


_CACHE: dict[str, list[Searcher]] = {}


def _searchers(blocks: list) -> list[Searcher]:
    """The tables, built once in each Python worker; blocks of an earlier run are let go."""
    key = repr([b._path for b in blocks])
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = [Searcher(b.value) for b in blocks]
    return _CACHE[key]


def items_sha256(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def stage(docs: DataFrame, items: DataFrame) -> DataFrame:
    """As a filter stage: a document that holds a window of a benchmark item goes.

    Null and blank texts hold none and stay; a null doc_id is judged like any other; repeated rows go or stay together;
    without items all stay; no rows give no rows; the columns of docs come back as they were."""
    return find_hits(docs, items).where(F.size("hits") == 0).select("row.*")
