"""SimHash near-dedup with bit-sliced comparison.

Distinct fingerprints are dealt into buckets by the pigeonhole rule: of r + 1 bands, two fingerprints within r bits
agree on one. A bucket over ``bucket_limit`` is split again by the same rule over the bits that it has not fixed,
until all are small; after ``MAX_LEVELS`` levels so few bits are free that a bucket is bounded by itself. So the
buckets are bounded and no link is lost. In a bucket fingerprints lie as bit planes, 64 to a word; saturating
carry-save counters update 64 distances at a time and a block is left once all of its lanes exceed the radius. Each
bucket emits a spanning forest of its links, not its pairs.

Defined results: a null or blank text has fingerprint zero and is linked like any other; rows that repeat a doc_id
are one node per distinct fingerprint; a null doc_id is below all others and its component is null; a bit set in just
half of the hashes is 0; equal fingerprints are one node, however many rows have them; a very long text is one piece,
of which only its hashes are held; an empty table gives an empty result; the id and the text alone are read, under
names of the operator's own, so no other column can clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_batch, discard, is_empty, materialise, parts_of, slices
from tidemark.llm.components import components

MAX_LEVELS = 4
NO_ID = -(2**63)
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def _hashes(words: list[bytes], width: int, seed: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), seed)] if words else [], np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1]
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


def shingle_hashes(text: bytes | None, width: int, seed: int = 42, at_once: int = 1 << 20) -> np.ndarray:
    """XXH64 of each shingle of lower-cased (A-Z) words; fewer words than the width are one shingle, none is none. A long
    text is taken a part at a time, each with the last words of the one before."""
    out, words = [], []
    for part in parts_of((text or b"").lower(), at_once):
        words += part.split()
        if len(words) >= width:
            out.append(_hashes(words, width, seed))
            words = words[len(words) - width + 1 :]
    if not out:
        return _hashes(words, width, seed)
    return out[0] if len(out) == 1 else np.concatenate(out)


def majority(h: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes, repeats included."""
    if not len(h):
        return 0
    octets = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(h) < 256:
        counts = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a family of 64-bit mixes of the hashes; the 0th is the hash itself."""
    if k == 0:
        return h
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: bytes | None, width: int = 3, words: int = 1) -> list[int]:
    """A SimHash of 64 bits a word."""
    h = shingle_hashes(text, width)
    return [majority(mixed(h, k)) for k in range(words)]


def fp_cols(words: int) -> list[str]:
    return [f"f{k}" for k in range(words)]


def fingerprints(docs: DataFrame, width: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, f0, ...): the fingerprint's words as signed longs."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(x.as_py(), width, words) for x in batch.column(1)], np.uint64).reshape(-1, words)
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(fps[:, k]).view(np.int64)) for k in range(words)]], ["doc", *fp_cols(words)])

    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    return ids.mapInArrow(by_batch(run), ", ".join(["doc long", *[f"{c} long" for c in fp_cols(words)]]))


def masks(level: int, ways: int) -> list[int]:
    """The bits that each path of bands has fixed: ways^level masks; child j of path p is p * ways + j."""
    if level == 0:
        return [0]
    out = []
    for fixed in masks(level - 1, ways):
        free = [b for b in range(64) if not fixed >> b & 1]
        for j in range(ways):
            out.append(fixed | sum(1 << b for b in free[len(free) * j // ways : len(free) * (j + 1) // ways]))
    return out


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def dealt(nodes: DataFrame, level: int, ways: int) -> DataFrame:
    """Each (f0, node, path) once for each child band: (f0, node, path, key)."""
    table = F.array(*[F.lit(_signed(m)) for m in masks(level, ways)])
    kids = nodes.select("f0", "node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(ways - 1)), lambda j: F.col("path") * ways + j)).alias("path"))
    return kids.withColumn("key", F.xxhash64("path", F.col("f0").bitwiseAND(F.element_at(table, F.col("path") + 1))))


# --- bit-sliced comparison -------------------------------------------------------------------------------------


def planes_of(fps: np.ndarray) -> np.ndarray:
    """fps[row, word] to planes[bit, block]: lane i of block b is the bit of row 64 b + i."""
    blocks = -(-len(fps) // 64)
    padded = np.zeros((blocks * 64, fps.shape[1]), np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(blocks, 64, 8 * fps.shape[1]), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0].astype(np.uint64)


def sliced_matches(fps: np.ndarray, planes: np.ndarray, query: np.ndarray, block: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs (query, block) the lanes, of those asked for, within the radius: (query, block, lanes) of the blocks that have any."""
    width = max(1, int(radius).bit_length())
    start = 2**width - 1 - radius  # a counter so filled carries over with bit radius + 1
    counters = [np.full(len(query), ALL if start >> k & 1 else np.uint64(0)) for k in range(width)]
    over = ~lanes
    bits = planes.shape[0]
    for bit in range(bits):
        if not len(query):
            break
        if bit % 64 == 0:
            values = fps[query, bit // 64]
        carry = planes[bit, block] ^ (np.uint64(0) - ((values >> np.uint64(bit % 64)) & np.uint64(1)))
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if bit >= radius and bit % 4 == 3:
            live = over != ALL
            if np.count_nonzero(live) < 0.75 * len(live):
                query, block, over, values = query[live], block[live], over[live], values[live]
                counters = [c[live] for c in counters]
    live = over != ALL
    return query[live], block[live], ~over[live]


def settle(labels: np.ndarray, a: np.ndarray, b: np.ndarray, edges: list | None = None) -> None:
    """Union the pairs in place: labels[i] becomes the smallest index of i's tree. edges gets the pairs that joined two
    trees, one for each tree that was joined to another."""
    while True:
        x, y = labels[a], labels[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = low != high
        if not apart.any():
            return
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        if edges is not None:
            order = np.lexsort((low, high))
            first = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]  # of each tree the pair to the lowest
            edges.append(np.stack([a[first], b[first]]))
        np.minimum.at(labels, high, low)
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def apart(labels: np.ndarray, query: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The lanes of each block that aren't yet in the query's tree."""
    padded = np.full(-(-len(labels) // 64) * 64, -1)
    padded[: len(labels)] = labels
    differ = padded.reshape(-1, 64)[block] != labels[query][:, None]
    return np.packbits(differ, axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


def trees_of(group: np.ndarray, tree: np.ndarray | None) -> np.ndarray:
    """For each row the first row of its group that has the same tree; without trees, itself."""
    n = len(group)
    labels = np.arange(n)
    if tree is not None and n:
        order = np.lexsort((labels, tree, group))
        new = np.concatenate([[True], (tree[order][1:] != tree[order][:-1]) | (group[order][1:] != group[order][:-1])])
        labels[order] = order[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
    return labels


def hits_of(fps: np.ndarray, planes: np.ndarray, ends: np.ndarray, rows: np.ndarray, labels: np.ndarray, radius: int, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (row, later row of its group) within the radius whose labels differ when their turn comes."""
    first, last = (rows + 1) // 64, (ends[rows] - 1) // 64
    todo = np.where(ends[rows] > rows + 1, last - first + 1, 0)
    cuts, total = [0], np.cumsum(todo)
    while cuts[-1] < len(rows):
        done = total[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(total, done + at_once, "right"))))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        count = todo[lo:hi]
        query = np.repeat(rows[lo:hi], count)
        if not len(query):
            continue
        block = np.repeat(first[lo:hi], count) + np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
        from_lane = np.clip(query + 1 - block * 64, 0, 63).astype(np.uint64)
        to_lane = np.clip(ends[query] - 1 - block * 64, 0, 63).astype(np.uint64)
        lanes = (ALL << from_lane) & (ALL >> (np.uint64(63) - to_lane)) & apart(labels, query, block)
        some = lanes != 0
        q, b, hit = sliced_matches(fps, planes, query[some], block[some], lanes[some], radius)
        for at in range(0, len(q), 1 << 14):
            bits = np.unpackbits(hit[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, lane = np.nonzero(bits)
            yield q[at + i], b[at + i] * 64 + lane


def forest(fps: np.ndarray, group: np.ndarray, radius: int, at_once: int = 1 << 15, tree: np.ndarray | None = None, edges: list | None = None) -> np.ndarray:
    """fps[row, word], rows sorted by group: for each row the smallest row that it is linked to inside its group.

    The first row of each block is compared first, so that in a group of near copies nearly all lanes are in one
    tree, and need no comparing, by the time that the other rows come. Rows of a group that have the same tree are
    linked from the start. edges gets the pairs within the radius that make the forest."""
    n = len(fps)
    labels = trees_of(group, tree)
    ends = np.searchsorted(group, group, "right")
    planes = planes_of(fps)
    begins = np.searchsorted(group, group, "left")
    leads = np.nonzero((begins == np.arange(n)) | (np.arange(n) % 64 == 0))[0]
    for rows in (leads, np.arange(n)):
        for a, b in hits_of(fps, planes, ends, rows, labels, radius, at_once):
            settle(labels, a, b, edges)
    return labels


def whole_keys(batches: Iterator[pa.RecordBatch], least: int = 1 << 13) -> Iterator[pa.Table]:
    """Rows sorted by key, in tables of at least so many rows that end where a key ends."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.concat_tables([*held, pa.Table.from_batches([batch])])
        key = table.column("key").to_numpy()
        changes = np.nonzero(key[1:] != key[:-1])[0]
        cut = int(changes[-1]) + 1 if len(changes) else 0  # the last key may go on
        held = [table]
        if cut >= least:
            held = [table.slice(cut)]
            yield table.slice(0, cut).combine_chunks()
    if held and held[0].num_rows:
        yield held[0].combine_chunks()


def _longs(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def compare_sorted(batches: Iterator[pa.RecordBatch], words: int, radius: int) -> Iterator[pa.RecordBatch]:
    """Over rows (key, node, f0, ...; root or not) sorted by key: pairs (a, b) of nodes within the radius, a spanning forest
    of each key's; nodes of one root need no pair."""
    for table in whole_keys(batches):
        node, edges = _longs(table, "node"), []
        fps = np.stack([_longs(table, c) for c in fp_cols(words)], axis=1).view(np.uint64)
        forest(fps, _rank(_longs(table, "key")), radius, tree=_longs(table, "root") if "root" in table.column_names else None, edges=edges)
        a, b = np.concatenate(edges, axis=1) if edges else np.empty((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])


def _rank(keys: np.ndarray) -> np.ndarray:
    """0, 1, ... for the runs of equal keys."""
    return np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])]) if len(keys) else keys


Comparing = Callable[[Iterator[pa.RecordBatch], int, int], Iterator[pa.RecordBatch]]


def compared(rows: DataFrame, words: int, radius: int, compare: Comparing = compare_sorted) -> DataFrame:
    """Bring the rows of a key together, sorted, and link them."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt_rows = rows.repartition(n, "key").sortWithinPartitions("key", *fp_cols(words))
    return dealt_rows.mapInArrow(lambda it: compare(it, words, radius), "a long, b long")


def exact_links(nodes: DataFrame, radius: int = 2, bucket_limit: int = 8192) -> DataFrame:
    """nodes (node, f0): links (a, b) whose closure is that of all pairs within the radius, by the pigeonhole rule."""
    ways, found, tables = radius + 1, [], []
    open_nodes = nodes.withColumn("path", F.lit(0))
    for level in range(1, MAX_LEVELS + 1):
        rows = dealt(open_nodes, level, ways)
        sizes = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
        shared = materialise(rows.join(sizes, "key"), f"buckets-{level}")
        discard(sizes)
        tables.append(shared)
        last = level == MAX_LEVELS
        found.append(compared(shared if last else shared.where(F.col("size") <= bucket_limit), 1, radius))
        large = shared.where(F.col("size") > bucket_limit)
        if last or not large.take(1):
            break
        open_nodes = large.select("f0", "node", "path")
    links = materialise(reduce(DataFrame.unionByName, found).distinct(), "links")
    discard(*tables)
    return links


def bucket_links(rows: DataFrame, words: int, radius: int, bucket_limit: int = 8192, compare: Comparing = compare_sorted) -> DataFrame:
    """rows (key, node, f0, ...; root or not, and what else the comparing needs): links among the nodes of a key that lie within the radius.

    A bucket over the limit is cut into tiles, and every two tiles meet in a task of their own."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    large = materialise(sizes.where(F.col("size") > bucket_limit).select(F.col("key").alias("large_key"), F.ceil(F.col("size") / (bucket_limit // 2)).cast("int").alias("tiles")), "large-buckets")
    if is_empty(large):
        discard(large)
        return materialise(compared(rows, words, radius, compare).distinct(), "links")
    marked = rows.join(large, rows["key"] == large["large_key"], "left")
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda u: F.xxhash64("key", F.least(tile, u), F.greatest(tile, u)))
    dealt_rows = marked.withColumn("key", F.explode(F.when(F.col("tiles").isNull(), F.array("key")).otherwise(pairs))).drop("large_key", "tiles")
    links = materialise(compared(dealt_rows, words, radius, compare).distinct(), "links")
    discard(large)
    return links


def band_links(nodes: DataFrame, words: int, radius: int, band_bits: int, bucket_limit: int = 8192) -> DataFrame:
    """nodes (node, f0, ...): links among nodes that agree on a band of bits and lie within the radius."""
    cols = fp_cols(words)
    rows = nodes.select("node", *cols, F.explode(F.array(*[key_of(cols, i, band_bits) for i in range(words * 64 // band_bits)])).alias("key"))
    return bucket_links(rows, words, radius, bucket_limit)


def key_of(cols: list[str], i: int, band_bits: int) -> Column:
    """Band i: bits i * band_bits and on of the fingerprint's words laid end to end."""
    word, bit = divmod(i * band_bits, 64)
    part = F.shiftrightunsigned(F.col(cols[word]), bit).bitwiseAND(F.lit((1 << min(band_bits, 64 - bit)) - 1))
    if bit + band_bits > 64:
        rest = F.col(cols[word + 1]).bitwiseAND(F.lit((1 << (bit + band_bits - 64)) - 1))
        part = part.bitwiseOR(F.shiftleft(rest, 64 - bit))
    return F.xxhash64(F.lit(i), part)


def cluster(docs: DataFrame, width: int = 3, radius: int = 2, words: int = 1, band_bits: int = 14, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, f0, ..., component) for each row of docs: the smallest doc that it reaches over links, itself included.

    One word of fingerprint is linked exactly; wider ones where a band of band_bits agrees."""
    cols = fp_cols(words)
    prints = materialise(fingerprints(docs, width, words, id_col, text_col), "fingerprints")
    # A node is a distinct fingerprint. Wide ones go by a hash of theirs: a clash of two would only join two groups.
    node = F.col("f0") if words == 1 else F.xxhash64(*cols)
    nodes = materialise(prints.groupBy(*cols).agg(F.min("doc").alias("rep")).withColumn("node", node), "distinct-fingerprints")
    slim = nodes.select("node", *cols)
    links = exact_links(slim, radius) if words == 1 else band_links(slim, words, radius, band_bits)
    roots = components(links)
    discard(links)
    linked = roots.withColumnRenamed("node", "linked")
    label = nodes.join(linked, nodes["node"] == linked["linked"], "left").select("node", "rep", F.coalesce("component", "node").alias("root"))
    label = materialise(label, "roots")
    least = materialise(label.groupBy("root").agg(F.min("rep").alias("component")), "least")
    named = materialise(label.join(least, "root").select(F.col("node").alias("named"), "component"), "labels")
    discard(nodes, roots, label, least)
    return prints.withColumn("node", node).join(named, F.col("node") == F.col("named"), "left").select("doc", *cols, "component")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- the stage: verified near duplicates -----------------------------------------------------------------------

#: Two documents are near duplicates if they share ALIKE of the shingles that either has.
ALIKE = (4, 5)
#: Words of the stage's fingerprints. A pair at the threshold differs in 39 of the 256 bits, give or take 6.
STAGE_WORDS = 4
#: Radii of the rounds by forests, of near pairs, few of which fail when they are verified; and of the last round, which
#: verifies every pair as it meets, so that none that fails hides another.
FOREST_RADII, LAST_RADIUS = (30, 43), 64
#: Documents meet that agree on all ROWS least hashes of one of BANDS bands. A pair at the threshold does but once in
#: 67,000 times, and lies within the last radius but once in 100,000.
BANDS, ROWS = 28, 5
_MIX = np.array([[xxhash.xxh64_intdigest(f"{k}:{i}") | 1 for i in range(BANDS * ROWS)] for k in range(2)], np.uint64)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def set_hash(h: np.ndarray) -> int:
    return _signed(xxhash.xxh3_64_intdigest(h.tobytes()))


def band_keys(h: np.ndarray, at_once: int = 1 << 14) -> np.ndarray:
    """A key for each band: a hash of the band's least hashes over the set."""
    least = np.full(BANDS * ROWS, ALL)
    for at in range(0, len(h), at_once):
        x = (h[at : at + at_once, None] ^ _MIX[0]) * _MIX[1]
        x ^= x >> np.uint64(32)
        least = np.minimum(least, x.min(axis=0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the sets (sorted) have a Jaccard similarity of ALIKE or more."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * (ALIKE[0] + ALIKE[1]) >= ALIKE[0] * (len(a) + len(b))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, mark, text): rows of one doc and mark have one text, as a null doc_id or a repeated one needn't."""
    text = F.col("text").cast("binary")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))


def sketches(rows: DataFrame, width: int) -> DataFrame:
    """(doc, mark, node, keys, f0, ...) of rows (doc, mark, text): node is the hash of the set of shingles, keys are those
    of its bands, f0 and on its fingerprint."""
    names = ["doc", "mark", "node", "keys", *fp_cols(STAGE_WORDS)]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for piece in slices(batch, 2, 4_000_000):
            sets = [shingle_set(x.as_py(), width) for x in piece.column(2)]
            keys = pa.array(np.concatenate([band_keys(h) for h in sets]).view(np.int64))
            ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
            prints = [pa.array(np.array([majority(mixed(h, k)) for h in sets], np.uint64).view(np.int64)) for k in range(STAGE_WORDS)]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([set_hash(h) for h in sets], pa.int64()), pa.ListArray.from_arrays(ends, keys), *prints], names)

    return rows.mapInArrow(by_batch(run), "doc long, mark long, node long, keys array<long>, " + ", ".join(f"{c} long" for c in fp_cols(STAGE_WORDS)))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets (node, shingles) are alike."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a, b = ([np.frombuffer(x.as_buffer() or b"", np.uint64) for x in batch.column(i)] for i in (2, 3))
        good = pa.array([alike(x, y) for x, y in zip(a, b, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["a", "b"])

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for piece in slices(batch, 2, 4_000_000):
            yield from run(piece)

    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(by_batch(cut), "a long, b long")


def shingle_sets(rows: DataFrame, own: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the nodes in own (node, d, m), each made from one row."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for piece in slices(batch, 1, 4_000_000):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([shingle_set(x.as_py(), width).tobytes() for x in piece.column(1)], pa.binary())], ["node", "shingles"])

    texts = rows.join(own.hint("merge"), (F.col("doc") == F.col("d")) & (F.col("mark") == F.col("m"))).select("node", "text").dropDuplicates(["node"])
    return texts.mapInArrow(by_batch(run), "node long, shingles binary")


def verify_sorted(batches: Iterator[pa.RecordBatch], words: int, radius: int) -> Iterator[pa.RecordBatch]:
    """Over rows (key, bucket, node, root, f0, ..., shingles) sorted by key: links of nodes whose sets are alike, a spanning
    forest of those within the radius that are in different trees. A pair that meets in several buckets is verified in that of
    the first band that it shares."""
    for table in whole_keys(batches, 1 << 11):
        node, key, bucket = _longs(table, "node"), _longs(table, "key"), _longs(table, "bucket")
        fps = np.stack([_longs(table, c) for c in fp_cols(words)], axis=1).view(np.uint64)
        sets = [np.frombuffer(x.as_buffer() or b"", np.uint64) for x in table.column("shingles")]
        keys = np.stack([band_keys(h) for h in sets]).view(np.int64)
        own = (keys == bucket[:, None]).argmax(axis=1)
        group = _rank(key)
        labels = trees_of(group, _longs(table, "root"))
        out: list[tuple[int, int]] = []
        for a, b in hits_of(fps, planes_of(fps), np.searchsorted(group, group, "right"), np.arange(len(fps)), labels, radius, 1 << 13):
            here = (keys[a] == keys[b]).argmax(axis=1) == own[a]
            for i, j in zip(a[here].tolist(), b[here].tolist(), strict=True):
                if labels[i] != labels[j] and alike(sets[i], sets[j]):
                    settle(labels, np.array([i]), np.array([j]))
                    out.append((int(node[i]), int(node[j])))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ([], []))], ["a", "b"])


def apart_buckets(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of buckets (key, node, ...) that still hold several components, with each node's root."""
    linked = roots.withColumnRenamed("node", "linked")
    rooted = materialise(buckets.drop("root").join(linked, F.col("node") == F.col("linked"), "left").withColumn("root", F.coalesce("component", "node")).drop("linked", "component"), "rooted")
    split = materialise(rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key"), "split")
    out = materialise(rooted.join(split, "key", "left_semi"), "split-buckets")
    discard(rooted, split)
    return out


def near_roots(rows: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, component) of the nodes (node, doc, mark, keys, f0, ...) that have near duplicates.

    Nodes that share a key meet. A round compares their fingerprints by bit planes, and verifies the pairs of a forest on the
    whole sets; the next sees only the buckets that verified links have not joined, and no pair inside a component. The
    last round has the sets at hand and verifies all pairs within its radius. So no pair within it is left out but
    inside a component, and no round emits more than a forest."""
    cols = fp_cols(STAGE_WORDS)
    dealt_rows = nodes.select("node", *cols, F.explode("keys").alias("key"))
    often = materialise(dealt_rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key"), "shared-keys")
    buckets = materialise(dealt_rows.join(often, "key", "left_semi"), "buckets")
    ends = buckets.select(F.col("node").alias("end")).distinct()
    own = materialise(nodes.join(ends, F.col("node") == F.col("end"), "left_semi").select("node", F.col("doc").alias("d"), F.col("mark").alias("m")), "compared")
    sets = materialise(shingle_sets(rows, own, width), "shingle-sets")
    discard(often, own)
    links, roots = [], None
    for radius in FOREST_RADII:
        if roots is not None:
            buckets = narrowed(buckets, roots)
        found = bucket_links(buckets, STAGE_WORDS, radius)
        links.append(materialise(verified(found, sets), "verified"))
        discard(found)
        roots = components(reduce(DataFrame.unionByName, links))
    buckets = narrowed(buckets, roots)
    held = buckets.withColumn("bucket", F.col("key")).join(sets.withColumnRenamed("node", "of"), F.col("node") == F.col("of")).drop("of")
    links.append(bucket_links(held, STAGE_WORDS, LAST_RADIUS, 2048, verify_sorted))
    roots = components(reduce(DataFrame.unionByName, links))
    discard(buckets, sets, *links)
    return roots


def narrowed(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """apart_buckets(), and what it was made of goes."""
    out = apart_buckets(buckets, roots)
    discard(buckets, roots)
    return out


def stage(docs: DataFrame, width: int = 5) -> DataFrame:
    """As a filter stage: of each component of near duplicates one row stays, of the smallest doc_id.

    Near duplicates have a Jaccard similarity of ALIKE or more in their sets of five-word shingles (A-Z lower-cased);
    fingerprints find them and every link is verified, see near_roots(). Rows are told apart by doc_id and text: a null
    doc_id is below all others, of its texts and of those of a repeated doc_id each is judged, and of equal rows one
    stays. Null and blank texts are alike; fewer than five words are one shingle; ties of doc_id go by a hash of the
    text; no rows give no rows; the columns of docs come back as they were."""
    rows = keyed(docs)
    prints = materialise(sketches(rows, width), "sketches")
    lowest = F.min(F.struct("doc", "mark")).alias("rep")
    one_of = [F.first(c).alias(c) for c in ("keys", *fp_cols(STAGE_WORDS))]
    nodes = materialise(prints.groupBy("node").agg(lowest, *one_of).select("node", "rep.doc", "rep.mark", "keys", *fp_cols(STAGE_WORDS)), "distinct-sets")
    discard(prints)
    roots = near_roots(rows, nodes, width)
    linked = roots.withColumnRenamed("node", "linked")
    label = nodes.join(linked, F.col("node") == F.col("linked"), "left").select("doc", "mark", F.coalesce("component", "node").alias("root"))
    keep = materialise(label.groupBy("root").agg(lowest).select(F.col("rep.doc").alias("d"), F.col("rep.mark").alias("m")), "kept")
    discard(nodes, roots)
    whole = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__doc"), F.xxhash64(F.col("text").cast("binary")).alias("__mark"))
    one = whole.join(keep.hint("merge"), (F.col("__doc") == F.col("d")) & (F.col("__mark") == F.col("m")), "left_semi").dropDuplicates(["__doc", "__mark"])
    return one.select("row.*")
