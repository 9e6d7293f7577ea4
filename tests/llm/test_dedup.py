import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import fixture as X
from tidemark.llm import components, line_dedup, simhash_dedup, substring_dedup
from tidemark.llm.simhash_dedup import NO_ID

ROWS = X.corpus()


def null(i):
    return None if i == NO_ID else i


@pytest.mark.parametrize("rows", [ROWS, [], [(1, None, None, None)], [(i, "w " * 200, "en", "hot") for i in range(40)]])
def test_substrings(spark, rows):
    got = {null(r.doc): (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(X.frame(spark, rows)).collect()}
    assert got == X.plain_substrings(rows)


def test_substrings_repeated_rows(spark):
    rows = [(1, "a b " * 15, "en", "s")] * 2 + [(2, "a b " * 15, "en", "s")]
    got = substring_dedup.dedup_substrings(X.frame(spark, rows)).collect()
    assert len(got) == 3 and len({(r.doc, r.kept_sha256) for r in got}) == 2


def test_spans_are_maximal():
    starts = np.zeros(70, bool)
    starts[[0, 1, 5, 40, 60]] = True
    assert substring_dedup.spans_of(starts, 20) == [(0, 25), (40, 80)]


def test_matches_extend_both_ways():
    rng = np.random.default_rng(1)
    words, other = rng.integers(0, 9**9, 100).astype(np.uint64), rng.integers(0, 9**9, 300).astype(np.uint64)
    other[150:190] = words[30:70]
    assert substring_dedup.along(words, other, 120, 20) == [(30, 51)]
    other[170] = 0
    assert substring_dedup.along(words, other, 120, 20) == [(30, 31)] and substring_dedup.along(words, other, 119, 20) == []
    assert substring_dedup.along(words, words, 0, 20) == [(0, 81)] and substring_dedup.along(words[:19], words, 0, 20) == []
    assert substring_dedup.along(words, words[40:], -40, 20) == [(40, 81)]


def passages(seed=3):
    """Texts of passages from a few, in any order, so that neighbours differ from text to text and diagonals cross."""
    rng = np.random.default_rng(seed)
    held = [" ".join(f"w{x}" for x in rng.integers(0, 400, n)) for n in (15, 22, 30, 60, 150, 300)]
    rows = []
    for i in range(60):
        some = [held[k] for k in rng.integers(0, len(held), rng.integers(1, 6))]
        own = [" ".join(f"o{x}" for x in rng.integers(0, 10**6, rng.integers(0, 9))) for _ in some]
        rows.append((i, " ".join(x for pair in zip(own, some, strict=True) for x in pair), "en", "s"))
    return [*rows, (900, "loop de loop " * 200, "en", "s"), (901, "a b c d e f g h i j k " * 60, "en", "s"), (902, "de loop loop " * 100, "en", "s")]


def test_substrings_of_shuffled_passages(spark):
    rows = passages()
    got = {null(r.doc): (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(X.frame(spark, rows)).collect()}
    assert got == X.plain_substrings(rows)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(0)
    for _ in range(50):
        shared = rng.integers(0, 2**63, 20).astype(np.uint64)
        places = []
        for n in (7, 31):
            words = np.concatenate([rng.integers(0, 2**63, n).astype(np.uint64), shared, rng.integers(0, 2**63, 9).astype(np.uint64)])
            at = substring_dedup.anchors(substring_dedup.gram_hashes(words, 7, 1), 14)
            places.append({int(a) - n for a in at if n <= a <= n + 13})
        assert places[0] & places[1]


@pytest.mark.parametrize("rows", [ROWS, [], [(None, "x" * 50, None, None)], [(i, "l" * 40 + "\nshort\n" + "L" * 40, "en", "s") for i in range(9)]])
@pytest.mark.parametrize("batches", [1, 5])
def test_lines(spark, rows, batches):
    docs = X.frame(spark, rows).withColumnsRenamed({"h": "n_lines", "doc": "n_dropped", "row": "kept_text"})
    out = line_dedup.dedup_lines(docs, batches=batches, fanout=2)
    got = {r.row.doc_id: (r.n_lines, r.n_dropped, r.s) for r in out.withColumn("s", F.sha2("kept_text", 256)).collect()}
    assert out.schema["row"].dataType.names == docs.columns
    assert got == X.plain_lines(rows)


def test_runs_are_disjoint_and_levelled(spark):
    index = line_dedup.LineRuns(spark, fanout=2)
    for lo in (30, 20, 10, 0):
        docs = spark.range(lo, lo + 12).select(F.col("id").alias("doc"), F.encode(F.col("id").cast("string"), "utf-8").alias("h"))
        index.add(docs)
    assert len(index.runs()) == 1 and len(index.levels) == 3
    runs = spark.table(index.runs()[0])
    assert runs.count() == runs.select("h").distinct().count() == 42
    assert index.frequent(2).count() == 6


def test_line_stage_keeps_columns(spark):
    docs = X.frame(spark, ROWS)
    out = line_dedup.stage(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    want = X.plain_lines(ROWS)
    for i, text, *_ in ROWS:
        if i in got and want[i][1]:
            assert X.sha(got[i]) == want[i][2]
        elif i in got:
            assert got[i] == text


@pytest.mark.parametrize("rows", [ROWS, [], [(None, "one two", None, None)]])
def test_simhash(spark, rows):
    found = simhash_dedup.cluster(X.frame(spark, rows)).withColumn("hex", simhash_dedup.hex_of(F.col("f0"))).collect()
    prints = {r[0]: X.plain_fingerprint(r[1]) for r in rows}
    assert {null(r.doc): r.hex for r in found} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {null(r.doc): null(r.component) for r in found} == X.plain_components(prints)


@pytest.mark.parametrize("limit", [4, 8192])
def test_links_are_exact_in_split_buckets(spark, limit):
    """A cloud of near fingerprints, far over the limit of a bucket."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**63))
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(400)} | {int(x) for x in rng.integers(0, 2**63, 200)}
    prints = dict(enumerate(sorted(fps)))
    nodes = spark.createDataFrame([(simhash_dedup._signed(p),) * 2 for p in prints.values()], "node long, f0 long")
    linked = components.components(simhash_dedup.exact_links(nodes, 2, limit)).collect()
    label = {r.node: r.component for r in linked}
    groups = lambda of: {frozenset(k for k in prints if of(k) == g) for g in {of(k) for k in prints}}
    plain = X.plain_components(prints)
    assert groups(lambda k: label.get(simhash_dedup._signed(prints[k]), simhash_dedup._signed(prints[k]))) == groups(plain.__getitem__)


@pytest.mark.parametrize("limit", [16, 8192])
def test_bands_in_tiles_find_the_same(spark, limit):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 4).astype(np.uint64)
    rows = []
    for i in range(120):
        fp = base.copy() if i < 90 else rng.integers(0, 2**63, 4).astype(np.uint64)
        for b in rng.choice(256, 8, replace=False):
            fp[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        rows.append((i, *[int(x) for x in fp.view(np.int64)]))
    nodes = spark.createDataFrame(rows, "node long, f0 long, f1 long, f2 long, f3 long")
    got = components.components(simhash_dedup.band_links(nodes, 4, 43, 14, limit)).collect()
    assert {r.node: r.component for r in got} == {i: 0 for i in range(1, 90)}


def test_forest_radius():
    rng = np.random.default_rng(2)
    fps = (rng.integers(0, 2**62, 300).astype(np.uint64) & np.uint64(0x3FF))[:, None]
    group = np.sort(rng.integers(0, 4, 300))
    for radius in (0, 1, 2, 3):
        got = simhash_dedup.forest(fps, group, radius, at_once=64)
        for g in range(4):
            own = {int(i): int(fps[i, 0]) for i in np.flatnonzero(group == g)}
            want = X.plain_components(own, radius)
            assert {i: int(got[i]) for i in own} == want


@pytest.mark.parametrize("text", [r[1] for r in ROWS[::6]] + ["a b", "", " x ", "a b c", "a b c d"])
def test_shingles_by_parts(text):
    raw = (text or "").encode()
    for at_once in (1, 5, 64):
        assert simhash_dedup.shingle_hashes(raw, 3, at_once=at_once).tolist() == simhash_dedup.shingle_hashes(raw, 3).tolist()


def test_recall_by_similarity():
    """Planted pairs: those of a Jaccard similarity of 0.8 or more meet in a band and lie within the last radius."""
    rng = np.random.default_rng(1)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    met = {0.8: [], 0.85: [], 0.9: []}
    for _ in range(900):
        base = words(int(rng.integers(60, 300)))
        copy = list(base)
        for at in rng.choice(len(base), max(1, int(len(base) * rng.uniform(0.005, 0.045))), replace=False):
            copy[at] = words(1)[0]
        a, b = (simhash_dedup.shingle_set(" ".join(x).encode(), 5) for x in (base, copy))
        alike = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        near = sum((simhash_dedup.majority(simhash_dedup.mixed(a, k)) ^ simhash_dedup.majority(simhash_dedup.mixed(b, k))).bit_count() for k in range(4)) <= simhash_dedup.LAST_RADIUS
        for low in met:
            if low <= alike < low + 0.05:
                met[low].append(near and bool((simhash_dedup.band_keys(a) == simhash_dedup.band_keys(b)).any()))
    assert all(len(x) > 100 and np.mean(x) > 0.99 for x in met.values())


def test_edges_make_the_forest():
    rng = np.random.default_rng(7)
    fps = (rng.integers(0, 2**62, 200).astype(np.uint64) & np.uint64(0xFF))[:, None]
    group, tree, edges = np.sort(rng.integers(0, 3, 200)), rng.integers(0, 150, 200), []
    labels = simhash_dedup.forest(fps, group, 1, at_once=64, tree=tree, edges=edges)
    a, b = np.concatenate(edges, axis=1)
    assert all(int(fps[i, 0] ^ fps[j, 0]).bit_count() <= 1 and group[i] == group[j] for i, j in zip(a.tolist(), b.tolist()))
    again = simhash_dedup.trees_of(group, tree)
    trees = len(set(again.tolist()))
    simhash_dedup.settle(again, a, b)
    assert again.tolist() == labels.tolist() and len(a) == trees - len(set(labels.tolist()))


def test_simhash_stage(spark):
    docs = X.frame(spark, ROWS)
    out = simhash_dedup.stage(docs)
    assert out.columns == docs.columns
    left = [r.doc_id for r in out.collect()]
    assert len(left) == len(set(left)) and 60 in left and not {61, 62, 63, 64, 65} & set(left)
    assert 904 in left and 905 not in left


def near_pairs(seed=8):
    """Texts in pairs of similarities from 0.55 to 1, and a large group of them around a base."""
    rng = np.random.default_rng(seed)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    out = []
    for edits in [0, *range(1, 13)] * 20:
        base = words(int(rng.integers(100, 260)))
        copy = list(base)
        for at in rng.choice(len(base), edits, replace=False):
            copy[at] = words(1)[0]
        out += [" ".join(base), " ".join(copy)]
    base = words(150)
    for _ in range(60):
        copy = list(base)
        for at in rng.choice(150, int(rng.integers(1, 7)), replace=False):
            copy[at] = words(1)[0]
        out.append(" ".join(copy))
    rows = [(i, t, "en", "hot") for i, t in enumerate(out)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in enumerate(out) for w in [t.split()]}
    return rows, sets


def plain_groups(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {find(i) for i in sets}


@pytest.fixture(scope="module")
def near(spark):
    rows, sets = near_pairs()
    return {r.doc_id for r in simhash_dedup.stage(X.frame(spark, rows)).collect()}, sets


def test_stage_finds_all_at_the_threshold(near):
    left, sets = near
    assert not left - plain_groups(sets)


def test_stage_keeps_what_is_below_the_threshold(near):
    left, sets = near
    assert not plain_groups(sets) - left


def test_stage_keeps_rows_without_an_id_of_their_own(spark):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(None, words(1), None, None), (None, words(2), None, None), (None, words(2), None, None), (5, words(3), None, None), (5, words(4), None, None), (6, words(4), None, None), (3, words(5), None, None), (5, words(5), None, None)]
    left = simhash_dedup.stage(X.frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == sorted([("None", words(1)), ("None", words(2)), ("5", words(3)), ("5", words(4)), ("3", words(5))])
    assert simhash_dedup.stage(X.frame(spark, [])).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {1000 + i: 1000 for i in range(1, 200)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
