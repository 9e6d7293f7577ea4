import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import fixture as X
from tidemark.llm import html_extract as H
from tidemark.llm import language_id as L
from tidemark.llm import mixing, quality_knn, quality_rules

ROWS = X.corpus()


# --- quality rules ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", [r[1] for r in ROWS[::5]] + [None, "", "a b c d e a b c d e f", "l x\nl x\n\n\nl x", "é# ##|<>&%$*", "x " * 50])
def test_counts(text):
    raw = text.encode() if text is not None else None
    assert quality_rules.counts_of(raw)[:5] == X.plain_counts(text) and quality_rules.counts_of(raw, 3) == quality_rules.counts_of(raw)


def labelled(n=600, seed=3):
    """Junk of two kinds among plain texts."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(3000)]
    rows, labels = [], []
    for i in range(n):
        text = [str(w) for w in rng.choice(words, rng.integers(20, 80))]
        kind = i % 6
        if kind == 0:
            text = [w + "###" for w in text]
        elif kind == 1:
            text = [w for w in text[:4] for _ in range(6)]
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, int(kind > 1)))
    return rows, labels


def test_rules_find_junk_and_keep_the_rest(spark):
    rows, labels = labelled()
    docs = X.frame(spark, rows + [(7000, None, None, None), (None, "a few words", None, None)])
    table = spark.createDataFrame([*labels, (5, None), (None, 0)], "doc_id long, quality int")
    got = {r.row.doc_id: r for r in quality_rules.judge(docs, table).collect()}
    truth = dict(labels)
    wrong = [i for i in truth if got[i].kept != bool(truth[i])]
    assert len(wrong) <= 6 and all(got[i].kept for i in truth if truth[i])
    assert not got[7000].kept and got[7000].base_failed
    assert quality_rules.stage(docs, table).columns == docs.columns


def test_rules_without_labels(spark):
    docs = X.frame(spark, ROWS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept != r.base_failed for r in quality_rules.judge(docs, none).collect())
    assert quality_rules.judge(X.frame(spark, []), none).count() == 0


def test_expression_equals_rules(spark):
    rows, labels = labelled()
    docs = X.frame(spark, rows)
    counted = quality_rules.with_counts(docs)
    rules = quality_rules.learn_from(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    frame = counted.select("row.doc_id", *[quality_rules.ratio(r).alias(r) for r in quality_rules.RATIOS], quality_rules.verdict(rules).alias("kept")).toPandas()
    x = {r: frame[r].to_numpy(float) for r in quality_rules.RATIOS}
    assert rules and (frame["kept"].to_numpy() == ~np.logical_or.reduce([r.covers(x) for r in rules])).all()


# --- quality by neighbours -------------------------------------------------------------------------------------


def test_neighbours(spark):
    rows, labels = labelled(900)
    docs = X.frame(spark, rows + [(7000, None, None, None), (7001, "", None, None), (None, "x", None, None)])
    got = quality_knn.score(docs, spark.createDataFrame(labels, "doc_id long, quality int"), sample=400).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 200 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got) and len(got) == 903


def test_neighbours_without_labels(spark):
    got = quality_knn.score(X.frame(spark, ROWS), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r.score for r in got} == {0.5}
    assert quality_knn.score(X.frame(spark, []), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0


def test_ties_go_to_the_first():
    base, z = np.tile(np.eye(2, dtype=np.float32)[0], (6, 1)), np.eye(2, dtype=np.float32)[:1]
    assert quality_knn.vote(z, base, np.array([1.0, 1, 1, 0, 0, 0]), 3)[0] == 1 and quality_knn.vote(z, base, np.array([0.0, 0, 1, 1, 1, 1]), 3)[0] == pytest.approx(1 / 3)


def plain_scores(rows, labels, sample_ids, k=quality_knn.K):
    """Cosines of every text to every labelled one, one pair at a time."""
    counts = {i: quality_knn.term_counts(t.encode() if t is not None else None) for i, t, *_ in rows}
    df = sum((c > 0).astype(float) for c in counts.values())
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    ids = sorted(sample_ids)
    x = quality_knn.weighted(np.stack([counts[i] for i in ids]), idf)
    axes = quality_knn.latent_axes(x, quality_knn.RANK)
    base = quality_knn.unit(x @ axes)
    out = {}
    for i, c in counts.items():
        if not c.any():
            out[i] = np.mean([labels[j] for j in ids])
            continue
        z = quality_knn.unit(quality_knn.weighted(c[None], idf).astype(np.float32) @ axes.astype(np.float32))[0]
        near = sorted(((-round(float(z @ b), 5), n) for n, b in enumerate(base)))[:k]
        weight = [max(-s, 0) ** 8 + 1e-12 for s, _ in near]
        out[i] = sum(w * labels[ids[n]] for w, (_, n) in zip(weight, near, strict=True)) / sum(weight)
    return out


def test_scores_are_those_of_plain_pairs(spark):
    rows, labels = labelled(150)
    docs = X.frame(spark, [*rows, (7000, None, None, None), (7001, rows[3][1], None, None)])
    got = {r.doc_id: r.score for r in quality_knn.score(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    learned = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    want = plain_scores([*rows, (7000, None), (7001, rows[3][1])], dict(labels), learned)
    assert got == {i: pytest.approx(v, abs=5e-3) for i, v in want.items()} and got[7001] == got[3]
    assert np.mean([abs(got[i] - want[i]) < 1e-4 for i in got]) > 0.95


def test_long_texts_are_counted_in_segments():
    text = b"alpha beta  gamma\n" * 5000
    assert (quality_knn.word_ids(text, 1000) == quality_knn.word_ids(text)).all() and len(quality_knn.word_ids(text, 1)) == 15_000
    c = quality_knn.term_counts(text)
    assert (quality_knn.unpacked([quality_knn.packed(c)])[0] == c).all()


def test_vote_is_exact():
    rng = np.random.default_rng(1)
    base, y, z = quality_knn.unit(rng.standard_normal((50, 8))), rng.integers(0, 2, 50).astype(float), quality_knn.unit(rng.standard_normal((9, 8)))
    got = quality_knn.vote(z, base, y, 7)
    for i in range(9):
        sims = base @ z[i]
        near = np.argsort(-sims)[:7]
        w = np.clip(sims[near], 0, None).astype(float) ** 8 + 1e-12
        assert got[i] == pytest.approx((w * y[near]).sum() / w.sum(), rel=1e-4)


# --- language --------------------------------------------------------------------------------------------------


def test_backpropagation_through_time():
    """Gradients against finite differences."""
    model = L.BiGRU(["a", "b", "c"], hidden=3, seed=0)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    raw, size = L.padded([b"abca", b"ba", b"c"])
    target, weight = np.array([0, 2, 1]), np.array([1.0, 2.0, 0.5])
    _, grad = model.gradients(raw, size, target, weight)
    rng = np.random.default_rng(0)
    for name, g in grad.items():
        flat = np.flatnonzero(np.abs(g).ravel() > 1e-4)
        for at in rng.choice(flat, min(4, len(flat)), replace=False):
            w = model.w[name].reshape(-1)
            keep, e = w[at], 1e-3
            w[at] = keep + e
            up, _ = model.gradients(raw, size, target, weight)
            w[at] = keep - e
            down, _ = model.gradients(raw, size, target, weight)
            w[at] = keep
            assert (up - down) / (2 * e) == pytest.approx(g.ravel()[at], rel=0.05, abs=2e-3), name


def language_rows(n=240, seed=4):
    rng = np.random.default_rng(seed)
    parts = {"en": ["th", "ing", "the", "wh", "ed"], "de": ["sch", "ung", "ein", "ä", "ü"]}
    rows = []
    for i in range(n):
        lang = ["en", "de"][i % 2]
        text = " ".join("".join(rng.choice(parts[lang], rng.integers(1, 4))) for _ in range(20))
        rows.append((i, text.upper() if i % 5 == 0 else text, None if i % 11 == 0 else lang, "s"))
    return rows


def test_languages(spark):
    rows = language_rows()
    docs = X.frame(spark, rows + [(7000, None, "en", None), (7001, "123 !!", "en", None), (7002, "", "de", None), (None, "thing the", "en", None)])
    got = {r.doc_id: r for r in L.identify(docs, steps=150).collect()}
    held = [(got[i].lang_pred, ["en", "de"][i % 2]) for i, *_ in rows if got[i].held_out]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (7000, 7001, 7002))
    assert all(0 <= r.score <= 1 for r in got.values())


def test_languages_unlearned(spark):
    rows = [(1, "words", None, None), (2, None, "en", None)]
    assert {r.lang_pred for r in L.identify(X.frame(spark, rows)).collect()} == {"und"}
    assert L.identify(X.frame(spark, [])).count() == 0


def plain_label(model, text, own, around):
    """A text's languages byte by byte in plain loops: slices with context, a state from each end, pooled letters."""
    w, h = {k: v.astype(float) for k, v in model.w.items()}, model.hidden
    sig = lambda x: 1 / (1 + np.exp(-x))
    logp, prob, n = np.zeros(len(model.languages)), np.zeros(len(model.languages)), 0
    for at in range(0, len(text), own):
        lo, hi = max(0, at - around), min(len(text), at + own + around)
        states = {}
        for d, order in (("f", range(lo, hi)), ("b", range(hi - 1, lo - 1, -1))):
            state = np.zeros(h)
            for i in order:
                x = w[f"x{d}"][text[i]] + w[f"b{d}"]
                zr = sig(x[: 2 * h] + state @ w[f"u{d}"])
                state = state + zr[:h] * (np.tanh(x[2 * h :] + (zr[h:] * state) @ w[f"c{d}"]) - state)
                states[d, i] = state
        for i in range(at, min(len(text), at + own)):
            if 97 <= text[i] <= 122 or text[i] >= 128:
                x = np.concatenate([states["f", i], states["b", i]]) @ w["o"] + w["ob"]
                p = np.exp(x - x.max())
                p /= p.sum()
                logp, prob, n = logp + np.log(p), prob + p, n + 1
    return (model.languages[int(logp.argmax())], prob[logp.argmax()] / n) if n else ("und", 0.0)


def test_labels_are_those_of_plain_loops():
    model = L.BiGRU(["a", "b", "c"], seed=1)
    texts = ["one two, one", "", None, "123", "ä", "straße " * 150, "x" * 1000, "end."]
    got = L.label(model, [t.encode() if t is not None else None for t in texts])
    for t, (lang, score) in zip(texts, got, strict=True):
        want = plain_label(model, (t or "").encode(), L.SLICE, L.CONTEXT)
        assert lang == want[0] and score == pytest.approx(want[1], abs=1e-4)
    for t, one in zip(texts, got, strict=True):  # the batch plays no part
        alone = L.label(model, [t.encode() if t is not None else None])[0]
        assert alone[0] == one[0] and alone[1] == pytest.approx(one[1], abs=1e-5)


def test_long_texts_keep_their_language():
    model = L.BiGRU(["a", "b"], seed=2)
    words = b"wing sch \xc3\xa4b " * 40_000  # 440 kB in 1,146 slices
    assert L.label(model, [words])[0][0] == L.label(model, [words[: 14 * 500]])[0][0]
    parts = L.cut(words)
    assert b"".join(p[a:b] for p, a, b in parts) == words and max(len(p) for p, _, _ in parts) <= L.SLICE + 2 * L.CONTEXT
    assert [len(L.spread(words[:n])) for n in (0, 10, 97, 5000)] == [1, 1, 1, 8] and L.spread(words)[-1] == words[-(len(words) % 96) - 96 : len(words) - len(words) % 96]


def test_rare_languages_and_repeats_are_learned(spark):
    rows = [(i, "the thing with wings", "en", "s") for i in range(700)] + [(i, "sch und ein", "de", "s") for i in range(700, 703)]
    rows += [(None, "null rows", "en", "s")] * 5 + [(5, "the thing with wings", "en", "s")] * 50 + [(9000, "½ ② 12", "en", "s")]
    got = L.training_slices(X.frame(spark, rows), 2, 4)
    de = [s for lang, s in got if lang == "de"]
    assert de and set(de) == {b"sch und ein"} and 300 < len(got) <= 704 and not any(b"null" in s or b"12" in s for _, s in got)


def test_numbers_that_look_like_letters_are_und(spark):
    rows = language_rows(60) + [(7000 + i, t, "en", "s") for i, t in enumerate(["½ ²", "①", "Ⅷ 12", "_"])]
    got = {r.doc_id: r for r in L.identify(X.frame(spark, rows), steps=5).collect()}
    assert all(got[7000 + i].lang_pred == "und" and got[7000 + i].score == 0 for i in range(4))


@pytest.mark.parametrize("n", [400, 30_000])
def test_samples_are_whole(spark, n):
    """Min(most, n) keys of sparse rows, whatever repeats; the same ones whatever the layout."""
    from tidemark.llm.common import hash_sample

    rows = spark.range(200_000).withColumn("label", F.when(F.col("id") % (200_000 // n) == 0, F.col("id") % 2))
    usable = rows.where("label IS NOT NULL")
    usable = usable.unionByName(usable.where("id = 0").crossJoin(spark.range(3000).select()))
    got = [r.id for r in hash_sample(usable, ["id"], 3000).collect()]
    total = usable.select("id").distinct().count()
    assert len(got) == len(set(got)) == min(3000, total)
    assert set(got) == {r.id for r in hash_sample(usable.repartition(7), ["id"], 3000).collect()}
    by = hash_sample(usable.withColumn("rare", F.when(F.col("id") < 2000, "r").when(F.col("id") > 150_000, "c")), ["id"], 100, by="rare")
    kinds = {r.rare: r.n for r in by.groupBy("rare").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = {"r": "id < 2000", "c": "id > 150000", None: "id BETWEEN 2000 AND 150000"}
    assert kinds == {k: min(100, usable.where(on).select("id").distinct().count()) for k, on in held.items()}
    assert hash_sample(usable.limit(0), ["id"], 10).count() == 0


# --- mixing ----------------------------------------------------------------------------------------------------


def mixed_rows():
    rng = np.random.default_rng(2)
    size = {"hot": 400, "mid": 60, "low": 12, None: 5}
    ids = iter(range(10_000))
    return [(next(ids), " ".join(["w"] * int(rng.integers(0, 30))), "en", s) for s, n in size.items() for _ in range(n)] + [(9000, None, None, "void")]


@pytest.mark.parametrize("kwargs", [{}, {"entropy": 0.6}, {"repeats": 2.0}, {"budget": 3000}, {"entropy": 1.0, "repeats": 1000.0}])
def test_mixing(spark, kwargs):
    rows = mixed_rows()
    got = mixing.mix(X.frame(spark, rows), **kwargs).toPandas()
    n = {i: len(X.split(t)) for i, t, *_ in rows}
    assert len(got) == len(rows) and all(n[r.doc_id] == r.n_tokens for r in got.itertuples())
    got["source"] = got["source"].fillna("-")
    per = got.groupby("source").agg(tokens=("n_tokens", "sum"), weight=("weight", "first"))
    per = per[per.tokens > 0]
    assert per.weight.sum() == pytest.approx(1)
    drawn = (got.n_tokens * got.copies).groupby(got.source).sum()[per.index]
    spend = kwargs.get("budget", (per.tokens / per.weight).max())
    for s in per.index:  # short of its quota by less than one document
        assert 0 <= per.weight[s] * spend - drawn[s] + 1e-6 < 31
    repeats = (per.weight * spend / per.tokens).max()
    entropy = -(per.weight * np.log(per.weight)).sum() / np.log(len(per))
    limit = kwargs.get("repeats", mixing.REPEATS)
    assert repeats <= limit * 1.001
    assert entropy >= kwargs.get("entropy", mixing.ENTROPY) - 1e-4 or repeats == pytest.approx(limit, rel=0.01) or "budget" in kwargs
    if "budget" not in kwargs:
        assert got.copies.min() >= 1


def test_mixing_takes_the_lowest_hashes(spark):
    got = mixing.mix(X.frame(spark, mixed_rows()), budget=2000).withColumn("h", F.md5(F.concat(F.lit("17:"), F.col("doc_id").cast("string")))).toPandas()
    for _, g in got[got.n_tokens > 0].groupby("source"):
        more = g[g.copies == g.copies.max()].h
        less = g[g.copies < g.copies.max()].h
        assert not len(less) or more.max() < less.min()


def test_mixing_edges(spark):
    assert mixing.mix(X.frame(spark, [])).count() == 0
    assert [r.copies for r in mixing.mix(X.frame(spark, [(1, None, None, None), (2, "", None, "a")])).collect()] == [1, 1]
    out = mixing.stage(X.frame(spark, ROWS))
    assert out.columns == [*X.frame(spark, []).columns, "mix_weight", "mix_copies"]
    assert mixing.draws(mixing.mix(X.frame(spark, mixed_rows()))).count() > len(mixed_rows())


# --- pages -----------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Top</header><nav><ul><li><a href="/a">menu</a></li></ul></nav>
<!-- ad --><div class="ad">Buy</div><div class="cookie-notice">We use</div><article><h1>Title&amp;</h1><p><b>One &lt;two&gt;
 three<br><p>Four&nbsp;five</p><form><input value=x>Send</form><aside>Side</aside><ul><li>i<li>j</ul></article><section id="comments"><p>Nice!</p></section><footer>&copy; x</footer>"""



def plain_removed(pages):
    """The style tree by plain sums over (host, html): ids of the zones and blocks that go."""
    pages = sorted(set(pages), key=str)
    kept = []  # per page: copy mark, styles by place, words by (place, text), nodes by place
    for host, page in pages:
        styles, nodes, blocks = {}, {}, {}
        walked = H.walk(H.parse(page), host, styles, nodes)
        roles = {n.zone: n.role for n in nodes.values()}
        every, own = [], []
        for b in walked:
            for zone, text in b.by_zone().items():
                blocks[b.place.at if zone == b.place.zone else zone, text] = len(text.split())
                every.append(text)
                own += [text] if roles[zone] != H.NOISE else []
        kept.append((H.copy_mark(own or every), {at: tuple(sorted(set(x))) for at, x in styles.items()}, blocks, nodes, H.path_hash(0, host)))
    marks, words, node, root = defaultdict(set), {}, {}, {}
    for mark, styles, blocks, nodes, r in kept:
        for at, style in styles.items():
            marks[at, "style", style].add(mark)
        for (at, text), n in blocks.items():
            marks[at, "block", text].add(mark)
            words[at, text] = n
        for at, n in nodes.items():
            node[at], root[at] = n, r
    of = defaultdict(list)
    for (at, kind, x), seen in marks.items():
        of[at, kind].append((len(seen), words.get((at, x), 0)))
    m = {at: sum(n for n, _ in of[at, "style"]) for at in node}
    back = lambda own, ats: {at: (own[at] * m[at] + H.BACK_OFF * sum(own[o] * m[o] for o in ats if node[o].anywhere == node[at].anywhere) / sum(m[o] for o in ats if node[o].anywhere == node[at].anywhere)) / (m[at] + H.BACK_OFF) for at in ats}
    importance, new = {}, {}
    for at in node:
        wide = math.log(m[at] + H.FEW_PAGES)
        style = -sum(n / m[at] * math.log(n / m[at]) for n, _ in of[at, "style"]) / math.log(m[at]) if m[at] > 1 else 1.0
        times = [n for n, _ in of[at, "block"] for _ in range(n)]
        importance[at] = (style + (sum(1 - math.log(n) / wide for n in times) / len(times) if times else 1.0)) / 2
        new[at] = sum(n * w * (1 - math.log(n) / wide) for n, w in of[at, "block"])
    importance = back(importance, list(node))
    zones = [at for at in node if node[at].zone == at]
    worth = {z: sum(new[at] for at in node if node[at].zone == z) / m[z] * H.WEIGHT[node[z].role] for z in zones}
    best = {z: max(worth[o] for o in zones if root[o] == root[z]) for z in zones}
    standing = back({z: worth[z] / best[z] if best[z] else 1.0 for z in zones}, zones)
    out = {z for z in zones if standing[z] < H.LEAST_STANDING[node[z].role]}
    for (at, kind, x), seen in marks.items():
        if kind == "block" and len(seen) > 1 and (1 - math.log(len(seen)) / math.log(m[at] + H.FEW_PAGES)) * (0.25 + 0.75 * importance[at]) < H.LEAST_NOVELTY:
            out.add(H.block_id(at, H.text_hash(x)))
    return out


def alone(page, host=""):
    return H.main_text(page, host, plain_removed([(host, page)]))


def test_main_text():
    assert alone(PAGE) == "Title&\nOne <two> three\nFour five\ni\nj"
    assert alone(None) == "" and alone("") == "" and alone("plain &eacute; text") == "plain é text"
    assert alone("<article><p>cut <b") == "cut"
    assert alone("<p>a<table><tr><td>b<td>c<tr><td>d</table>e") == "a\nb c\nd\ne"


def test_names_weigh_but_do_not_settle():
    assert alone("<body><nav><a>Home</a></nav><div id='search-results'><p>" + "own words of this page " * 9 + "</p></div><footer>Imprint</footer></body>").startswith("own words")
    assert alone("<body><div class='legal-news'><p>Legal article</p></div></body>") == "Legal article"
    assert alone("<body><form id=f><p>" + "the page is a form " * 9 + "</p><label>Name</label></form><div class=ad>Buy</div></body>").startswith("the page")
    assert alone("<body><article><header><h1>Head</h1></header><p>" + "one two three " * 9 + "</p></article></body>").startswith("Head\none")
    both = alone("<body><div><p>" + "lead text " * 20 + "</p></div><article>" + "body text " * 20 + "</article><div class=comments><article>" + "so nice " * 30 + "</article></div></body>")
    assert both.startswith("lead") and "body text" in both and "nice" not in both


def site(n=12):
    rows = [(i, f"http://Site.example:80/{i}", f"<body><div class='top'>Always here</div><div class='body'><p>Own text {i} {i * 7}</p></div><div>Read more</div></body>") for i in range(n)]
    return [*rows, (100, None, PAGE), (101, "http://one.example/", "<body><div>Alone</div></body>"), (102, "nonsense", None), (None, "http://site.example/x", rows[0][2])]


@pytest.mark.parametrize("rows_broadcast", [200_000, 0])
def test_style_tree(spark, monkeypatch, rows_broadcast):
    monkeypatch.setattr(H, "BROADCAST_ROWS", rows_broadcast)
    docs = spark.createDataFrame([(*r, "h", "r") for r in site()], "page_id long, url string, html string, host string, row string")
    got = {r.page_id: r.text for r in H.extract(docs).collect()}
    assert got[3] == "Own text 3 21" and got[None] == "Own text 0 0"
    assert got[100].startswith("Title&") and got[101] == "Alone" and got[102] == ""
    removed = plain_removed([(H.host_of(url), page) for _, url, page in site()])
    assert got == {i: H.main_text(page, H.host_of(url), removed) for i, url, page in site()}


def news(seed=9):
    """Hosts with menus, adverts without a telling name, a notice inside the article, copies, and one page alone."""
    rng = np.random.default_rng(seed)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    rows, want = [], {}
    copy = [text(30) for _ in range(6)]
    for i in range(90):
        paragraphs = copy if i % 3 == 0 else [text(30) for _ in range(int(rng.integers(2, 7)))]
        if i % 9 == 0:
            paragraphs = [*paragraphs[:-1], text(30)]
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        want[i] = "\n".join(paragraphs)
        rows.append((i, f"https://news.example/{i}", f"<body><div class=x7>{text(2)} {text(1)}</div><nav><a>{text(1)}</a></nav><div class=story>{body}<p>Sign up to our letter now</p></div><div class=x9>All rights with us</div></body>"))
    rows.append((500, "https://alone.example/", f"<body><nav><a>{text(1)}</a></nav><article><p>Only page</p></article><footer>{text(9)}</footer></body>"))
    want[500] = "Only page"
    return rows, want


def test_tree_decides(spark):
    rows, want = news()
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    removed = plain_removed([(H.host_of(url), page) for _, url, page in rows])
    assert got == {i: H.main_text(page, H.host_of(url), removed) for i, url, page in rows}
    assert [i for i in want if got[i] != want[i]] == []


def test_copies_of_an_article_stay(spark):
    rows = [(i, "http://c.example/", "<body><nav>menu</nav><article><p>The same text</p></article></body>") for i in range(20)]
    rows += [(100 + i, "http://d.example/", "<body><div><p>The same long text of many copies on one host</p></div></body>") for i in range(90)]
    rows += [(300 + i, "http://d.example/", f"<body><div><p>Other words {i} that this one page has for itself {i * i}</p></div></body>") for i in range(10)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(20)} == {"The same text"} and {got[i] for i in range(100, 190)} == {"The same long text of many copies on one host"}
    assert got[304] == "Other words 4 that this one page has for itself 16"


def test_no_pages(spark):
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
