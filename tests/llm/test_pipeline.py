"""The registered queries and the pipeline on the smallest tables, against plain versions."""

import html
import os
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from tests.llm import fixture as X
from tests.llm.test_models import plain_scores
from tidemark.llm import queries as Q
from tidemark.llm import quality_rules
from tidemark.llm.common import table

DATA = os.environ.get("TIDEMARK_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in table(spark, DATA, "documents").select("doc_id", "text", "lang", "source").collect()]


def test_names():
    assert [f.__name__.split("_")[0] for f in Q.OPERATORS] == [f"op{n}" for n in range(1, 11)]
    assert set(Q.queries()) < set(E.queries()) and "pipeline" in E.queries()


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = Q.queries()[name](spark, DATA)
    got = duck.execute(Q.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, got.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in df.collect())


def test_op8(spark, rows):
    prints = {r[0]: X.plain_fingerprint(r[1]) for r in rows}
    groups = X.plain_components(prints)
    got = Q.op8_simhash_dedup(spark, DATA).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", groups[i]) for i in prints}


def test_op5(spark, rows):
    got = {r.doc_id: r for r in Q.op5_quality_rules(spark, DATA).collect()}
    for i, text, *_ in rows:
        r, want = got[i], X.plain_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.kept and r.base_failed)


def test_pipeline(spark, rows):
    docs = table(spark, DATA, "documents")
    kept = {r.row.doc_id for r in quality_rules.judge(docs, table(spark, DATA, "labels")).where("kept").collect()}
    left = [r for r in rows if r[0] in kept]
    lines = X.plain_lines(left)
    last = defaultdict(set)
    for i, text, *_ in left:
        for x in text.split("\n"):
            k = x.strip(X.WS).translate(X.LOW)
            if len(k) >= 40:
                last[k].add(i)
    last = {k: max(v) for k, v in last.items() if len(v) >= 5}
    texts = {i: "\n".join(x for x in text.split("\n") if last.get(x.strip(X.WS).translate(X.LOW), i) == i) for i, text, *_ in left}
    texts = {i: t for i, t in texts.items() if not lines[i][1] or t.strip(X.WS)}
    items = [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()]
    hits = X.plain_hits(list(texts.items()), items)

    out = corpus_pipeline.run(spark, DATA).collect()
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids)) and set(ids) <= set(texts)
    for r in out:
        assert r.text == texts[r.doc_id] and not hits[r.doc_id][1] and r.mix_copies >= 1
    # What went after the lines is contaminated, or has a near copy with a smaller id.
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() for w in [X.split(t.translate(X.LOW))]}
    for i in set(texts) - set(ids):
        assert hits[i][1] or any(j < i and len(shingles[i] & shingles[j]) >= 0.6 * len(shingles[i] | shingles[j]) for j in texts), i
    for i in ids:
        assert not any(j < i and shingles[i] == shingles[j] for j in ids)


def held_out(i, folds):
    return zlib.crc32(str(i).encode()) % folds


def test_op1(spark):
    """Against the articles of the raw pages, cut out by hand."""
    pages = table(spark, DATA, "pages").collect()
    got = {r.page_id: r for r in Q.op1_html_extract(spark, DATA).collect()}
    assert len(got) == len(pages)
    for r in pages:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", lambda m: " " if m[0].startswith("<br") else "", x)).split()) for x in re.split(r"</?(?:p|h1)[^>]*>", article)]
        want = "\n".join(x for x in parts if x)
        assert (got[r.page_id].url, got[r.page_id].text, got[r.page_id].n_chars) == (r.url, want, len(want))


def test_op2(spark, rows):
    labels = {r.doc_id: r.quality for r in table(spark, DATA, "labels").collect()}
    df = Q.op2_quality_knn(spark, DATA)
    assert df.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = {r.doc_id: r for r in df.collect()}
    assert len(got) == len(rows) and all(r.held_out == (held_out(i, 3) == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    want = plain_scores([r[:2] for r in rows], labels, [i for i in labels if i in got and held_out(i, 3) != 1])
    assert np.mean([abs(got[i].score - want[i]) < 1e-3 for i in want]) > 0.95
    held = [i for i in labels if got[i].held_out]
    assert np.mean([got[i].predicted == labels[i] for i in held]) > 0.9


def test_op3(spark, rows):
    df = Q.op3_language_id(spark, DATA)
    assert df.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    got = {r.doc_id: r for r in df.collect()}
    assert len(got) == len(rows) and all(r.held_out == (held_out(i, 4) == 2) for i, r in got.items())
    sure = [got[i].lang_pred == lang for i, _, lang, _ in rows if lang and got[i].held_out]
    assert len(sure) > 20 and np.mean(sure) > 0.9
    assert {r.lang_pred for r in got.values()} <= {lang for _, _, lang, _ in rows} | {"und"}


def test_op9(spark, rows):
    """The notices that the tables hold, by their words."""
    told = {"GNU General Public License": "gpl", "CC BY-NC": "cc-by-nc", "MIT License": "mit", "Apache License": "apache"}
    got = {r.doc_id: r for r in Q.op9_license_scan(spark, DATA).collect()}
    for i, text, *_ in rows:
        want = sorted({f for words, f in told.items() if words in (text or "")})
        assert got[i].families == ",".join(want) and got[i].n_license == len(want) and (got[i].score > 0.3) == bool(want)
        assert got[i].n_paragraphs == len(re.findall(r"(?:^|\n[^a-zA-Z0-9\u0080-\U0010ffff]*\n)[^a-zA-Z0-9\u0080-\U0010ffff]*[a-zA-Z0-9\u0080-\U0010ffff]", text or ""))


ODD = [
    (None, None, None, None),
    (None, None, None, None),
    (1, None, None, None),
    (None, "", None, "a"),
    (None, "words without an id that go on for a while and then stop at last", "en", None),
    (None, "words without an id that go on for a while and then stop at last", "en", None),
    (5, "one document with an id that is there twice but with two texts here", "en", "a"),
    (5, "the other document with the same id and with a text that is its own", None, "a"),
    (6, " \t\n\r\n ", "en", "a"),
    (7, "ü" * 3000 + " x" * 3000 + "\n" * 500, "de", "b"),
]


@pytest.mark.parametrize("stage", range(5))
@pytest.mark.parametrize("rows", [[], ODD], ids=["none", "odd"])
def test_stages_take_odd_tables(spark, stage, rows):
    """Nulls, blanks, repeats, long texts and names that the operators use themselves."""
    name, f = corpus_pipeline.STAGES[stage]
    names = {"h": "key", "doc": "mix_weight", "row": "n_words"}
    docs = X.frame(spark, rows).withColumnsRenamed(names).withColumns({"text.more": F.lit(1), "node": F.lit("n"), "hits": F.lit(2)})
    out = f(spark, docs, DATA)
    got = out.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("x")).collect()
    assert out.columns[: len(docs.columns)] == docs.columns
    assert out.columns[len(docs.columns) :] == (["mix_weight_", "mix_copies"] if name == "mixing" else [])
    texts = sorted(str(r.x.text) for r in got)
    every = sorted(str(r[1]) for r in rows)
    if name in ("decontamination", "mixing", "line_dedup"):
        assert texts == every
    elif name == "simhash_dedup":  # equal and blank texts are one group
        assert len(texts) == len({t if t and t.split() else "" for _, t, *_ in rows})
    else:  # ten words at least, and few of them repeated
        assert set(texts) <= {t for t in every if len(t.split()) >= 10}
    out.write.mode("overwrite").format("noop").save()


def test_tables_left(spark):
    """What a query leaves behind is what its result still reads, and sweep() removes that."""
    from tidemark.llm import common

    common.sweep()
    for f in (Q.op2_quality_knn, Q.op4_substring_dedup, Q.op6_mixing, Q.op7_line_dedup, Q.op8_simhash_dedup):
        f(spark, DATA).count()
        assert common.sweep(spark) <= 3, f.__name__
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(("run_", "tally_"))]


def test_stages_keep_columns(spark):
    docs = table(spark, DATA, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_dedup", "decontamination", "mixing"]
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, docs, DATA).columns == docs.columns
