import numpy as np
import pytest

from tests.llm import fixture as X
from tidemark.llm import decontaminate as D
from tidemark.llm import license_scan

ROWS = X.corpus()
WORDS = X.split(ROWS[0][1])
ITEMS = [(1, " ".join(WORDS[:14])), (2, " ".join(X.split(ROWS[10][1])[:3])), (3, None), (4, "  ... "), (5, "x"), (10, " ".join(X.split(ROWS[8][1])[-12:]).upper()), (None, "a b"), (6, "É ß"), (7, " ".join(WORDS[:14]))]


@pytest.mark.parametrize("items", [ITEMS, ITEMS[:1], []])
@pytest.mark.parametrize("at_once", [2, 5000])
def test_hits(spark, items, at_once):
    docs = X.frame(spark, ROWS)
    found = D.find_hits(docs, spark.createDataFrame(items, "item_id long, text string"), at_once=at_once).collect()
    assert {r.row.doc_id: (r.n_words, list(r.hits), list(r["items"])) for r in found} == X.plain_hits(ROWS, items)
    assert set(found[0].row.asDict()) == set(docs.columns)


def test_long_texts_are_searched_in_segments():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 400, 3000)]
    items = [(i, " ".join(words[a : a + n])) for i, (a, n) in enumerate([(0, 10), (11, 14), (1490, 40), (2960, 40), (700, 3), (701, 1)])]
    whole, parts = D.Searcher(D.windows_of(items)), D.Searcher(D.windows_of(items))
    text = (" ,".join(words)).encode()
    n, hits, names = whole.search([text])[0]
    for most in (1, 7, 100, 1001):
        got = parts.search([b"x", text, None], most)[1]
        assert got[0] == n == 3000 and got[1].tolist() == hits.tolist() and got[2] == names


def test_no_documents(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.find_hits(X.frame(spark, []), items).count() == 0
    assert D.stage(X.frame(spark, ROWS), items.where("item_id = 1")).columns == X.frame(spark, []).columns


def test_shift_table_skips():
    table = D.WuManber([b"alpha beta gamma delta", b"gamma delta epsilon zeta eta"])
    buffer, _ = D.normalised([b"none of it " * 50 + b"Gamma, delta; epsilon--zeta ETA", b"alpha beta gamma deltas alpha beta gamma delta"])
    start, pattern = table.find(buffer)
    assert sorted(pattern.tolist()) == [0, 1]
    assert int(table.shift.max()) > 10


def test_normalised():
    buffer, bounds = D.normalised([b" A,b--C ", None, "É1 x".encode(), b""])
    texts = [bytes(buffer[a:b]).split() for a, b in zip(bounds, bounds[1:], strict=False)]
    assert texts == [[b"a", b"b", b"c"], [], ["É1".encode(), b"x"], []]


WRAPPED_MIT = """Copyright (c) 2019 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software"""
WRAPPED_APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
"""
WRAPPED_BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:"""
LICENCES = [
    ("Released under the MIT License.", ["mit"]),
    ("Copyright 2020. Licensed under the Apache License, Version 2.0 (the License).", ["apache"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["gpl"]),
    ("GNU GENERAL PUBLIC LICENSE Version 2", ["gpl"]),
    ("  GNU GENERAL PUBLIC LICENSE\n     Version 3, 29 June 2007", ["gpl"]),
    ("under the GNU Lesser General Public License, version 3", ["lgpl"]),
    ("Licensed under CC BY-NC 4.0.", ["cc-by-nc"]),
    ("Licensed under CC BY-SA 4.0.", ["cc-by-sa"]),
    ("Licensed under CC BY 4.0.", ["cc-by"]),
    ("Licensed under the ISC license", ["isc"]),
    ("Licensed under the Eclipse Public License, Version 2.0", ["epl"]),
    ("// SPDX-License-Identifier: MIT", ["mit"]),
    (WRAPPED_MIT, ["mit"]),
    (WRAPPED_APACHE, ["apache"]),
    (WRAPPED_BSD, ["bsd"]),
    ("Licensed under CC BY-NC-SA 4.0.", []),
    ("Licensed under the Artistic License 2.0", []),
    ("Licensed under the zlib license", []),
    ("She got permission from MIT to study.", []),
    ("The license of my car is under review, version 3 is free.", []),
    ("A plain line of words about software and the public.", []),
    ("", []),
]
AROUND = ["{}", "Some words here.\n{}\nMore words there.", "One paragraph.\n\n{}\n\nAnother one of words.", " ".join(f"word{i}" for i in range(70)) + "\n{}\n" + "and on " * 90]


@pytest.fixture(scope="module")
def model(spark):
    return license_scan.train(X.frame(spark, ROWS))


def test_planted_notices(model):
    """Each notice in each surrounding: none is missed, none is found where there is none, none gets another's name."""
    found = [(fill.format(text), families, {f[2] for f in license_scan.find(model, [fill.format(text).encode()])[0][1]}) for text, families in LICENCES for fill in AROUND]
    assert [(t, want, got) for t, want, got in found if set(want) != got] == []


def test_paragraphs_and_blocks(model, monkeypatch):
    text = (WRAPPED_MIT + "\n *\n\n" + WRAPPED_APACHE).encode()
    n, found = license_scan.find(model, [text])[0]
    assert n == 4 and {(p, line, f) for p, line, f, *_ in found} >= {(1, 2, "mit"), (2, 9, "apache")}
    words = " ".join(f"w{i}" for i in range(5000)).encode()
    text = words + b"\nReleased under the MIT License.\n" + words + b" licensed under\nthe ISC license " + words
    whole = license_scan.find(model, [text, None, b"\n# \n"])
    assert [w[0] for w in whole] == [1, 0, 0] and sorted((f[1], f[2]) for f in whole[0][1]) == [(1, "mit"), (2, "isc")]
    for block in (24, 240, 4800):
        monkeypatch.setattr(license_scan, "BLOCK_WORDS", block)
        assert license_scan.find(model, [text])[0] == whole[0]


def test_licences(spark, model):
    texts = [(5000 + i, AROUND[1].format(line), None, None) for i, (line, _) in enumerate(LICENCES)] + ROWS
    texts += [(5000, AROUND[1].format(LICENCES[0][0]), None, None)]  # a repeated row
    docs = X.frame(spark, texts + [(9999, None, None, None)])
    rows = license_scan.scan(docs).collect()
    found = {r.doc_id: r for r in rows if r.doc_id is not None}
    for i, (_, families) in enumerate(LICENCES):
        assert sorted({f.family for f in found[5000 + i].found}) == families, LICENCES[i]
    assert len(rows) == len(texts) + 1 and len([r for r in rows if r.doc_id == 5000 and r.found == found[5000].found]) == 2
    assert found[9999].n_paragraphs == 0
    assert license_scan.scan(X.frame(spark, []), model).count() == 0


def test_order_confirms():
    words = license_scan.words_of(b"released under the mit license")
    family = license_scan.FAMILIES.index("mit")
    assert license_scan.confirmed(family, words)[0] == 1.0
    assert license_scan.confirmed(family, words[::-1])[0] < license_scan.CONFIRM
    assert license_scan.aligned([b"a", b"b", b"c"], [b"x", b"a", b"b", b"y", b"c"]) == (1.0, 1, 5)
