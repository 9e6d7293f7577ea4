"""The text functions against plain Python."""

import html
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import text as T


def plain_clean(x):
    """What a reader keeps of a text, character by character: no quoted line, no address, no mark, single blanks."""
    kept = []
    for line in (x or "").split("\n"):  # a quote may stand after lines of blanks alone, which it takes along
        kept.append(" " if line.lstrip().startswith(">") else line)
    text, at, bare = "\n".join(kept), 0, []
    while at < len(text):
        head = next((h for h in ("http://", "https://") if text.startswith(h, at) and at + len(h) < len(text) and not text[at + len(h)].isspace()), "")
        if not head:
            bare.append(text[at])
            at += 1
            continue
        at += len(head)
        while at < len(text) and not text[at].isspace():
            at += 1
        bare.append(" ")
    out, chars = [], iter(html.unescape("".join(bare)))
    for c in chars:
        if c == "\\":
            after = next(chars, "")
            out.append(after if after and after in "\\`*_{}[]()#+-.!>" else c + after)
        else:
            out.append(c)
    return " ".join("".join(c for c in "".join(out) if c not in "*#").split())


#: Texts and what is kept of them, by hand.
HAND = [
    (None, ""),
    ("", ""),
    ("> quoted\nkept", "kept"),
    ("a\n\n  > after a blank line\nb", "a b"),
    ("see https://x.org/a b and http://y", "see b and"),
    ("&gt; escaped\n&amp;gt; twice &amp no semicolon", "> escaped &gt; twice & no semicolon"),
    (r"\[x\] **bold** # head \\ \*", "[x] bold head \\"),
    ("a\rb > not a line\x1cc\x85d", "a b > not a line c d"),
    ("emoji \U0001f600 end \u2003\u3000", "emoji \U0001f600 end"),
    ("&nbsp;&nbsp;x", "x"),
    (">only quoted", ""),
]


def rows(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")


def test_clean_by_hand(spark):
    got = [r[0] for r in rows(spark, [x for x, _ in HAND]).orderBy("i").select(T.clean_body(F.col("x"))).collect()]
    assert got == [want for _, want in HAND] == [plain_clean(x) for x, _ in HAND]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from("ab >\n\r\t*#\\[]&;gtamp:/hps.  \x1c\x85　é"), max_size=40), min_size=20, max_size=60))
def test_clean_at_random(spark, values):
    got = [r[0] for r in rows(spark, values).orderBy("i").select(T.clean_body(F.col("x"))).collect()]
    assert got == [plain_clean(x) for x in values]


def test_white_space_is_pythons(spark):
    points = [c for c in range(1, 0x3100) if chr(c).isspace()] + [0x200B, 0x180E, 0x41]
    got = [r[0] for r in rows(spark, [chr(c) for c in points]).orderBy("i").select(T.strip(F.col("x"))).collect()]
    assert got == [chr(c).strip() for c in points]


def test_word_count(spark):
    got = [r[0] for r in rows(spark, ["", "a", "a b  c".replace("  ", " ")]).orderBy("i").select(T.word_count(F.col("x"))).collect()]
    assert got == [0, 1, 3]


def test_slug_and_norm(spark):
    values = ['"Car Data!"', "--x--", "A_b c", "Ünï"]
    got = rows(spark, values).orderBy("i").select(T.slug(F.col("x")), T.norm(F.col("x"))).collect()
    assert [r[0] for r in got] == [re.sub(r"[^A-Za-z0-9]+", "-", v).strip("-").lower() for v in values]
    assert [r[1] for r in got] == [re.sub(r"[^a-z0-9]+", " ", v.lower()).strip() for v in values]


def test_phrases(spark):
    df = spark.createDataFrame([("self driving cars", "driving car"), ("a car drives itself", "car self"), ("x", "y")], "h string, p string")
    got = [tuple(r) for r in df.select(T.holds_phrase(F.col("h"), F.col("p")), T.holds_all_tokens(F.col("h"), F.col("p"))).collect()]
    assert got == [(True, True), (False, True), (False, False)]
