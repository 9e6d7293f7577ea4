import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions.values import round_exact, utc_timestamp
from tidemark.operators import bands, checks, classify, coverage, phrases, series
from tidemark.plans import frame, probe


def test_windows(spark):
    annual = [tuple(r) for r in frame.windows(spark, "annual").collect()]
    assert len(annual) == 10 and annual[0] == ("2016-01-01", "2016-12-31") and annual[-1] == ("2025-01-01", "2025-04-30")
    quarters = [tuple(r) for r in frame.windows(spark, "quarterly").collect()]
    assert len(quarters) == 38 and quarters[-1] == ("2025-04-01", "2025-04-30")
    assert frame.windows(spark, "none").count() == 1
    with pytest.raises(ValueError):
        frame.windows(spark, "weekly")


def test_jobs(spark):
    assert frame.jobs(spark).count() == 90
    report = spark.createDataFrame([("cars", "FSD", "True"), ("cars", "V2X", "1"), ("cars", "Waymo", None), ("Waymo", "FSD", "false")], "subreddit string, term string, saturated string")
    jobs = frame.jobs(spark, report)
    assert jobs.count() == 88 + 20
    assert jobs.where("blocked").select("term").distinct().count() == 2
    only = spark.createDataFrame([("cars", "FSD")], "subreddit string, term string")
    assert frame.jobs(spark, report, only=only).count() == 10
    files = jobs.withColumn("f", frame.job_file())
    assert files.where("subreddit = 'cars' AND term = 'Waymo'").first()["f"] == "cars__waymo__2016-01-01_2025-04-30.json"
    quoted = spark.createDataFrame([("T", "a", '"x y"', "s", "e"), ("T", "a", "x y", "s", "e")], "tier string, subreddit string, term string, start string, end string")
    rows = quoted.select(frame.job_file().alias("f"), frame.job_key().alias("k")).collect()
    assert rows[0].f == rows[1].f and rows[0].k != rows[1].k


def test_budget(spark):
    jobs = spark.createDataFrame([(i, 10.0) for i in range(1, 8)], "n int, c double")
    assert [r.n for r in frame.affordable(jobs, ["n"], "c", 5.0, 30.0).orderBy("n").collect()] == [1, 2, 3]
    assert [r.n for r in frame.affordable_ahead(jobs, ["n"], "c", 5.0, 30.0).orderBy("n").collect()] == [1, 2]
    mixed = spark.createDataFrame([(1, 10.0), (2, 50.0), (3, 1.0)], "n int, c double")
    assert [r.n for r in frame.affordable_ahead(mixed, ["n"], "c", 0.0, 30.0).collect()] == [1]
    assert frame.affordable(jobs.limit(0), ["n"], "c", 0.0, 1.0).count() == 0 == frame.affordable_ahead(jobs.limit(0), ["n"], "c", 0.0, 1.0).count()


def test_running_sum_over_many_cells(spark):
    rows = [(f"k{i % 7}", i * 37 % 1000, i % 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "a string, b int, c long").repartition(5)
    upto, want = 0, {}
    for a, b, c in sorted(rows):
        upto += c
        want[a, b] = upto
    got = {(r.a, r.b): r.upto for r in frame.running_sum(df, ["a", "b"], "c", "upto").collect()}
    assert got == want and len(want) == 1000


def test_ceilings(spark):
    jobs = spark.createDataFrame([(1,), (2,)], "n long")
    assert [r.ceiling_usd for r in frame.ceiling(jobs).collect()] == [pytest.approx(0.02 + 0.002 * 1600)] * 2
    assert frame.posts_ceiling(jobs).first().ceiling_usd == pytest.approx(2 * (0.02 + 0.2))
    got = frame.recovery_ceiling(spark.createDataFrame([(3,), (5,)], "n_targets long")).first()
    assert (got.batches, got.targets) == (2, 8) and got.ceiling_usd == pytest.approx(0.04 + 0.002 * 8 * 16) and got.modelled_usd == pytest.approx(0.04 + 0.002 * 8 * 10.4)


def test_backfill_jobs_stop(spark):
    held = spark.createDataFrame([("T", "a", "x", "2020-01-01"), ("T", "a", "y", "2016-01-01"), ("T", "a", "z", None)], "tier string, subreddit string, term string, earliest string")
    assert [r.ok for r in frame.tail_checks(held).orderBy("term").collect()] == [True, False, False]
    with pytest.raises(ValueError, match="2016-01-01"):
        frame.backfill_jobs(held)
    good = held.where("term = 'x'")
    assert frame.backfill_jobs(good, expected=1).first().end == "2020-01-01"
    with pytest.raises(ValueError, match="1 jobs, not 10"):
        frame.backfill_jobs(good, expected=10)


def test_summarise(spark):
    jobs = spark.createDataFrame([("a",), ("b",), ("c",)], "q string")
    posts = spark.createDataFrame([("a", "2020-05-01T00:00:00Z", 40), ("a", "", 2), ("a", None, None)] + [("b", "2021-01-01", 1)] * 100, "q string, createdAt string, commentsCount long")
    got = {r.q: r for r in probe.summarise(jobs, posts, ["q"], 10).collect()}
    assert got["a"].posts_found == 3 and got["a"].comments_available == 42 and got["a"].earliest_post == "2020-05-01" == got["a"].latest_post
    assert got["a"].stored_per_post == pytest.approx(17 / 3) and got["a"].est_collect_comments == 17
    assert got["b"].will_block and got["b"].est_runs == 10 and got["b"].est_collect_posts == 30
    assert got["c"].posts_found == 0 and got["c"].earliest_post == "" and got["c"].est_collect_usd == pytest.approx(0.02)


def test_bands(spark):
    report = spark.createDataFrame([("T", n) for n in (0, 59, 60, 99, 100)], "tier string, posts_found long")
    assert tuple(bands.crosstab(report, 60, 100).first()) == ("T", 2, 2, 1)
    assert [r.dropped for r in bands.in_band(report, 60, 100).collect()] == [39, 0]
    r = bands.remedies(bands.in_band(report, 60, 100), 60, 100, 10).first()
    assert r.posts_now == 120 and r.usd_now == pytest.approx(2 * (0.02 + 0.002 * 60 * 10.4))


def test_coverage(spark):
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id string")
    probe_, orig, back = {"a", "b", "c", "d"}, {"a", "x"}, {"b", "x", "y"}
    r = coverage.coverage(ids(probe_), ids(orig), ids(back)).first()
    assert (r.n_overlap, r.n_recovered, r.n_represented, r.n_unaccounted, r.n_new) == (len(probe_ & orig), len((probe_ - orig) & back), len(probe_ & (orig | back)), len(probe_ - orig - back), len(back - orig))


def test_batches_and_manifest(spark):
    t = spark.createDataFrame([("T", "B", "q", "t3_2", "u2", "2020"), ("T", "B", "q", "t3_1", "u1", None), ("T", "a", "q", "t3_3", "u3", "2019")], "tier string, subreddit string, term string, post_id string, post_url string, probe_created_at string")
    got = coverage.batches(t, ["tier", "subreddit", "term"]).collect()
    assert [(r.subreddit, r.n_targets, r.urls) for r in got] == [("a", 1, ["u3"]), ("B", 2, ["u1", "u2"])]
    assert [(r.first_url, r.last_url, r.too_large, r.repeated_urls) for r in got] == [("u3", "u3", False, False), ("u1", "u2", False, False)]
    large = spark.createDataFrame([(None, f"{i:03d}", f"u{i % 100}", None) for i in range(150)], "q string, post_id string, post_url string, probe_created_at string")
    one = coverage.batches(large, ["q"]).first()
    assert one.n_targets == 150 and one.too_large and one.repeated_urls and one.urls is None and one.first_url == "u0" and one.last_url == "u49"
    by = ["tier", "subreddit", "term"]
    targets = coverage.present_elsewhere(t, spark.createDataFrame([("t3_3",)], "post_id string"))
    done = spark.createDataFrame([("T", "B", "q")], "tier string, subreddit string, term string")
    returned = spark.createDataFrame([("T", "B", "q", "t3_1")], "tier string, subreddit string, term string, post_id string")
    status = {r.post_id: r.status for r in coverage.manifest(targets, done, returned, by).collect()}
    assert status == {"t3_1": "recovered", "t3_2": "unaccounted_in_recovery_file", "t3_3": "already_present_elsewhere"}
    assert {r.state for r in coverage.batch_states(targets.where("recovery_required"), returned, by).collect()} == {"PARTIAL"}
    urls = spark.createDataFrame([("t3_Ab", "https://x/r/c/comments/ab/t/"), ("t3_ab", "https://x/comments/abc/")], "post_id string, post_url string")
    assert [r[0] for r in urls.select(coverage.address_matches_id()).collect()] == [True, False]


def test_phrases(spark):
    arms = spark.createDataFrame([("A", "self-driving car"), ("B", "none here"), ("C", "x")], "arm string, phrase string")
    posts = spark.createDataFrame([("A", "1", "Self driving", "car!"), ("A", "2", "driving itself", "a car"), ("B", "3", None, "no")], "arm string, parsedId string, title string, body string")
    base = spark.createDataFrame([("A", "1"), ("A", "9")], "arm string, parsedId string")
    got = {r.arm: r for r in phrases.precision(arms, posts, base).collect()}
    assert (got["A"].phrase_pct, got["A"].alltok_pct, got["A"].overlap, got["A"].overlap_pct) == (50.0, 100.0, 1, 50.0)
    assert got["C"].posts == 0 and got["C"].phrase_pct == 0.0
    out = phrases.interpretation(phrases.precision(arms, posts, base)).first()
    assert out.quoting == "mixed" and out.mechanism == "limit of multi-word matching"
    titled = posts.withColumns({"file_name": F.col("parsedId"), "pos": F.lit(0)})
    assert [(r.arm, r.place, r.title) for r in phrases.first_titles(titled, 1).orderBy("arm").collect()] == [("A", 0, "Self driving"), ("B", 0, "")]


@pytest.mark.parametrize("n", [0, 1, 1000, 2000])
def test_holding(spark, n):
    texts = ["one two three four five six", "two three four", "", None, "five six one", "one two three four nine six", "x " * 300 + "seven"]
    stated = [("one two three four five", [0]), ("three four", [0, 1, 5]), ("six", [0, 4, 5]), ("two three four five six one", []), ("x x x x x seven", [6]), ("", []), ("wo three", []), (None, [])]
    phrases_ = [(i, p) for i, (p, _) in enumerate(stated)][:n] + [(100 + i, f"nothing of {i} here") for i in range(max(0, n - len(stated)))]
    got = phrases.holding(spark.createDataFrame([(i, (x or "").strip() if x is not None else None) for i, x in enumerate(texts)], "id int, hay string"), spark.createDataFrame(phrases_, "phrase_id int, phrase string")).collect()
    assert sorted((r.phrase_id, r.id) for r in got) == sorted((i, j) for i, (_, held) in enumerate(stated[:n]) for j in held)


def test_classify(spark):
    df = spark.createDataFrame([(0.4, 0.4, 0.2), (0.1, 0.45, 0.45), (0.5, 0.2, 0.3), (float("nan"), 0.1, 0.2)], "p_neg double, p_neu double, p_pos double")
    got = df.select(classify.predicted_class(), classify.concern_flag()).collect()
    assert [r[0] for r in got[:3]] == ["negative", "neutral", "negative"] and [r[1] for r in got] == [0, 0, 1, 0]

    class Swapped:
        def score(self, texts):
            return [(p, u, n) for n, u, p in classify.LexiconScorer().score(texts)]

    with pytest.raises(ValueError):
        classify.check_labels(Swapped())
    texts = spark.createDataFrame([("I love this great car",), ("awful, not safe, I hate it",)], "clean_body string")
    assert [r.predicted_class for r in classify.classify(texts).collect()] == ["positive", "negative"]
    said = spark.createDataFrame([(0, "the cat is on the mat"), (1, ""), (2, None), (3, "Über das der die"), (4, "the der")], "i int, x string")
    assert [r[0] for r in said.orderBy("i").select(classify.language_of(F.col("x"))).collect()] == ["en", None, None, "de", None]
    picked = classify.with_labels(said, classify.KeywordScorer(classify.STOP_WORDS), "x").orderBy("i").collect()
    assert [r.label for r in picked] == ["en", "en", "en", "de", "en"] and picked[0].labels == ["en"] and picked[1].labels == []


def test_series(spark):
    y = [1, 3, 2, 2, 5, 4]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "t int, v double")
    s = sum((b > a) - (b < a) for i, a in enumerate(y) for b in y[i + 1 :])
    got = series.mann_kendall(df, "t", "v").first()
    var = (6 * 5 * 17 - 2 * 1 * 9) / 18
    assert got.s == s and got.var_s == pytest.approx(var) and got.z == pytest.approx((s - 1) / math.sqrt(var))
    assert got.p == pytest.approx(math.erfc(abs(got.z) / math.sqrt(2)))
    slopes = sorted((b - a) / (j - i) for i, a in enumerate(y) for j, b in enumerate(y) if j > i)
    assert series.sen_slope(df, "t", "v").first()[0] == pytest.approx(slopes[len(slopes) // 2])
    step = spark.createDataFrame([("g", f"{i:03d}", (0.0 if i < 20 else 9.0) + (i % 3) * 0.1) for i in range(40)], "g string, t string, v double")
    assert [r.period for r in series.changepoints(step, "g", "t", "v").collect()] == ["020"]


def test_values(spark):
    df = spark.createDataFrame([("2020-01-01T00:00:00Z",), ("12:30",), ("2020",), ("junk",), (None,), ("2020-01-01T02:00:00+02:00",)], "x string")
    got = [r[0] for r in df.select(utc_timestamp(F.col("x"))).collect()]
    assert got[0] == got[5] and got[1:5] == [None] * 4
    nums = spark.createDataFrame([(0.35,), (2.675,), (2.5,)], "x double")
    assert [r[0] for r in nums.select(round_exact(F.col("x"), 1)).collect()] == [round(0.35, 1), round(2.675, 1), 2.5]


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, None)], "k int, v string")
    got = {r["check"]: r.ok for r in checks.report(checks.unique(df, "u", "k"), checks.no_nulls(df, "n", "v"), checks.row_count(df, "c", 2), checks.has_columns(df, "h", ["k"])).collect()}
    assert got == {"u": False, "n": False, "c": True, "h": True}
    with pytest.raises(ValueError, match="u: 1"):
        checks.require(checks.unique(df, "u", "k"))
    wanted = spark.createDataFrame([(1,), (2,)], "k int")
    assert {(r.k, r.n, r.ok) for r in checks.matches(df, wanted, ["k"]).collect()} == {(1, 2, False), (2, 0, False)}
    with pytest.raises(ValueError, match="1: 2 rows, not 1"):
        checks.exactly_one(df, wanted, ["k"])
    assert checks.exactly_one(df.limit(1), wanted.where("k = 1"), ["k"]).count() == 1
    stated = spark.createDataFrame([(1, 2), (2, 0), (3, 1)], "k int, n int")
    assert [r.ok for r in checks.agreeing(stated, spark.createDataFrame([(1, 2)], "k int, m int"), "a", ["k"], "n", "m").collect()] == [False]
    assert checks.apart(wanted, stated, "p", "k").first().detail == "2" and not checks.at_least(spark, "cap", 60, 100).first().ok
