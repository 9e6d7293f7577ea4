import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators.funnel import Funnel, corpus, skeleton_corpus
from tidemark.sources import fetch, sinks, tables
from tidemark.sources.json_lists import baseline_ids, count_comments, post_ids, read_jobs, read_json_lists, read_json_lists_strict

LONG = " ".join(f"word{i}" for i in range(25))


def comment(id, body=LONG, author="x", made="2020-01-01T00:00:00Z", sub="cars", **more):
    return {"dataType": "comment", "id": id, "body": body, "authorName": author, "commentCreatedAt": made, "subredditName": sub, **more}


def write(folder, name, data):
    (folder / name).write_text(data if isinstance(data, str) else json.dumps(data), encoding="utf-8")


def english(_):
    return F.lit(True)


def test_tolerant_and_strict(spark, tmp_path):
    write(tmp_path, "a.json", [comment("1"), {"dataType": "post", "id": "t3_p", "commentsCount": None}])
    write(tmp_path, "b.json", '[{"id": "x"')
    write(tmp_path, "c.json", {"id": "object"})
    write(tmp_path, "d.json", [])
    (tmp_path / "sub").mkdir()
    write(tmp_path / "sub", "e.json", [comment("hidden")])
    got = read_json_lists(spark, str(tmp_path)).orderBy("file_name", "pos").select("file_name", "pos", "id").collect()
    assert [tuple(r) for r in got] == [("a.json", 0, "1"), ("a.json", 1, "t3_p")]
    assert [r.id for r in post_ids(read_json_lists(spark, str(tmp_path))).collect()] == ["t3_p"]
    with pytest.raises(ValueError, match="b.json|c.json"):
        read_json_lists_strict(spark, str(tmp_path))


def test_suffix_left_out(spark, tmp_path):
    write(tmp_path, "q.json", [comment("1")])
    write(tmp_path, "q__recovery.json", [comment("2")])
    assert [r.id for r in read_json_lists(spark, str(tmp_path), exclude_suffix="__recovery.json").collect()] == ["1"]


def test_funnel_orders(spark, tmp_path):
    write(tmp_path, "a.json", [comment("1", "[deleted]"), comment("2"), comment(None), comment(None), comment("3", author="AutoModerator"), comment("4", None), comment("5", author=None)])
    write(tmp_path, "b.json", [comment("1"), comment("2", "other " + LONG), comment("6", made="12:30"), comment("7", made="2015-12-31T23:59:59Z"), comment("8", made="2025-04-30T23:59:59Z"), comment("9", made="2025-05-01T00:00:00Z"), comment("10", "> " + LONG), comment("11", " ".join("w" * 19))])
    items = read_json_lists(spark, str(tmp_path))
    funnel = Funnel()
    got = {r.id: r for r in corpus(items, english, funnel).collect()}
    assert set(got) == {"2", None, "5", "8"}
    assert got["2"].body == LONG and got["2"].tier == "Tier 2" and got["2"].year == 2020
    counts = [r["items"] for r in funnel.table(spark).orderBy("stage_no").collect()]
    assert counts == [15, 15, 12, 10, 9, 8, 6, 4, 4]
    assert {r.id for r in skeleton_corpus(items, english).collect()} == {"1", "2", None, "5", "7", "8", "9"}


def test_sinks(spark, tmp_path):
    write(tmp_path, "a.json", [comment("1", LONG + '\n"quoted", line')])
    df = corpus(read_json_lists(spark, str(tmp_path)), english)
    sinks.write_corpus(df, str(tmp_path / "corpus"))
    back = spark.read.parquet(str(tmp_path / "corpus"))
    assert sinks.corpus_columns(df).columns == ["id", "created", "year", "subreddit", "tier", "score", "depth", "parentKind", "parsedPostId", "clean_wordcount", "body", "clean_body"]
    assert "authorName" not in back.columns and back.count() == 1
    sinks.write_corpus_csv(df, str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv")).first()["body"] == LONG + '\n"quoted", line'
    with pytest.raises(ValueError, match="authorName"):
        sinks.assert_deidentified(df)


def test_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert tables.read_log(spark, path).count() == 0
    row = spark.createDataFrame([("t", "Tier 1", "cars", '"a b"', "2016-01-01", "2016-12-31", True, 5, 4, 0.03)], tables.SCRAPE_LOG)
    sinks.append_log(row, path)
    sinks.append_log(row, path)
    assert tables.read_log(spark, path).agg(F.sum("est_usd")).first()[0] == pytest.approx(0.06)
    (tmp_path / "bad").mkdir()
    write(tmp_path / "bad", "x.csv", "a,b\n1,2\n")
    with pytest.raises(ValueError):
        sinks.append_log(row, str(tmp_path / "bad"))


def test_report_with_bom(spark, tmp_path):
    (tmp_path / "r.csv").write_text('﻿tier,subreddit,term,posts_found,saturated\nT,cars,"""a b""",100,True\nT,cars,c,3,\n', encoding="utf-8")
    got = tables.read_csv(spark, str(tmp_path / "r.csv")).collect()
    assert got[0]["tier"] == "T" and got[0]["term"] == '"a b"' and got[1]["saturated"] is None


def test_replay_and_requests(spark, tmp_path):
    write(tmp_path, "job.json", [comment("1")])
    cached = tmp_path / "cache.json"
    df = fetch.read_or_fetch(spark, str(cached), fetch.ReplayFetcher(spark, str(tmp_path)), {"file": "job.json"})
    assert df.count() == 1 and cached.exists() and not (tmp_path / "cache.json.part").exists()

    class Other:
        def fetch(self, job):
            return [comment("1"), comment("2")]

    assert fetch.read_or_fetch(spark, str(cached), Other(), {}).count() == 1
    assert fetch.read_or_fetch(spark, str(cached), Other(), {}, force=True).count() == 2
    with pytest.raises(FileExistsError):
        tables.write_text(spark, str(cached), "[]")
    job = spark.createDataFrame([("T", "cars", '"a b"', "2016-01-01", "2016-12-31", True)], "tier string, subreddit string, term string, start string, end string, blocked boolean")
    got = json.loads(job.select(fetch.collect_request()).first()[0])
    assert got["searchTerms"] == ['"a b"'] and got["maxPostsCount"] == 3 and got["maxCommentsPerPost"] == 15
    assert got["proxy"] == {"useApifyProxy": True, "apifyProxyGroups": ["RESIDENTIAL"]} and got["postedAfter"] == "2016-01-01" and got["includeNSFW"] is False
    assert json.loads(job.select(fetch.probe_request()).first()[0])["maxCommentsCount"] == 0
    arm = json.loads(job.select(fetch.arm_request(60)).first()[0])
    assert arm["maxPostsCount"] == 60 and arm["crawlCommentsPerPost"] is False and arm["searchTerms"] == ['"a b"']
    batch = spark.createDataFrame([(["u1", "u2"],)], "urls array<string>")
    direct = json.loads(batch.select(fetch.direct_request()).first()[0])
    assert direct["startUrls"] == [{"url": "u1"}, {"url": "u2"}] and (direct["maxPostsCount"], direct["maxCommentsCount"]) == (2, 30)


def test_job_files_and_baselines(spark, tmp_path):
    write(tmp_path, "a.json", [comment("1"), {"dataType": "post", "id": "t3_p", "parsedId": "p"}, {"dataType": "post", "id": "t3_q", "parsedId": ""}])
    write(tmp_path, "b.json", "[broken")
    jobs = spark.createDataFrame([("A", "a.json"), ("B", "b.json"), ("C", "c.json")], "arm string, file string")
    held = read_jobs(spark, str(tmp_path), jobs)
    assert {(r.arm, r.id) for r in held.collect()} == {("A", "1"), ("A", "t3_p"), ("A", "t3_q")}
    assert {(r["arm"], r["items"], r["comments"]) for r in count_comments(held, ["arm"]).collect()} == {("A", 3, 1)}
    got = baseline_ids(spark, {"A": str(tmp_path / "a*.json"), "B": str(tmp_path / "b*.json"), "C": ""})
    assert [tuple(r) for r in got.collect()] == [("A", "p")]


def test_env(tmp_path, monkeypatch):
    monkeypatch.delenv("TIDE_A", raising=False)
    monkeypatch.setenv("TIDE_B", "kept")
    (tmp_path / ".env").write_text("# c\n#TIDE_C=1\n\nTIDE_A = 'v=1'\nTIDE_B=new\nnoline\n")
    assert fetch.settings_of('a = "x y" \n b=\'q\'\nc=\nd = e = f\na=2') == {"a": "x y", "b": "q", "c": "", "d": "e = f"}
    fetch.load_env(str(tmp_path / "no such file"))
    fetch.load_env(str(tmp_path / ".env"))
    import os

    assert os.environ.pop("TIDE_A") == "v=1" and os.environ["TIDE_B"] == "kept"
