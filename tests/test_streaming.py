import json

from tidemark.streaming import stream


def test_stream_dedup(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    item = lambda i, made: {"dataType": "comment", "id": i, "body": "text", "authorName": "x", "commentCreatedAt": made, "subredditName": "cars"}
    (src / "a.json").write_text(json.dumps([item("1", "2020-01-01T00:00:00Z"), item("1", "2020-01-01T01:00:00Z"), item("2", "2020-01-02T00:00:00Z")]))
    (src / "b.json").write_text(json.dumps([item("2", "2020-01-02T00:00:00Z"), item("3", "2020-01-03T00:00:00Z"), item("4", "12:30"), item("5", "2020"), item("6", None)]))
    rows = stream.first_seen(stream.stream_items(spark, str(src)))
    stream.write(rows, str(tmp_path / "out"), str(tmp_path / "ck"), trigger_once=True).awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2", "3"]
    counts = stream.window_counts(stream.first_seen(stream.stream_items(spark, str(src))))
    stream.write(counts, str(tmp_path / "out2"), str(tmp_path / "ck2"), trigger_once=True).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out2")).columns == ["start", "end", "tier", "n"]
