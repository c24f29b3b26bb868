import json

from pyspark.sql import functions as F

from quernel.plans import segments
from quernel.plans.search import SearchEngine
from quernel.streaming import ingest


def record(i, text, day, polarity="positive", **parts):
    return {
        "doc_id": i, "source_platform": "forum", "source_url": "u", "content_type": "post", "content": {"thread_title": "T", "main_text": text}, "labels": {"agents": [], "polarity": polarity, "subjectivity": "neutral", "aspects": None, "sarcasm": None},
        "platform_context": {"subreddit": "s"}, "author": {"username": "a"}, "timestamps": {"created_at": f"2024-05-{day:02d}T10:00:00Z"}, "engagement": {"upvotes": day}, **parts,
    }


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n{broken\n")


def test_upserts_across_batches(spark, tmp_path):
    run = lambda: ingest.ingest(ingest.record_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/index", f"{tmp_path}/state").awaitTermination()
    land(tmp_path / "in", "a.jsonl", [record("a", "one", 1), record("b", "one", 1), record("a", "two", 2)])
    run()
    land(tmp_path / "in", "b.jsonl", [record("b", "three", 3), record("c", "one", 3, author=None)])
    run()
    assert {(r.doc_id, r.text) for r in ingest.current(spark, f"{tmp_path}/index").collect()} == {("a", "T two"), ("b", "T three")}
    assert len(ingest.versions(spark, f"{tmp_path}/index")) == 2 and ingest.current(spark, f"{tmp_path}/none") is None


def test_old_records_come_late_and_only_touched_parts_are_written(spark, tmp_path):
    index = f"{tmp_path}/index"
    run = lambda: ingest.ingest(ingest.record_stream(spark, f"{tmp_path}/in"), index, f"{tmp_path}/state", buckets=64).awaitTermination()
    found = lambda: {r.doc_id: r.text for r in ingest.current(spark, index).collect()}
    land(tmp_path / "in", "a.jsonl", [record(f"d{i}", "first", 5) for i in range(200)])
    run()
    before = ingest.parts(spark, index)
    land(tmp_path / "in", "b.jsonl", [record("d1", "late", 2), record("d2", "new", 6), record("d3", "equal", 5)])
    run()
    expected = {f"d{i}": "T first" for i in range(200)} | {"d2": "T new", "d3": "T equal"}
    assert found() == expected
    after = ingest.parts(spark, index)
    assert set(after) == set(before) and 1 <= sum(after[b] != before[b] for b in after) <= 3
    for day in (7, 8, 9):
        land(tmp_path / "in", f"{day}.jsonl", [record(f"d{i}", f"day {day}", day) for i in range(200)])
        run()
    assert found() == {f"d{i}": "T day 9" for i in range(200)}
    assert ingest.versions(spark, index) == [3, 4]  # the newest, and what its repetition would start from
    land(tmp_path / "in", "none.jsonl", [])
    run()
    assert len(found()) == 200


def test_windows(spark, tmp_path):
    land(tmp_path / "in", "a.jsonl", [record("a", "x", 1), record("a", "x", 1), record("b", "x", 1, "negative"), record("c", "x", 2, None), record("z", "x", 20)])
    stream = ingest.windowed_trend(ingest.documents_of(ingest.record_stream(spark, f"{tmp_path}/in")))
    query = stream.writeStream.format("memory").queryName("trend").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.day: (r.positive, r.negative, r.not_applicable, r["count"], r.avg_upvotes) for r in spark.table("trend").withColumn("day", F.date_format("start", "dd")).collect()}
    assert got == {"01": (1, 1, 0, 2, 1.0), "02": (0, 0, 1, 1, 2.0)}


def test_what_has_come_can_be_searched(spark, tmp_path):
    index = f"{tmp_path}/index"
    run = lambda: segments.follow(ingest.documents_of(ingest.record_stream(spark, f"{tmp_path}/in")), index, f"{tmp_path}/state").awaitTermination()
    asked = spark.createDataFrame([(1, "license")], "query_id int, q string")
    found = lambda: {r.doc_id for r in SearchEngine.open(spark, index).keyword(asked, 10).collect()}
    land(tmp_path / "in", "a.jsonl", [record("a", "license terms", 3), record("b", "other words", 3), record("a", "license old", 1)])
    run()
    assert found() == {"a"}
    land(tmp_path / "in", "b.jsonl", [record("a", "no more", 4), record("b", "license late", 2), record("c", "license", 1)])
    run()
    assert found() == {"c"} and {r.doc_id: r.text for r in SearchEngine.open(spark, index).index.documents.collect()} == {"a": "T no more", "b": "T other words", "c": "T license"}
    land(tmp_path / "in", "none.jsonl", [])
    run()
    assert found() == {"c"}
