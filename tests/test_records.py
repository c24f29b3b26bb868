import json

import pytest
from pyspark.sql import functions as F

from quernel.sources import records

GOOD = {
    "doc_id": "r1", "source_platform": "forum", "source_url": "u", "content_type": "post", "content": {"thread_title": "T", "main_text": " body ", "reply_text": None},
    "labels": {"agents": ["copilot"], "polarity": "positive", "subjectivity": "neutral", "aspects": {"cost": "negative"}, "sarcasm": False},
    "platform_context": {"subreddit": "s"}, "author": {"username": "a"}, "timestamps": {"created_at": "2024-05-01T10:00:00Z"}, "engagement": {"upvotes": 3},
}


def changed(**parts):
    return {**json.loads(json.dumps(GOOD)), **parts}


@pytest.fixture
def path(tmp_path):
    lines = [
        GOOD,
        changed(doc_id="r2", labels={**GOOD["labels"], "aspects": ["cost", "ux"]}, content={"reply_text": "only reply"}),
        changed(doc_id="r3", labels={**GOOD["labels"], "aspects": None, "polarity": None}, content={"thread_title": ""}, timestamps={"created_at": "no date"}),
        changed(doc_id="r4", timestamps={"created_at": "2024-05-01T10:00:00+02:00"}, engagement={"upvotes": 1, "num_replies": 7}),
        {k: v for k, v in GOOD.items() if k != "author"},
        "",
        "{broken",
    ]
    file = tmp_path / "in.jsonl"
    file.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return str(file)


def test_records_become_documents(spark, path):
    good, bad = records.split_rejects(records.read_records(spark, path))
    assert bad.count() == 2
    got = {r.doc_id: r for r in records.to_documents(good).collect()}
    assert sorted(got) == ["r1", "r2", "r3", "r4"]
    assert (got["r1"].title, got["r1"].text, got["r1"].aspects, got["r1"].num_replies) == ("T", "T  body", ["cost:negative"], 0)
    assert (got["r2"].title, got["r2"].text, got["r2"].aspects) == ("", "only reply", ["cost", "ux"])
    assert (got["r3"].text, got["r3"].aspects, got["r3"].sentiment, got["r3"].date) == (records.NO_TEXT, [], None, None)
    assert got["r4"].num_replies == 7 and spark.createDataFrame([(got["r4"].date,)], "d timestamp").select(F.date_format("d", "HH")).first()[0] == "08"


def test_missing_file(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        records.read_records(spark, "/no/such/file.jsonl").count()


def test_issues(spark, tmp_path):
    issue = {**{k: GOOD[k] for k in ("doc_id", "source_platform", "source_url", "content", "author", "timestamps")}, "platform_context": {"repo": "o/r"}, "engagement": {"reactions_total": 5, "num_comments": 2}}
    (tmp_path / "i.jsonl").write_text(json.dumps(issue) + "\n" + json.dumps({**issue, "engagement": {"num_comments": 2}}) + "\nnot json\n")
    out = records.issues_to_records(records.read_issues(spark, f"{tmp_path}/i.jsonl"))
    (row,) = out.collect()
    assert (row.content_type, row.platform_context.subreddit, row.engagement.upvotes, row.engagement.num_replies, row.labels.agents) == ("post", "o/r", 5, 2, [])
    out.write.json(f"{tmp_path}/out")
    good, bad = records.split_rejects(records.read_records(spark, f"{tmp_path}/out"))
    assert (good.count(), bad.count()) == (1, 0) and records.to_documents(good).first().subreddit == "o/r"


def test_upsert_and_latest(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "c", 2), (2, "d", 1)], "doc_id int, text string, seq int")
    new = records.latest(rows, "doc_id", F.col("seq"))
    old = spark.createDataFrame([(1, "old", 0), (3, "stays", 0)], "doc_id int, text string, seq int")
    assert {(r.doc_id, r.text) for r in records.upsert(old, new).collect()} == {(1, "b"), (2, "d"), (3, "stays")}
    path = f"{tmp_path}/index"
    records.write_index(old, path, files=1)
    records.clear_index(spark, path)
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(path).columns == old.columns
