"""Requests end to end: query syntax, analysis, checks, spelling, trends with totals, records to a saved index."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_search import DOCUMENT

from quernel.config import SearchConfig
from quernel.operators import index, words
from quernel.operators.filters import Filters
from quernel.plans.build import index_records, vector_lengths
from quernel.plans.search import NO_MATCH, SearchEngine
from quernel.sources.records import read_records


@pytest.fixture(scope="module")
def documents(spark):
    rows = [
        (1, "General notes", "public general license text", "s1", "x", ["a"], "positive", "neutral", [], datetime(2024, 1, 3), 5, [1.0, 0.0]),
        (2, "Licenses", "general public license version two", "s1", "x", ["a"], "mixed", "neutral", [], datetime(2024, 2, 3), 5, [0.0, 1.0]),
        (3, "Running", "he runs and ran, running on", "s1", "x", ["a"], None, "neutral", [], None, 5, [0.6, 0.8]),
    ]
    return spark.createDataFrame(rows, DOCUMENT).cache()


@pytest.fixture(scope="module", params=["plain", "english"])
def engine(documents, request):
    return SearchEngine(index.build_index(documents, request.param), now=datetime(2024, 6, 1))


def found(engine, q):
    queries = engine.index.documents.sparkSession.createDataFrame([(1, q, [1.0, 0.0])], "query_id int, q string, vector array<float>")
    return sorted(r.doc_id for r in engine.search(queries, "keyword").rows.collect())


def test_query_syntax_decides(engine):
    assert found(engine, "general") == [1, 2] and found(engine, "general -version") == [1] and found(engine, "general +version") == [2]
    assert found(engine, '"general public"') == [2] and found(engine, '"public general" license') == [1] and found(engine, '"no such"') == []
    assert found(engine, "-general") == [] and found(engine, "+license +text") == [1]


def test_analysis_end_to_end(documents, spark, tmp_path):
    index.save_index(index.build_index(documents, "english"), f"{tmp_path}/english")
    english, plain = SearchEngine.open(spark, f"{tmp_path}/english"), SearchEngine(index.build_index(documents))
    assert english.index.analyzer == "english"
    assert found(english, "run") == [3] and found(plain, "run") == [] and found(english, "license") == [1, 2] and found(english, "the and") == []


def test_requests_are_checked(engine):
    answer = engine.answer("general licnese", [1.0, 0.0], page_size=500)
    assert {r.doc_id for r in answer.page.collect()} == {1, 2, 3}
    assert answer.counts.first().total_count == 3
    for bad in ({"q": " "}, {"q": "x", "mode": "odd"}, {"q": "x", "page": 0}, {"q": "x", "min_similarity": 2.0}):
        with pytest.raises(ValueError):
            engine.answer(**bad)


def test_questions_without_vectors_are_encoded(spark, documents):
    encoder = lambda texts: [[1.0, 0.0]] * len(texts)
    engine = SearchEngine(index.build_index(documents), encoder=encoder)
    got = engine.search(spark.createDataFrame([(1, "anything")], "query_id int, q string"), "semantic").rows.orderBy("ord").collect()
    assert [r.doc_id for r in got] == [1, 3, 2]


def test_trends_tell_totals(engine, spark):
    asked = lambda q: spark.createDataFrame([(1, q, [1.0, 0.0])], "query_id int, q string, vector array<float>")
    some = engine.trend_of(asked(" "), "month")
    assert tuple(some.totals.first()) == (3, None) and sum(r["count"] for r in some.points.collect()) == 2
    assert tuple(engine.trend_of(asked("zzz"), "month").totals.first()) == (0, NO_MATCH)
    assert tuple(engine.trend_of(asked("general"), "month", "keyword", Filters(sentiment="mixed")).totals.first()) == (1, None)


def test_corrected_questions(spark):
    asked = spark.createDataFrame([(1, "claud licnese  terms"), (2, "license terms")], "query_id int, q string")
    vocabulary = spark.createDataFrame([("license", 9), ("terms", 9), ("claud", 9)], "term string, n long")
    hints = words.spelling(asked, words.known_words(vocabulary))
    assert [tuple(r) for r in words.corrected(asked, hints).collect()] == [(1, "claude license terms")]


def test_cloud_stop_words():
    assert len(words.CLOUD_STOP_WORDS) == len(set(words.CLOUD_STOP_WORDS)) == 207


def test_config_from_a_file(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"search": {"rrf_k": 9, "aspect": {"factor": 2.0}}}))
    c = SearchConfig.from_file(f"{tmp_path}/c.json", "search")
    assert c.rrf_k == 9 and c.aspect.factor == 2.0 and c.page_size == 10


def test_records_to_results(spark, tmp_path):
    record = lambda i, day, **more: {"doc_id": i, "source_platform": "reddit", "source_url": f"u/{i}", "content_type": "comment", "content": {"thread_title": None, "main_text": "", "reply_text": f"cursor reply {i}"}, "labels": {"agents": ["cursor"], "polarity": "positive", "subjectivity": "x", "aspects": "[]", "sarcasm": None}, "platform_context": {"subreddit": "s"}, "author": {"username": "a"}, "timestamps": {"created_at": f"2024-01-0{day}T00:00:00Z"}, "engagement": {"upvotes": 1, "num_replies": 0}, **more}
    lines = [json.dumps(record("a", 1)), json.dumps(record("b", 2)), json.dumps(record("a", 3, source_url="u/new")), json.dumps(record("c", 1, author=None)), "{broken", ""]
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    counts = index_records(read_records(spark, f"{tmp_path}/r.jsonl"), f"{tmp_path}/index")
    assert counts.first().asDict() == {"indexed": 2, "without_vector": 0, "repeated": 1, "skipped": 2}
    engine = SearchEngine.open(spark, f"{tmp_path}/index")
    page = engine.answer("cursor").page.orderBy("doc_id").select("doc_id", "url", "content_type", "title", "shown_title").collect()
    assert [tuple(r) for r in page] == [("a", "u/new", "comment", "", "Reddit Comment"), ("b", "u/b", "comment", "", "Reddit Comment")]
    assert tuple(vector_lengths(engine.index.vectors).first()) == (64, 2, 0)


def test_spelling_by_parts_finds_all_within_two_edits(spark):
    """Held against every pair, with swaps, short words and words of one length apart."""
    import random

    rnd = random.Random(4)
    words_ = sorted({"".join(rnd.choice("abcé") for _ in range(rnd.randrange(1, 9))) for _ in range(600)})
    tokens = sorted({"".join(rnd.choice("abcé") for _ in range(rnd.randrange(3, 9))) for _ in range(150)} - set(words_))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    swap = lambda a, b: len(a) == len(b) and a != b and any(a[:i] + a[i + 1] + a[i] + a[i + 2 :] == b for i in range(len(a) - 1))
    frequency = {w: 1 + (7 * i) % 5 for i, w in enumerate(words_)}
    expected = {}
    for t in tokens:
        near = sorted((1 if swap(t, w) else d, -n, w) for w, n in frequency.items() if (d := distance(t, w)) <= 2)
        if near:
            expected[t] = (near[0][2], near[0][0])
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "query_id int, q string")
    known = spark.createDataFrame(list(frequency.items()), "word string, n long")
    assert {r.token: (r.correction, r.distance) for r in words.spelling(asked, known).collect()} == expected


def test_spelling_of_a_saved_index(documents, spark, tmp_path):
    index.save_index(index.build_index(documents), f"{tmp_path}/plain")
    saved, whole = SearchEngine.open(spark, f"{tmp_path}/plain"), SearchEngine(index.build_index(documents))
    asked = spark.createDataFrame([(1, "licnese publik genral claud cusror runing"), (2, "license"), (3, "zzzzzzzz")], "query_id int, q string")
    told = lambda e: sorted(tuple(r) for r in e.spelling(asked).collect())
    assert told(saved) == told(whole) and len(told(saved)) >= 5


def test_documents_of_many_ids_are_read_without_moving_the_others(spark, monkeypatch, tmp_path):
    from quernel.sources.shared import held

    spark.range(5000).withColumn("text", F.lit("x")).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents")
    documents = spark.read.parquet(f"{tmp_path}/documents")
    rows = held(spark.createDataFrame([(i % 300, i) for i in range(900)] + [(9999, 1), (None, 2)], "doc_id long, n int"), "rows")
    expected = sorted(map(str, rows.join(documents, "doc_id", "left").collect()))
    monkeypatch.setattr(index, "MANY_IDS", 10)
    for size in (1 << 20, 1000):
        monkeypatch.setattr(index, "ID_BYTES", size)
        assert sorted(map(str, index.with_documents(rows, documents).collect())) == expected
    assert index.with_documents(rows, documents, "inner").count() == 900
