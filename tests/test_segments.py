"""An index that grows by batches equals one built anew."""

import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quernel.operators import index
from quernel.plans import segments
from quernel.plans.search import SearchEngine
from quernel.sources.shared import shared_dir

SCHEMA = "doc_id long, title string, text string, vector array<float>, tools array<string>, sentiment string, subreddit string, date timestamp, upvotes int"
WORDS = ["the", "the", "of", "license", "token", "plan", "price", "editor", "model", "zeta"]


def document(rnd, i):
    text = " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(0, 25)))
    return (i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(3))), rnd.choice([text, text, text, None]), rnd.choice([None, [rnd.random(), rnd.random()]]), rnd.choice([None, [], ["a", " b"], ["b"]]), rnd.choice(["positive", "odd", None]), rnd.choice(["x", " ", None, "y"]), rnd.choice([None, datetime(2024, rnd.randrange(1, 13), rnd.randrange(1, 28), 23)]), rnd.choice([None, 1, 5]))


def show(engine, asked):
    rows = lambda df, *columns: sorted(map(str, df.select(*columns).collect()))
    return {
        "keyword": rows(engine.keyword(asked, 30), "query_id", "ord", "doc_id", "score"),
        "vector": rows(engine.vector(asked, 5), "query_id", "ord", "doc_id", "score"),
        "spelling": rows(engine.spelling(asked), "query_id", "pos", "token", "correction", "distance"),
        "vocabulary": rows(engine.index.vocabulary, "term", "field", "df"),
        "stats": rows(engine.index.stats.select("field", "n_docs", F.round("avgdl", 9)), "*"),
        "documents": rows(engine.index.documents, "doc_id", "title", "text"),
        "facets": rows(engine.stats(), "facet", "value", "count"),
        **{g: rows(engine.corpus_trend(g), "*") for g in ("day", "week", "month")},
        "postings": rows(engine.index.postings, "term", "field", "doc_id", "tf", "dl", "positions"),
    }


@pytest.mark.parametrize("analyzer", ["plain", "english"])
def test_batches_equal_a_rebuild(spark, tmp_path, analyzer):
    rnd, path, state = random.Random(analyzer), f"{tmp_path}/index", {}
    asked = spark.createDataFrame([(1, "the token", [0.5, 0.5]), (2, '"the license" -zeta', None), (3, "licnese pirce", [1.0, 0.0])], "query_id int, q string, vector array<float>")
    merged = 0
    for number, size in enumerate((60, 5, 3, 4, 2)):
        rows = [document(rnd, i) for i in rnd.sample(range(90), size)]
        gone = rnd.sample(sorted(state), 3) if state else []
        state = {i: r for i, r in state.items() if i not in gone} | {r[0]: r for r in rows}
        before = len(segments.manifest(spark, path))
        batch = spark.createDataFrame([*rows, (None, "no", "id", *[None] * 6)], SCHEMA)
        segments.upsert(batch, path, analyzer, spark.createDataFrame([(i,) for i in [*gone, 777]], "doc_id long"), number)
        merged += len(segments.manifest(spark, path)) <= before
        if number in (1, 4):
            grown, anew = SearchEngine.open(spark, path), SearchEngine(index.build_index(spark.createDataFrame(list(state.values()), SCHEMA), analyzer))
            assert show(grown, asked) == show(anew, asked)
    assert merged == 1 and [r.batch for r in segments.manifest(spark, path)][-1] == 4
    old = len(segments.manifest(spark, path))
    segments.upsert(spark.createDataFrame([], SCHEMA), path)
    assert len(segments.manifest(spark, path)) == old
    assert segments.vacuum(spark, path, keep=1) and SearchEngine.open(spark, path).index.documents.count() == len(state)


def test_an_unfinished_batch_is_not_seen(spark, tmp_path, monkeypatch):
    rnd, path = random.Random(1), f"{tmp_path}/index"
    segments.upsert(spark.createDataFrame([document(rnd, i) for i in range(5)], SCHEMA), path)

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(segments, "_commit", lost)
    with pytest.raises(RuntimeError):
        segments.upsert(spark.createDataFrame([document(rnd, i) for i in range(9)], SCHEMA), path)
    monkeypatch.undo()
    assert SearchEngine.open(spark, path).index.documents.count() == 5
    segments.upsert(spark.createDataFrame([document(rnd, i) for i in range(9)], SCHEMA), path)
    assert SearchEngine.open(spark, path).index.documents.count() == 9


@pytest.mark.parametrize("parts", [False, True])
def test_batches_leave_no_copies(spark, tmp_path, monkeypatch, parts):
    """Nothing of the documents stays outside of the index, and old versions are found by ids in broadcast parts too."""
    if parts:
        monkeypatch.setattr(index, "MANY_IDS", 2)
        monkeypatch.setattr(index, "ID_BYTES", 100)
        monkeypatch.setattr(segments, "HIDDEN", 2)
    rnd, path, shared = random.Random(5), f"{tmp_path}/index", shared_dir(spark)
    before = set(os.listdir(shared.removeprefix("file:")))
    rows = {i: document(rnd, i) for i in range(40)}
    for ids in (range(40), range(0, 40, 2), range(0, 40, 3)):
        rows |= {i: document(rnd, i) for i in ids}
        gone = [] if len(ids) == 40 else [ids[0] + 1]
        rows = {i: r for i, r in rows.items() if i not in gone}
        segments.upsert(spark.createDataFrame([rows[i] for i in ids if i in rows], SCHEMA), path, deleted=spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    assert {n for n in set(os.listdir(shared.removeprefix("file:"))) - before if not n.startswith("words")} == set()
    asked = spark.createDataFrame([(1, "the token", [0.5, 0.5])], "query_id int, q string, vector array<float>")
    assert show(SearchEngine.open(spark, path), asked) == show(SearchEngine(index.build_index(spark.createDataFrame(list(rows.values()), SCHEMA))), asked)


def test_which_segments_are_merged():
    assert segments.due([100]) == 0 and segments.due([100, 10]) == 1 and segments.due([100, 10, 5]) == 1
    assert segments.due([100, 10, 5, 40]) == 0 and segments.due([1000, 100, 10, 1]) == 3
