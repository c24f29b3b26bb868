"""How postings and blocks are made: without shuffles, in bounded pieces, and alike."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.functions import text
from quernel.operators import index
from quernel.plans import queries
from quernel.plans.search import SearchEngine


def documents(spark, n=300):
    rnd = random.Random(3)
    words = ["Running", "runs", "ran", "the", "license", "licenses", "connection", "connected", "cat's", "été", "x1"]
    text = lambda k: " ".join(rnd.choice(words) for _ in range(rnd.randrange(k)))
    rows = [(i if i % 50 else None if i else 0, text(4) if i % 7 else None, text(40)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, title string, text string").withColumn("vector", F.lit(None).cast("array<float>"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("analyzer", ["plain", "english"])
@pytest.mark.parametrize("tokens", [1 << 19, 50])
def test_blocks_hold_the_postings_and_are_not_shuffled(spark, monkeypatch, analyzer, tokens):
    monkeypatch.setattr(index, "TOKENS", tokens)
    docs = documents(spark)
    posted, blocks = index.build_index(docs, analyzer).postings, index.blocks_of(docs, analyzer)
    assert "Exchange" not in plan(posted) and "Exchange" not in plan(blocks)
    told = lambda rows: sorted((str(r) for r in rows.select("term", "field", "doc_id", "tf", "dl", "positions").collect()))
    assert told(index.unpacked(blocks, "positions")) == told(posted)
    raw = index.postings(index.field_tokens(docs, index.ANALYZERS[analyzer]))
    same = index.stemmed(raw, analyzer).select("term", "field", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.explode("positions").alias("p"))
    mine = posted.select("term", "field", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.explode("positions").alias("p"))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, mine.collect()))
    for r in blocks.collect():
        ids = [-1 if i is None else i for i in r.doc_ids]
        assert ids == sorted(ids) and r.n == len(ids) <= index.BLOCK and r.most_tf == max(r.tfs) and r.least_dl == min(r.dls)
    sums = {r.field: (r.n, r.t) for r in blocks.groupBy("field").agg(F.sum("heads").alias("n"), F.sum("tokens").alias("t")).collect()}
    built = index.build_index(docs, analyzer).stats.collect()
    assert sums == {r.field: (r.n_docs, round(r.n_docs * r.avgdl)) for r in built}
    # A document's fields are in one block, so a block's bound holds for its documents.
    if tokens == 50:
        ids = docs.where("doc_id IS NOT NULL")
        where = index.unpacked(index.blocks_of(ids, analyzer)).groupBy("doc_id").agg(F.count_distinct("block").alias("n"))
        assert where.where("n > 1").isEmpty()


def test_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(index, "TOKENS", 10)
    sizes = np.array([4, 4, 4, 0, 30, 1, 1, 1, 9])
    assert list(index._ranges(sizes, 3)) == [(0, 2), (2, 4), (4, 5), (5, 8), (8, 9)]
    assert list(index._ranges(np.zeros(0, int), 3)) == []


def test_vocabulary_of_plain_words_needs_no_python(spark):
    built = index.build_index(documents(spark))
    assert "Arrow" not in plan(built.vocabulary)
    df = {(r.term, r.field): r.df for r in built.postings.groupBy("term", "field").agg(F.count("*").alias("df")).collect()}
    assert {(r.term, r.field): r.df for r in built.vocabulary.collect()} == df


@pytest.mark.parametrize("analyzer", ["plain", "english"])
def test_texts_are_read_once_for_asked_terms(spark, monkeypatch, analyzer):
    """What is known of asked terms equals what the whole index has of them; nothing of the texts is in the plan of the search any more."""
    monkeypatch.setattr(index, "TOKENS", 50)
    built = index.build_index(documents(spark), analyzer)
    asked = spark.createDataFrame([("run",), ("licens",), ("license",), ("x1",), ("none",), ("x1",)], "term string")
    found = index.of_asked(built, asked)
    for name in ("postings", "vocabulary", "stats"):
        rows = getattr(built, name)
        rows = rows.join(asked.distinct(), "term", "left_semi") if "term" in rows.columns else rows
        kept = [c for c in rows.columns if c != "head"]
        got = getattr(found, name)
        assert "Arrow" not in plan(got) and "Arrow" in plan(built.postings)
        assert sorted(map(str, got.select(*kept).collect())) == sorted(map(str, rows.select(*kept).collect()))
    engine, calls = SearchEngine(built), []
    real = index._posted
    monkeypatch.setattr(index, "_posted", lambda *a: calls.append(a) or real(*a))
    told = engine.keyword(spark.createDataFrame([(1, "running license x1")], "query_id int, q string"), 5)
    assert len(calls) == 1 and "Arrow" not in plan(told) and told.count() == 5


def test_possessive_endings(spark):
    words = ["cat's", "cat’s", "it's", "s", "x's's", "l'été", "dogs'", "'s"]
    told = spark.createDataFrame([(" ".join(words),)], "t string").select(text.english_terms(F.col("t")).alias("w")).first().w
    assert told == ["cat", "cat", "it", "s", "x's", "l'été", "dogs", "s"]


def test_index_build_starts_no_python_workers(spark):
    told = plan(queries.REGISTERED["index_build"](spark, "/root/testdata/sf0.001"))
    assert "HashAggregate" in told and not any(word in told for word in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("analyzer", ["plain", "english"])
@pytest.mark.parametrize("size", [1 << 20, 200])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_blocks_are_packed_where_they_are_dealt(spark, monkeypatch, analyzer, size, kind):
    """The shuffle carries packed blocks only, and what comes out of it are the blocks with their buckets."""
    monkeypatch.setattr(index, "PACKED", size)
    docs = documents(spark).withColumn("doc_id", F.col("doc_id").cast(kind))
    dealt = index.dealt_blocks(docs, analyzer)
    assert dealt._jdf.queryExecution().optimizedPlan().toString().count("RebalancePartitions") == 1
    node = dealt._jdf.queryExecution().optimizedPlan().children().head()
    assert node.nodeName() == "RebalancePartitions" and [c.name() for c in (node.output().apply(i) for i in range(node.output().length()))] == ["bucket", "packed"]
    told = lambda rows: sorted(map(str, rows.collect()))
    assert told(dealt) == told(index.blocks_of(docs, analyzer).withColumn("bucket", index.term_bucket(F.col("term"))))
    assert dealt.schema.simpleString() == index.blocks_of(docs, analyzer).withColumn("bucket", index.term_bucket(F.col("term"))).schema.simpleString()
    assert index.dealt_blocks(docs.limit(0), analyzer).count() == 0


def test_saved_tables_are_compressed_well(spark, tmp_path):
    index.save_index(index.build_index(documents(spark)), f"{tmp_path}/index")
    files = [f for f in tmp_path.rglob("*.parquet") if f.is_file() and f.parts[len(tmp_path.parts) + 1] in ("documents", "vectors", "blocks", "vocabulary", "nearby")]
    assert files and all(".zstd." in f.name for f in files)
    assert ".zstd." in index.held(documents(spark), "x").inputFiles()[0]


def test_vector_search_saves_vectors_only(spark, monkeypatch):
    def not_asked(*_, **__):
        raise AssertionError("texts are indexed")

    monkeypatch.setattr(index, "save_index", not_asked)
    monkeypatch.setattr(queries, "INDEXES", {})
    found = queries.REGISTERED["knn_topk"](spark, "/root/testdata/sf0.001")
    assert found.groupBy("query_id").count().select("count").distinct().collect() == [(100,)]
    ((path, saved),) = queries.INDEXES.values()
    assert saved.columns == ["doc_id", "vector"] and saved.where("vector IS NULL").isEmpty()
