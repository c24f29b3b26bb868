from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.operators import rank, rerank

ROWS = "query_id int, ord int, doc_id string, score double, sentiment string"


def test_sentiment_boost(spark):
    rows = spark.createDataFrame([(1, 1, "d1", 1.0, "positive"), (1, 2, "d2", 0.9, "negative"), (1, 3, "d3", 0.8, "mixed"), (1, 4, "d4", 0.7, None), (1, 5, "d5", 0.1, "odd")], ROWS)
    got = rerank.sentiment_boost(rows, {"positive": 1.5, "negative": 0.7, "mixed": 1.0, "not_applicable": 1.0}).orderBy("ord").collect()
    assert [(r.doc_id, round(r.score, 4)) for r in got] == [("d1", 1.5), ("d3", 0.8), ("d4", 0.7), ("d2", 0.63), ("d5", 0.1)]


def test_aspect_boost_counts_once(spark):
    rows = spark.createDataFrame([(1, 1, "a", 0.031, ["cost_value:x"]), (1, 2, "b", 0.030, [" Code_Quality :y", "code_quality:z"]), (1, 3, "c", 0.029, ["code_quality"]), (1, 4, "d", 0.02, None)], "query_id int, ord int, doc_id string, score double, aspects array<string>").withColumn("detected", F.array(F.lit("code_quality")))
    got = rerank.aspect_boost(rows).orderBy("ord").collect()
    assert [(r.doc_id, round(r.score, 4)) for r in got] == [("b", 0.039), ("c", 0.0377), ("a", 0.031), ("d", 0.02)]


def test_time_decay(spark):
    now = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, 1, "old", 0.0310, datetime(2021, 4, 6)), (1, 2, "new", 0.0308, datetime(2023, 12, 22)), (1, 3, "none", 0.0306, None), (1, 4, "far", 0.001, datetime(2000, 1, 1)), (1, 5, "next", 0.0305 - 0.02, datetime(2030, 1, 1))], "query_id int, ord int, doc_id string, score double, date timestamp")
    got = {r.doc_id: r for r in rerank.time_decay(rows, now).collect()}
    assert round(got["old"].score, 4) == 0.0114 and round(got["new"].score, 4) == 0.0305
    assert got["none"].score == 0.0306 and not got["far"].near_tie and got["far"].score == 0.001 and got["next"].score == 0.0105
    assert got["none"].ord == 1


def test_equal_scores_keep_their_order(spark):
    rows = spark.createDataFrame([(1, i, f"d{i}", 0.5, None) for i in range(1, 9)], ROWS)
    assert [r.doc_id for r in rank.resorted(rows).orderBy("ord").collect()] == [f"d{i}" for i in range(1, 9)]


def test_pages_part_the_result(spark):
    rows = spark.createDataFrame([(1, i, f"d{i}", 0.5, None) for i in range(1, 24)], ROWS)
    pages = [[r.doc_id for r in rank.page(rows, n, 10).orderBy("ord").collect()] for n in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [10, 10, 3, 0] and sum(pages, []) == [f"d{i}" for i in range(1, 24)]
    assert tuple(rank.page_counts(rows, 10).first()) == (1, 23, 3)


def greedy(rows, query, weight, pool):
    head, tail = rows[:pool], rows[pool:]
    vectors = np.array([np.zeros(4) if v is None else v for _, _, v in head])
    relevance = vectors @ query if query is not None else np.array([s for _, s, _ in head]) / max(s for _, s, _ in head)
    if query is not None and relevance.max() > relevance.min():
        relevance = (relevance - relevance.min()) / (relevance.max() - relevance.min())
    left, picked = list(range(len(head))), []
    while left:
        value = [round(weight * relevance[i] - (1 - weight) * max(vectors[i] @ vectors[j] for j in picked), 12) if picked else round(relevance[i], 12) for i in left]
        best = left[int(np.argmax(value))]
        picked.append(best)
        left.remove(best)
    return [head[i][0] for i in picked] + [r[0] for r in tail]


@pytest.mark.parametrize(("with_query", "weight"), [(True, 0.8), (False, 0.5), (True, 0.0), (True, 1.0)])
def test_diversity_equals_greedy_choice(spark, with_query, weight):
    rng = np.random.default_rng(3)
    query = [0.5, -0.25, 0.75, 0.125] if with_query else None
    rows = [(f"d{i}", float(1 / (i + 1)), None if i % 5 == 4 else [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(14)]
    df = spark.createDataFrame([(1, i + 1, d, s, v, query) for i, (d, s, v) in enumerate(rows)], "query_id int, ord int, doc_id string, score double, vector array<float>, query_vector array<float>")
    got = [r.doc_id for r in rerank.diversified(df, weight, 10).orderBy("ord").collect()]
    assert got == ([d for d, _, _ in rows] if weight >= 1 else greedy(rows, None if query is None else np.array(query), weight, 10))


def test_threshold(spark):
    rows = spark.createDataFrame([(1, 1, "a", 0.9, 0.0), (1, 2, "b", 0.4, 0.7)], "query_id int, ord int, doc_id string, score double, vector_score double")
    kept = lambda t, mode: [r.doc_id for r in rerank.similarity_threshold(rows, t, mode).orderBy("ord").collect()]
    assert (kept(0.5, "semantic"), kept(0.5, "hybrid"), kept(0.5, "keyword"), kept(0.0, "hybrid")) == (["a"], ["b"], ["a", "b"], ["a", "b"])
