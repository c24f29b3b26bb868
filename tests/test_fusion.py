import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernel.operators import fuse

KEYWORD = "query_id int, ord int, doc_id string, score double"


def lists(spark, keyword, vector):
    """Ranked lists of ids."""
    one = spark.createDataFrame([(1, i, d, 1.0 / i) for i, d in enumerate(keyword, 1)], KEYWORD)
    two = spark.createDataFrame([(1, i, d, 1 - i / 100) for i, d in enumerate(vector, 1)], KEYWORD)
    return one, two


def fused(spark, keyword, vector):
    return fuse.fuse(*lists(spark, keyword, vector)).orderBy("ord").collect()


@pytest.mark.parametrize(("rank", "score"), [(1, 1 / 61), (2, 1 / 62), (100, 1 / 160)])
def test_formula(spark, rank, score):
    assert spark.range(1).select(fuse.rrf(F.lit(rank))).first()[0] == pytest.approx(score, rel=1e-5)


def test_two_lists(spark):
    rows = fused(spark, ["d1", "d2", "d3"], ["d2", "d1", "d4"])
    assert [r.doc_id for r in rows] == ["d1", "d2", "d3", "d4"]
    assert rows[0].score == pytest.approx(1 / 61 + 1 / 62, rel=1e-5)
    assert (rows[3].keyword_rank, rows[3].vector_rank) == (None, 3) and rows[2].vector_score == 0


def test_shared_document_adds_up(spark):
    (row,) = fused(spark, ["d1"], ["d1"])
    assert row.score == pytest.approx(2 / 61, rel=1e-5)


def test_rows_without_an_id_use_up_their_place(spark):
    rows = fused(spark, ["", "a", None, "b"], ["b"])
    assert {r.doc_id: round(r.score, 9) for r in rows} == {"a": round(1 / 62, 9), "b": round(1 / 64 + 1 / 61, 9)}


def test_empty_and_single_lists(spark):
    assert fused(spark, [], []) == []
    assert [r.doc_id for r in fused(spark, ["a", "b"], [])] == ["a", "b"]
    assert [r.doc_id for r in fused(spark, [], ["b", "a"])] == ["b", "a"]


def test_missing_ids_keep_their_place_and_twice_adds_up(spark):
    rows = {r.doc_id: r for r in fused(spark, [None, "a", "a"], [])}
    assert rows["a"].score == pytest.approx(1 / 62 + 1 / 63) and rows["a"].keyword_rank == 3


def test_worked_example(spark):
    rows = fused(spark, ["A", "x", "B"], ["y", "B", "z", "u", "A"])
    score = {r.doc_id: round(r.score, 4) for r in rows}
    assert score["A"] == 0.0318 and score["B"] == 0.032 and rows[0].doc_id == "B"


def test_explanation(spark):
    row = spark.createDataFrame([(3, None)], "keyword_rank int, vector_rank int").select(fuse.explanation()).first()[0]
    assert row == "Keyword(rank=3): 1/(60+3) = 0.0159; Total: 0.0159"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from("abcdef"), unique=True), st.lists(st.sampled_from("abcdef"), unique=True))
def test_scores_do_not_depend_on_sides(spark, a, b):
    one, two = ({r.doc_id: r.score for r in fused(spark, *x)} for x in ((a, b), (b, a)))
    assert one.keys() == two.keys() and all(math.isclose(one[k], two[k]) for k in one)
