"""Approximate vector search against the exact one."""

import numpy as np
import pytest

from quernel.operators import cells, retrieve


def clustered(n, dim, seed, groups=60):
    rng = np.random.default_rng(seed)
    means = rng.standard_normal((groups, dim))
    x = means[rng.integers(groups, size=n)] + 0.45 * rng.standard_normal((n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    x = clustered(6000, 24, 1)
    # A third of all rows are copies of one vector.
    x[4000:] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(9001, None), (9002, []), (9003, [float("nan")] * 24), (9004, [0.5] * 3), (9005, [0.25, 0.5, 1.0]), (9006, [None] * 24)]
    vectors = spark.createDataFrame(rows + odd, "doc_id long, vector array<float>").repartition(6).cache()
    path = str(tmp_path_factory.mktemp("cells"))
    cells.save_cells(vectors, path)
    return vectors, cells.VectorCells.open(spark, path)


def told(rows):
    return {(r.query_id, r.ord, r.doc_id, round(r.score, 6)) for r in rows.collect()}


def test_recall_and_cells_read(table):
    vectors, saved = table
    asked = vectors.where("doc_id % 20 = 0 AND doc_id < 4000").withColumnRenamed("doc_id", "query_id")
    exact, got = told(retrieve.vector_top(vectors, asked, 10)), told(saved.search(asked, 10))
    scores = lambda rows: {(q, o): s for q, o, _, s in rows}
    # Scores of each place are compared, as copies are alike.
    best, near = scores(exact), scores(got)
    assert len(got) == len(exact) and np.mean([near[p] >= s - 1e-6 for p, s in best.items()]) >= 0.9
    assert saved.default_probes() < 0.2 * len(saved.centers)
    hundred, more = told(retrieve.vector_top(vectors, asked.limit(20), 100)), told(saved.search(asked.limit(20), 100))
    assert np.mean([scores(more)[p] >= s - 1e-6 for p, s in scores(hundred).items()]) >= 0.9


def test_all_cells_and_candidates_are_exact(table, monkeypatch):
    vectors, saved = table
    monkeypatch.setattr(cells, "QUESTIONS", 3)
    asked = vectors.where("doc_id IN (0, 5, 17, 4100, 9003, 9004, 9005)").where("doc_id <> 9003").withColumnRenamed("doc_id", "query_id")
    assert told(saved.search(asked, 7, probes=len(saved.centers), rerank=1000)) == told(retrieve.vector_top(cells.finite(vectors), asked, 7))


def test_every_vector_is_in_a_cell_and_cells_are_pruned(table):
    vectors, saved = table
    rows = saved.vectors
    assert rows.count() == 6002 and {r.doc_id for r in rows.where("cell = -1").collect()} == {9004, 9005}
    assert len(saved.centers) == 77
    plan = saved.candidates(np.arange(1, dtype=np.int32), clustered(1, 24, 3), 2, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_tables_without_vectors(spark, tmp_path):
    schema = "doc_id string, vector array<float>"
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<float>")
    for name, rows in (("none", []), ("null", [("a", None)])):
        cells.save_cells(spark.createDataFrame(rows, schema), f"{tmp_path}/{name}")
        assert cells.VectorCells.open(spark, f"{tmp_path}/{name}").search(asked, 5).count() == 0
    cells.save_cells(spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], schema), f"{tmp_path}/few", n_cells=2)
    got = cells.VectorCells.open(spark, f"{tmp_path}/few").search(asked, 2, probes=2).orderBy("ord").collect()
    assert [(r.doc_id, round(r.score, 6)) for r in got] == [("a", 1.0), ("b", 1.0)]


def test_an_engine_searches_by_cells(spark, tmp_path):
    from quernel.config import SearchConfig
    from quernel.operators import index
    from quernel.plans.search import SearchEngine

    x = clustered(400, 8, 2, groups=8)
    docs = spark.createDataFrame([(i, "a title", f"text {i}", v.tolist()) for i, v in enumerate(x)], "doc_id long, title string, text string, vector array<float>")
    index.save_index(index.build_index(docs), f"{tmp_path}/index", cells=True)
    asked = spark.createDataFrame([(i, "text", x[i].tolist()) for i in (3, 30, 300)], "query_id int, q string, vector array<float>")
    exact, near = (SearchEngine.open(spark, f"{tmp_path}/index", config=SearchConfig(vector_rows=10, vector_probes=p)) for p in (0, 20))
    assert exact.index.cells is not None and len(exact.index.cells.centers) == 20
    # All cells are read, and all candidates that codes rank among the first 80 are scored exactly.
    assert len(told(near.vector(asked, 10)) & told(exact.vector(asked, 10))) >= 27
