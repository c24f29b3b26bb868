import math
import random

import pytest
from pyspark.sql import functions as F

from quernel.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k=10):
    import numpy as np

    usable = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            usable.setdefault(i, []).append([math.floor(1024 * float(np.float32(x))) for x in v])
    out = set()
    for q, vs in usable.items():
        if q % every == 0:
            for v in {tuple(x) for x in vs}:
                scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, ws in usable.items() if i != q for w in ws if len(w) == len(v))
                out |= {(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)}
    return out


@pytest.mark.parametrize(("n", "dim", "chunk", "block"), [(300, 8, 50, 7), (12, 3, 4096, 2048), (400, 2, 16, 2048)])
def test_equal_to_brute_force(as_table, monkeypatch, n, dim, chunk, block):
    monkeypatch.setattr(topk, "CHUNK", chunk)
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "SAMPLE", 40)
    rnd = random.Random(n)
    rows = [(i, [rnd.choice([rnd.gauss(0, 1), 0.5, -0.25]) for _ in range(dim)], 0) for i in range(n)]
    rows += [(n + 10, None, 1), (n + 11, [], 1), (n + 12, [float("nan")] * dim, 1), (n + 13, [None] * dim, 1), (n + 14, [float("inf")] * dim, 1), (None, [0.1] * dim, 1)]
    rows += [(n + 15, [0.5] * (dim + 1), 1), (10 * n, [0.25] * (dim + 1), 1), (n + 17, rows[0][1], 1), (n + 18, rows[0][1], 1)]
    got = topk.exact_topk(as_table(rows, SCHEMA, name="embeddings"), F.col("vec_id") % 10 == 0).collect()
    assert {tuple(r) for r in got} == brute(rows, 10)
    assert len(got) == len({tuple(r) for r in got})


def test_empty(as_table):
    assert topk.exact_topk(as_table([], SCHEMA, name="none"), F.col("vec_id") % 10 == 0).count() == 0
    assert topk.exact_topk(as_table([(1, [1.0], 0)], SCHEMA, name="one"), F.col("vec_id") % 10 == 0).count() == 0


def test_large_vectors_are_scored_exactly(as_table):
    rnd = random.Random(4)
    sizes = [1.0, 1.0, 2.0**9, 2.0**14, 2.0**17]
    rows = [(i, [rnd.gauss(0, 1) * rnd.choice(sizes) for _ in range(5)], 0) for i in range(250)]
    rows += [(300, [2.0**20, 0.0, 0.0, 0.0, 0.0], 0), (310, [1.0, 0.0, 0.0, 0.0, 0.0], 0), (311, [0.0] * 5, 0), (320, [0.0] * 5, 0), (321, [2.0**19, 1.0, 0.0, 0.0, 2.0**-9], 0)]
    df = as_table(rows, SCHEMA, name="embeddings")
    for k in (3, 10):
        assert {tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 10 == 0, k).collect()} == brute(rows, 10, k)
    only = as_table([(100, [1.0, 0.0], 0), (50, [2.0**20, 0.0], 0), (14, [3.0, 0.0], 0)], SCHEMA, name="three")
    assert [tuple(r) for r in topk.exact_topk(only, F.col("vec_id") % 100 == 0, 1).collect()] == [(100, 1, 50, 2**40)]


def test_scores_beyond_a_long(as_table):
    schema = "vec_id long, embedding array<double>"
    # Too small a score takes no place among the best; one that does, or that is too large, can't be told.
    rows = [(0, [1.0, 2.0]), (1, [1e200, -1e300]), (2, [3.0, 4.0]), (100, [0.0, 0.0])]
    df = as_table(rows, schema)
    got = {tuple(r) for r in topk.exact_topk(df, F.col("vec_id") == 0, 2).collect()}
    assert got == {(0, 1, 2, 11 << 20), (0, 2, 100, 0)}
    assert {tuple(r)[2:] for r in topk.exact_topk(df, F.col("vec_id") == 100).collect()} == {(0, 0), (1, 0), (2, 0)}
    more = as_table([*rows, (3, [0.0, -1e300])], schema, name="more")
    for table, query, k in ((df, 0, 3), (more, 1, 1)):
        with pytest.raises(Exception, match="exceeds a long"):
            topk.exact_topk(table, F.col("vec_id") == query, k).collect()
