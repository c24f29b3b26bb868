import numpy as np

from quernel.functions import encode


def test_hashed_vectors(spark):
    rows = spark.createDataFrame([(1, "one Two two"), (2, "one two two!"), (3, ""), (4, None), (5, "other words")], "doc_id int, text string")
    got = {r.doc_id: r.vector for r in encode.embedded(rows).collect()}
    assert got[1] == got[2] and abs(np.linalg.norm(got[1]) - 1) < 1e-6 and len(got[1]) == 64
    assert not any(got[3]) and got[4] is None and got[5] != got[1]


def test_failing_batches_have_no_vectors(spark):
    def odd(texts):
        if "bad" in texts:
            raise ValueError("bad")
        return np.ones((len(texts), 2), dtype=np.float32)

    rows = spark.createDataFrame([(i, "bad" if i == 1 else "good") for i in range(6)], "doc_id int, text string").coalesce(1)
    got = [r.vector for r in encode.embedded(rows, odd, batch=2).orderBy("doc_id").collect()]
    assert got == [None, None, [1, 1], [1, 1], [1, 1], [1, 1]]
