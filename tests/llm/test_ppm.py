import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quernel.llm import frequency, ppm

ORDER = 3


def training(seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcde ") for _ in range(rnd.randrange(60))).encode() for _ in range(60)]


def contexts(texts, order=ORDER):
    counts = [{} for _ in range(order + 1)]
    for x in texts:
        s = [255] * order + list(x) + [255]
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[k].setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1
    return counts


def brute(counts, x, least):
    order = len(counts) - 1
    s, total = [255] * order + list(x) + [255], 0.0
    for i in range(order, len(s)):
        excluded = set()
        for k in range(order, -1, -1):
            full = counts[k].get(tuple(s[i - k : i]), {})
            kept = {y: n for y, n in full.items() if n >= least}
            left = {y: n for y, n in kept.items() if y not in excluded}
            if not left:
                continue
            escape = len(left) + sum(full.values()) - sum(kept.values())
            if s[i] in left:
                total += math.log10(left[s[i]] / (sum(left.values()) + escape))
                break
            total += math.log10(escape / (sum(left.values()) + escape))
            excluded |= set(left)
        else:
            total -= math.log10(256 - len(excluded))
    return total


@pytest.mark.parametrize("nodes", [10**6, 200, 30, 0])
def test_equal_to_brute_force_and_sums_to_one(spark, nodes):
    texts = training()
    counts = contexts(texts)
    every = [n for level in counts for d in level.values() for n in d.values()]
    least = next((x for x in sorted(set(every)) if sum(n >= x for n in every) <= nodes), 10**9)
    trie = ppm.train(spark.createDataFrame([(bytearray(x),) for x in texts], "text binary"), ORDER, nodes)
    asked = [*texts, b"zzq!a", b""]
    assert np.allclose(trie.score_texts(asked), [brute(counts, x, least) for x in asked], atol=1e-9)
    for a, b, c in ((97, 98, 99), (255, 255, 120), (255, 255, 255), (1, 2, 3)):
        assert abs((10 ** trie.score(np.array([(a << 24) | (b << 16) | (c << 8) | x for x in range(256)], dtype=np.uint64))).sum() - 1) < 1e-9


@pytest.mark.parametrize("hot", [0, 3, 1 << 18])
def test_baseline(as_table, monkeypatch, hot):
    monkeypatch.setattr(ppm, "HOT", hot)
    rnd = random.Random(3)
    rows = [(i, rnd.choice([" ", "\n"]).join(rnd.choice(["A", "a", "é", "b\x1f", "C" * 70, str(i % 7)]) for _ in range(rnd.randrange(30)))) for i in range(120)] + [(500, None), (501, ""), (1, "again")]
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    words = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    counts = Counter(w for i, t in rows if not out(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    expected = sorted((i, out(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)), 6)) for i, t in rows)
    got = ppm.score_texts(as_table(rows)).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert all(r.score < 0 for r in got)


def test_no_training_text(as_table):
    got = ppm.score_texts(as_table([(3, "ab")] if zlib.crc32(b"3") % 5 == 1 else [(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1), "ab")])).first()
    assert (got.held_out, got.n_tokens, got.n_known, got.train_tokens, got.base_score) == (True, 2, 0, 0, 0.0)
    assert abs(got.score + 3 * math.log10(256)) < 1e-9
    assert ppm.score_texts(as_table([], name="none")).count() == 0


def test_frequency_threshold(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(n,) for n in (5, 4, 4, 3, 1)], "n long")
    assert [df.where(frequency.at_most(df, F.col("n"), most)).count() for most in (0, 1, 2, 3, 4, 9)] == [0, 1, 1, 3, 4, 5]


@pytest.mark.parametrize("hot", [0, 50, 1 << 20])
def test_all_contexts_count(as_table, hot):
    texts = [*training(), b"zzq!a", b"", b"\xc3\xa9 abc"]
    rows = [(i, t.decode()) for i, t in enumerate([*texts, *training(2)[:20]])]
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    docs = as_table(rows)
    texts = docs.select("doc_id", ppm.held_out(docs.doc_id).alias("held_out"), docs.text.cast("binary").alias("text"))
    counted = ppm.written(ppm.count_windows(texts.selectExpr("text", "NOT held_out"), ORDER), "windows")
    scores = ppm.written(ppm.score_windows(counted, ORDER), "scores")
    got = {r.place: r.score for r in ppm.sum_windows(texts.selectExpr("doc_id AS place", "text"), scores, ORDER, hot).collect()}
    counts = contexts([t.encode() for i, t in rows if not out(i)])
    assert sorted(got) == [i for i, _ in rows] and any(out(i) for i in got)
    assert np.allclose([got[i] for i, _ in rows], [brute(counts, t.encode(), 1) for _, t in rows], atol=1e-9)


@pytest.mark.parametrize("most", [1, 12, 60])
def test_heavy_ends_of_contexts_are_split(as_table, most):
    """Contexts of six bytes, of which many end alike: by whatever number of bytes windows meet, the scores are those of the whole trie."""
    rnd = random.Random(most)
    texts = [" ".join(rnd.choice(["he said", "she said", "the", "said he", "aaaa", "é"]) for _ in range(rnd.randrange(30))).encode() for _ in range(60)]
    docs = as_table([(i, t.decode()) for i, t in enumerate(texts)])
    rows = docs.select(docs.text.cast("binary").alias("text"), (docs.doc_id % 4 != 0).alias("learned"), "doc_id")
    counted = ppm.written(ppm.count_windows(rows.select("text", "learned"), 6), "windows")
    found = ppm.heavy_suffixes(counted, 3, 6, most)
    assert sorted(found) == {1: [3, 4, 5], 12: [3, 4, 5]}.get(most, [])
    scores = ppm.written(ppm.score_windows(counted, 6, most), "scores")
    got = {r.place: r.score for r in ppm.sum_windows(rows.selectExpr("doc_id AS place", "text"), scores, 6).collect()}
    whole = ppm.train(docs.where("doc_id % 4 <> 0").select(docs.text.cast("binary")), 6, 10**6).score_texts(texts)
    assert np.allclose([got[i] for i in range(len(texts))], whole, atol=1e-9)


def test_no_node_is_left_out_of_the_query(as_table, monkeypatch):
    """However few nodes fit in memory, the scores are those of all contexts."""
    rows = [(i, t.decode()) for i, t in enumerate(training())]
    docs = as_table(rows)
    learned = docs.where(~ppm.held_out(docs.doc_id)).select(docs.text.cast("binary"))
    whole = ppm.train(learned, nodes=10**6).score_texts([t.encode() for _, t in rows])
    for name in ("NODES", "HOT_WINDOWS"):
        monkeypatch.setattr(ppm, name, 30, raising=False)
    monkeypatch.setattr(ppm.train, "__defaults__", (ppm.ORDER, 30))
    if hasattr(ppm, "sum_windows"):
        monkeypatch.setattr(ppm.sum_windows, "__defaults__", (ppm.ORDER, 30))
    assert np.allclose([r.score for r in ppm.score_texts(docs).orderBy("doc_id").collect()], whole, atol=1e-9)


def test_contexts_of_six_bytes():
    keys, _ = ppm.windows([b"abcdefg"])
    assert int.from_bytes(b"abcdefg") in keys.tolist()


def test_scores_of_the_query_equal_brute_force(as_table):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice(["abra", "cadabra", "é", "x" * 20, str(i % 5)]) for _ in range(rnd.randrange(12)))) for i in range(80)] + [(200, None), (201, ""), (1, "again")]
    counts = contexts([(t or "").encode() for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1], ppm.ORDER)
    got = sorted((r.doc_id, round(r.score, 6)) for r in ppm.score_texts(as_table(rows)).collect())
    assert got == sorted((i, round(brute(counts, (t or "").encode(), 1), 6)) for i, t in rows)


def test_long_tokens_are_keys_of_bounded_length():
    keys = {frequency.key_of(t) for t in ("-" * 80, "-" * 81, "-" * 64, b"-" * 80, "é" * 10**6)}
    assert len(keys) == 5 and all(len(k) <= 66 for k in keys) and frequency.key_of("-" * 64) == "-" * 64


def test_scores_do_not_depend_on_partitions(spark, as_table):
    """Windows of different suffixes are scored in different tasks, with different tries."""
    rows = [(i, t.decode()) for i, t in enumerate([*training(), *training(2)])]
    counts = contexts([t.encode() for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1], ppm.ORDER)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.doc_id: r.score for r in ppm.score_texts(as_table(rows)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert np.allclose([got[i] for i, _ in rows], [brute(counts, t.encode(), 1) for _, t in rows], atol=1e-6)
