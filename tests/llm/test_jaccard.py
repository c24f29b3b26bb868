import random
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quernel.llm import components, jaccard


def brute(rows, width=4, percent=85):
    """doc_id: (set size, smallest id reachable), for distinct ids."""
    sets = {}
    for i, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                o = len(sets[i] & sets[j])
                if 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def texts(seed, n, words=40):
    """Copies, chains of near copies, texts around one passage, and unrelated ones."""
    rnd = random.Random(seed)
    base = [[f"w{rnd.randrange(60)}" for _ in range(rnd.randrange(1, words))] for _ in range(6)]
    passage = [f"p{k}" for k in range(30)]
    out = []
    for _ in range(n):
        w = list(rnd.choice(base + out[-5:] if out else base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            w.insert(rnd.randrange(len(w) + 1), f"w{rnd.randrange(60)}")
        if rnd.random() < 0.3:
            w = passage + [f"w{rnd.randrange(60)}" for _ in range(rnd.randrange(4))]
        out.append(w)
    return [" ".join(w).upper() if rnd.random() < 0.2 else " \n".join(w) for w in out]


@pytest.mark.parametrize(("seed", "long", "block"), [(1, 64, 256), (2, 3, 4), (3, 2, 2)])
def test_components_equal_brute_force(as_table, monkeypatch, seed, long, block):
    monkeypatch.setattr(jaccard, "LONG", long)
    monkeypatch.setattr(jaccard, "DENSE", long)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = [*enumerate(texts(seed, 150)), (900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE two"), (905, "two one")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(as_table(rows)).collect()}
    assert got == brute(rows)


def test_other_thresholds(as_table):
    rows = list(enumerate(texts(7, 60)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(as_table(rows), 5, 80).collect()}
    assert got == brute(rows, 5, 80)


def test_blocks_and_pairs_find_all_without_stars(as_table, monkeypatch):
    monkeypatch.setattr(jaccard, "LONG", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    real, calls = jaccard.verified, []

    def verified(pairs, sets, percent):
        calls.append(1)
        return real(pairs.where(F.lit(False)) if len(calls) == 1 else pairs, sets, percent)

    monkeypatch.setattr(jaccard, "verified", verified)
    rows = list(enumerate(texts(5, 120)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(as_table(rows)).collect()}
    assert got == brute(rows)


def test_one_of_each_stays(as_table):
    rows = [(3, "a b c d e"), (1, "A b c d e"), (1, "a b c d e"), (None, "a b c d e"), (7, None), (8, ""), (9, "x y z")]
    kept = jaccard.keep_one_of_each(as_table(rows)).collect()
    assert sum(r.text is not None and r.text.lower() == "a b c d e" for r in kept) == 1
    assert sorted(r.doc_id for r in kept if r.text is None or r.text.lower() != "a b c d e") == [7, 8, 9]
    assert next(r.doc_id for r in kept if r.text and r.text.lower() == "a b c d e") == 1
    assert kept[0].asDict().keys() >= {"doc_id", "text", "node", "row"}


def test_one_of_each_with_null_ids_and_any_names(as_table, monkeypatch):
    from quernel.llm import common

    rows = [(None, "a b c d e", "u", "1", "2", "3", "4"), (2, "a b c d e", "v", "1", "2", "3", "4"), (2, "a b c d e", "w", "1", "2", "3", "4"), (5, "x", "y", "1", "2", "3", "4")]
    docs = as_table(rows, "doc_id long, text string, gone_id string, file string, at string, mark string, kept string", extra=False)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    out = jaccard.keep_one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.file, r.kept) for r in out.collect()) == [(2, "1", "4"), (5, "1", "4")]
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()


def test_repeated_rows_and_empty_table(spark, as_table):
    rows = [(1, "a b c d e")] * 3
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_documents(as_table(rows)).collect()] == [(1, 2, 1)] * 3
    assert jaccard.similar_documents(as_table([], name="none")).count() == 0


def test_components_of_paths(spark):
    rnd = random.Random(3)
    names = rnd.sample(range(10**6), 120)
    edges = [(names[i], names[i + 1]) for i in range(59)] + [(names[i], names[i + 1]) for i in range(60, 119)] + [(names[0], names[0])]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: min(names[:60]) if i < 60 else min(names[60:]) for i, x in enumerate(names)}


def test_prefix_size_is_exact():
    for n in range(1, 300):
        need = -(-85 * n // 100)
        assert jaccard.prefix_size(n, 85) == n - need + 1
    assert np.array_equal(jaccard.Order(np.array([5, 1], np.uint64), np.array([9, 2])).first(np.array([1, 3, 5, 8], np.uint64), 3), [3, 8, 1])


@pytest.mark.parametrize(("n", "pool"), [(1, 5), (2, 5), (30, 40), (200, 1500), (200, 60)])
def test_overlaps_of_sets(n, pool):
    rng = np.random.default_rng(n + pool)
    sets = [np.unique(rng.integers(0, pool, rng.integers(1, 30)).astype(np.uint64)) for _ in range(n)]
    found = jaccard.overlaps(sets)
    assert all(found[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(n) for j in range(n) if i != j)


@pytest.mark.parametrize("text", [b"", b" ", b"a", b" \t\n\x0b\x0c\r", b"a  b\tc\x1cd \xc2\xa0e\x85 \x00 a", b"\x08a\x0eb\x1fc ", bytes(range(256)) * 3])
def test_words_of_any_bytes(text):
    assert jaccard.words_of(text).to_pylist() == text.split()
    assert jaccard.WordHashes()(text).tolist() == [xxhash.xxh3_64_intdigest(w) for w in text.split()]


def test_sets_cost_less_than_looking_up_each_word():
    rng = np.random.default_rng(2)
    names = [f"w{x}" for x in range(20000)]
    texts = [" ".join(names[x] for x in rng.zipf(1.3, 1000) % 20000).encode() for _ in range(1000)]
    hashes, known = jaccard.WordHashes(), {w: xxhash.xxh3_64_intdigest(w) for t in texts for w in t.split()}
    start = time.process_time()
    for a in range(0, 1000, 200):
        assert len(list(jaccard.shingle_sets(texts[a : a + 200], 5, hashes))) == 200
    mine = time.process_time() - start
    start = time.process_time()
    for a in range(0, 1000, 200):
        found = b" ".join(texts[a : a + 200]).split()
        values = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
        for x in range(0, len(found), 1000):
            np.unique(values[x : x + 1000])
    assert mine < time.process_time() - start


def test_two_blocks_cost_what_their_nodes_share():
    """Two full blocks whose nodes share a passage and little else: the work must not be that of a dense product over all n-grams (2 * 10^12 steps)."""
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 1 << 60, 30, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.integers(0, 1 << 60, 226, dtype=np.uint64), passage])) for _ in range(2 * jaccard.BLOCK)]
    sets[5] = sets[1000]
    start = time.process_time()
    assert jaccard.connecting(np.arange(len(sets)), np.arange(len(sets)), sets, 80) == [(5, 1000)]
    assert time.process_time() - start < 10
