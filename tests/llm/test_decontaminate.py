import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from quernel.llm import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, width):
    w = words(text)
    hit, found, longest, at = set(), set(), 0, None
    for item, t in items:
        b = words(t)
        for win in [b[i : i + width] for i in range(len(b) - width + 1)] if len(b) >= width else [b] * bool(b):
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(str(item))
        for i, j in itertools.product(range(len(w)), range(len(b))):
            n = next((k for k, (x, y) in enumerate(zip(w[i:], b[j:], strict=False)) if x != y), min(len(w) - i, len(b) - j))
            if n >= width or (n == len(b) > 0):
                longest, at = max((longest, at), (n, i), key=lambda m: (m[0], -(m[1] or 0)))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), longest, at


def data(seed):
    rnd = random.Random(seed)
    vocabulary = ["a", "B", "c", "é", "d1", "ß", "x"]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 9)))) for i in range(12)]
    items += [(12, items[5][1]), (13, None), (14, "..."), (5, "c c c c c")]
    docs = []
    for i in range(80):
        w = [rnd.choice([*vocabulary, "unknown"]) for _ in range(rnd.randrange(0, 40))]
        if rnd.random() < 0.5:
            w += (rnd.choice(items)[1] or "").upper().split()
        docs.append((i, rnd.choice([" ", ", ", "\n--"]).join(w)))
    return [*docs, (100, None), (101, ""), (102, "ÿ� a B c"), (103, "a " * 500)], items


@pytest.mark.parametrize(("seed", "width", "block"), [(1, 4, 1 << 20), (2, 3, 40), (3, 2, 1 << 20)])
def test_equal_to_brute_force(as_table, monkeypatch, seed, width, block):
    real = decontaminate.benchmark_blocks
    monkeypatch.setattr(decontaminate, "benchmark_blocks", lambda b: real(b, block))
    docs, items = data(seed)
    got = decontaminate.find_contamination(as_table(docs), as_table(items, "item_id long, text string", name="benchmark"), width).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {i: brute(t, items, width) for i, t in docs}


def test_sql_and_brute_force_agree(as_table):
    import duckdb

    docs, items = data(4)
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    docs = [(i, t) for i, t in docs if i != 102] + [(200, f"{'a b c d e ' * 4}"), (201, "x c c c c c d1 x x x " * 2)]
    items += [(20, "b c d e a b c d e a b c d e"), (21, "d e a b c d e a b c d")]
    duck.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    duck.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    got = duck.sql("SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, longest_at FROM (" + decontaminate.DECONTAMINATION_SQL + ")").fetchall()
    assert {r[0]: r[1:] for r in got} == {i: brute(t, items, 10) for i, t in docs}


def test_repeats_that_overlap_are_read_in_time():
    test = decontaminate.TestSuffixes([("x", b"0 " * 400)], 10)
    n_words, n_hit, items, longest, first = decontaminate.scan_shard([b"0 " * 500] * 2000 + [b"1 " + b"0 " * 30, b"0 " * 9], [test])
    assert n_words.tolist() == [500] * 2000 + [31, 9] and n_hit.tolist() == [500] * 2000 + [30, 0]
    assert longest.tolist() == [400] * 2000 + [30, 0] and first.tolist() == [0] * 2000 + [1, -1]


def test_deepest():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 100):
        lo = rnd.integers(0, n, 30)
        spans = np.stack([rnd.integers(1, 50, 30), lo, np.minimum(n, lo + rnd.integers(1, n + 1, 30))])
        assert decontaminate.deepest(n, spans).tolist() == [max((d for d, a, b in spans.T if a <= i < b), default=0) for i in range(n)]
    assert decontaminate.deepest(3, np.zeros((3, 0), dtype=np.int64)).tolist() == [0, 0, 0]


def test_longest_matches(as_table):
    docs = [(1, "p q r s t u"), (2, "x q r s y"), (3, "q r s t")]
    items = [(9, "a q r s t b")]
    got = decontaminate.longest_matches(as_table(docs), as_table(items, "item_id long, text string", name="benchmark"), 2).collect()
    assert sorted(map(tuple, got)) == [("9", 1, 4, 1, 1), ("9", 2, 3, 1, 2), ("9", 3, 2, 1, 3)]


def test_removal_and_empty_benchmark(as_table):
    docs = as_table([(1, "one two three four"), (2, "five"), (3, None)])
    kept = decontaminate.decontaminate(docs, as_table([(1, "TWO three")], "item_id long, text string", name="benchmark"), 10)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    none = as_table([], "item_id long, text string", name="empty")
    assert decontaminate.decontaminate(docs, none).count() == 3
    assert decontaminate.find_contamination(as_table([], name="no_docs"), none).count() == 0
