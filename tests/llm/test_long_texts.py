"""Texts far longer than what is held at once give what short pieces would: bounds are lowered, so that every path cuts."""

import random

import numpy as np
import pytest

from quernel.llm import common, decontaminate, frequency, jaccard, ppm


@pytest.fixture
def tiny(monkeypatch):
    monkeypatch.setattr(common, "PIECE_BYTES", 7)
    monkeypatch.setattr(ppm, "SHARD_BYTES", 5)
    monkeypatch.setattr(ppm, "HELD", 11)


def texts():
    rnd = random.Random(2)
    return [b"", b"x" * 50, *(b" ".join(rnd.choice([b"ab", b"c" * 9, b"d\n", b"e"]) for _ in range(rnd.randrange(40))) for _ in range(30))]


def test_pieces_keep_words(tiny):
    for t in texts():
        cut = list(common.pieces(t))
        assert b"".join(cut) == t and [w for p in cut for w in p.split()] == t.split()


def test_windows_in_shards(tiny):
    raw = texts()
    got = [list(zip(np.repeat(of, n), keys, strict=True)) for keys, n, of in ppm.shards(raw)]
    keys, n = ppm.windows(raw)
    assert [x for part in got for x in part] == list(zip(np.repeat(np.arange(len(raw)), n), keys, strict=True)) and len(got) > len(raw)


def test_counts_of_windows(tiny, as_table, monkeypatch):
    from collections import Counter

    monkeypatch.setattr(ppm, "MERGED", 20)
    raw = [t.decode() for t in texts()]
    docs = as_table(list(enumerate(raw)))
    got = {r.key: (r.n, r.seen) for r in ppm.count_windows(docs.selectExpr("CAST(text AS BINARY)", "doc_id % 3 > 0")).collect()}
    seen, n = Counter(), Counter()
    for i, t in enumerate(raw):
        keys = ppm.windows([t.encode()])[0].astype(np.int64).tolist()
        seen.update(keys)
        n.update(keys if i % 3 else [])
    assert got == {k: (n[k], c) for k, c in seen.items()}


def test_sets_and_suffixes(monkeypatch):
    raw = texts()
    whole = [s.tolist() for s in jaccard.shingle_sets(raw, 3, jaccard.WordHashes())]
    test = decontaminate.TestSuffixes([("1", b"ab e ab"), ("2", raw[7][:40])], 3)
    hits = decontaminate.scan_shard(raw, [test])
    monkeypatch.setattr(common, "PIECE_BYTES", 7)
    assert [s.tolist() for s in jaccard.shingle_sets(raw, 3, jaccard.WordHashes())] == whole
    again = decontaminate.scan_shard(raw, [test])
    assert hits[0].tolist() == again[0].tolist() and hits[1].tolist() == again[1].tolist() and hits[2] == again[2]


def test_a_text_of_megabytes(as_table):
    rows = [(1, "word " * 2_000_000), (2, "short text")]
    docs = as_table(rows)
    scores = {r.doc_id: (r.n_tokens, r.score) for r in ppm.score_texts(docs).collect()}
    assert scores[1][0] == 2_000_001 and scores[1][1] < 0
    assert {r.doc_id: r.n_shingles for r in jaccard.similar_documents(docs).collect()} == {1: 1, 2: 1}
    assert frequency.HOT_LENGTH == 64
