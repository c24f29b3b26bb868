import random
import zlib
from collections import Counter

import numpy as np
import pytest


from quernel.llm import quality


def by_hand(part):
    """Vectors of a part's passages, byte by byte and word by word; without the hashed words."""
    out, words = [], part.split()
    for a in range(0, max(1, len(words)), quality.PASSAGE_WORDS):
        mine = words[a : a + quality.PASSAGE_WORDS]
        v = np.zeros(quality.WIDTH)
        if mine:
            # From the passage's first byte to the next one's first, white space included.
            joined = out_of(part, words, a)
            for kind, n in Counter(quality.KINDS[b] for b in joined).items():
                v[kind] = np.sqrt(n / len(joined))
            v[-6:] = [len(set(mine)) / len(mine), sum(x == y for x, y in zip(mine, mine[1:])) / len(mine), *np.log1p([np.mean([len(w) for w in mine]), np.std([len(w) for w in mine]), max(map(len, mine)), len(mine)])]
        out.append(v)
    return np.array(out)


def out_of(part, words, a):
    starts, at = [], 0
    for w in words:
        at = part.index(w, at)
        starts.append(at)
        at += len(w)
    part += b" "
    end = starts[a + quality.PASSAGE_WORDS] if a + quality.PASSAGE_WORDS < len(words) else len(part)
    return part[starts[a] : end]


def test_vectors_equal_brute_force():
    rnd = random.Random(5)
    parts = [b"", b"   \n", b"one", *(" ".join(rnd.choice(["a", "a", "Word", "é!", "12", "|", "x\ny", "\t"]) for _ in range(rnd.randrange(200))).encode() for _ in range(40))]
    got, owner = quality.encode(parts)
    stats = [*range(quality.N_KINDS), *range(quality.WIDTH - 6, quality.WIDTH)]
    for i, part in enumerate(parts):
        expected = by_hand(part)
        assert np.allclose(got[owner == i][:, stats], expected[:, stats], atol=1e-5), part
        assert np.allclose(got[owner == i], quality.encode([part])[0])


def test_gradients_equal_differences():
    rnd = np.random.default_rng(1)
    x, bag, label, weight = rnd.standard_normal((9, 6)), np.array([0, 0, 0, 1, 2, 2, 2, 2, 3]), np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 0.5])
    model = quality.QualityModel(np.zeros(6), np.ones(6))
    model.mean, model.scale = model.mean.astype(float), model.scale.astype(float)
    model.weights = {k: v.astype(float) for k, v in model.weights.items()}

    def loss():
        p = model.passages(x)
        starts = np.flatnonzero(np.diff(bag, prepend=-1))
        s = model.score(np.add.reduceat(p["e"][:, None] * p["h"], starts), np.add.reduceat(p["e"], starts))
        return -(weight * (label * np.log(s) + (1 - label) * np.log(1 - s))).mean()

    for k, g in model.gradients(x, bag, label, weight).items():
        for at in list(np.ndindex(g.shape))[:20]:
            was = model.weights[k][at]
            model.weights[k][at] = was + 1e-5
            up = loss()
            model.weights[k][at] = was - 1e-5
            down = loss()
            model.weights[k][at] = was
            assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-5), (k, at)


def good(rnd, n):
    return " ".join(rnd.choice(["the", "house", "stands", "by", "a", "river", "and", "people", "walk", "there."]) for _ in range(n))


def junk(rnd, n):
    return " ".join(rnd.choice(["$$$", "||", "BUY!!", "%%%", "XX##"]) for _ in range(n))


@pytest.fixture
def corpus(as_table):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        # Only one passage of a bad document is junk.
        parts = [good(rnd, 64) for _ in range(rnd.randrange(1, 5))]
        if bad:
            parts[rnd.randrange(len(parts))] = junk(rnd, 64)
        rows.append((i, " ".join(parts)))
        labels.append((i, int(not bad)))
    return rows, labels


def test_held_out_documents_and_the_passages_that_decide(corpus, as_table):
    rows, labels = corpus
    odd = [(None, "no id"), (9001, None), (9002, ""), (9003, " \n "), (9004, rows[1][1]), (9005, "x" * 3_000_000), (9006, (good(random.Random(1), 64) + " ") * 20_000), (1, "an id again")]
    more = [(None, 1), (5, None), (6, 1), (6, 0), (7, 1), (7, 1), (8, 3)]
    docs, marks = as_table(rows + odd), as_table(labels + more, "doc_id long, quality int", name="labels")
    out = quality.score_quality(docs, marks)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)
    by_id = {r.doc_id: r for r in got if r.doc_id != 1}
    held = [(by_id[i].predicted, y) for i, y in labels if i in by_id and by_id[i].held_out]
    assert np.mean([p == y for p, y in held]) >= 0.95
    assert by_id[9001].score == by_id[9002].score == by_id[9003].score and by_id[9004].score == [r for r in got if r.doc_id == 1 and r.n_passages == by_id[9004].n_passages][0].score
    assert by_id[9006].predicted == 1 and by_id[9006].n_passages >= 20_000
    told = quality.passage_weights(docs, marks).where("doc_id % 4 = 0 AND doc_id < 600").select("doc_id", "text", "quality.*").collect()
    sums = [sum(r.weights) for r in told]
    assert np.allclose(sums, 1)
    mixed = [r for r in told if len(r.weights) > 1]
    hits = [(["$$$" in " ".join(r.text.split()[64 * k : 64 * k + 64]) for k in range(len(r.weights))][int(np.argmax(r.weights))]) for r in mixed]
    assert np.mean(hits) > 0.8


def test_labels_are_inputs_of_no_score_and_one_value_teaches_nothing(corpus, as_table):
    rows, labels = corpus
    docs = as_table(rows)
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    told = {i for i, _ in held}
    schema = "doc_id long, quality int"
    one = quality.score_quality(docs, as_table(labels, schema, name="l1")).collect()
    two = quality.score_quality(docs, as_table([(i, 1 - y if i in told else y) for i, y in labels], schema, name="l2")).collect()
    assert sorted((r.doc_id, r.score) for r in one) == sorted((r.doc_id, r.score) for r in two)
    only = quality.score_quality(docs, as_table([(i, 1) for i, _ in labels], schema, name="l3")).select("score").distinct().collect()
    assert [r.score for r in only] == [1.0]
    assert quality.score_quality(as_table([], name="none"), as_table([], schema, name="l4")).count() == 0
    assert {r.score for r in quality.score_quality(docs, as_table([], schema, name="l5")).collect()} == {0.5}


def test_texts_are_cut_into_chunks(monkeypatch):
    monkeypatch.setattr(quality, "CHUNK", 10)
    for text in (b"", b"ab cd ef gh ij kl mn op", b"x" * 35, b"one two\nthreefourfive six"):
        parts = list(quality.chunks(text))
        assert b"".join(parts) == text and all(len(p) <= 10 for p in parts)
