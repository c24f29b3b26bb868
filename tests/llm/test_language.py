import random

import numpy as np
import pytest

from quernel.llm import language

SYLLABLES = {"aa": ["ka", "ri", "mo", "tu"], "bb": ["sch", "ein", "öl", "ung"], "cc": ["да", "не", "ли", "ко"]}


def sentence(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def test_viterbi_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        k, lengths, switch = int(rng.integers(1, 6)), rng.integers(0, 300, 5), float(rng.choice([0.5, 2, 8]))
        scores = rng.normal(0, 3, (lengths.sum(), k)).astype(np.float32)
        labels, at = language.viterbi(scores, lengths, switch), 0
        for n in lengths:
            x, y = scores[at : at + n].astype(float), labels[at : at + n]
            at += n
            if n:
                best = x[0].copy()
                for t in range(1, n):
                    best = np.maximum(best, best.max() - switch) + x[t]
                assert abs(x[np.arange(n), y].sum() - switch * (y[1:] != y[:-1]).sum() - best.max()) < 1e-2


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    out = [(i, sentence(rnd, lang, rnd.randrange(1, 60)), lang) for i, lang in enumerate(rnd.choices(sorted(SYLLABLES), k=300))]
    return [*out, (900, None, "aa"), (901, "", "bb"), (902, "12 _ ²", "cc"), (903, "日本語 です", None), (904, sentence(rnd, "aa", 30) + " " + sentence(rnd, "cc", 20), None), (None, sentence(rnd, "bb", 9), "bb")]


def test_held_out_accuracy_and_cases(as_table, rows):
    import zlib

    got = {r.doc_id: r for r in language.identify_languages(as_table(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(b"" if i is None else str(i).encode()) % 3 == 1) for i, r in got.items())
    truth = {i: lang for i, t, lang in rows if lang and i is not None and i < 900}
    right = [got[i].lang_pred == lang for i, lang in truth.items() if got[i].held_out]
    assert len(right) > 50 and sum(right) >= 0.95 * len(right)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_pred in SYLLABLES and got[904].lang_pred == "aa" and got[904].n_spans == 2
    assert all(0 <= r.score <= 1 for r in got.values())


def test_spans(spark, as_table, rows):
    from pyspark.sql import functions as F

    df = as_table(rows, "doc_id long, text string, lang string")
    found = df.select("doc_id", language.identify(F.col("text"), language.fit(df), spark, spans=True).alias("x")).where("doc_id = 904").first().x
    assert [(s.lang, s.first_word, s.last_word) for s in found.spans] == [("aa", 0, 29), ("cc", 30, 49)]


def test_nothing_learned(as_table):
    df = as_table([(1, "some text", None), (2, None, "aa")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify_languages(df).collect()} == {"und"}
    assert language.identify_languages(as_table([], "doc_id long, text string, lang string", name="none")).count() == 0


def test_only_unidentified_go(as_table, rows):
    df = as_table(rows, "doc_id long, text string, lang string")
    kept = language.keep_identified(df)
    assert kept.columns == df.columns and {r[0] for r in rows} - {r.doc_id for r in kept.collect()} <= {900, 901, 902, 904}


def brute_query(rows):
    """The whole query with dictionaries and the plain quadratic Viterbi."""
    import math
    import zlib

    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1 for i, _, _ in rows}
    grams = lambda w: [int(h) for part in language.features([w])[0] for h in part]
    labelled = [(t, x) for i, t, x in rows if not held[i] and t is not None and x is not None]
    names = sorted({x for _, x in labelled})
    counts, scripts = {x: {} for x in names}, {x: {} for x in names}
    for t, x in labelled:
        for w in language.words_of(t):
            for g in grams(w):
                counts[x][g] = counts[x].get(g, 0) + 1
            s = language.script(w)
            scripts[x][s] = scripts[x].get(s, 0) + 1
    size = 1 << language.FEATURE_BITS
    total = {x: math.log(sum(counts[x].values()) + language.SMOOTH * size) for x in names}
    out = []
    for i, t, _ in rows:
        words = language.words_of(t)
        if not words:
            out.append((i, held[i], "und", 0.0))
            continue
        scores = []
        for w in words:
            uses = [x for x in names if scripts[x].get(language.script(w), 0) >= language.USES * sum(scripts[x].values())] or names
            raw = {x: language.TEMPER * sum(math.log(counts[x].get(g, 0) + language.SMOOTH) - total[x] for g in grams(w)) for x in uses}
            scores.append({x: raw[x] - max(raw.values()) if x in raw else -language.FOREIGN for x in names})
        value, back = dict(scores[0]), []
        for s in scores[1:]:
            best = max(names, key=lambda x: (value[x], -names.index(x)))
            back.append({x: best if value[best] - language.SWITCH > value[x] else x for x in names})
            value = {x: max(value[x], value[best] - language.SWITCH) + s[x] for x in names}
        label = max(names, key=lambda x: (value[x], -names.index(x)))
        labels = [label]
        for b in reversed(back):
            labels.append(label := b[label])
        votes = {x: labels.count(x) for x in names}
        win = max(names, key=lambda x: (votes[x], -names.index(x)))
        out.append((i, held[i], win, round(votes[win] / len(words), 6)))
    return out


def test_query_equals_brute_force(as_table, rows):
    docs = as_table(rows, "doc_id long, text string, lang string")
    got = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in language.identify_languages(docs).collect()]
    assert sorted(got, key=str) == sorted(brute_query(rows), key=str)
