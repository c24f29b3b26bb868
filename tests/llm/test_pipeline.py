import hashlib
import random
import re

import pytest
import test_decontaminate
import test_jaccard
import test_mixing
import test_secrets
from quernel.llm import secrets

import corpus_pipeline

SYLLABLES = {"aa": ["ka", "ri", "mo", "tu", "el"], "bb": ["sch", "ein", "ung", "ver", "ät"]}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def folder(spark, tmp_path):
    rnd = random.Random(8)
    word = lambda lang: "".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randrange(2, 5)))
    items = [(i, " ".join(word("aa") for _ in range(14))) for i in range(3)]
    texts = []
    for i in range(90):
        lang = rnd.choice(sorted(SYLLABLES))
        w = [word(lang) for _ in range(rnd.randrange(5, 60))]
        if i % 9 == 1 and texts:
            w = texts[-1][0].split()
            w[rnd.randrange(len(w))] = word(lang)
        if i % 11 == 2:
            w += items[i % 3][1].split()[2:13]
        if i % 7 == 3:
            w.insert(3, 'token="24be64439e3e49cf46b2d7c90f3602a3d0b907ff"')
        texts.append((" ".join(w), lang))
    rows = [(i, t, lang, rnd.choice(["a", "a", "a", "b", "c", None]), len(t)) for i, (t, lang) in enumerate(texts)]
    rows += [(900, None, "aa", "a", 0), (901, "", "bb", "b", 0), (902, "123 456 !!", "aa", "a", 10), (903, rows[0][1], "aa", "b", rows[0][4])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, items


def redacted(text):
    out, at = "", 0
    for _, start, end in test_secrets.base(text):
        if start >= at:
            out += text[at:start] + "<secret>"
        at = max(at, end)
    return out + text[at:]


def brute(rows, items):
    rows = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    groups = test_jaccard.brute([(r[0], r[1]) for r in rows], 5, 80)
    rows = [r for r in rows if groups[r[0]][1] == r[0]]
    rows = [r for r in rows if not test_decontaminate.brute(r[1], items, 10)[4]]
    rows = [(i, redacted(t), lang, source) for i, t, lang, source, _ in rows]
    rows = [(i, t, lang, source, len(t)) for i, t, lang, source in rows]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    targets, out = test_mixing.fill(sizes), []
    for s in sizes:
        rate = int(targets[s] / sizes[s] * (1 << 30) // 1)
        offset = int(hashlib.md5(f"mix:{chr(0) if s is None else s}".encode()).hexdigest()[:7], 16) * 4
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (-size(r[1]), r[0]))
        for n, r in enumerate(own):
            copies = (((n + 1) * rate + offset) >> 30) - ((n * rate + offset) >> 30)
            out += [(*r, k + 1) for k in range(copies)]
    return rows, out


def test_run_equals_brute_force(spark, folder):
    path, rows, items = folder
    _, expected = brute(rows, items)
    got = corpus_pipeline.run(spark, path)
    assert set(got.columns) == {*COLUMNS, "copy"}
    assert sorted(map(str, (tuple(r) for r in got.select(*COLUMNS, "copy").collect()))) == sorted(map(str, expected))


def test_stages_keep_the_columns(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language id", "near duplicates", "decontamination", "secrets", "mixing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == COLUMNS and out.count() > 0
    assert not any(s in r.text for r in corpus_pipeline.without_secrets(spark, docs.where("text IS NOT NULL"), path).collect() for s in ("24be64439e",))
    assert secrets.KINDS[0] == "assign"


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
