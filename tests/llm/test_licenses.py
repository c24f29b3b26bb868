import random
import re

from quernel.llm import licenses


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for label, phrase in licenses.BASE:
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_places_equal_plain_search(as_table):
    rnd = random.Random(2)
    parts = ["under", "the", "MIT", "license", "Apache", "License,", "version", "2.0", "cc", "BY-NC", "by", "nc", "é", "licenſe", "liKense", "under the MIT-License", "cc-by-nc cc by nc"]
    rows = list(enumerate([None, "", " . ", *(" ".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 25))) for _ in range(300)), "cc by " * 3000 + "nc"]))
    got = {r.doc_id: r for r in licenses.scan_licenses(as_table(rows)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text), text
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_long_templates_bear_changes(as_table):
    bsd = dict((label, text) for label, text in licenses.TEMPLATES if label == "bsd")["bsd"]
    w = bsd.split()
    rows = [(1, "x " * 20 + bsd), (2, " ".join(w[:8] + ["really"] + w[8:])), (3, " ".join(w[:6])), (4, "GNU General Public License, version 3."), (5, "gnu lesser general public license"), (5, "nothing")]
    got = {(r.doc_id, r.labels, r.score == 1) for r in licenses.scan_licenses(as_table(rows)).collect()}
    assert got == {(1, "bsd", True), (2, "bsd", False), (3, "", False), (4, "gpl,gpl-3", True), (5, "lgpl", True), (5, "", False)}


def test_templates_of_any_length(as_table):
    long = " ".join(f"w{i}" for i in range(500))
    wordings = (("long", long), ("it's", "One, two; three's 4"))
    w = long.split()
    rows = [(1, long), (2, " ".join(w[:200] + ["more"] + w[200:])), (3, " ".join(w[:300])), (4, " ".join(w[:340] + ["x"] * 600 + w[340:])), (5, " ".join(w[:360])), (6, "one two three s 4"), (7, " ".join(w[:250] * 2))]
    got = {r.doc_id: (r.labels, round(r.score, 3)) for r in licenses.scan_licenses(as_table(rows), wordings).collect()}
    assert got == {1: ("long", 1.0), 2: ("long", round(496 / 498, 3)), 3: ("", 0.0), 4: ("", 0.0), 5: ("long", round(358 / 498, 3)), 6: ("it's", 1.0), 7: ("", 0.0)}


def test_whole_texts_count_as_their_licence(as_table):
    rows = [(i, f"Copyright (c) 2020 {i}. " + text.upper() + " End.") for i, (_, text) in enumerate(licenses.TEMPLATES)]
    got = {r.doc_id: r for r in licenses.scan_licenses(as_table(rows)).collect()}
    for i, (label, _) in enumerate(licenses.TEMPLATES):
        assert label in got[i].labels.split(",") and got[i].score == 1


def test_no_python_in_the_plan(as_table, capsys):
    df = licenses.scan_licenses(as_table([(1, "x")]))
    df.explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out.replace("PythonUDF", "Python"))
    assert licenses.scan_licenses(as_table([], name="none")).count() == 0
