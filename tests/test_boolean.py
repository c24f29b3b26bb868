"""Questions with operators, against the same conditions in plain Python."""

import re

import pytest

from quernel.operators import index
from quernel.operators.boolean import boolean_search, parsed

DOCS = [
    (1, "Alpha plan", "alpha beta gamma", "S1"),
    (2, "Beta", "beta delta beta", "s2"),
    (3, "", "gamma delta alphabet", None),
    (4, None, "alpha delta", "s1"),
    (5, "Gamma ray", "the gamma ray of alpha beta", "s2"),
    (6, "none", "", "s1"),
]
words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
has = lambda d, w: w in words(d[1]) or w in words(d[2])
begins = lambda d, p: any(w.startswith(p) for w in words(d[1]) + words(d[2]))
row = lambda d, p: any(f" {p} " in f" {' '.join(words(t))} " for t in d[1:3])
CASES = [
    ("alpha", lambda d: has(d, "alpha")),
    ("alpha beta", lambda d: has(d, "alpha") or has(d, "beta")),
    ("alpha AND beta", lambda d: has(d, "alpha") and has(d, "beta")),
    ("alpha beta AND delta", lambda d: has(d, "alpha") or has(d, "beta") and has(d, "delta")),
    ("(alpha OR delta) AND NOT beta", lambda d: (has(d, "alpha") or has(d, "delta")) and not has(d, "beta")),
    ("alpha AND -gamma", lambda d: has(d, "alpha") and not has(d, "gamma")),
    ("NOT (alpha AND NOT beta) AND delta", lambda d: not (has(d, "alpha") and not has(d, "beta")) and has(d, "delta")),
    ("alpha -beta delta", lambda d: (has(d, "alpha") or has(d, "delta")) and not has(d, "beta")),
    ("-alpha delta", lambda d: has(d, "delta") and not has(d, "alpha")),
    ("alpha NOT (beta OR gamma)", lambda d: has(d, "alpha") and not (has(d, "beta") or has(d, "gamma"))),
    ("alpha OR NOT beta", lambda d: has(d, "alpha")),
    ("alpha*", lambda d: begins(d, "alpha")),
    ('"alpha beta" OR title:beta', lambda d: row(d, "alpha beta") or "beta" in words(d[1])),
    ('title:"gamma ray" AND text:gamma', lambda d: "gamma ray" in " ".join(words(d[1])) and "gamma" in words(d[2])),
    ("source:s1 AND alpha", lambda d: (d[3] or "").lower() == "s1" and has(d, "alpha")),
    ("text:gam* AND NOT source:s2", lambda d: any(w.startswith("gam") for w in words(d[2])) and d[3] != "s2"),
    ("alpha-beta", lambda d: row(d, "alpha beta")),
    (")alpha AND (", lambda d: has(d, "alpha")),
    ("AND OR )(", lambda d: False),
    ("NOT alpha", lambda d: False),
    ("", lambda d: False),
    (None, lambda d: False),
    ("zzz AND alpha", lambda d: False),
]


@pytest.fixture(scope="module", params=["memory", "saved"])
def built(spark, request, tmp_path_factory):
    docs = spark.createDataFrame(DOCS, "doc_id long, title string, text string, source string").selectExpr("*", "CAST(NULL AS array<float>) AS vector")
    made = index.build_index(docs)
    if request.param == "memory":
        return made
    path = str(tmp_path_factory.mktemp("boolean"))
    index.save_index(made, path)
    return index.load_index(spark, path)


def test_questions_find_what_they_say(spark, built):
    asked = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(CASES)], "query_id int, q string")
    got = {}
    for r in boolean_search(built, asked).collect():
        got.setdefault(r.query_id, set()).add(r.doc_id)
    for i, (q, holds) in enumerate(CASES):
        assert got.get(i, set()) == {d[0] for d in DOCS if holds(d)}, q
    best = boolean_search(built, spark.createDataFrame([(1, "alpha AND beta"), (2, "source:s1")], "query_id int, q string"), 1).orderBy("query_id").collect()
    assert best[0].doc_id == 1 and best[0].score > 0 and (best[1].doc_id, best[1].score) == (1, 0.0)


def test_programs_are_well_formed():
    import random

    rnd = random.Random(1)
    for _ in range(2000):
        q = " ".join(rnd.choice(["a", "b*", "AND", "OR", "NOT", "(", ")", "-c", '"d e"', "title:f", "x:", ":", "-"]) for _ in range(rnd.randrange(9)))
        depth = 0
        for s in parsed(q):
            depth += {"leaf": 1, "not": 0}.get(s["op"], -1)
            assert depth >= 1
        assert depth == bool(parsed(q)), q
