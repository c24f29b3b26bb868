from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quernel.config import SearchConfig
from quernel.functions import text as texts
from quernel.operators import facets, filters, index, retrieve, trend, words
from quernel.operators.filters import Filters
from quernel.plans.search import SearchEngine

DOCUMENT = "doc_id long, title string, text string, source string, subreddit string, tools array<string>, sentiment string, subjectivity string, aspects array<string>, date timestamp, upvotes int, vector array<float>"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "Cheap editor plugin", "The editor plugin is cheap. License terms apply.", "s1", "x", ["copilot", " cursor "], "positive", "opinionated", ["cost_value:positive"], datetime(2024, 1, 3, 23), 5, [1.0, 0.0]),
        (2, "Slow editor", "editor editor crashes often", "s1", "x", ["cursor"], "negative", "opinionated", ["troubleshooting"], datetime(2024, 1, 8), None, [0.6, 0.8]),
        (3, "", "Token limits of the plugin", "s2", None, [], None, "neutral", None, None, 2, None),
        (4, "License", "license license license", "s2", "y", ["", "v0"], "mixed", "neutral", ["control:mixed"], datetime(2024, 2, 1), 1, [-1.0, 0.0]),
    ]
    return spark.createDataFrame(rows, DOCUMENT).cache()


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "editor plugin price", [1.0, 0.0]), (2, "license", None)], "query_id int, q string, vector array<float>").cache()


@pytest.fixture(scope="module")
def engine(docs):
    return SearchEngine(index.build_index(docs), now=datetime(2024, 6, 1))


def test_bm25_by_hand(spark, docs, engine):
    import math

    got = {r.doc_id: r.score for r in engine.keyword(spark.createDataFrame([(1, "editor", None)], "query_id int, q string, vector array<float>"), 10).collect()}
    idf = lambda n, df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    part = lambda boost, n, df, tf, dl, avg: boost * idf(n, df) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    title, text = (3 + 2 + 1) / 3, (8 + 4 + 5 + 3) / 4
    assert got[1] == pytest.approx(max(part(2, 3, 2, 1, 3, title), part(1, 4, 2, 1, 8, text)), abs=1e-8)
    assert got[2] == pytest.approx(max(part(2, 3, 2, 1, 2, title), part(1, 4, 2, 2, 4, text)), abs=1e-8)


def test_vector_search(engine, queries):
    assert [(r.query_id, r.doc_id, round(r.score, 6)) for r in engine.vector(queries, 10).orderBy("ord").collect()] == [(1, 1, 1.0), (1, 2, 0.8), (1, 4, 0.0)]


@pytest.mark.parametrize("block", [1, 4096])
def test_vector_search_equals_brute_force(spark, monkeypatch, block):
    import numpy as np

    monkeypatch.setattr(retrieve, "QUERY_BLOCK", block)
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(np.float32(x)) for x in rng.choice([0.5, -0.5, 0.25], 3 if i % 9 else 2)]) for i in range(300)]
    asked = [(q, rows[q][1]) for q in (3, 9, 20)]
    expected = {(q, n, i, round(s, 6)) for q, v in asked for n, (s, i) in enumerate(sorted((((1 + sum(a * b for a, b in zip(v, w, strict=True))) / 2, i) for i, w in rows if len(w) == len(v)), key=lambda x: (-x[0], x[1]))[:7], 1)}
    vectors = spark.createDataFrame([*rows, (999, None), (998, [])], "doc_id long, vector array<float>").repartition(5)
    queries = spark.createDataFrame([*asked, (99, None)], "query_id int, vector array<float>")
    got = {(r.query_id, r.ord, r.doc_id, round(r.score, 6)) for r in retrieve.vector_top(vectors, queries, 7).collect()}
    assert got == expected
    assert retrieve.vector_top(vectors, queries, None).count() == sum(len(v) == len(w) for _, v in asked for _, w in rows)


def test_search_pages_and_facets(engine, queries):
    results = engine.search(queries)
    page = engine.page(results, 1, 2).where("query_id = 1").orderBy("ord").collect()
    assert [r.doc_id for r in page] == [1, 2] and page[0].tools == ["copilot", "cursor"] and page[0].aspects[0].polarity == "positive"
    assert page[1].aspects[0].polarity is None and page[1].upvotes == 0
    tools = {(r.query_id, r.value): r["count"] for r in results.facets.where("facet = 'tools'").collect()}
    assert tools == {(1, "copilot"): 1, (1, "cursor"): 2, (1, "v0"): 1, (2, "copilot"): 1, (2, "cursor"): 1, (2, "v0"): 1}
    assert {r.query_id: (r.total_count, r.total_pages) for r in results.counts.collect()} == {1: (4, 1), 2: (2, 1)}


def test_modes_and_thresholds(engine, queries):
    assert {r.doc_id for r in engine.search(queries, min_similarity=0.7).rows.where("query_id = 1").collect()} == {1, 2}
    assert {r.doc_id for r in engine.search(queries, "semantic", min_similarity=0.9).rows.collect()} == {1}
    assert engine.page(engine.search(queries, "keyword"), 1, 10).where("similarity_score IS NOT NULL").count() == 0


def test_filters(docs):
    kept = lambda **f: sorted(r.doc_id for r in filters.filtered(docs, Filters(**f)).collect())
    assert kept(date_from="2024-01-08") == [2, 3, 4] and kept(date_to="2024-01-03") == [1, 3]
    assert kept(tools=("cursor", "v0")) == [1, 2, 4] and kept(tools=(" copilot", "")) == [1] and kept(tools=("",)) == [] and kept(sentiment="not_applicable") == [] and kept(sentiment="mixed") == [4]
    assert kept(source="s2", subjectivity="neutral") == [3, 4] and kept(aspect="COST") == [1] and kept(aspect="positive") == []
    for bad in ("2024-1-5", "05.01.2024", "2024-02-30"):
        with pytest.raises(ValueError):
            kept(date_from=bad)
    assert filters.validated(" ", "hybrid", 1, 10) and filters.validated("q", "odd", 1, 10) and filters.validated("q", "hybrid", 0, 10) and filters.validated("q", "hybrid", 1, 101) and filters.validated("q", "hybrid", 1, 10, 1.5)
    assert filters.validated("q", "hybrid", 1, 10) is None


def test_trend(docs, engine, queries):
    rows = {r.date: r for r in trend.trend(docs, "week").collect()}
    assert set(rows) == {"2024-01-01", "2024-01-08", "2024-01-29"} and rows["2024-01-08"].avg_upvotes == 0 and rows["2024-01-01"].positive == 1
    months = {r.date: r["count"] for r in trend.trend(docs, "odd").collect()}
    assert months == {"2024-01": 2, "2024-02": 1}
    assert {r.date: r["count"] for r in engine.trend(queries.where("query_id = 1"), "day", min_similarity=0.7).collect()} == {"2024-01-03": 1, "2024-01-08": 1}


def test_trends_of_unknown_and_empty_questions(spark, engine):
    asked = lambda q: spark.createDataFrame([(1, q, [1.0, 0.0])], "query_id int, q string, vector array<float>")
    assert engine.trend(asked("zzzz"), "day").count() == 0
    assert {r.date: r["count"] for r in engine.trend(asked(" "), "month").collect()} == {"2024-01": 2, "2024-02": 1}


def test_saved_index(spark, docs, queries, tmp_path):
    index.save_index(index.build_index(docs), f"{tmp_path}/index")
    engine = SearchEngine.open(spark, f"{tmp_path}/index", now=datetime(2024, 6, 1))
    again = SearchEngine(index.build_index(docs), now=datetime(2024, 6, 1))
    show = lambda e: [tuple(r) for r in e.page(e.search(queries)).orderBy("query_id", "ord").collect()]
    assert show(engine) == show(again)
    asked = spark.createDataFrame([("license",), ("zzz",)], "term string")
    posted = index.asked_buckets(asked, engine.index.postings).where("term IN ('license', 'zzz')")
    assert {r.doc_id for r in posted.collect()} == {1, 4}
    told = lambda p: sorted(tuple(map(str, r)) for r in p.select("term", "field", "doc_id", "tf", "dl", "positions").collect())
    assert told(engine.index.postings) == told(again.index.postings)
    assert sorted(map(tuple, engine.index.stats.collect())) == sorted(map(tuple, again.index.stats.collect()))
    assert engine.document(3).first().text.startswith("Token") and engine.document(99).isEmpty()
    assert {r.component: r.rows for r in engine.health().collect()} == {"documents": 4, "vectors": 3}
    assert {(r.facet, r.value): r["count"] for r in engine.stats().collect()}[("total", "documents")] == 4


def test_suggestions_and_spelling(spark, engine):
    asked = spark.createDataFrame([(1, "license", None), (2, "l", None), (3, "cusror licnese 123 ab a:b editor", None), (4, "plugin", None)], "query_id int, q string, vector array<float>")
    told = {(r.query_id, r.place): r.suggestion for r in engine.suggest(asked).collect()}
    assert told[(1, 1)] == "License" and not any(q == 2 for q, _ in told) and "Token limits of the plugin" in told.values()
    assert {(r.pos, r.correction, r.distance) for r in engine.spelling(asked.where("query_id = 3")).collect()} == {(0, "cursor", 1), (1, "license", 1)}


def test_word_cloud(spark):
    rows = spark.createDataFrame([(1, 1, "Alpha beta", "alpha alpha the 123 ab", 0.5), (1, 2, "", "beta gamma", None)], "query_id int, ord int, title string, text string, similarity double")
    got = [(r.word, r.weight, r.tier) for r in words.word_cloud(rows).orderBy("place").collect()]
    assert got == [("alpha", 5, 1), ("beta", 3, 2), ("gamma", 1, 3)]


def test_postings_tell_positions(spark):
    rows = [(1, "b a", "a b a c a"), (2, None, ""), (3, "", "c c"), (None, "x", None)]
    built = index.build_index(spark.createDataFrame(rows, "doc_id long, title string, text string").withColumn("vector", F.lit(None).cast("array<float>")))
    got = {(r.term, r.field, r.doc_id): (r.tf, r.dl, r.positions) for r in built.postings.collect()}
    assert got == {("b", "title", 1): (1, 2, [0]), ("a", "title", 1): (1, 2, [1]), ("a", "text", 1): (3, 5, [0, 2, 4]), ("b", "text", 1): (1, 5, [1]), ("c", "text", 1): (1, 5, [3]), ("c", "text", 3): (2, 2, [0, 1]), ("x", "title", None): (1, 1, [0])}
    heads = {(r.field, r.doc_id): r.n for r in built.postings.groupBy("field", "doc_id").agg(F.count_if("head").alias("n")).collect()}
    assert set(heads.values()) == {1}


@pytest.fixture(scope="module")
def random_index(spark, tmp_path_factory):
    """Documents of few words, so that phrases meet, and the same index in memory and saved."""
    import random

    rnd = random.Random(8)
    words = ["the"] * 6 + ["of"] * 3 + list("abcdefgh")
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(4))), " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60)))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, text string").withColumn("vector", F.lit(None).cast("array<float>"))
    built = index.build_index(docs)
    path = str(tmp_path_factory.mktemp("random"))
    index.save_index(built, path)
    return rows, built, index.load_index(spark, path)


def test_pruned_top_equals_the_whole(spark, random_index):
    _, built, saved = random_index
    asked = spark.createDataFrame([(1, "the"), (2, "the of"), (3, "a +b the -c"), (4, "zz"), (5, '"a b" the'), (6, "h")], "query_id int, q string")
    whole, fast = SearchEngine(built), SearchEngine(saved)
    for k in (1, 10, 200):
        told = lambda rows: sorted(tuple(r) for r in rows.select("query_id", "ord", "doc_id", "score").collect())
        expected = told(whole.keyword(asked, k))
        assert told(fast.keyword(asked, k)) == expected
        quoted = retrieve.asked_phrases(asked)
        assert told(retrieve.pruned_top(saved, fast.terms(asked), k, phrases=quoted)) == expected


def test_blocks_that_cannot_matter_are_not_read(spark, random_index):
    _, _, saved = random_index
    terms = spark.createDataFrame([(1, "h")], "query_id int, term string")
    asked = retrieve.known_terms(saved, terms, SearchConfig(), None)
    bounds = retrieve.block_bounds(saved, asked, SearchConfig()).collect()
    scores = {r.doc_id: r.score for r in retrieve.keyword_scores(saved, terms).collect()}
    blocks = {r.doc_id: r.block for r in index.unpacked(saved.blocks).where("term = 'h'").select("doc_id", "block").distinct().collect()}
    best = {}
    for doc_id, s in scores.items():
        best[blocks[doc_id]] = max(best.get(blocks[doc_id], 0), s)
    assert {r.block: r.bound >= best[r.block] - 1e-9 for r in bounds} == dict.fromkeys(best, True)
    assert sum(r.bound < max(scores.values()) for r in bounds) > 0


def test_phrases_by_positions(spark, random_index):
    import re

    rows, built, saved = random_index
    for q in ('"the of the"', '"a b" "c"', '"the the"', '"a"', '"a zz"', '"" the'):
        phrases = [re.findall("[a-z0-9]+", p) for p in re.findall('"([^"]*)"', q)]
        phrases = [p for p in phrases if p]
        stands = lambda p, *texts: any(f" {' '.join(p)} " in f" {t} " for t in texts)
        expected = {i for i, *texts in rows if all(stands(p, *texts) for p in phrases) and (phrases or any("the" in t.split() for t in texts))}
        asked = spark.createDataFrame([(1, q)], "query_id int, q string")
        for one in (built, saved):
            assert {r.doc_id for r in SearchEngine(one).keyword(asked, None).collect()} == expected, q


def test_shares_and_match_all(docs, queries):
    assert {(r.value, r.share) for r in facets.shares(docs).collect()} == {("positive", 25.0), ("negative", 25.0), ("mixed", 25.0), ("not_applicable", 25.0)}
    assert retrieve.match_all(docs, queries).count() == 8


def test_lists_of_any_length_are_numbered(spark):
    import random

    from quernel.operators import rank

    rnd = random.Random(3)
    rows = [(rnd.choice([1, 1, 1, 2, 3]), i, rnd.choice([0.5, 1.0, rnd.random()])) for i in range(2000)]
    df = spark.createDataFrame(rows, "query_id int, doc_id long, score double").repartition(7)
    expected = {}
    for q in (1, 2, 3):
        for n, (_, i) in enumerate(sorted((-s, i) for x, i, s in rows if x == q), 1):
            expected[(q, i)] = n
    assert {(r.query_id, r.doc_id): r.ord for r in rank.numbered(df, retrieve.best_first()).collect()} == expected
    got, last = [], spark.createDataFrame([], "query_id int, score double, doc_id long")
    for _ in range(3):
        page = rank.after(df.where("query_id = 1"), last, 40).orderBy("ord").collect()
        got += [r.doc_id for r in page]
        last = spark.createDataFrame([(1, page[-1].score, page[-1].doc_id)], "query_id int, score double, doc_id long")
    assert [expected[(1, i)] for i in got] == list(range(1, 121))


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "rational": "ration", "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "hopefulness": "hope", "formaliti": "formal", "triplicate": "triplic", "formative": "form", "goodness": "good", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "be": "be", "généralement": "généralement"}
    porter = texts.Porter()
    assert {w: porter.stem(w) for w in pairs} == pairs


def test_analysis(spark):
    row = spark.createDataFrame([("The dog's CATS aren't running; été 2x",)], "t string").select(texts.english_terms(F.col("t")), texts.word_tokens(F.col("t")), texts.plain_tokens(F.col("t"))).first()
    assert row[0] == ["dog", "cats", "aren't", "running", "été", "2x"]
    assert row[1] == ["the", "dog's", "cats", "aren't", "running", "été", "2x"] and row[2][:3] == ["the", "dog", "s"]
    found = spark.createDataFrame([("Build a FIX",), (None,)], "t string").select(texts.detected_aspects(F.col("t"))).collect()
    assert found[0][0] == ["integration_ux", "troubleshooting"] and found[1][0] == []


def test_config():
    c = SearchConfig.from_dict({"rrf_k": 10, "decay": {"enabled": False}})
    assert c.rrf_k == 10 and not c.decay.enabled and c.decay.rate == 0.001 and c.diversity.pool == 50 and not c.sentiment.enabled
