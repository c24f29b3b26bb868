"""The registered queries of the search engine: each applies an operator, or the whole engine, to the tables of a folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AspectBoost, Diversity, SearchConfig, SentimentBoost, TimeDecay
from ..functions import encode
from ..functions import text as texts
from ..operators import boolean, cells, facets, filters, fuse, index, rank, rerank, retrieve, trend, words
from ..operators.filters import Filters
from ..sources import records
from ..sources.shared import WRITTEN, exists, file_state, held, holding, shared_dir
from ..sources.tables import search_documents, table
from . import segments
from .search import SearchEngine, enriched

#: The stated queries: id, text, and the vector they ask with.
QUERIES = ((1, "rely hati license cost", 7), (2, "ouque la menttion ui", 11), (3, "license token error und", 23))
#: Questions with operators.
BOOLEAN = ((1, "license AND (version OR token) NOT apache"), (2, 'title:license OR "general public"'), (3, "licen* AND source:src3"), (4, "-license version"), (5, "sentiment:mixed AND NOT (the OR der)"))
#: Questions of common words.
COMMON = ((1, "the"), (2, "the of and"), (3, "la de +license"), (4, "und -license"))
NOW = datetime(2002, 1, 1)
BOOSTS = {"positive": 1.2, "negative": 0.8, "mixed": 1.0, "not_applicable": 1.0}
REGISTERED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    REGISTERED[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
    return f


#: Saved indexes by application and state of the tables' files: as in any use of the engine, a folder is indexed and opened once, and questions read the index.
INDEXES: dict[tuple, tuple[str, index.Index | cells.VectorCells]] = {}


def opened(spark: SparkSession, name: str, sf_dir: str, tables: tuple[str, ...], save: Callable[[str], None], load: Callable[[str], object]):
    """What is saved of a folder's tables, at the first question and when their files have changed; saved again, if the shared folder was cleared."""
    key = (spark.sparkContext.applicationId, name, sf_dir, *(file_state(spark, f"{sf_dir}/{t}.parquet") for t in tables))
    if key not in INDEXES or not exists(spark, INDEXES[key][0]):
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        save(path)
        INDEXES[key] = (path, load(path))
    return INDEXES[key][1]


def saved_index(spark: SparkSession, sf_dir: str) -> index.Index:
    tables = ("documents", "labels", "events", "orders", "embeddings")
    return opened(spark, "index", sf_dir, tables, lambda path: index.save_index(index.build_index(search_documents(spark, sf_dir)), path), lambda path: index.load_index(spark, path))


def saved_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, vector of all documents that have one: all that vector search reads of an index, so texts are neither copied nor indexed for it."""
    tables = ("documents", "labels", "events", "orders", "embeddings")
    return opened(spark, "vectors", sf_dir, tables, lambda path: index.build_index(search_documents(spark, sf_dir)).vectors.write.options(**WRITTEN).parquet(path), spark.read.parquet)


def saved_cells(spark: SparkSession, sf_dir: str) -> cells.VectorCells:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return opened(spark, "cells", sf_dir, ("embeddings",), lambda path: cells.save_cells(vectors, path), lambda path: cells.VectorCells.open(spark, path))


class Tables:
    """What queries start from, for one folder. docs: documents put together from the tables; index, engine, hits: of the saved index."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def docs(self) -> DataFrame:
        return search_documents(self.spark, self.sf_dir)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def queries(self) -> DataFrame:
        told = self.spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}, '{q}', {v}L)" for i, q, v in QUERIES) + " AS t(query_id, q, vec_id)")
        return told.join(self.table("embeddings").select("vec_id", F.col("embedding").alias("vector")), "vec_id", "left").drop("vec_id")

    @cached_property
    def index(self) -> index.Index:
        return saved_index(self.spark, self.sf_dir)

    def engine(self, **config) -> SearchEngine:
        plain = {"sentiment": SentimentBoost(), "aspect": AspectBoost(False), "decay": TimeDecay(False), "diversity": Diversity(False)}
        return SearchEngine(self.index, replace(SearchConfig(), **{**plain, **config}), NOW)

    def fused(self) -> DataFrame:
        return self.engine().candidates(self.queries, "hybrid")

    def hits(self) -> DataFrame:
        """Fused rows with their documents."""
        rows = index.with_documents(held(self.fused(), "fused", 200 * len(QUERIES)), self.index.documents, "inner")
        return rows.join(self.index.vectors, "doc_id", "left")


def rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, 6) for c in columns})


@query
def bm25_single_field(t: Tables) -> DataFrame:
    return rounded(retrieve.keyword_top(t.index, retrieve.query_terms(t.queries), 100, boosts={"text": 1.0}), "score")


@query
def bm25_dismax_title2(t: Tables) -> DataFrame:
    return rounded(t.engine().keyword(t.queries, 100), "score")


@query
def keyword_search_page(t: Tables) -> DataFrame:
    engine = t.engine()
    return formatted(engine.page(engine.search(t.queries, "keyword"), 2, 10))


@query
def knn_topk(t: Tables) -> DataFrame:
    only = replace(index.build_index(t.docs), vectors=saved_vectors(t.spark, t.sf_dir))
    return rounded(SearchEngine(only).vector(t.queries, 100), "score")


@query
def knn_approximate(t: Tables) -> DataFrame:
    """The ten nearest by cells, for every twentieth vector against all others and itself."""
    asked = t.table("embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return rounded(saved_cells(t.spark, t.sf_dir).search(asked, 10), "score")


@query
def bm25_pruned_top10(t: Tables) -> DataFrame:
    """The best ten by blocks' bounds, for questions of very common and of rare words."""
    told = t.spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}, '{q}')" for i, q in COMMON) + " AS q(query_id, q)")
    return rounded(retrieve.pruned_top(t.index, t.engine().terms(told), 10), "score")


def grown_index(spark: SparkSession, sf_dir: str) -> index.Index:
    """All documents by batches: each first with another text, then as it is, those of one language and the others apart."""

    def save(path: str) -> None:
        english = F.coalesce(F.array_contains("tools", "en"), F.lit(False))
        with holding(search_documents(spark, sf_dir), "documents") as docs:
            segments.upsert(docs.withColumn("text", F.concat("text", F.lit(" and the license"))), path, written=True)
            segments.upsert(docs.where(english), path, written=True)
            segments.upsert(docs.where(~english), path, written=True)

    return opened(spark, "grown", sf_dir, ("documents", "labels", "events", "orders", "embeddings"), save, lambda path: segments.open_index(spark, path))


@query
def bm25_after_upserts(t: Tables) -> DataFrame:
    return rounded(SearchEngine(grown_index(t.spark, t.sf_dir)).keyword(t.queries, 100), "score")


@query
def keyword_pages_after(t: Tables) -> DataFrame:
    """The third page of all that match, each page from the last row of the one before."""
    engine, last = t.engine(), None
    for _ in range(3):
        page = held(engine.keyword_page(t.queries, 50, last), "page", 50 * len(QUERIES))
        last = page.groupBy("query_id").agg(F.max_by(F.struct("score", "doc_id"), "ord").alias("x")).select("query_id", "x.*")
    return rounded(page.select("query_id", "ord", "doc_id", "score"), "score")


@query
def boolean_questions(t: Tables) -> DataFrame:
    told = t.spark.createDataFrame(list(BOOLEAN), "query_id int, q string")
    return rounded(boolean.boolean_search(t.index, told, None), "score")


@query
def stats_after_upserts(t: Tables) -> DataFrame:
    return SearchEngine(grown_index(t.spark, t.sf_dir)).stats()


@query
def trend_after_upserts(t: Tables) -> DataFrame:
    return SearchEngine(grown_index(t.spark, t.sf_dir)).corpus_trend("month")


@query
def semantic_search_threshold(t: Tables) -> DataFrame:
    engine = t.engine()
    return rounded(engine.search(t.queries, "semantic", min_similarity=0.55).rows.select("query_id", "ord", "doc_id", "score"), "score")


@query
def rrf_fuse(t: Tables) -> DataFrame:
    return rounded(t.fused(), "score", "vector_score")


@query
def rrf_explain(t: Tables) -> DataFrame:
    return t.fused().select("query_id", "doc_id", fuse.explanation().alias("explanation"))


@query
def hybrid_search(t: Tables) -> DataFrame:
    engine = t.engine(aspect=AspectBoost(), decay=TimeDecay())
    return formatted(engine.page(engine.search(t.queries), 1, 10))


@query
def hybrid_search_diverse(t: Tables) -> DataFrame:
    engine = t.engine(aspect=AspectBoost(), decay=TimeDecay(), diversity=Diversity())
    return engine.search(t.queries).rows.where("ord <= 20").select("query_id", "ord", "doc_id")


@query
def hybrid_min_similarity(t: Tables) -> DataFrame:
    return rounded(t.engine().search(t.queries, min_similarity=0.6).rows.select("query_id", "ord", "doc_id", "score", "vector_score"), "score", "vector_score")


@query
def sentiment_boost(t: Tables) -> DataFrame:
    return rounded(rerank.sentiment_boost(t.hits(), BOOSTS).select("query_id", "ord", "doc_id", "score"), "score")


@query
def aspect_detect(t: Tables) -> DataFrame:
    return t.docs.select("doc_id", F.array_join(texts.detected_aspects(F.col("text")), ",").alias("detected"))


def asked(t: Tables) -> DataFrame:
    return t.hits().join(F.broadcast(t.queries.select("query_id", texts.detected_aspects(F.col("q")).alias("detected"))), "query_id")


@query
def aspect_boost(t: Tables) -> DataFrame:
    return rounded(rerank.aspect_boost(asked(t)).select("query_id", "ord", "doc_id", "score"), "score")


@query
def near_tie_flags(t: Tables) -> DataFrame:
    return rerank.near_ties(t.fused(), 0.0002).select("query_id", "ord", "doc_id", "near_tie")


@query
def time_decay(t: Tables) -> DataFrame:
    return rounded(rerank.time_decay(t.hits(), NOW).select("query_id", "ord", "doc_id", "score", "near_tie"), "score")


@query
def mmr_order(t: Tables) -> DataFrame:
    rows = t.hits().join(F.broadcast(t.queries.select("query_id", F.col("vector").alias("query_vector"))), "query_id")
    return rerank.diversified(rows).select("query_id", "ord", "doc_id")


def _filtered(t: Tables, f: Filters) -> DataFrame:
    return filters.filtered(t.hits(), f).select("query_id", "ord", "doc_id")


@query
def filter_date_range(t: Tables) -> DataFrame:
    return _filtered(t, Filters(date_from="1996-03-01", date_to="1999-06-30"))


@query
def filter_tools_any(t: Tables) -> DataFrame:
    return _filtered(t, Filters(tools=("fr", "click")))


@query
def filter_sentiment(t: Tables) -> DataFrame:
    return _filtered(t, Filters(sentiment="positive", tools=("en", "purchase"), date_from="1995-06-01"))


@query
def filter_source_post_limit(t: Tables) -> DataFrame:
    return _filtered(t, Filters(source="src3"))


@query
def filter_subjectivity(t: Tables) -> DataFrame:
    return _filtered(t, Filters(subjectivity="opinionated"))


@query
def filter_aspect(t: Tables) -> DataFrame:
    return _filtered(t, Filters(aspect="UX"))


@query
def facet_tools(t: Tables) -> DataFrame:
    return facets.tool_facet(t.hits())


@query
def facet_sentiment(t: Tables) -> DataFrame:
    return facets.value_facet(t.hits(), "sentiment", "not_applicable")


@query
def facet_source(t: Tables) -> DataFrame:
    return facets.value_facet(t.hits(), "source", "reddit")


@query
def facet_top10_source(t: Tables) -> DataFrame:
    return facets.value_facet(t.hits(), "subreddit", None, 10)


@query
def corpus_stats(t: Tables) -> DataFrame:
    return index.corpus_stats(t.docs)


@query
def trend_day(t: Tables) -> DataFrame:
    return trend.trend(t.docs, "day")


@query
def trend_week(t: Tables) -> DataFrame:
    return trend.trend(t.docs, "week")


@query
def trend_month(t: Tables) -> DataFrame:
    return trend.trend(t.docs, "month")


@query
def trend_events_day(t: Tables) -> DataFrame:
    events = t.table("events").select(F.col("ts").alias("date"), F.col("event_type").alias("sentiment"), F.col("value").alias("upvotes"))
    return trend.trend(events, "day").select("date", "count", "avg_upvotes")


@query
def trend_hybrid_threshold(t: Tables) -> DataFrame:
    return t.engine().trend(t.queries, "month", "hybrid", min_similarity=0.55)


@query
def trend_keyword(t: Tables) -> DataFrame:
    return t.engine().trend(t.queries, "month", "keyword")


@query
def trend_aspect(t: Tables) -> DataFrame:
    return trend.trend(filters.filtered(t.docs, Filters(aspect="ux")), "month")


@query
def sentiment_share(t: Tables) -> DataFrame:
    return facets.shares(t.docs).withColumn("label", texts.named(F.col("value"), texts.SENTIMENT_LABELS))


@query
def sentiment_chart(t: Tables) -> DataFrame:
    """Shares with the labels and colours that they are shown with."""
    value = F.col("value")
    return facets.shares(t.docs).select("value", "share", texts.named(value, texts.SENTIMENT_LABELS).alias("label"), texts.named(value, texts.SENTIMENT_COLORS).alias("color"))


@query
def word_cloud_top60(t: Tables) -> DataFrame:
    page = rank.page(t.hits(), 1, 50).withColumn("similarity", F.round("vector_score", 4))
    return words.word_cloud(page)


@query
def suggest_titles(t: Tables) -> DataFrame:
    return t.engine().suggest(t.queries)


@query
def spell_candidates(t: Tables) -> DataFrame:
    asked = t.spark.sql("SELECT * FROM VALUES (1, 'licnese of cusror 12345 a:b'), (2, 'aparche verison teh'), (3, 'zzzzzzzzzz refactr und') AS q(query_id, q)")
    told = index.field_tokens(t.docs, fields=("text",)).select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return words.spelling(asked, words.known_words(told))


@query
def snippet_enrich(t: Tables) -> DataFrame:
    return t.docs.select("doc_id", texts.snippet(F.col("text")).alias("snippet"))


@query
def paginate(t: Tables) -> DataFrame:
    return rank.page(t.fused(), 3, 7).select("query_id", "ord", "doc_id")


@query
def page_counts(t: Tables) -> DataFrame:
    return rank.page_counts(t.fused(), 10)


@query
def doc_lookup(t: Tables) -> DataFrame:
    return index.lookup(t.table("documents"), 42)


@query
def match_all(t: Tables) -> DataFrame:
    return retrieve.match_all(t.docs, t.queries).select("query_id", "ord", "doc_id")


@query
def phrase_and_must_terms(t: Tables) -> DataFrame:
    """Phrases by positions: which documents a question with a phrase, a word that must stand and one that must not finds, in title or text."""
    asked = t.spark.sql("""SELECT 1 AS query_id, 'license "general public" +version -apache' AS q""")
    return t.engine().keyword(asked, None).select("doc_id")


@query
def health_counts(t: Tables) -> DataFrame:
    return index.health(t.docs, t.docs.where("vector IS NOT NULL"))


@query
def upsert_latest(t: Tables) -> DataFrame:
    old = t.table("events").select(F.col("event_id").alias("doc_id"), F.col("value").alias("score"), F.lit(0).cast("long").alias("version"))
    new = t.table("events").select(F.col("user_id").alias("doc_id"), F.col("value").alias("score"), (F.col("event_id") + 1).alias("version"))
    return records.upsert(old, records.latest(new, "doc_id", F.col("version")))


@query
def combine_text(t: Tables) -> DataFrame:
    return t.table("documents").select("doc_id", records.combined_text(F.substring_index("text", ".", 1), F.concat(F.lit("\n "), F.col("text")), F.col("source")).alias("combined"))


@query
def aspect_normalise(t: Tables) -> DataFrame:
    """An object, a list and plain text of each event."""
    raw = {"from_object": F.col("props"), "from_list": F.concat(F.lit('["'), F.col("event_type"), F.lit('", "x"]')), "from_text": F.col("event_type")}
    return t.table("events").select("event_id", *(F.array_join(records.normal_aspects(c), ",").alias(name) for name, c in raw.items()))


@query
def aspect_parse(t: Tables) -> DataFrame:
    one = F.explode(texts.parsed_aspects(F.concat("aspects", F.array(F.lit(" plain "), F.lit(""), F.lit("a:b:c")))))
    return t.docs.select("doc_id", one.alias("a")).select("doc_id", "a.name", "a.polarity")


@query
def text_norm_tokens(t: Tables) -> DataFrame:
    tokens = t.table("documents").select(F.explode(texts.plain_tokens(F.col("text"))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


@query
def index_build(t: Tables) -> DataFrame:
    built = index.build_index(t.docs)
    return built.vocabulary.join(built.stats, "field").select("term", "field", "df", "n_docs", F.round("avgdl", 6).alias("avgdl"))


@query
def tool_display_names(t: Tables) -> DataFrame:
    tools = t.docs.select(F.explode(F.concat("tools", F.array(F.lit("claude_code"), F.lit("v0")))).alias("tool")).distinct()
    return tools.select("tool", texts.named(F.col("tool"), texts.TOOL_NAMES).alias("name"))


@query
def stemmed_bm25(t: Tables) -> DataFrame:
    """Stems are looked up for distinct terms only."""
    engine = SearchEngine(index.build_index(t.docs, "english"))
    return rounded(engine.keyword(t.queries, 20), "score")


@query
def hashed_semantic_search(t: Tables) -> DataFrame:
    """Texts and questions through the default encoder."""
    documents = encode.embedded(t.table("documents").select("doc_id", "text")).select("doc_id", "vector")
    asked = encode.embedded(t.queries.select("query_id", "q"), column="q")
    return rounded(retrieve.vector_top(documents, asked, 20), "score")


def formatted(page: DataFrame) -> DataFrame:
    """Lists as text, for comparison."""
    return page.withColumns({"tools": F.array_join("tools", ","), "aspects": F.array_join(F.transform("aspects", lambda a: F.concat_ws(":", a["name"], a["polarity"])), ","), "date": F.date_format("date", "yyyy-MM-dd")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTERED)


__all__ = ["enriched", "queries"]
