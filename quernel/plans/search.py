"""The search engine: hybrid search from retrieval to pages, trends, suggestions, statistics, look-ups."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..functions.encode import Encoder, embedded
from ..functions.text import detected_aspects, parsed_aspects, snippet
from ..operators import boolean, facets, filters, fuse, index, rank, rerank, retrieve, trend, words
from ..operators.filters import Filters
from ..operators.index import Index
from ..sources.shared import held, stated
from . import segments

#: Columns of a document that results and filters use. Texts and vectors join in for the few rows that need them.
LIGHT = ("doc_id", "source", "subreddit", "tools", "sentiment", "subjectivity", "aspects", "date", "upvotes", "url", "content_type")


@dataclass
class Results:
    """rows: all candidates that passed, in order. pages come from it. most: a bound of their number, if the questions are few. Facets and counts are made when they are asked for."""

    rows: DataFrame
    mode: str
    page_size: int
    most: int | None = None

    @cached_property
    def facets(self) -> DataFrame:
        told = facets.tool_facet(self.rows).withColumn("facet", F.lit("tools"))
        for name, column, missing, most in (("sentiment", "sentiment", "not_applicable", None), ("source", "source", "reddit", None), ("subreddits", "subreddit", None, 10)):
            told = told.unionByName(facets.value_facet(self.rows, column, missing, most).withColumn("facet", F.lit(name)))
        return told

    @cached_property
    def counts(self) -> DataFrame:
        return rank.page_counts(self.rows, self.page_size)


@dataclass
class Answer:
    """A page of results of one question, its facets and counts, and the question with its spelling corrected (no row if nothing is to correct)."""

    page: DataFrame
    facets: DataFrame
    counts: DataFrame
    spelling: DataFrame


@dataclass
class Trend:
    """points: see trend.trend(). totals: total_results (undated documents too) and a message if nothing was found."""

    points: DataFrame
    totals: DataFrame


NO_MATCH = "No documents match these words. Try another search term."


class SearchEngine:
    """Answers tables of queries (query_id, q, vector) in one job each. Queries without a column vector get theirs from the encoder."""

    def __init__(self, index_: Index, config: SearchConfig = SearchConfig(), now: datetime | None = None, encoder: Encoder | None = None):
        self.index, self.config, self.now, self.encoder = index_, config, now or datetime.now(), encoder

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> SearchEngine:
        """The index that save_index() or segments.upsert() has put at the path."""
        return cls(segments.open_index(spark, path) if segments.manifest(spark, path) else index.load_index(spark, path), **options)

    def asked(self, questions: DataFrame) -> DataFrame:
        """Questions (query_id, q) with the vectors that this engine's encoder gives them."""
        return questions if "vector" in questions.columns else embedded(questions, self.encoder, "q")

    def terms(self, queries: DataFrame) -> DataFrame:
        """query_id, term, must, banned, as the index's analyzer has terms."""
        told = retrieve.asked_terms(queries, index.ANALYZERS[self.index.analyzer])
        if self.index.analyzer == "plain":
            return told
        return index.stemmed(told, self.index.analyzer).groupBy("query_id", "term").agg(F.bool_or("must").alias("must"), F.bool_or("banned").alias("banned"))

    def keyword(self, queries: DataFrame, k: int | None) -> DataFrame:
        """The best k, or, without k, all that match, in no order."""
        terms, quoted = stated(self.terms(queries))[0], stated(retrieve.asked_phrases(queries, self.index.analyzer))[0]
        quoted, found = None if quoted.isEmpty() else quoted, index.of_asked(self.index, terms)
        if k is not None:
            return retrieve.keyword_top(found, terms, k, self.config, phrases=quoted)
        scores = retrieve.keyword_scores(found, terms, self.config)
        return scores if quoted is None else retrieve.with_phrases(scores, found, quoted)

    def boolean(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """The best documents for questions with AND, OR, NOT, groups, fields and open endings (see operators.boolean)."""
        return boolean.boolean_search(self.index, queries, k or self.config.keyword_rows, self.config)

    def keyword_page(self, queries: DataFrame, size: int, last: DataFrame | None = None) -> DataFrame:
        """The next page of all that match, after the last row (query_id, score, doc_id) of the page before; lists are as long as they are, not cut at keyword_rows."""
        if last is None:
            return self.keyword(queries, size)
        return rank.after(self.keyword(queries, None), last, size)

    def vector(self, queries: DataFrame, k: int | None) -> DataFrame:
        asked = queries.where("vector IS NOT NULL").select("query_id", "vector")
        if k is not None and self.config.vector_probes and self.index.cells is not None:
            return self.index.cells.search(asked, k, self.config.vector_probes)
        return retrieve.vector_top(self.index.vectors, asked, k)

    def candidates(self, queries: DataFrame, mode: str) -> DataFrame:
        """query_id, ord, doc_id, score, keyword_rank, vector_rank, vector_score."""
        c, queries = self.config, self.asked(queries)
        none = lambda kind: F.lit(None).cast(kind)
        if mode == "keyword":
            return self.keyword(queries, c.keyword_rows).withColumns({"keyword_rank": F.col("ord"), "vector_rank": none("int"), "vector_score": none("double")})
        if mode == "semantic":
            return self.vector(queries, c.vector_rows).withColumns({"keyword_rank": none("int"), "vector_rank": F.col("ord"), "vector_score": F.col("score")})
        return fuse.fuse(self.keyword(queries, c.keyword_rows), self.vector(queries, c.vector_rows), c.rrf_k)

    def search(self, queries: DataFrame, mode: str = "hybrid", f: Filters = Filters(), sentiment: bool = False, aspects: bool = True, min_similarity: float = 0.0) -> Results:
        """The stages in their fixed order: threshold, sentiment, aspects, time decay, filters, diversity, facets.

        The candidates, at most some hundreds for each query, are held: what follows reads them, and of the documents only theirs.
        """
        if wrong := filters.validated("any", mode, 1, 1, min_similarity):
            raise ValueError(wrong)
        c = self.config
        queries, told = stated(self.asked(queries))
        most = None if told is None else len(told) * {"keyword": c.keyword_rows, "semantic": c.vector_rows}.get(mode, c.keyword_rows + c.vector_rows)
        rows = rerank.similarity_threshold(held(self.candidates(queries, mode), "candidates", most), min_similarity, mode)
        rows = rank.ranked(rows.withColumn("was", F.col("ord")), [F.col("was")]).drop("was")
        rows = index.with_documents(rows, self.index.documents.select(*(x for x in LIGHT if x in self.index.documents.columns)))
        rows = rows.join(F.broadcast(queries.select("query_id", detected_aspects(F.col("q")).alias("detected"), F.col("vector").alias("query_vector"))), "query_id")
        if sentiment and c.sentiment.enabled:
            rows = rerank.sentiment_boost(rows, c.sentiment.factors)
        if aspects and c.aspect.enabled:
            rows = rerank.aspect_boost(rows, c.aspect.factor)
        if c.decay.enabled:
            rows = rerank.time_decay(rows, self.now, c.decay.rate, c.decay.threshold)
        rows = filters.filtered(rows, f)
        rows = rank.ranked(rows.withColumn("was", F.col("ord")), [F.col("was")]).drop("was")
        if c.diversity.enabled:
            rows = held(index.with_documents(held(rows, "rows", most), self.index.vectors), "pool", most)
            rows = rerank.diversified(rows, c.diversity.weight, c.diversity.pool).drop("vector")
        rows = held(rows.drop("query_vector", "detected", "near_tie"), "results", most)
        return Results(rows, mode, c.page_size, most)

    def page(self, results: Results, number: int = 1, size: int | None = None) -> DataFrame:
        """Formatted results of a page; titles and texts are read for its rows only."""
        if wrong := filters.validated("any", results.mode, number, size or self.config.page_size, max_page_size=self.config.max_page_size):
            raise ValueError(wrong)
        rows = held(rank.page(results.rows, number, size or self.config.page_size), "page", results.most)
        return enriched(index.with_documents(rows, self.index.documents.select("doc_id", "title", "text"), "inner"), results.mode)

    def answer(self, q: str, vector: list[float] | None = None, mode: str = "hybrid", page: int = 1, page_size: int | None = None, min_similarity: float = 0.0, **options) -> Answer:
        """One question, as a request: checked, searched, with a hint on its spelling."""
        size = min(page_size or self.config.page_size, self.config.max_page_size)
        if wrong := filters.validated(q, mode, page, size, min_similarity, self.config.max_page_size):
            raise ValueError(wrong)
        spark = self.index.documents.sparkSession
        asked = spark.createDataFrame([(1, q)], "query_id int, q string") if vector is None else spark.createDataFrame([(1, q, vector)], "query_id int, q string, vector array<float>")
        found = self.search(asked, mode, min_similarity=min_similarity, **options)
        return Answer(self.page(found, page, size), found.facets, rank.page_counts(found.rows, size), words.corrected(asked, self.spelling(asked)))

    def answered(self, queries: DataFrame) -> DataFrame:
        """query_id of the queries of which the index has any term; filters play no part."""
        terms = stated(self.terms(queries).where("NOT banned"))[0]
        known = index.asked_buckets(terms, self.index.vocabulary).select("term")
        return known.join(F.broadcast(terms), "term").select("query_id").distinct()

    def found(self, queries: DataFrame, mode: str | None = None, min_similarity: float | None = None) -> DataFrame:
        """query_id, doc_id of all that the queries find, in no order; nothing is ranked that a threshold decides.

        Queries without text find every document. The others find none, if no document has a term of theirs. Without a mode, they are
        hybrid. Boosts, decay and diversity only reorder, so they are left out.
        """
        least = self.config.trend_min_similarity if min_similarity is None else min(max(min_similarity, 0.0), 1.0)
        queries = self.asked(queries)
        worded = queries.where(F.trim("q") != "")
        if mode == "keyword":
            rows = self.keyword(worded, None).select("query_id", "doc_id")
        else:
            near = retrieve.vector_scores(self.index.vectors, worded.where("vector IS NOT NULL").select("query_id", "vector"))
            rows = near.where(F.col("score") >= least).select("query_id", "doc_id")
            if least <= 0:
                rows = rows.unionByName(self.keyword(worded, self.config.keyword_rows).select("query_id", "doc_id")).distinct()
        rows = rows.join(self.answered(worded), "query_id", "left_semi")
        return rows.unionByName(retrieve.every_document(self.index.documents, queries.where(F.trim("q") == "")))

    def trend_of(self, queries: DataFrame, granularity: str = "month", mode: str | None = None, f: Filters = Filters(), min_similarity: float | None = None) -> Trend:
        """Trend of all rows that the queries find, taken together, and how many these are."""
        rows = filters.filtered(self.found(queries, mode, min_similarity).join(self.index.documents.select(*(c for c in LIGHT if c in self.index.documents.columns)), "doc_id"), f)
        n = F.col("total_results")
        return Trend(trend.trend(rows, granularity), rows.agg(F.count("*").alias("total_results")).select(n, F.when(n == 0, NO_MATCH).alias("message")))

    def trend(self, queries: DataFrame, granularity: str = "month", mode: str | None = None, f: Filters = Filters(), min_similarity: float | None = None) -> DataFrame:
        return self.trend_of(queries, granularity, mode, f, min_similarity).points

    def suggest(self, queries: DataFrame, most: int = 8) -> DataFrame:
        asked, told = stated(queries.select("query_id", "q").where(F.length(F.trim("q")) >= 2))
        rows = held(self.keyword(asked, most), "suggested", None if told is None else len(told) * most)
        return words.suggestions(index.with_documents(rows, self.index.documents.select("doc_id", "title", "text"), "inner"), most)

    def spelling(self, queries: DataFrame) -> DataFrame:
        """Of a saved index only the buckets of the tokens and of their parts are read."""
        asked = words.asked_tokens(stated(queries.select("query_id", "q"))[0])
        known = words.known_words(index.asked_buckets(asked, self.index.vocabulary, "word").groupBy("term").agg(F.max("df").alias("n")))
        if self.index.nearby is None:
            return words.spelling(queries, known)
        parts = asked.select(F.explode(words.probes_of(F.col("word"))).alias("key"))
        near = index.asked_buckets(parts, self.index.nearby, "key").select("key", "word", "n")
        return words.spelling(queries, known, words.with_domain(near))

    def stats(self) -> DataFrame:
        return index.corpus_stats(self.index.documents) if self.index.values is None else index.stored_stats(self.index.values)

    def corpus_trend(self, granularity: str = "month") -> DataFrame:
        """The trend of all documents; that of a saved index is a sum of what its batches have added and taken back."""
        return trend.trend(self.index.documents, granularity) if self.index.days is None else trend.stored_trend(self.index.days, granularity)

    def health(self) -> DataFrame:
        return index.health(self.index.documents, self.index.vectors)

    def document(self, doc_id) -> DataFrame:
        return index.lookup(self.index.documents, doc_id)


def enriched(rows: DataFrame, mode: str) -> DataFrame:
    """Result rows as shown: rounded scores, snippet, parsed aspects, defaults for what is missing."""
    extra = [F.coalesce(c, F.lit("")).alias(c) for c in ("url", "content_type") if c in rows.columns]
    if "content_type" in rows.columns:
        extra.append(shown_title(F.col("title"), F.col("content_type")).alias("shown_title"))
    similarity = {"semantic": F.round("score", 4), "hybrid": F.round(F.coalesce("vector_score", F.lit(0.0)), 4)}.get(mode, F.lit(None).cast("double"))
    return rows.select(
        "query_id",
        "ord",
        "doc_id",
        F.round("score", 4).alias("score"),
        similarity.alias("similarity_score"),
        "keyword_rank",
        "vector_rank",
        F.coalesce("title", F.lit("")).alias("title"),
        snippet(F.col("text")).alias("snippet"),
        F.coalesce("source", F.lit("reddit")).alias("source"),
        "date",
        F.coalesce("sentiment", F.lit("not_applicable")).alias("sentiment"),
        F.filter(F.transform(F.coalesce("tools", F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "").alias("tools"),
        parsed_aspects(F.col("aspects")).alias("aspects"),
        F.coalesce("subreddit", F.lit("")).alias("subreddit"),
        F.coalesce("upvotes", F.lit(0)).alias("upvotes"),
        *extra,
    )


def shown_title(title: Column, content_type: Column) -> Column:
    """The title as displayed: one for its kind where there is none."""
    return F.coalesce(F.nullif(title, F.lit("")), F.when(content_type == "comment", "Reddit Comment").otherwise("Reddit Post"))
