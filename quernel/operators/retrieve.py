"""Retrieval: BM25 over several fields, vector search, match-all. All take a table of queries and answer them in one job."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..functions.text import plain_tokens
from ..sources.shared import held, stated
from .index import ANALYZERS, BLOCK, Index, asked_buckets, in_buckets, stemmed, term_bucket, unpacked
from .rank import numbered, top

#: Scores are compared after rounding to so many digits, as sums of floats depend on their order.
DIGITS = 9
#: Questions in one broadcast block of vector search.
QUERY_BLOCK = 4096


def best_first() -> list[Column]:
    return [F.col("score").desc(), F.col("doc_id")]


def query_terms(queries: DataFrame, tokens=plain_tokens) -> DataFrame:
    """query_id, term: the distinct terms of the queries (query_id, q), but for those that must not stand."""
    return asked_terms(queries, tokens).where("NOT banned").select("query_id", "term")


def asked_terms(queries: DataFrame, tokens=plain_tokens) -> DataFrame:
    """query_id, term, must, banned of queries (query_id, q) of plain words (any will do), +must, -not and "phrases", whose words must all stand (see with_phrases())."""
    quoted = F.regexp_extract_all("q", F.lit('"([^"]*)"'), 1)
    words = F.split(F.trim(F.regexp_replace("q", '"[^"]*"', " ")), r"\s+")
    part = lambda text, must, banned: F.struct(tokens(text).alias("terms"), must.alias("must"), banned.alias("banned"))
    parts = F.concat(F.transform(quoted, lambda p: part(p, F.lit(True), F.lit(False))), F.transform(words, lambda w: part(w, w.startswith("+"), w.startswith("-"))))
    each = queries.where(F.col("q").isNotNull()).select("query_id", F.explode(parts).alias("p")).select("query_id", F.explode("p.terms").alias("term"), "p.must", "p.banned")
    return each.groupBy("query_id", "term").agg(F.bool_or("must").alias("must"), F.bool_or("banned").alias("banned"))


def asked_phrases(queries: DataFrame, analyzer: str = "plain") -> DataFrame:
    """query_id, phrase, j, term, words: the words of each "phrase" of the queries (query_id, q), as the analyzer has them, with their places and their number."""
    told = queries.where(F.col("q").isNotNull()).select("query_id", F.posexplode(F.regexp_extract_all("q", F.lit('"([^"]*)"'), 1)).alias("phrase", "text"))
    tokens = told.select("query_id", "phrase", ANALYZERS[analyzer](F.col("text")).alias("tokens")).withColumn("words", F.size("tokens"))
    return stemmed(tokens.select("query_id", "phrase", "words", F.posexplode("tokens").alias("j", "term")), analyzer)


def phrase_documents(index: Index, asked: DataFrame) -> DataFrame:
    """query_id, doc_id, had: how many of its query's phrases (see asked_phrases(); a few rows) stand in one of its fields, or in the field that a column `only` names.

    A phrase stands where its words' positions, each less the word's place in the phrase, have one in common. No text is read.
    """
    if index.blocks is None:
        rows = index.postings.join(F.broadcast(asked), "term")
    else:
        met = asked_buckets(asked, index.blocks).select("segment", "term", "field", "doc_ids", "tfs", "dls", "positions").join(F.broadcast(asked), "term")
        rows = index.live(unpacked(met, "positions"))
    if "only" in asked.columns:
        rows = rows.where("only IS NULL OR only = field")
    shifted = rows.select("query_id", "phrase", "words", "field", "doc_id", F.transform("positions", lambda p: p - F.col("j")).alias("starts"))
    met = shifted.groupBy("query_id", "phrase", "words", "field", "doc_id").agg(F.collect_list("starts").alias("s")).where(F.size("s") == F.col("words"))
    stands = F.size(F.aggregate(F.slice("s", 2, F.size("s")), F.get("s", F.lit(0)), F.array_intersect)) > 0
    return met.where(stands).select("query_id", "phrase", "doc_id").distinct().groupBy("query_id", "doc_id").agg(F.count("*").alias("had"))


def with_phrases(scores: DataFrame, index: Index, asked: DataFrame) -> DataFrame:
    """scores (query_id, doc_id, ...) of documents in which all phrases of their query stand. asked: see asked_phrases()."""
    needed = asked.groupBy("query_id").agg(F.count_distinct("phrase").alias("needed"))
    told = scores.join(F.broadcast(needed), "query_id", "left").join(phrase_documents(index, asked), ["query_id", "doc_id"], "left")
    return told.where(F.col("needed").isNull() | (F.col("needed") == F.col("had"))).select(*scores.columns)


#: Asked terms whose statistics are broadcast at most; more of them are joined by shuffle.
BROADCAST_TERMS = 1 << 17
#: Postings of asked terms from which on a top-k looks at the blocks' bounds first; below, that costs more than it saves.
PRUNE_FROM = 1_000_000


@dataclass
class Asked:
    """Asked terms as an index knows them. known: query_id, term, field, must, banned, avgdl, weight; needed: query_id, needed (terms that must stand). postings: how many there are, or None, if the terms are many."""

    known: DataFrame
    needed: DataFrame
    buckets: list[int]
    small: Callable[[DataFrame], DataFrame]
    postings: int | None


def known_terms(index: Index, terms: DataFrame, config: SearchConfig, boosts: dict[str, float] | None) -> Asked:
    """terms: query_id, term, or with must, banned too. Only buckets of asked terms are read. A few terms become literal rows."""
    if "must" not in terms.columns:
        terms = terms.select("query_id", "term", F.lit(False).alias("must"), F.lit(False).alias("banned"))
    boosts = boosts or {"title": config.title_boost, "text": 1.0}
    terms, rows = stated(terms.select("query_id", "term", "must", "banned", term_bucket(F.col("term")).alias("bucket")))
    n_terms, buckets = (len(rows), sorted({r.bucket for r in rows})) if rows is not None else terms.agg(F.count("*"), F.collect_set("bucket")).first()  # BUCKETS numbers at most
    terms = terms.drop("bucket")
    small = F.broadcast if n_terms <= BROADCAST_TERMS else lambda df: df
    boost = F.coalesce(*(F.when(F.col("field") == f, F.lit(float(w))) for f, w in boosts.items()))
    n, df = (F.col(c).cast("double") for c in ("n_docs", "df"))
    words = in_buckets(index.vocabulary, buckets).where(F.col("field").isin(*boosts)).select("term", "field", "df")
    known = words.join(small(terms), "term").join(F.broadcast(index.stats), "field")
    known = known.select("query_id", "term", "field", "must", "banned", "avgdl", "df", (boost * F.log(1 + (n - df + 0.5) / (df + 0.5))).alias("weight"))
    known, found = stated(known)
    return Asked(known, small(terms.groupBy("query_id").agg(F.count_if("must").alias("needed"))), buckets, small, None if found is None else sum(r.df for r in found))


def term_part(tf: Column, dl: Column, config: SearchConfig) -> Column:
    """What a posting adds to a score, at most 1, but for the term's weight."""
    tf = tf.cast("double")
    return F.col("weight") * tf / (tf + config.k1 * (1 - config.b + config.b * dl.cast("double") / F.col("avgdl")))


def asked_blocks(index: Index, asked: Asked) -> DataFrame:
    """The blocks of the asked terms, with what is known of these."""
    return in_buckets(index.blocks, asked.buckets).drop("bucket").join(asked.small(asked.known), ["term", "field"])


def scored(met: DataFrame, asked: Asked, config: SearchConfig) -> DataFrame:
    """query_id, doc_id, score of postings with what is known of their terms. Postings are shuffled once, by query and document."""
    each = met.select("query_id", "doc_id", "term", "must", "banned", term_part(F.col("tf"), F.col("dl"), config).alias("s")).repartition("query_id", "doc_id")
    best = each.groupBy("query_id", "doc_id", "term").agg(F.max("s").alias("s"), F.first("must").alias("must"), F.first("banned").alias("banned"))
    told = best.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), DIGITS).alias("score"), F.count_if("must").alias("had"), F.bool_or("banned").alias("bad"))
    return told.where("NOT bad").join(asked.needed, "query_id").where("had = needed").select("query_id", "doc_id", "score")


def keyword_scores(index: Index, terms: DataFrame, config: SearchConfig = SearchConfig(), boosts: dict[str, float] | None = None, asked: Asked | None = None) -> DataFrame:
    """query_id, doc_id, score by BM25 of all that match. A term counts with its best field; a document's terms add up; any term will do, but those that must stand, or must not."""
    asked = asked or known_terms(index, terms, config, boosts)
    if index.blocks is None:
        return scored(index.postings.join(asked.small(asked.known), ["term", "field"]), asked, config)
    return scored(index.live(unpacked(asked_blocks(index, asked))), asked, config)


def block_bounds(index: Index, asked: Asked, config: SearchConfig) -> DataFrame:
    """query_id, block, bound, postings: no document of the block scores higher. The lists of the blocks aren't read."""
    told = asked_blocks(index, asked).where("NOT banned").select("query_id", "block", "term", "n", term_part(F.col("most_tf"), F.col("least_dl"), config).alias("s"))
    best = told.groupBy("query_id", "block", "term").agg(F.max("s").alias("s"), F.sum("n").alias("n"))
    return best.groupBy("query_id", "block").agg(F.sum("s").alias("bound"), F.sum("n").alias("postings"))


def pruned_top(index: Index, terms: DataFrame, k: int, config: SearchConfig = SearchConfig(), boosts: dict[str, float] | None = None, phrases: DataFrame | None = None, asked: Asked | None = None) -> DataFrame:
    """keyword_top() without reading postings that can't matter: the blocks of the highest bounds are scored first; of the others only those whose bound reaches the k-th score that these give."""
    asked = asked or known_terms(index, terms, config, boosts)
    bounds = held(block_bounds(index, asked, config), "bounds")

    def of_blocks(chosen: DataFrame) -> DataFrame:
        met = asked_blocks(index, asked).join(chosen.select("query_id", "block"), ["query_id", "block"])
        scores = scored(index.live(unpacked(met)), asked, config)
        return scores if phrases is None else with_phrases(scores, index, phrases)

    first = top(bounds, max(4, -(-2 * k // BLOCK)), [F.col("bound").desc(), F.col("block")])
    begun = held(top(of_blocks(first), k, best_first()).drop("ord"), "begun")
    reached = begun.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    rest = bounds.join(first, ["query_id", "block"], "left_anti").join(F.broadcast(reached), "query_id", "left")
    # Bounds are sums of floats too, and equal scores may go to smaller ids.
    rest = rest.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 10 ** (2 - DIGITS)))
    return top(begun.unionByName(top(of_blocks(rest), k, best_first()).drop("ord")), k, best_first())


def keyword_top(index: Index, terms: DataFrame, k: int = 100, config: SearchConfig = SearchConfig(), boosts: dict[str, float] | None = None, phrases: DataFrame | None = None) -> DataFrame:
    """query_id, ord, doc_id, score of the best k documents for each query's terms (see keyword_scores()), with its phrases (see asked_phrases())."""
    asked = known_terms(index, terms, config, boosts)
    if index.blocks is not None and (asked.postings is None or asked.postings >= PRUNE_FROM):
        return pruned_top(index, terms, k, config, boosts, phrases, asked)
    scores = keyword_scores(index, terms, config, boosts, asked)
    return top(scores if phrases is None else with_phrases(scores, index, phrases), k, best_first())


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_top(vectors: DataFrame, queries: DataFrame, k: int | None = 100) -> DataFrame:
    """query_id, ord, doc_id, score = (1 + dot product) / 2 of the best k of vectors (doc_id, vector) for each of queries (query_id, vector).

    Queries are a stated set. They go out in blocks of QUERY_BLOCK; each batch of vectors is multiplied with a block as matrices and passes on its
    best k for each query, with ties, so neither pairs nor whole lists are sorted or shuffled. Vectors of other lengths don't compare.
    """
    asked = queries.select("query_id", "vector").where("vector IS NOT NULL")
    if k is None:
        return numbered(vector_scores(vectors, asked), best_first())
    kinds = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c, d in (("query_id", asked), ("doc_id", vectors)))
    rows = vectors.select("doc_id", F.col("vector").cast("array<double>").alias("vector")).where(F.size("vector") > 0)
    asked, told = stated(asked, QUERY_BLOCK)
    n = max(1, -(-asked.count() // QUERY_BLOCK)) if told is None else 1
    found = None
    for b in range(n):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b) if n > 1 else asked
        block = part.select("query_id", F.col("vector").cast("array<double>").alias("vector")).toArrow().combine_chunks()
        best = rows.mapInArrow(best_of_batches(vectors.sparkSession.sparkContext.broadcast(block), k), f"{kinds}, score double")
        found = best if found is None else found.unionByName(best)
    return top(found, k, best_first())


def by_length(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors of each length."""
    flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[offsets[rows][:, None] + np.arange(d)]


class TaskTop:
    """The best k rows (number of the question, score, and columns of which the first is the id) of a task for each of its n questions; equal scores go to smaller ids, so copies don't pile up."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.size = n, k, 0
        self.least = np.full(n, -np.inf)
        self.held: list[pa.Table] = []

    def add(self, scores: np.ndarray, which: np.ndarray, columns: list[pa.Array]) -> None:
        """scores: of the questions `which` (rows) for each row of the columns; what is no number takes no part."""
        scores = np.where(np.isnan(scores), -np.inf, scores)
        floor = self.least[which]
        if scores.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
        i, j = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
        taken = [c.take(pa.array(j)) for c in columns]
        self.held.append(pa.table([pa.array(which[i]), pa.array(scores[i, j].astype(float)), *taken], names=["which", "score", *(f"c{x}" for x in range(len(taken)))]))
        self.size += len(i)
        if self.size > 4 * self.k * self.n:
            self.best()

    def best(self) -> pa.Table | None:
        if not self.held:
            return None
        rows = pa.concat_tables(self.held)
        rows = rows.take(pc.sort_indices(rows, [("which", "ascending"), ("score", "descending"), ("c0", "ascending")], null_placement="at_start"))
        which = rows.column("which").to_numpy()
        starts = np.searchsorted(which, np.arange(self.n))
        rows = rows.take(pa.array(np.flatnonzero(np.arange(len(which)) - starts[which] < self.k)))
        which, scores = rows.column("which").to_numpy(), rows.column("score").to_numpy()
        full = np.flatnonzero(np.bincount(which, minlength=self.n) >= self.k)
        self.least[full] = scores[np.searchsorted(which, full, side="right") - 1]
        self.held, self.size = [rows], len(which)
        return rows


def best_of_batches(queries, k: int):
    """Function for mapInArrow over (doc_id, vector): the task's best k rows for each query (query_id, vector; broadcast)."""

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = queries.value
        if not table.num_rows:
            return
        ids = table.column(0).chunk(0)
        asked = {m.shape[1]: (rows, m, TaskTop(len(rows), k)) for rows, m in by_length(table.column(1).chunk(0))}
        for batch in batches:
            for rows, m in by_length(batch.column(1)):
                if m.shape[1] in asked:
                    _, q, kept = asked[m.shape[1]]
                    kept.add(np.round((1 + q @ m.T) / 2, DIGITS), np.arange(len(q)), [batch.column(0).take(pa.array(rows))])
        for numbers, _, kept in asked.values():
            if (found := kept.best()) is not None:
                found = found.combine_chunks()
                part = lambda name: found.column(name).chunk(0)  # noqa: B023, E731
                if found.num_rows:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(numbers[part("which").to_numpy()])), part("c0"), part("score")], names=["query_id", "doc_id", "score"])

    return search


def vector_scores(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, score of all vectors for each query, in no order: for few queries, when a threshold decides."""
    asked = F.broadcast(queries.agg(F.collect_list(F.struct("query_id", F.col("vector").alias("q"))).alias("asked")))
    rows = vectors.join(asked, F.size("vector") > 0).select("doc_id", "vector", F.explode("asked").alias("x"))
    return rows.where(F.size("vector") == F.size("x.q")).select("x.query_id", "doc_id", F.round((1 + dot(F.col("vector"), F.col("x.q"))) / 2, DIGITS).alias("score"))


def every_document(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id: every document for every query, in no order."""
    ids = F.broadcast(queries.agg(F.collect_list("query_id").alias("ids")))
    return documents.select("doc_id").join(ids, F.lit(True)).select(F.explode("ids").alias("query_id"), "doc_id")


def match_all(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """Every document for every query, with score 1, in order of their ids. Documents are numbered once, by range partitions, so no task holds all of them."""
    rows = numbered(documents.select("doc_id"), [F.col("doc_id")], by=None)
    ids = F.broadcast(queries.agg(F.collect_list("query_id").alias("ids")))
    return rows.join(ids, F.lit(True)).select(F.explode("ids").alias("query_id"), "doc_id", F.lit(1.0).alias("score"), F.col("ord").cast("int").alias("ord"))
