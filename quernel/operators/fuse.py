"""Reciprocal rank fusion of a keyword list and a vector list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import ranked


def rrf(rank: Column, k: int = 60) -> Column:
    return 1 / (F.lit(k) + rank)


def fuse(keyword: DataFrame, vector: DataFrame, k: int = 60) -> DataFrame:
    """query_id, ord, doc_id, score, keyword_rank, vector_rank, vector_score of the lists (query_id, ord, doc_id, score).

    A document's score is the sum over its places in both lists. Rows without an id, or with an empty one, are left out, though their places count. An id that a
    list has twice adds up and keeps the last place. Equal scores: keyword list's order first, then the vector list's.
    """
    known = F.col("doc_id").cast("string") != ""
    one = keyword.where(known).select("query_id", "doc_id", rrf(F.col("ord"), k).alias("s"), F.col("ord").alias("kr"), F.lit(None).cast("int").alias("vr"), F.lit(None).cast("double").alias("vs"))
    two = vector.where(known).select("query_id", "doc_id", rrf(F.col("ord"), k).alias("s"), F.lit(None).cast("int").alias("kr"), F.col("ord").alias("vr"), F.col("score").alias("vs"))
    both = one.unionByName(two).groupBy("query_id", "doc_id")
    fused = both.agg(F.round(F.sum("s"), 12).alias("score"), F.max("kr").alias("keyword_rank"), F.max("vr").alias("vector_rank"), F.coalesce(F.max_by("vs", "vr"), F.lit(0.0)).alias("vector_score"))
    return ranked(fused, [F.col("score").desc(), F.col("keyword_rank").asc_nulls_last(), F.col("vector_rank").asc_nulls_last()])


def explanation(k: int = 60) -> Column:
    """How a fused score comes about, from keyword_rank and vector_rank; a list that lacks the document is left out."""
    part = lambda name, c: F.when(F.col(c) > 0, F.format_string(f"{name}(rank=%d): 1/({k}+%d) = %.4f", F.col(c), F.col(c), rrf(F.col(c), k)))
    total = sum((F.coalesce(F.when(F.col(c) > 0, rrf(F.col(c), k)), F.lit(0.0)) for c in ("keyword_rank", "vector_rank")), F.lit(0.0))
    return F.concat_ws("; ", part("Keyword", "keyword_rank"), part("Vector", "vector_rank"), F.format_string("Total: %.4f", total))
