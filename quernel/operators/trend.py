"""Trends: documents by day, week or month, with sentiments as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTIMENTS = ("positive", "negative", "mixed", "not_applicable")
FORMATS = {"day": "yyyy-MM-dd", "week": "yyyy-MM-dd", "month": "yyyy-MM"}


def bucket(at: Column, granularity: str) -> Column:
    """Key of a period: the day, the week's Monday, or the month. Other granularities are months."""
    g = granularity if granularity in FORMATS else "month"
    return F.date_format(F.date_trunc(g, at), FORMATS[g])


def trend(rows: DataFrame, granularity: str, at: str = "date", label: str = "sentiment", votes: str = "upvotes") -> DataFrame:
    """date, a count for each sentiment, count, avg_upvotes (two places). Undated rows are left out; other labels count in count only. One shuffle, of partial sums."""
    dated = rows.where(F.col(at).isNotNull()).groupBy(bucket(F.col(at), granularity).alias("date"))
    label_ = F.coalesce(label, F.lit("not_applicable"))
    return dated.agg(*(F.count_if(label_ == s).alias(s) for s in SENTIMENTS), F.count("*").alias("count"), F.round(F.avg(F.coalesce(votes, F.lit(0))), 2).alias("avg_upvotes"))


def stored_trend(days: DataFrame, granularity: str) -> DataFrame:
    """trend() of an index's days (day, label, count, votes); no document is read."""
    dated = days.where("day IS NOT NULL").groupBy(bucket(F.col("day"), granularity).alias("date"))
    of = lambda s: F.coalesce(F.sum(F.when(F.col("label") == s, F.col("count"))), F.lit(0))
    n = F.sum("count")
    return dated.agg(*(of(s).alias(s) for s in SENTIMENTS), n.alias("count"), F.round(F.sum("votes") / n, 2).alias("avg_upvotes"))
