"""Ranked lists: rows with query_id, doc_id, score and ord, the position from 1. Order is data, so every re-sort is stable by ord."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import held


def ranked(rows: DataFrame, order: list[Column], name: str = "ord") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def top(rows: DataFrame, k: int | None, order: list[Column], name: str = "ord") -> DataFrame:
    """The first k of each query. Spark keeps k rows of each partition only before it shuffles them."""
    out = ranked(rows, order, name)
    return out if k is None else out.where(F.col(name) <= k)


def numbered(rows: DataFrame, order: list[Column], name: str = "ord", by: str | None = "query_id") -> DataFrame:
    """ranked() of lists of any length: rows are range-partitioned by the order, and numbered from the counts of the partitions before. No task holds a whole list. by: None for one list."""
    lists = [by] if by else []
    order = [*(F.col(c) for c in lists), *order]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    kept = held(placed, "numbered")
    # A row for each list and each partition that it reaches.
    runs = kept.groupBy(*lists, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy(*lists).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*lists, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_skip"))
    return kept.join(runs, [*lists, "_part"]).withColumn(name, (F.col("_place") + F.col("_skip") + 1).cast("long")).drop("_part", "_place", "_skip")


def after(rows: DataFrame, last: DataFrame, size: int) -> DataFrame:
    """The page that follows on a row: the best `size` of each query's rows (query_id, doc_id, score) that come after the row in `last` (query_id, score, doc_id), or the first ones.

    Only a page's rows are sorted, however far down the list it lies.
    """
    seen = F.broadcast(last.select("query_id", F.col("score").alias("_score"), F.col("doc_id").alias("_id")))
    later = F.col("_score").isNull() | (F.col("score") < F.col("_score")) | (F.col("score") == F.col("_score")) & (F.col("doc_id") > F.col("_id"))
    return top(rows.join(seen, "query_id", "left").where(later).drop("_score", "_id"), size, [F.col("score").desc(), F.col("doc_id")])


def resorted(rows: DataFrame, digits: int = 12) -> DataFrame:
    """By falling score; equal scores keep their order."""
    return ranked(rows.withColumn("was", F.col("ord")), [F.round("score", digits).desc(), F.col("was")]).drop("was")


def page(rows: DataFrame, number: int, size: int | None) -> DataFrame:
    """Page `number` (from 1) of each query's list; beyond the end there are no rows."""
    return rows if size is None else rows.where(F.col("ord").between((number - 1) * size + 1, number * size))


def page_counts(rows: DataFrame, size: int | None) -> DataFrame:
    """query_id, total_count, total_pages."""
    n = F.count("*")
    pages = F.lit(1).cast("long") if size is None else F.call_function("div", n + size - 1, F.lit(size).cast("long"))
    return rows.groupBy("query_id").agg(n.alias("total_count"), pages.alias("total_pages"))
