"""Facet counts over result rows, in long form: facet, value, count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counted(rows: DataFrame, facet: str, most: int | None = None) -> DataFrame:
    """Counts of the column value; blank values don't count. With most, only the most frequent, ties by value."""
    out = rows.where(F.trim("value") != "").groupBy(F.trim("value").alias("value")).agg(F.count("*").alias("count"))
    if most is not None:
        out = out.orderBy(F.col("count").desc(), "value").limit(most)
    return out.select(F.lit(facet).alias("facet"), "value", "count")


def tool_facet(rows: DataFrame) -> DataFrame:
    """query_id, value, count, place: occurrences of each tool; places by falling count, ties by where the tool is seen first."""
    seen = rows.select("query_id", "ord", F.posexplode("tools").alias("pos", "tool")).where(F.trim("tool") != "")
    per = seen.groupBy("query_id", F.trim("tool").alias("value")).agg(F.count("*").alias("count"), F.min(F.struct("ord", "pos")).alias("first"))
    return per.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("count").desc(), "first"))).drop("first")


def value_facet(rows: DataFrame, column: str, default: str | None = None, most: int | None = None) -> DataFrame:
    """query_id, value, count, place of a single-valued column; a missing value counts as the default, if there is one; blanks don't count."""
    value = F.coalesce(column, F.lit(default)) if default else F.col(column)
    per = rows.select("query_id", "ord", value.alias("value")).where(F.col("value") != "").groupBy("query_id", "value").agg(F.count("*").alias("count"), F.min("ord").alias("first"))
    out = per.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("count").desc(), "first"))).drop("first")
    return out if most is None else out.where(F.col("place") <= most)


def shares(rows: DataFrame, column: str = "sentiment", default: str = "not_applicable") -> DataFrame:
    """value, count, share of all in percent to one place."""
    per = rows.groupBy(F.coalesce(column, F.lit(default)).alias("value")).agg(F.count("*").alias("count"))
    return per.withColumn("share", F.round(F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy(F.lit(1))), 1))
