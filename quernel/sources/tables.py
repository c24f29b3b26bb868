"""Search documents over a star schema: texts, labels, events, orders and embeddings that share ids are put together as documents of the search schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import detected_aspects


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sentiment(quality: Column, toxic: Column) -> Column:
    return F.when(quality.isNull(), "not_applicable").when(quality == 0, "negative").when(toxic == 1, "mixed").otherwise("positive")


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title (first sentence), text, source, subreddit, tools, sentiment, subjectivity, aspects, date, upvotes, author, vector (or null)."""
    t = lambda name: table(spark, sf_dir, name)
    labels = t("labels").select("doc_id", "quality", "toxic")
    events = t("events").select(F.col("event_id").alias("doc_id"), "event_type", "value", "user_id")
    orders = t("orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("timestamp").alias("date"))
    vectors = t("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    joined = t("documents").join(labels, "doc_id", "left").join(events, "doc_id", "left").join(orders, "doc_id", "left").join(vectors, "doc_id", "left")
    mood = sentiment(F.col("quality"), F.col("toxic"))
    return joined.select(
        "doc_id",
        F.substring_index("text", ".", 1).alias("title"),
        "text",
        "source",
        F.col("source").alias("subreddit"),
        F.array_compact(F.array("lang", "event_type")).alias("tools"),
        mood.alias("sentiment"),
        F.when(F.col("quality").isNull(), "neutral").otherwise("opinionated").alias("subjectivity"),
        F.transform(detected_aspects(F.col("text")), lambda a: F.concat(a, F.lit(":"), mood)).alias("aspects"),
        "date",
        F.floor("value").cast("int").alias("upvotes"),
        F.col("user_id").alias("author"),
        "vector",
    )
