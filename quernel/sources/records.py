"""Raw JSON-lines records to indexed documents, and the index's writes: batch load, upsert, clearing, compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ISSUE, RAW

NO_TEXT = "[No text content]"
REQUIRED = ("doc_id", "source_platform", "source_url", "content_type", "content", "labels", "platform_context", "author", "timestamps", "engagement.upvotes")


def read_records(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """Records of a JSON-lines file or folder; malformed lines have only `rejected`, the line's text. Blank lines are no records. A missing path is an error."""
    return spark.read.schema(f"{schema}, rejected string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "rejected").json(path)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def combined_text(title: Column, main: Column, reply: Column) -> Column:
    """The parts that aren't empty, joined by spaces; a mark if none is left."""
    joined = trimmed(F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in (title, main, reply))))
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(NO_TEXT))


def normal_aspects(raw: Column) -> Column:
    """Aspects from JSON text: an object gives name:polarity strings, a list stays, all else is empty."""
    pairs = F.transform(F.map_entries(F.from_json(F.when(raw.startswith("{"), raw), "map<string,string>")), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return F.coalesce(pairs, F.from_json(F.when(raw.startswith("["), raw), "array<string>"), F.array().cast("array<string>"))


def split_rejects(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with all required parts, and the others."""
    whole = F.col("rejected").isNull()
    for c in REQUIRED:
        whole &= F.col(c).isNotNull()
    return records.where(whole).drop("rejected"), records.where(~whole)


def to_documents(records: DataFrame) -> DataFrame:
    """Flat documents of valid records."""
    c = F.col
    return records.select(
        "doc_id",
        F.coalesce("content.thread_title", F.lit("")).alias("title"),
        combined_text(c("content.thread_title"), c("content.main_text"), c("content.reply_text")).alias("text"),
        c("source_platform").alias("source"),
        c("source_url").alias("url"),
        "content_type",
        c("labels.agents").alias("tools"),
        c("labels.polarity").alias("sentiment"),
        c("labels.subjectivity").alias("subjectivity"),
        normal_aspects(c("labels.aspects")).alias("aspects"),
        c("labels.sarcasm").alias("sarcasm"),
        c("platform_context.subreddit").alias("subreddit"),
        c("author.username").alias("author"),
        F.try_to_timestamp(c("timestamps.created_at")).alias("date"),
        c("engagement.upvotes").alias("upvotes"),
        F.coalesce("engagement.num_replies", F.lit(0)).alias("num_replies"),
    )


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path, ISSUE)


def issues_to_records(issues: DataFrame) -> DataFrame:
    """Issues in the shape of raw records: repository as subreddit, reactions as upvotes, comments as replies, no labels. Issues without one of these are left out."""
    c = F.col
    labels = F.struct(F.array().cast("array<string>").alias("agents"), *(F.lit(None).cast("string").alias(n) for n in ("polarity", "subjectivity", "aspects", "sarcasm")))
    whole = c("platform_context.repo").isNotNull() & c("engagement.reactions_total").isNotNull() & c("engagement.num_comments").isNotNull()
    return issues.where(whole).select(
        "doc_id",
        "source_platform",
        "source_url",
        F.lit("post").alias("content_type"),
        "content",
        labels.alias("labels"),
        F.struct(c("platform_context.repo").alias("repo"), c("platform_context.repo").alias("subreddit")).alias("platform_context"),
        "author",
        "timestamps",
        c("engagement").withField("upvotes", c("engagement.reactions_total")).withField("num_replies", c("engagement.num_comments")).alias("engagement"),
    )


def latest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """One row for each key: that of the highest order. A max per key combines before the shuffle, so hot keys don't meet in one task."""
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r"))
    return best.select(key, *(F.col(f"r.{c}").alias(c) for c in others))


def upsert(current: DataFrame, incoming: DataFrame, key: str = "doc_id") -> DataFrame:
    """current with the rows of incoming put in place of those with the same key. incoming has one row for each key (see latest)."""
    return current.join(incoming.select(key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def write_index(documents: DataFrame, path: str, files: int | None = None) -> None:
    """Replaces an index: clears it, writes, and compacts to so many files."""
    (documents.repartition(files) if files else documents).write.mode("overwrite").parquet(path)


def clear_index(spark: SparkSession, path: str) -> None:
    """Leaves an index of no rows and the same columns."""
    spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)
