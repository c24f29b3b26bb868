"""Continuous ingest: records as they arrive are validated, deduplicated, put into an index, and counted by windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.trend import SENTIMENTS
from ..schema import RAW
from ..sources import records
from ..sources.shared import shared_dir


def record_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Records from JSON-lines files that land in a folder."""
    return spark.readStream.schema(f"{RAW}, rejected string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "rejected").option("maxFilesPerTrigger", files_per_batch).json(path)


def documents_of(stream: DataFrame) -> DataFrame:
    good, _ = records.split_rejects(stream)
    return records.to_documents(good)


#: Parts of an index, by key. A batch rewrites the parts that its keys fall into. The number is fixed for an index.
BUCKETS = 256


def ingest(stream: DataFrame, index_path: str, checkpoint: str, buckets: int = BUCKETS, **trigger) -> StreamingQuery:
    """Upserts each batch into a Parquet index, version=<batch>/bucket=<part of the keys>. Of the records of one id the latest dated stays, of equal dates the last to come; undated ones count as oldest.

    Only parts that a batch touches are read and written. They count when all are written, and a batch starts from what was before it, so a repeated batch
    or a lost executor changes nothing. Of each part, the newest state and the one that a repetition of the last batch would start from are kept.
    """

    bucket = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(buckets)).cast("int")

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        scratch = f"{shared_dir(spark)}/batch-{uuid.uuid4().hex}"
        records.latest(batch.withColumn("seq", F.monotonically_increasing_id()), "doc_id", F.struct("date", "seq")).drop("seq").withColumn("bucket", bucket).write.parquet(scratch)
        new = spark.read.parquet(scratch)
        touched = {r.bucket for r in new.select("bucket").distinct().collect()}
        if touched:
            merge(new, touched, number)
        _delete(spark, scratch)

    def merge(new: DataFrame, touched: set[int], number: int) -> None:
        spark = new.sparkSession
        old = [path for b, path in parts(spark, index_path, before=number).items() if b in touched]
        rows = new.withColumn("fresh", F.lit(1))
        if old:
            rows = rows.unionByName(spark.read.parquet(*old).withColumns({"bucket": bucket, "fresh": F.lit(0)}), allowMissingColumns=True)
        merged = records.latest(rows, "doc_id", F.struct("date", "fresh")).drop("fresh")
        merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{index_path}/version={number}")
        expire(spark, index_path, number)

    return documents_of(stream).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, folder: str) -> None:
    path, fs = _files(spark, folder)
    fs.delete(path, True)


def _numbered(spark: SparkSession, folder: str, name: str) -> dict[int, str]:
    """Folders <name>=<number> in a folder, by number."""
    path, fs = _files(spark, folder)
    found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    return {int(p.getName().split("=")[1]): p.toString() for p in found if p.getName().startswith(f"{name}=")}


def versions(spark: SparkSession, index_path: str) -> list[int]:
    """Numbers of the complete versions, oldest first."""
    _, fs = _files(spark, index_path)
    complete = lambda folder: fs.exists(_files(spark, f"{folder}/_SUCCESS")[0])
    return sorted(v for v, folder in _numbered(spark, index_path, "version").items() if complete(folder))


def parts(spark: SparkSession, index_path: str, before: int | None = None) -> dict[int, str]:
    """The folder of each bucket in the newest complete version that has it, or the newest before a number."""
    newest: dict[int, str] = {}
    for v in versions(spark, index_path):
        if before is None or v < before:
            newest.update(_numbered(spark, f"{index_path}/version={v}", "bucket"))
    return newest


def expire(spark: SparkSession, index_path: str, number: int) -> None:
    """Deletes parts that neither version `number` nor the state before it is made of, and versions that are left without parts."""
    needed = {*parts(spark, index_path, before=number + 1).values(), *parts(spark, index_path, before=number).values()}
    for v in versions(spark, index_path):
        folder = f"{index_path}/version={v}"
        found = set(_numbered(spark, folder, "bucket").values())
        gone = [folder] if v < number and not found & needed else found - needed if v < number else ()
        for name in gone:
            _delete(spark, name)


def current(spark: SparkSession, index_path: str) -> DataFrame | None:
    """The newest state; none if there is none."""
    found = list(parts(spark, index_path).values())
    return spark.read.option("mergeSchema", True).parquet(*found) if found else None


def windowed_trend(stream: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, a count for each sentiment, count, avg_upvotes by event-time window of a stream of documents; ids seen before within the lateness don't count again."""
    label = F.coalesce("sentiment", F.lit("not_applicable"))
    fresh = stream.where("date IS NOT NULL").withWatermark("date", late).dropDuplicatesWithinWatermark(["doc_id"])
    counts = fresh.groupBy(F.window("date", window)).agg(*(F.count_if(label == s).alias(s) for s in SENTIMENTS), F.count("*").alias("count"), F.avg(F.coalesce("upvotes", F.lit(0))).alias("avg_upvotes"))
    return counts.select(F.col("window.start").alias("start"), *SENTIMENTS, "count", F.round("avg_upvotes", 2).alias("avg_upvotes"))
